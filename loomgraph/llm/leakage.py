"""Evaluation items that leaked into a corpus (problem 7).

Pigeonhole edit matching: an item's own text (without an instruction that several items share) is cut into pieces;
every run of one piece more than the error budget is a window, so that a window within its budget leaves some piece
untouched. All pieces are searched for at once in every whole document; windows with a hit, most of whose halves of
pieces stand about where they are due (the budget leaves that many), are verified by Myers' bit-parallel distance, and
the verified windows' share of the item decides. No step before the verification loses a window within the budget.

Defined results: null and empty texts and items match nothing; repeated documents are each reported; an item
whose text is nothing but a shared instruction matches by that text; ties can't occur, as every pair above the
share is reported.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, written

SHARE = 0.4
#: (least length of a piece in normalised characters, error budget of a window), for Latin-like and for wide scripts.
LATIN = (9, 3)
WIDE = (5, 2)
#: An opening sentence that so many items have is an instruction.
SHARED_BY = 3
#: Items are searched for in blocks of so many, so that what is broadcast has a bound whatever the number of items.
ITEM_BLOCK = 20_000

_DROP = re.compile(r"[\W_]+")
_SENT = re.compile(r"(?<=[.?!:])\s+|(?<=[。？！：])")
#: Accented Latin letters and full-width forms, each with the plain character that its decomposition begins with.
_FOLD = {chr(c): unicodedata.normalize("NFKD", chr(c))[0].lower() for c in (*range(0xC0, 0x250), *range(0xFF10, 0xFF5B)) if unicodedata.normalize("NFKD", chr(c))[0] != chr(c)} | {"ø": "o", "ß": "s"}
_FOLDABLE = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]")


def normal(text: str) -> str:
    """Lower-case letters and digits only, without accents."""
    text = _DROP.sub("", text.lower())
    if text.isascii():
        return text
    return _FOLDABLE.sub(lambda m: _FOLD[m[0]], text)


def own_texts(items: DataFrame) -> DataFrame:
    """(item_id, own): normalised text of each item without its shared opening sentences, which are counted over all items."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                said = [normal(s) for s in _SENT.split(text) if s.strip()]
                rows += [(i, k, s, len(said)) for k, s in enumerate(said)]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["item_id", "pos", "said", "n"])

    once = items.filter(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    said = once.mapInArrow(run, "item_id bigint, pos int, said string, n int")
    shared = said.filter("pos = 0").groupBy("said").agg(F.count("*").alias("by")).filter(F.col("by") >= SHARED_BY).withColumn("shared", F.lit(True)).drop("by")
    marked = said.join(shared, "said", "left")
    start = F.least(F.coalesce(F.min(F.when(F.col("shared").isNull(), F.col("pos"))), F.max("n") - 1), F.max("n") - 1)
    whole = marked.groupBy("item_id").agg(start.alias("start"), F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("all"))
    own = F.array_join(F.transform(F.filter("all", lambda s: s["pos"] >= F.col("start")), lambda s: s["said"]), "")
    return whole.select("item_id", own.alias("own")).filter("own <> ''")


def _wide(text: str) -> bool:
    return sum(c > "⺀" for c in text) * 2 > len(text)


def myers(pattern_masks: dict[str, int], m: int, text: str, limit: int) -> int:
    """Least edit distance of the pattern (of length m) to any substring of text; limit + 1 where none is within it."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = pattern_masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best if best <= limit else limit + 1


class Matcher:
    """All items' pieces and windows, and the automaton over the pieces.

    An item is cut into pieces of equal length; every run of budget + 1 pieces is a window, so that a window within its
    budget of edits has a piece without any, wherever the edits are. Nothing within the budget is missed.
    """

    def __init__(self, own: dict[int, str]):
        import ahocorasick

        self.own = own
        self.cuts: dict[int, list[int]] = {}
        self.budget: dict[int, int] = {}
        self.reach: dict[int, int] = {}
        self.halves: dict[int, list[tuple[str, int, int]]] = {}
        self.pieces: dict[str, dict[int, list[int]]] = {}
        for item, text in own.items():
            size, edits = WIDE if _wide(text) else LATIN
            n = max(1, len(text) // size)
            self.cuts[item] = [len(text) * k // n for k in range(n + 1)]
            self.budget[item] = min(edits, n - 1)
            # a hit tells of the windows that it is in, and of less than a piece beyond them on either side
            self.reach[item] = self.budget[item] + 1
            spans = list(zip(self.cuts[item], self.cuts[item][1:], strict=False))
            for k, (x, y) in enumerate(spans):
                self.pieces.setdefault(text[x:y], {}).setdefault(item, []).append(k)
            parts = [p for x, y in spans for p in ((x, (x + y) // 2), ((x + y) // 2, y))]
            self.halves[item] = [(text[x:y], x, y) for x, y in parts]
        self.automaton = ahocorasick.Automaton()
        for piece, places in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), tuple(places.items())))
        if self.pieces:
            self.automaton.make_automaton()
        self._masks: dict = {}

    def _pattern(self, item: int, a: int, b: int) -> dict[str, int]:
        key = (item, a)
        if key not in self._masks:
            masks: dict[str, int] = {}
            for k, c in enumerate(self.own[item][a:b]):
                masks[c] = masks.get(c, 0) | 1 << k
            self._masks[key] = masks
        return self._masks[key]

    def candidates(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Items with the (piece, place) of all hits, without those whose hits can't make up the share."""
        if not self.pieces:
            return {}
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, ks in places:
                at = hits.setdefault(item, [])
                for k in ks:
                    at.append((k, end + 1 - size))
        out = {}
        for item, found in hits.items():
            cuts, reach = self.cuts[item], self.reach[item]
            most, done = 0, 0
            for k in sorted({k for k, _ in found}):
                x, y = cuts[max(k - reach, 0)], cuts[min(k + reach + 1, len(cuts) - 1)]
                most += max(0, y - max(x, done))
                done = max(done, y)
            if most >= SHARE * len(self.own[item]):
                out[item] = found
        return out

    def covered(self, item: int, text: str, hits: list[tuple[int, int]]) -> float:
        """Share of the item's own text that the document repeats: all verified windows, and what is equal next to them."""
        own, cuts, edits = self.own[item], self.cuts[item], self.budget[item]
        halves, last = self.halves[item], len(cuts) - 1 - (edits + 1)
        mark = bytearray(len(own))
        tried: dict[tuple[int, int], bool] = {}
        for k, place in hits:
            shift = place - cuts[k]
            first, good = max(0, k - edits), False
            # of the window's halves of pieces the budget leaves all but so many as it is, about where they are due
            there = [h in text[max(0, shift + x - edits):max(0, shift + y + edits)] for h, x, y in halves[2 * first:2 * (k + edits + 1)]]
            for w in range(first, min(k, last) + 1):
                key = (w, shift)
                if key not in tried:
                    tried[key] = False
                    if sum(there[2 * (w - first):2 * (w - first + edits + 1)]) >= edits + 2:
                        a, b = cuts[w], cuts[w + edits + 1]
                        part = text[max(0, shift + a - edits):max(0, shift + b + edits)]
                        if own[a:b] in part or myers(self._pattern(item, a, b), b - a, part, edits) <= edits:
                            tried[key] = True
                            mark[a:b] = b"\1" * (b - a)
                good = good or tried[key]
            if good:
                i, j = cuts[k], place
                while i > 0 and j > 0 and own[i - 1] == text[j - 1]:
                    i -= 1
                    j -= 1
                e, f = cuts[k + 1], place + cuts[k + 1] - cuts[k]
                while e < len(own) and f < len(text) and own[e] == text[f]:
                    e += 1
                    f += 1
                mark[i:e] = b"\1" * (e - i)
        return sum(mark) / len(own)

    def find(self, text: str) -> list[tuple[int, float]]:
        out = []
        for item, hits in self.candidates(text).items():
            share = self.covered(item, text, hits)
            if share >= SHARE:
                out.append((item, share))
        return out


def matches(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of every document that repeats at least SHARE of an item's own text. Each block of items is
    searched for in one pass over the documents."""
    own = own_texts(eval_items.select("item_id", "item_text"))
    n = eval_items.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    docs = spread(documents.select("doc_id", "text").filter(F.col("text").isNotNull()))
    own = written(own, "items") if blocks > 1 else own
    out = None
    for k in range(blocks):
        part = {r["item_id"]: r["own"] for r in own.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()}
        found_k = docs.mapInArrow(_search(documents.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex), "doc_id bigint, item_id bigint, share double")
        out = found_k if out is None else out.unionByName(found_k)
    return out


#: The matcher that a Python worker built last, by its block: tasks of one worker share it.
_BUILT: dict[str, Matcher] = {}


def _search(shared, block: str):
    def run(batches):
        if block not in _BUILT:
            _BUILT.clear()
            _BUILT[block] = Matcher(shared.value)
        matcher = _BUILT[block]
        for batch in batches:
            docs, items, shares = [], [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for item, share in matcher.find(normal(t)) if t else ():
                    docs.append(d)
                    items.append(item)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "share"])

    return run


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return matches(documents, eval_items).select("doc_id", "item_id")


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Every item with the number of documents it leaked into, 0 where none."""
    hits = matches(documents, eval_items).groupBy("item_id").agg(F.count("*").alias("docs"), F.round(F.max("share"), 6).alias("most"))
    return eval_items.select("item_id", "lang", "task").join(hits, "item_id", "left").select("item_id", "lang", "task", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most", F.lit(0.0)).alias("most"))
