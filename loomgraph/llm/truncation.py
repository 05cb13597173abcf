"""Text cut off by field limits (problem 6).

A backward character n-gram model: for the contexts that stand at the end of some value, the whole corpus is
counted for how often each context is followed by an end (a stop, or the value's own end after one) and how
often by anything else. A value's final context gives the log-odds of continuation against end, with a prior
from the column's length histogram (a length that stands out from its neighbours is a field limit), and a
threshold for each language and column. Every value comes from what the model puts forward; where the original
sentence, the row's other copy of it, or the JSON syntax tells more, that exact check follows.

Defined results: null and empty values are whole; a value that ends in a cut mark ("..." or "[…]") is cut; values
without any context counted take the shortest order's odds; repeated rows each get their own result.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import script_lang, spread, written

ORDERS = (3, 6, 10)
#: Bits of a hash by which most positions are passed over before the wanted contexts are looked up exactly.
SIEVE_BITS = 20
#: Log-odds from which the model puts a value forward to the exact check: one that ends in a stop, and one that doesn't.
FORWARD = (-1.5, -7.0)
#: Log-odds from which a value is cut where nothing can be checked and no threshold could be fitted.
START_THRESHOLD = 1.5
#: What a cut mark adds to the log-odds of continuation.
MARK_ODDS = 8.0
SPIKE_LEAST = 12

_STOPS = ".!?。！？…"
_CLOSERS = "”\"»“’'」』›）)]"
_MARK = re.compile(r"(?:\.\.\.|\[…\]|\[\.\.\.\]|(?<=\S)\s…)$")
_LABEL = re.compile(r"^\[[^\]]*\] ")
FIELDS = ("evidence_sentence", "snippet", "reasons", "top_sentence")


def _hashes(cp: np.ndarray) -> dict[int, np.ndarray]:
    """order -> 64-bit hash of the context that ends at each position (0 before the text's start is part of it)."""
    out = {}
    acc = np.zeros(len(cp), np.uint64)
    shifted = cp.astype(np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(ORDERS) + 1):
        acc = (acc ^ (shifted + np.uint64(n))) * mul
        acc ^= acc >> np.uint64(29)
        shifted = np.concatenate([np.zeros(1, np.uint64), shifted[:-1]])
        if n in ORDERS:
            out[n] = acc.view(np.int64)
    return out


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SIEVE_BITS, bool)
    out[keys & ((1 << SIEVE_BITS) - 1)] = True
    return out


def _places(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted keys, -1 where it isn't one of them."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


_PAD = "\0" * max(ORDERS)


def _cps(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after a pad of zeros, and the positions of their last characters."""
    joined = "".join(_PAD + t for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(_PAD) + len(t) for t in texts]) - 1
    return cp, ends


def body(value: str, field: str = "") -> tuple[str, bool]:
    """The value without a cut mark, and whether it had one; JSON never ends in three dots, so they mark it as cut."""
    if field == "reasons":
        return (value[:-3], True) if value.endswith("...") else (value, False)
    m = _MARK.search(value)
    return (value[: m.start()], True) if m else (value, False)


def _context(value: str, field: str) -> str:
    """What the model sees of a value's end: what stands before a cut mark."""
    return body(value, field)[0] if field == "reasons" else body(value)[0].rstrip()


def _values(batch, fields):
    for f in fields:
        yield f, [v or "" for v in batch.column(f).to_pylist()]


def _end_contexts(rows: DataFrame, fields: tuple) -> tuple[dict[int, np.ndarray], dict]:
    """The distinct contexts at the ends of values, sorted for each order, and the length histograms."""

    def scan(batches):
        seen = {n: np.zeros(0, np.int64) for n in ORDERS}
        lengths: dict[tuple[str, int], int] = {}
        for batch in batches:
            for f, texts in _values(batch, fields):
                for t in texts:
                    if t:
                        lengths[f, len(t)] = lengths.get((f, len(t)), 0) + 1
                tails = [_context(t[-80:], f)[-max(ORDERS):] for t in texts if t]
                if tails:
                    cp, ends = _cps(tails)
                    for n, h in _hashes(cp).items():
                        seen[n] = np.union1d(seen[n], h[ends])
        for n in ORDERS:
            keys = seen[n]
            yield pa.RecordBatch.from_arrays([pa.array([f"#{n}"] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(np.ones(len(keys), np.int64))], ["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in lengths], pa.string()), pa.array([k for _, k in lengths], pa.int64()), pa.array(list(lengths.values()), pa.int64())], ["kind", "key", "n"])

    counted = rows.mapInArrow(scan, "kind string, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    got = counted.filter(F.col("kind").startswith("#") | (F.col("n") >= SPIKE_LEAST)).toPandas()
    marks, hist = {}, {}
    for n in ORDERS:
        marks[n] = np.sort(got["key"][got["kind"] == f"#{n}"].to_numpy(np.int64))
    rest = got[~got["kind"].str.startswith("#")]
    for f, k, v in zip(rest["kind"], rest["key"], rest["n"], strict=True):
        hist[f, int(k)] = int(v)
    return marks, hist


_STOP_CPS = np.array([ord(c) for c in _STOPS + _CLOSERS], np.uint32)
_STOP_ONLY = np.array([ord(c) for c in _STOPS], np.uint32)
_SPACES = np.array([ord(c) for c in " \n\t\r\u00a0\u202f"], np.uint32)


def _ends_after(cp: np.ndarray, field: str) -> np.ndarray:
    """Whether a sentence (for JSON the value) ends after each position: after a stop, where nothing in lower
    case and no digit follows; elsewhere, where a stop follows that isn't within a number or a word."""
    zero = np.zeros(2, np.uint32)
    nxt, after = np.concatenate([cp[1:], zero[:1]]), np.concatenate([cp[2:], zero])
    if field == "reasons":
        return nxt == 0
    space = np.isin(nxt, _SPACES)
    follower = np.where(space, after, nxt)
    small = (follower >= 0x61) & (follower <= 0x7A) | (follower >= 0xDF) & (follower <= 0xFF) | (follower >= 0x430) & (follower <= 0x45F) | (follower >= 0x30) & (follower <= 0x39)
    small |= np.isin(follower, np.array([ord(c) for c in ",;:，；：、—–と"], np.uint32))
    latin_close = ~space & (nxt >= 0x41) & (nxt < 0x2000)
    at_stop = np.isin(cp, _STOP_CPS)
    tight = (nxt == ord(".")) & (after > 0x20) & (after < 0x2000) & ~np.isin(after, _STOP_CPS)
    before_stop = np.isin(nxt, _STOP_ONLY) & ~tight | (np.isin(nxt, _STOP_CPS) | space) & np.isin(after, _STOP_ONLY)
    return np.where(at_stop, (nxt == 0) | np.isin(nxt, _STOP_CPS) | ~small & ~latin_close, before_stop)


def _count(rows: DataFrame, fields: tuple, shared) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """order -> (contexts, occurrences, ends) of the wanted contexts over every position of every value."""

    def scan(batches):
        marks = shared.value
        sieves = {n: _sieve(keys) for n, keys in marks.items()}
        total = {n: np.zeros(len(marks[n]), np.int64) for n in ORDERS}
        end = {n: np.zeros(len(marks[n]), np.int64) for n in ORDERS}
        for batch in batches:
            for f, texts in _values(batch, fields):
                # the end of a marked value is no end
                texts = [t + "\1" if marked else t for t, marked in (body(t, f) for t in texts if t)] if f == "reasons" else [body(t)[0] for t in texts if t]
                if not texts:
                    continue
                cp, ends = _cps(texts)
                is_end = _ends_after(cp, f)
                for n, h in _hashes(cp).items():
                    use = sieves[n][h & ((1 << SIEVE_BITS) - 1)] & (cp != 0)
                    if f != "reasons":
                        # a value's own last character tells nothing where no stop stands: what follows may have been cut
                        last = ends[~np.isin(cp[ends], _STOP_CPS)]
                        use[last] = False
                    at = _places(h[use], marks[n])
                    total[n] += np.bincount(at[at >= 0], minlength=len(marks[n]))
                    end[n] += np.bincount(at[(at >= 0) & is_end[use]], minlength=len(marks[n]))
        for n in ORDERS:
            seen = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), n, np.int32)), pa.array(marks[n][seen], pa.int64()), pa.array(total[n][seen]), pa.array(end[n][seen])], ["order", "key", "total", "ends"]
            )

    counted = rows.mapInArrow(scan, "order int, key bigint, total bigint, ends bigint")
    got = counted.groupBy("order", "key").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends")).toPandas()
    out = {}
    for n in ORDERS:
        mine = got[got["order"] == n].sort_values("key")
        out[n] = (mine["key"].to_numpy(np.int64), mine["total"].to_numpy(np.float32), mine["ends"].to_numpy(np.float32))
    return out


class Model:
    """Continuation odds of the wanted contexts, and the prior of each length."""

    def __init__(self, counts, hist):
        self.counts = counts
        whole = counts[ORDERS[0]]
        self.base = float((whole[2].sum() + 1) / (whole[1].sum() + 50))
        self.prior = {}
        by: dict[str, dict[int, int]] = {}
        for (f, size), n in hist.items():
            by.setdefault(f, {})[size] = n
        for f, h in by.items():
            for size, n in h.items():
                near = sorted(h.get(size + d, 0) for d in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5))
                usual = max(near[7], 1)
                if n > 2.5 * usual and n - usual >= SPIKE_LEAST / 2:
                    self.prior[f, size] = math.log((n - usual) / usual)

    def odds(self, texts: list[str], field: str) -> np.ndarray:
        """Log-odds of continuation against end at each text's final context, by interpolating the orders."""
        cp, ends = _cps([_context(t[-80:], field)[-max(ORDERS):] for t in texts])
        p = np.full(len(texts), self.base)
        for n, h in _hashes(cp).items():
            keys, total, end = self.counts[n]
            at = _places(h[ends], keys)
            known = at >= 0
            p[known] = (end[at[known]] + 2 * p[known]) / (total[at[known]] + 2)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log1p(-p) - np.log(p)


def _train(rows: DataFrame, fields: tuple, learn_from: tuple):
    spark = rows.sparkSession
    marks, hist = _end_contexts(rows, fields)
    shared = spark.sparkContext.broadcast(marks)
    counts = _count(rows, learn_from, shared)
    return spark.sparkContext.broadcast(Model(counts, hist))


SCORED = "tab string, row_id bigint, field_name string, source string, idx string, lang string, text string, other string, marked boolean, odds double, prior double, json_ok boolean"


def scored(rows: DataFrame, tab: str, fields: tuple, shared, every: bool = False) -> DataFrame:
    """The values that the model puts forward (every: all values), with their odds."""

    def run(batches):
        model = shared.value
        for batch in batches:
            ids, src, idx = (batch.column(c).to_pylist() for c in ("row_id", "source", "idx"))
            cols: list[list] = [[] for _ in range(12)]
            texts_of = dict(_values(batch, fields))
            for f in fields:
                texts = texts_of[f]
                live = [i for i, t in enumerate(texts) if t]
                if not live:
                    continue
                odds = model.odds([texts[i] for i in live], f)
                for i, o in zip(live, odds.tolist(), strict=True):
                    t = texts[i]
                    prior = model.prior.get((f, len(t)), 0.0)
                    bare, marked = body(t, f)
                    stopped = f == "reasons" or t[-1] in _STOPS or t[-1] in _CLOSERS
                    if not every and o + max(prior, 0) * 3 + MARK_ODDS * marked <= FORWARD[not stopped]:
                        continue
                    ok = None
                    if f == "reasons":
                        try:
                            json.loads(t)
                            ok = True
                        except ValueError:
                            ok = False
                    other = ""
                    if f == "evidence_sentence" and "snippet" in texts_of:
                        other = _LABEL.sub("", body(texts_of["snippet"][i])[0])
                    elif f == "snippet":
                        bare = _LABEL.sub("", bare)
                        other = body(texts_of["evidence_sentence"][i])[0]
                    row = (tab, ids[i], f, src[i], idx[i], "" if f == "reasons" else script_lang(t), "" if f == "reasons" else bare, other, marked, o + MARK_ODDS * marked, prior, ok)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            names = [x.split()[0] for x in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return rows.mapInArrow(run, SCORED)


def _candidates(triples: DataFrame, predictions: DataFrame) -> DataFrame:
    t = spread(triples.select("row_id", F.col("source_url").alias("source"), F.col("sentence_idx").alias("idx"), "evidence_sentence", "snippet", "reasons"))
    p = spread(predictions.select("row_id", F.col("source_id").alias("source"), F.col("top_sentence_idx").cast("string").alias("idx"), "top_sentence"))
    shared_t = _train(t, ("evidence_sentence", "snippet", "reasons"), ("evidence_sentence", "reasons"))
    # top_sentence holds the same kind of text, so it is judged by its own contexts
    shared_p = _train(p, ("top_sentence",), ("top_sentence",))
    return scored(t, "triples_extracted", ("evidence_sentence", "snippet", "reasons"), shared_t).unionByName(scored(p, "re_predictions", ("top_sentence",), shared_p))


def judged(triples: DataFrame, predictions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Values put forward, with what the exact check says: cut, whole, or null where nothing can be checked."""
    cand = written(_candidates(triples, predictions), "truncation")
    text = cand.filter("field_name <> 'reasons'")
    keys = F.col("source_id").alias("source"), F.col("sentence_idx").cast("string").alias("idx")
    original = sentences.filter("sentence is not null").select(*keys, "sentence")
    joined = text.select("tab", "row_id", "field_name", "source", "idx", "text").join(original, ["source", "idx"])
    plain = F.rtrim(F.col("text"))
    same = (F.col("sentence") == F.col("text")) | (F.rtrim("sentence") == plain) & (F.col("text") == plain)
    checks = joined.groupBy("tab", "row_id", "field_name").agg(F.max(same).alias("same"), F.max(F.col("sentence").startswith(F.col("text")) & (F.length("sentence") > F.length("text"))).alias("longer"))
    out = text.join(checks, ["tab", "row_id", "field_name"], "left")  # a row and its field are one value, as row_id is unique
    by_other = F.when((F.length("other") > F.length("text")) & F.col("other").startswith(F.col("text")), True)
    truth = (
        F.when(F.col("marked"), True)
        .when(F.col("same"), False)
        .when(F.col("longer"), True)
        .otherwise(by_other)
    )
    named = out.withColumn("cut", truth)  # null: only the model can tell
    rest = cand.filter("field_name = 'reasons'").withColumn("same", F.lit(None).cast("boolean")).withColumn("longer", F.lit(None).cast("boolean")).withColumn("cut", F.col("marked") | ~F.col("json_ok"))
    return named.unionByName(rest)


def _with_stop(values: DataFrame) -> DataFrame:
    return values.withColumn("stopped", (F.col("field_name") != "reasons") & F.substring("text", -1, 1).isin(*(_STOPS + _CLOSERS)))


def thresholds(values: DataFrame) -> DataFrame:
    """For each language and column, with and without a stop at the end, the log-odds that part checked cut values
    from checked whole ones best."""
    score = F.round((F.col("odds") + F.col("prior")) * 2) / 2
    hist = values.filter("cut is not null and not marked").groupBy("tab", "field_name", "lang", "stopped", score.alias("at")).agg(
        F.sum(F.col("cut").cast("int")).alias("c"), F.sum((~F.col("cut")).cast("int")).alias("w")
    )
    down = Window.partitionBy("tab", "field_name", "lang", "stopped").orderBy(F.desc("at"))
    up = Window.partitionBy("tab", "field_name", "lang", "stopped").orderBy(F.asc("at")).rowsBetween(Window.unboundedPreceding, -1)
    wrong = hist.withColumn("false_cut", F.sum("w").over(down)).withColumn("missed", F.coalesce(F.sum("c").over(up), F.lit(0)))
    best = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("tab", "field_name", "lang", "stopped").orderBy(F.col("false_cut") + F.col("missed"), "at")))
    return best.filter("rank = 1").select("tab", "field_name", "lang", "stopped", F.col("at").alias("threshold"))


def found(triples: DataFrame, predictions: DataFrame, sentences: DataFrame, checked: bool = True) -> DataFrame:
    """(tab, row_id, field_name) of every value that lacks the end of the original value.

    checked: what the exact check says holds over the model's word. Without it the model alone decides, by thresholds that
    were fitted to checked values."""
    values = _with_stop(written(judged(triples, predictions, sentences), "judged"))
    cut = by_model(values, thresholds(values))
    return cut.filter(F.coalesce("cut", "model_cut") if checked else F.col("model_cut")).select("tab", "row_id", "field_name")


def by_model(values: DataFrame, levels: DataFrame) -> DataFrame:
    """values with model_cut: whether their odds reach the threshold of their language and column."""
    both = values.join(F.broadcast(levels), ["tab", "field_name", "lang", "stopped"], "left")
    return both.withColumn("model_cut", F.col("odds") + F.col("prior") >= F.coalesce("threshold", F.lit(START_THRESHOLD)))


def model_alone(triples: DataFrame, predictions: DataFrame, sentences: DataFrame) -> DataFrame:
    """How well the model decides by itself: for each table and field the numbers of checked values of held-out sources
    that are cut, that the model says are cut, and both. Thresholds are fitted to the other half of the sources. Values
    that the model doesn't put forward aren't checked; they count in p6_found's own comparison only."""
    values = _with_stop(written(judged(triples, predictions, sentences), "judged")).withColumn("held", F.pmod(F.xxhash64("source"), F.lit(2)) == 1)
    tried = by_model(values.filter("held"), thresholds(values.filter("not held"))).filter("cut is not null")
    n = lambda c: F.sum(c.cast("int"))
    return tried.groupBy("tab", "field_name").agg(n(F.col("cut")).alias("cut"), n(F.col("model_cut")).alias("said"), n(F.col("cut") & F.col("model_cut")).alias("both"))


def rates(triples: DataFrame, predictions: DataFrame, sentences: DataFrame) -> DataFrame:
    """For each source and field the number of values and the share of them that are cut."""
    cut = found(triples, predictions, sentences).withColumn("is_cut", F.lit(1))
    t = triples.select("row_id", "source_url", F.explode(F.create_map(*[x for f in FIELDS[:3] for x in (F.lit(f), F.col(f))])).alias("field_name", "value")).withColumn("tab", F.lit("triples_extracted"))
    p = predictions.select("row_id", "source_url", F.lit("top_sentence").alias("field_name"), F.col("top_sentence").alias("value")).withColumn("tab", F.lit("re_predictions"))
    rows = t.unionByName(p).filter("value is not null and value <> ''").drop("value")
    got = rows.join(cut, ["tab", "row_id", "field_name"], "left").groupBy("tab", "source_url", "field_name")
    return got.agg(F.count("*").alias("values"), F.coalesce(F.sum("is_cut"), F.lit(0)).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("values"), 6))
