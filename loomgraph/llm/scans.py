"""Noise in text from scanned pages (problem 3).

Running headers are found by masking digits, case and spaces of the lines of a volume; page numbers by their form,
their range and their order; words are grouped by a confusable-glyph skeleton, and of each group the frequent form
that its context supports is taken, for scripts without spaces through the characters around; words in two pieces
are joined where the joined form is known. SQL windows put the cleaned rows of a volume together again.

Defined results: null and empty sentences have no damage and add nothing to the text; a volume without a row in
pdf_sources takes its page range from its source_id, or has none; swapped pages are put in order, a missing last
page leaves the range open; repeated rows each get their own result, and add once to the text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SCAN_PREFIX, spread, written

#: Glyphs as they are misread, each drawn out into the strokes that it shares with its look-alikes.
STROKES = (("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("u", "ii"))
#: Single glyphs of one look, the second standing for both.
SAME_LOOK = ("ej10596", "cilosgb")
#: A form is a misreading where the form of its group that is frequent outside scans has so many times its count there.
DOMINANCE = 40
LEAST_SEEN = 3
#: A pair of wide characters is a misreading where so many different contexts show it.
PAIR_CONTEXTS = 3
#: A context in which the right character was seen so often counts as strong.
STRONG = 100
#: One in so many of a character's uses in scans must be odd in this way, or its odd uses come from broken lines.
ODD_SHARE = 10
BLOCK = 64
TEXT_BLOCK = 512
#: Characters from which a paragraph may end.
PARAGRAPH = 1200
#: Where a word has a number beside it in this share of its uses, a bare number there belongs to the sentence.
NUMBER_DUE = 0.15
#: Headers are broadcast up to this number, and joined by volume beyond it.
BROADCAST_ROWS = 200_000

_WORD = re.compile(r"[^\W_]+")
_HYPHENED = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_BEFORE_NUMBER = re.compile(r"([^\W\d_]+)\.?\s+\d{1,3}(?![\d.,]\d|\d)")
_AFTER_NUMBER = re.compile(r"(?<![\d.,])\d{1,3}\s+([^\W\d_]+)")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_WIDE_RUN = re.compile(r"[#぀-ヿ㐀-鿿，、。“”：；！？·（）]+")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*%?")
_LINE = re.compile(r"\r?\n")
_BREAK = re.compile(r"([^\W\d_]+)(?:[-‐¬]\s*\r?\n\s*|­\s*|¬\s*|[-‐]\s+)([^\W\d_]+)")
_FRAMED = re.compile(r"(?<!\S)(?:\[\s?(\d{1,4})\s?\]|([-—–·•])\s?(\d{1,4})\s?\2|第\s?(\d{1,4})\s?[页頁])(?!\S)")
_ABBREVIATED = re.compile(r"(?<!\S)(?:p|S|s|с|pág|pag|стр)\.[ \t]?(\d{1,4})(?!\S)")
_CITED = re.compile(r"(?:[,;(]|\b[^\W\d_]{1,4}\.)\s*$")
_BARE = re.compile(r"(?<!\S)(\d{1,4})(?!\S)")
_CHAPTER = re.compile(r"^(?:(?:chapter|kapitel|chapitre|cap[íi]tulo|глава)\s*(?:\d+|[ivxlc]+)\b|第[一二三四五六七八九十百〇零\d]+[章回节卷])", re.IGNORECASE)
_STOP_END = re.compile(r"[.!?。！？…;；,，:：、”»“」）)]$")


def page_range(source_id: str) -> tuple[int | None, int | None]:
    m = re.search(r"#pages=(\d*)-(\d*)", source_id or "")
    if not m:
        return None, None
    a, b = (int(x) if x else None for x in m.groups())
    return (b, a) if a is not None and b is not None and b < a else (a, b)


@lru_cache(1 << 16)
def mask(line: str) -> str:
    """A line without case, spaces, digits and page-number marks: what the repeats of a running header share."""
    bare = _FRAMED.sub(" ", line)
    bare = re.sub(r"(?:^|\s)(?:p|S|с|pág)\.\s?\d+(?=\s|$)", " ", bare)
    return re.sub(r"[\W_\d]+", "", bare).lower()


def count_row(text: str, scanned: bool, out: dict) -> None:
    """Counts of a row, apart for scanned and other rows: words, hyphened words, words before numbers, wide trigrams."""
    k = 1 if scanned else 0
    low = text.lower()
    if not _WIDE.search(text):
        out["w", k].update(_WORD.findall(low))
        if "-" in low:
            out["y", k].update(_HYPHENED.findall(low))
        out["n", k].update(_BEFORE_NUMBER.findall(low))
        out["m", k].update(_AFTER_NUMBER.findall(low))
        return
    out["w", k].update(w for w in _WORD.findall(low) if w.isascii() or not _WIDE.match(w))
    for run in _WIDE_RUN.findall(_DIGITS.sub("#", text)):
        run = f"^{run}$"
        out["t", k].update([run[i:i + 3] for i in range(len(run) - 2)])


def statistics(sentences: DataFrame) -> DataFrame:
    """(kind, key, clean, scan): counts over all rows, summed in each partition before the shuffle."""

    def run(batches):
        out = {(kind, k): Counter() for kind in "wynmt" for k in (0, 1)}
        for batch in batches:
            for text, scanned in zip(batch.column("sentence").to_pylist(), batch.column("scanned").to_pylist(), strict=True):
                if text:
                    count_row(text, scanned, out)
            if sum(map(len, out.values())) > 600_000:
                yield from _count_batches(out)
                out = {key: Counter() for key in out}
        yield from _count_batches(out)

    rows = sentences.select("sentence", F.coalesce("source_id", F.lit("")).startswith(SCAN_PREFIX).alias("scanned"))
    counted = rows.mapInArrow(run, "kind string, key string, clean bigint, scan bigint")
    return counted.groupBy("kind", "key").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))


def _count_batches(out: dict):
    for (kind, k), counts in out.items():
        if counts:
            n = pa.array(list(counts.values()), pa.int64())
            zero = pa.array([0] * len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(counts)), pa.array(list(counts)), zero if k else n, n if k else zero], ["kind", "key", "clean", "scan"])


def skeleton(word):
    """The strokes of a word, in which all its possible misreadings agree."""
    for glyph, strokes in STROKES:
        word = F.replace(word, F.lit(glyph), F.lit(strokes))
    return F.translate(word, *SAME_LOOK)


def wrong_words(stats: DataFrame) -> DataFrame:
    """(word, right): forms that scans have and other text doesn't, with the frequent form of their group."""
    words = stats.filter("kind = 'w'").withColumn("skeleton", skeleton(F.col("key")))
    best = words.groupBy("skeleton").agg(F.max_by("key", "clean").alias("right"), F.max("clean").alias("n"))
    seen = words.filter("scan > 0").filter(F.length("key") >= 2).filter(F.col("key").rlike(r"\p{L}"))
    hit = seen.join(best.filter(F.col("n") >= LEAST_SEEN), "skeleton")
    return hit.filter((F.col("key") != F.col("right")) & (F.col("clean") * DOMINANCE <= F.col("n")) & F.col("right").rlike(r"^[\p{L}]+$")).select(F.col("key").alias("word"), "right", "skeleton")


def wrong_pairs(stats: DataFrame) -> tuple[DataFrame, list[tuple[str, str, bool]]]:
    """Trigrams that only scans have, with the character that other text has between the same neighbours; and the
    pairs of characters that enough different neighbours show, at most as many as there are pairs in use, each with
    whether other text never has the first; of a character's partners the one with the most comes first."""
    t = stats.filter("kind = 't'").withColumn("ctx", F.concat(F.substring("key", 1, 1), F.substring("key", 3, 1))).withColumn("c", F.substring("key", 2, 1))
    han = t.filter(F.col("c").rlike("[㐀-鿿]"))
    best = han.groupBy("ctx").agg(F.max_by("c", "clean").alias("right"), F.max("clean").alias("n"))
    odd = han.filter((F.col("scan") > 0) & (F.col("clean") == 0))
    hit = odd.join(best.filter(F.col("n") >= LEAST_SEEN), "ctx").filter((F.col("c") != F.col("right")) & (F.col("n") >= DOMINANCE / 4 * F.col("scan")))
    votes = hit.groupBy("c", "right").agg(F.count("*").alias("contexts"), F.sum((F.col("n") >= STRONG).cast("int")).alias("strong"), F.sum("scan").alias("odd_scan"))
    chars = t.groupBy("c").agg(F.sum("clean").alias("c_clean"), F.sum("scan").alias("c_scan"))
    pairs = votes.join(chars, "c").filter((F.col("contexts") >= PAIR_CONTEXTS) | (F.col("c_clean") * DOMINANCE <= F.col("c_scan")) & (F.col("c_scan") >= LEAST_SEEN))
    # of a character's partners only one that has the most votes is its look-alike, unless it doesn't stand elsewhere at all
    top = pairs.withColumn("most", F.max("contexts").over(Window.partitionBy("c")))
    kept = top.filter((F.col("contexts") * 2 >= F.col("most")) & ((F.col("c_clean") * 2 <= F.col("c_scan")) | (F.col("strong") >= PAIR_CONTEXTS)) & (F.col("odd_scan") * ODD_SHARE >= F.col("c_scan")))
    rows = sorted(kept.select("c", "right", "c_clean", "contexts").collect(), key=lambda r: (r["c"], -r["contexts"], r["right"]))
    return hit, [(r["c"], r["right"], r["c_clean"] == 0) for r in rows]


def volumes(pdf_sources: DataFrame) -> DataFrame:
    """path, first page, last page (null where open), title ("" where the label is none)."""
    a, b = F.col("page_start"), F.col("page_end")
    title = F.when(F.lower("label").rlike(r"^\s*scan\s*\d*\s*$") | F.col("label").isNull(), "").otherwise(F.col("label"))
    rows = pdf_sources.filter("pdf_relative_path is not null").select(F.trim("pdf_relative_path").alias("path"), F.least(a, b).alias("first"), F.when(b.isNotNull(), F.greatest(a, b)).alias("last"), title.alias("title"))
    return rows.groupBy("path").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("title").alias("title"))


def headers(scanned: DataFrame, stats_lines: DataFrame | None = None) -> DataFrame:
    """(source_id, header): one spelling of each running header of a volume."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for src, text, title in zip(*(batch.column(c).to_pylist() for c in ("source_id", "sentence", "title")), strict=True):
                title_key = mask(title or "")
                for line in _LINE.split(text):
                    key = mask(line)
                    if len(key) < (5 if _WIDE.search(key) else 10):
                        continue
                    stripped = _FRAMED.sub(" ", line).strip()
                    chapter = bool(_CHAPTER.match(re.sub(r"(?<=[㐀-鿿]) +", "", stripped)))
                    if not chapter and key != title_key and (_STOP_END.search(stripped) or len(key) > 80 or "\n" not in text):
                        continue
                    if stripped[-1:] in "-‐¬\xad" or chapter and (len(key) > 60 or len(stripped.split()) > 8 and not _WIDE.search(key) or _STOP_END.search(stripped)):
                        continue
                    bare = re.sub(r"^\d{1,4}\s+|\s+\d{1,4}$", "", stripped) if not chapter else stripped
                    for c, v in zip(cols, (src, key, bare, chapter or key == title_key, stripped != line.strip() or bool(re.match(r"^\d+\s", stripped))), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["source_id", "key", "line", "sure", "numbered"])

    lines = scanned.select("source_id", "sentence", "title").mapInArrow(run, "source_id string, key string, line string, sure boolean, numbered boolean")
    by_volume = lines.groupBy("source_id", "key").agg(
        F.count("*").alias("n"), F.countDistinct("line").alias("variants"), F.max("sure").alias("sure"), F.max("numbered").alias("numbered"), F.min_by("line", F.struct(F.length("line"), "line")).alias("header")
    )
    spread_ = by_volume.groupBy("key").agg(F.count("*").alias("volumes"))
    tried = by_volume.join(spread_, "key")
    plain = (F.col("n") >= 3) | ((F.col("n") >= 2) & ((F.col("variants") >= 2) | F.col("numbered")))
    wide_enough = F.col("header").rlike(r"[㐀-鿿]{6}|\S+\s+\S+\s+\S+")
    return tried.filter(F.col("sure") | (plain & (F.col("volumes") == 1) & wide_enough)).select("source_id", "header")


@lru_cache(4096)
def _header_regex(found: tuple[str, ...]):
    parts = []
    for h in sorted(found, key=len, reverse=True):
        chars = [c for c in h if not c.isspace()]
        parts.append(r"\s*".join(re.escape(c) for c in chars))
    return re.compile("|".join(parts), re.IGNORECASE) if parts else None


def take_apart(text: str, found: tuple[str, ...], first: int | None, last: int | None):
    """(text without headers and framed page numbers, had a header, framed page numbers, bare numbers with the
    words before and after and their span)."""
    had = False
    rx = _header_regex(found)
    if rx:
        text, n = rx.subn("\n", text)
        had = n > 0
    low, high = first if first is not None else 0, last if last is not None else 9999

    pages: list[int] = []

    def drop(m):
        number = int(next(g for g in m.groups() if g and g.isdigit()))
        if low <= number <= high:
            pages.append(number)
            return "\n"
        return m[0]

    text = _FRAMED.sub(drop, text)
    text = _ABBREVIATED.sub(lambda m: m[0] if _CITED.search(m.string[max(0, m.start() - 12):m.start()].rstrip(" ") if "\n" not in m.string[m.start() - 1:m.start()] else "") else drop(m), text)
    bare = []
    for m in _BARE.finditer(text):
        number = int(m[1])
        if low <= number <= high:
            left, right = text[:m.start()].rstrip(), text[m.end():].lstrip()
            before = re.search(r"([^\W\d_]+)(\.?)$", left[-40:])
            after = re.match(r"[^\W\d_]+", right[:40])
            wide = _WIDE.search(text)
            own_line = "\n" in text[len(left):m.start()] or not left
            if before and before[2] and len(before[1]) <= 4 and not own_line and before[1].isascii() and not wide:
                continue  # an abbreviation that a number follows
            if wide:
                if left.endswith(".") and not own_line:
                    continue
                bare.append((number, "", "", m.span()))
            else:
                bare.append((number, before[1].lower() if before and not before[2] else "", after[0].lower() if after else "", m.span()))
    return text, had, pages, bare


def _broken(m) -> tuple[str, str] | None:
    """(the word joined, the word with its hyphen) of a break that may be within a word."""
    return ((m[1] + m[2]).lower(), f"{m[1]}-{m[2]}".lower()) if m[2][0].islower() or "\xad" in m[0] or "¬" in m[0] else None


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in sorted(spans, reverse=True):
        text = f"{text[:a]}\n{text[b:]}"
    return text


def wide_places(text: str, suspects: set) -> list[tuple[str, str, int]]:
    """(trigram, two characters on both sides, place in text) of each suspect wide character."""
    at = [i for i, c in enumerate(text) if not c.isspace()]
    flat, places, done = [], [], 0
    bare = "".join(text[i] for i in at)
    for m in _DIGITS.finditer(bare):
        flat += [*bare[done:m.start()], "#"]
        places += [*at[done:m.start()], -1]
        done = m.end()
    flat, places = "".join([*flat, bare[done:]]), places + at[done:]
    out = []
    for m in _WIDE_RUN.finditer(flat):
        run = f"^^{m[0]}$$"
        out += [(run[i - 1:i + 2], run[i - 2:i] + run[i + 1:i + 3], places[m.start() + i - 2]) for i, c in enumerate(run) if c in suspects]
    return out


PIECES = "row_id bigint, source_id string, idx int, kind string, key string, other string, number int"


def pieces(rows: DataFrame, pairs: list[tuple[str, str, bool]], for_text: bool = False) -> DataFrame:
    """What each scanned row has that may be damage: with all its words, or (for_text) with all places to repair. rows:
    row_id, source_id, sentence_idx, sentence, first, last, headers."""
    shared = rows.sparkSession.sparkContext.broadcast(({c for c, _, _ in pairs}, {c for c, _, never in pairs if never}))

    def run(batches):
        suspects, never = shared.value
        for batch in batches:
            out: list[tuple] = []
            for rid, src, idx, text, first, last, heads in zip(*(batch.column(c).to_pylist() for c in ("row_id", "source_id", "sentence_idx", "sentence", "first", "last", "headers")), strict=True):
                a, b = page_range(src)
                clean, had, pages, bare = take_apart(text, tuple(heads or ()), a if first is None else first, last if last is not None or first is not None else b)
                if had:
                    out.append((rid, src, idx, "header", "", "", None))
                out.extend((rid, src, idx, "page", "", "", n) for n in pages)
                out.extend((rid, src, idx, "bare", before, after, n) for n, before, after, _ in bare)
                for m in _BREAK.finditer(clean):
                    if both := _broken(m):
                        sure = "1" if "\xad" in m[0] or "¬" in m[0] else ""
                        out.append((rid, src, idx, "break", both[0], both[1] + "|" + sure, None))
                if bare and for_text:
                    # words that come together where the numbers between turn out to be page numbers
                    over = {both for m in _BREAK.finditer(_without(clean, [x[3] for x in bare])) if (both := _broken(m))}
                    out.extend((rid, src, idx, "over", key, hyphened + "|", None) for key, hyphened in over)
                joined = _BREAK.sub(r"\1\2", clean)
                if not for_text:
                    out.extend((rid, src, idx, "word", w, "", None) for w in {w for w in _WORD.findall(joined.lower()) if len(w) > 1 and not w.isdigit() and not _WIDE.search(w)})
                if never.intersection(joined):
                    out.append((rid, src, idx, "never", "", "", None))
                if suspects.intersection(joined) and (for_text or not never.intersection(joined)):
                    out.extend((rid, src, idx, "wide", key, other, None) for key, other, _ in wide_places(joined, suspects))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(run, PIECES)


def prepared(sentences: DataFrame, pdf_sources: DataFrame) -> DataFrame:
    """Scanned rows with their volume's pages, title and headers."""
    path = F.regexp_extract("source_id", r"^file:([^#]*)", 1)
    rows = sentences.filter(F.col("source_id").startswith(SCAN_PREFIX) & F.col("sentence").isNotNull()).select("row_id", "source_id", "sentence_idx", "sentence", path.alias("path"))
    rows = spread(rows).join(volumes(pdf_sources), "path", "left").drop("path")
    found_ = headers(rows).groupBy("source_id").agg(F.collect_set("header").alias("headers"))
    found_ = written(found_, "headers")
    hint = F.broadcast if found_.count() <= BROADCAST_ROWS else (lambda d: d)
    return rows.join(hint(found_), "source_id", "left")


def bare_pages(every: DataFrame, stats: DataFrame) -> DataFrame:
    """(row_id, number, key, other): bare numbers between their two words that are page numbers."""
    # a bare number is a page number where the framed ones around it leave room for it and no number is due there
    blocks = every.filter("kind = 'page'").select("source_id", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", "number")
    near = blocks.select("source_id", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), "idx", "number")
    bare = every.filter("kind = 'bare'").withColumn("block", F.floor(F.col("idx") / BLOCK))
    before = _due(stats, "n").select(F.col("skeleton").alias("s_before"), F.col("due").alias("due_b"))
    after = _due(stats, "m").select(F.col("skeleton").alias("s_after"), F.col("due").alias("due_a"))
    bare = bare.withColumn("s_before", skeleton(F.col("key"))).withColumn("s_after", skeleton(F.col("other")))
    # wide text has no words beside its numbers, so those rows meet nothing
    worded, alone = bare.filter("s_before <> '' or s_after <> ''"), bare.filter("s_before = '' and s_after = ''")
    due = worded.join(before, "s_before", "left").join(after, "s_after", "left").filter("due_b is null and due_a is null")
    bare = due.select(alone.columns).unionByName(alone)
    room = (
        bare.select("row_id", "source_id", "block", "idx", "number", "key", "other")
        .join(near.select("source_id", "block", F.col("idx").alias("p_idx"), F.col("number").alias("p")), ["source_id", "block"], "left")
        .groupBy("row_id", "number", "key", "other")
        .agg(F.max(F.when(F.col("p_idx") <= F.col("idx"), F.col("p"))).alias("low"), F.min(F.when(F.col("p_idx") >= F.col("idx"), F.col("p"))).alias("high"))
    )
    fits = room.filter((F.col("low").isNull() | (F.col("number") >= F.col("low") - 1)) & (F.col("high").isNull() | (F.col("number") <= F.col("high") + 1)))
    return fits.select("row_id", "number", "key", "other")


def joins(every: DataFrame, stats: DataFrame, kinds: tuple = ("break",)) -> DataFrame:
    """(row_id, key, hyphened): breaks within a word that has no hyphen of its own."""
    words = stats.filter("kind = 'w'").withColumn("skeleton", skeleton(F.col("key")))
    known = words.groupBy("skeleton").agg(F.max("clean").alias("known"))
    hyphened = stats.filter("kind = 'y'").select(F.col("key").alias("hyphened"), F.col("clean").alias("as_hyphened"))
    cut = every.filter(F.col("kind").isin(*kinds)).select("row_id", "key", F.substring_index("other", "|", 1).alias("hyphened"), F.col("other").endswith("1").alias("sure"))
    cut = cut.withColumn("skeleton", skeleton(F.col("key"))).join(known, "skeleton", "left").join(hyphened, "hyphened", "left").na.fill(0, ["known", "as_hyphened"])
    return cut.filter(F.col("sure") | (F.col("known") >= F.col("as_hyphened"))).select("row_id", "key", "hyphened")


def wide_corrections(every: DataFrame, stats: DataFrame, odd: DataFrame, pairs: list[tuple]) -> DataFrame:
    """(row_id, key, other, right): misread wide characters within their contexts."""
    wide = every.filter("kind = 'wide'").select("row_id", "key", "other")
    table = _pairs_table(every, pairs)
    keyed = wide.join(odd.select("key", "right"), "key").withColumn("c", F.substring("key", 2, 1)).join(table, ["c", "right"])
    # the context must support the other character on one more side
    side_left = F.concat(F.substring("other", 1, 2), F.col("right"))
    side_right = F.concat(F.col("right"), F.substring("other", 3, 2))
    sides = keyed.select("row_id", "key", "other", "right", F.explode(F.array(side_left, side_right)).alias("side"))
    support = stats.filter("kind = 't' and clean >= 2").select(F.col("key").alias("side"))
    return sides.join(support, "side").select("row_id", "key", "other", "right")


def found(sentences: DataFrame, pdf_sources: DataFrame) -> DataFrame:
    """(row_id, kind) of each kind of damage in the rows of scanned volumes."""
    stats = written(statistics(sentences), "scan-stats")
    rows = prepared(sentences, pdf_sources)
    odd, pairs = wrong_pairs(stats)
    every = written(pieces(rows, pairs), "scan-pieces")

    header = every.filter("kind = 'header'").select("row_id", F.lit("header").alias("kind"))
    page = every.filter("kind = 'page'").select("row_id", F.lit("page_number").alias("kind"))
    bare_page = bare_pages(every, stats).select("row_id", F.lit("page_number").alias("kind"))
    broken = joins(every, stats).select("row_id", F.lit("broken_word").alias("kind"))
    wrong = every.filter("kind = 'word'").select("row_id", F.col("key").alias("word")).join(wrong_words(stats).select("word"), "word").select("row_id", F.lit("wrong_char").alias("kind"))
    never = every.filter("kind = 'never'").select("row_id", F.lit("wrong_char").alias("kind"))
    wrong_wide = wide_corrections(every, stats, odd, pairs).select("row_id", F.lit("wrong_char").alias("kind"))
    out = header.unionByName(page).unionByName(bare_page).unionByName(broken).unionByName(wrong).unionByName(never).unionByName(wrong_wide)
    return out.distinct()


def _due(stats: DataFrame, kind: str) -> DataFrame:
    """Words that a number stands before (kind m) or after (kind n) in a good part of their uses."""
    near = stats.filter((F.col("kind") == kind) & (F.col("clean") >= LEAST_SEEN)).select("key", F.col("clean").alias("n"))
    words = stats.filter("kind = 'w'").select("key", F.col("clean").alias("all"))
    due = near.join(words, "key").filter(F.col("n") > NUMBER_DUE * F.col("all"))
    return due.select(skeleton(F.col("key")).alias("skeleton")).distinct().withColumn("due", F.lit(True))


def _pairs_table(df: DataFrame, pairs: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame([p[:2] for p in pairs] or [("", "")], "c string, right string")


def corrections(sentences: DataFrame, pdf_sources: DataFrame) -> DataFrame:
    """(wrong, right): misread words and characters with what they are read as."""
    stats = written(statistics(sentences), "scan-stats")
    _, pairs = wrong_pairs(stats)
    table = _pairs_table(stats, pairs).filter("c <> ''").select(F.col("c").alias("wrong"), "right")
    return wrong_words(stats).select(F.col("word").alias("wrong"), "right").unionByName(table)


def repair(text: str, bare: list, decided: list[dict], suspects: set, never: dict[str, str]) -> str:
    """A row's text without headers and framed page numbers, with what was decided about its pieces: wide characters in
    their contexts (those that no other text has, in any), bare page numbers, and joins; other breaks keep the hyphen."""
    wide = {(d["key"], d["other"]): d["right"] for d in decided if d["kind"] == "wide"}
    pages = {(d["number"], d["key"], d["other"]) for d in decided if d["kind"] == "bare"}
    whole = {(d["key"], d["other"]) for d in decided if d["kind"] == "break"}
    if suspects.intersection(text):
        at, done = [], 0
        for m in _BREAK.finditer(text):
            at += [*range(done, m.end(1)), *range(m.start(2), m.end())]
            done = m.end()
        at += range(done, len(text))
        chars = list(text)
        for key, other, place in wide_places("".join(text[i] for i in at), suspects):
            chars[at[place]] = wide.get((key, other)) or never.get(key[1], key[1])
        text = "".join(chars)
    text = _without(text, [x[3] for x in bare if x[:3] in pages])
    return _BREAK.sub(lambda m: m[0] if (both := _broken(m)) is None else m[1] + m[2] if both in whole else f"{m[1]}-{m[2]}", text)


def volume_text(sentences: DataFrame, pdf_sources: DataFrame) -> DataFrame:
    """(source_id, block, paragraph, text): each volume's continuous text, in paragraphs that end where a sentence ends and
    enough text has come together. Rows of one index with equal repaired texts add once, with different ones each."""
    rows = prepared(sentences, pdf_sources)
    stats = written(statistics(sentences), "scan-stats")
    right = wrong_words(stats).select("word", "right")
    odd, pairs = wrong_pairs(stats)
    every = written(pieces(rows, pairs, for_text=True), "scan-pieces")
    none, no_number = F.lit("").alias("right"), F.lit(None).cast("int").alias("number")
    fixes = (
        bare_pages(every, stats).select("row_id", F.lit("bare").alias("kind"), "key", "other", none, "number")
        .unionByName(joins(every, stats, ("break", "over")).select("row_id", F.lit("break").alias("kind"), "key", F.col("hyphened").alias("other"), none, no_number))
        .unionByName(wide_corrections(every, stats, odd, pairs).select("row_id", F.lit("wide").alias("kind"), "key", "other", "right", no_number))
    )
    fixes = fixes.groupBy("row_id").agg(F.collect_set(F.struct("kind", "key", "other", "right", "number")).alias("decided"))
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        suspects = {c for c, _, _ in shared.value}
        never = {c: r for c, r, only in reversed(shared.value) if only}
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for rid, src, idx, text, first, last, heads, decided in zip(*(batch.column(c).to_pylist() for c in ("row_id", "source_id", "sentence_idx", "sentence", "first", "last", "headers", "decided")), strict=True):
                a, b = page_range(src)
                clean, _, _, bare = take_apart(text, tuple(heads or ()), a if first is None else first, last if last is not None or first is not None else b)
                clean = repair(clean, bare, decided or [], suspects, never)
                clean = re.sub(r"(?<=[㐀-鿿，。；：、])\s+|\s+(?=[㐀-鿿，。；：、])", "", clean)
                clean = re.sub(r"\s+", " ", clean).strip()
                for c, v in zip(cols, (rid, src, idx, clean), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["row_id", "source_id", "idx", "text"])

    rows = rows.join(fixes, "row_id", "left")
    clean = rows.mapInArrow(run, "row_id bigint, source_id string, idx int, text string")
    tokens = clean.select("row_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\d]+)"), F.lit(1)))).alias("token"))
    fixes = tokens.withColumn("word", F.lower("token")).join(right, "word").groupBy("row_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "right"))).alias("fixes"))
    fixed = clean.join(fixes, "row_id", "left")
    parts = F.split("text", r"(?<=[\p{L}\d])(?![\p{L}\d])|(?<![\p{L}\d])(?=[\p{L}\d])")
    repaired = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at("fixes", p), p)), ""))
    once = fixed.withColumn("text", repaired).filter("text <> ''").groupBy("source_id", "idx", "text").agg(F.min("row_id").alias("row_id"))
    return paragraphs(written(once, "scan-texts"))


def paragraphs(once: DataFrame) -> DataFrame:
    """(source_id, block, paragraph, text) of rows (source_id, idx, row_id, text): a paragraph ends behind a row that ends a
    sentence, once PARAGRAPH characters have come together. Lengths and ends are counted within blocks of indexes and carried
    over from block to block, so block edges don't show; block is that of a paragraph's first row."""
    block = F.coalesce(F.floor(F.col("idx") / TEXT_BLOCK), F.lit(-1))
    order = Window.partitionBy("source_id", "block").orderBy("idx", "row_id")
    earlier = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sized = once.withColumns({"block": block, "size": F.length("text"), "ends": F.col("text").rlike(r"[.!?。！？…”»」]$")})
    sums = sized.groupBy("source_id", "block").agg(F.sum("size").alias("all"), F.max_by("ends", F.struct("idx", "row_id")).alias("last_ends"))
    base = sums.select("source_id", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.lag("last_ends").over(Window.partitionBy("source_id").orderBy("block")), F.lit(False)).alias("before_block"))
    so_far = F.col("base") + F.sum("size").over(order)
    placed = sized.join(base, ["source_id", "block"]).withColumn("so_far", so_far).withColumn("before", F.coalesce(F.lag("ends").over(order), F.col("before_block")))
    starts = (F.floor(F.col("so_far") / PARAGRAPH) > F.floor((F.col("so_far") - F.col("size")) / PARAGRAPH)) & F.col("before")
    counted = placed.withColumn("nth", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    begun = counted.groupBy("source_id", "block").agg(F.max("nth").alias("begun"))
    first = begun.select("source_id", "block", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("first"))
    numbered = counted.join(first, ["source_id", "block"]).withColumn("paragraph", F.col("first") + F.col("nth"))
    glue = F.when(F.col("text").rlike("^[㐀-鿿“（]"), F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text")))
    gathered = numbered.groupBy("source_id", "paragraph").agg(F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct("idx", "row_id", glue.alias("t")))).alias("parts"))
    return gathered.select("source_id", F.col("block").cast("int").alias("block"), F.col("paragraph").cast("int").alias("paragraph"), F.trim(F.array_join(F.col("parts.t"), "")).alias("text"))
