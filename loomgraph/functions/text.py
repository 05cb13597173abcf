"""Text functions as Column expressions: they stay in generated code, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Unicode has it, spelt out so that all dialects of expressions read it alike.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that don't belong to a mention at its ends (fixed values).
MENTION_MARKS = "\"'“”‘’()（）[]【】"
LITERAL_MARKS = MENTION_MARKS + "《》"
ZH_STOPS = "。！？；\n"
MIN_SENTENCE = 9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zh_ratio(text) -> Column:
    """Share of Han characters (U+4E00 to U+9FFF) in the code points of the text; 0 for an empty one."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.regexp_count(t, F.lit("[\\x{4e00}-\\x{9fff}]")) / F.greatest(F.length(t), F.lit(1))


def is_zh(text, at_least: float = 0.12) -> Column:
    return zh_ratio(text) >= at_least


def squeeze(text) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), f"{SPACE}+", " "))


def strip(text) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def strip_marks(text, marks: str = MENTION_MARKS) -> Column:
    inside = "".join("\\" + c if c in "[]" else c for c in marks)
    return F.regexp_replace(_col(text), f"^[{inside}]+|[{inside}]+$", "")


def mention(text) -> Column:
    """A mention in its normal form: single spaces, without quotes and brackets around it."""
    return F.trim(strip_marks(squeeze(text)))


def literal(text) -> Column:
    """A literal in its normal form: lower case, single spaces, without brackets around it."""
    return F.trim(strip_marks(squeeze(F.lower(_col(text))), LITERAL_MARKS))


def zh_slot(text) -> Column:
    """A slot phrase without commas around it and without what follows an 'and others', at most 80 characters."""
    bare = F.regexp_replace(strip(text), "^[，,、]+|[，,、]+$", "")
    return F.substring(F.trim(F.regexp_replace(bare, "(?s)[等及其].*$", "")), 1, 80)


def tokens(text) -> Column:
    """Distinct lower-case words of more than one character."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def set_jaccard(a, b) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 where one is empty. Where they are expensive, give columns."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def token_jaccard(a, b) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def char_ngrams(text, n: int = 3) -> Column:
    """Distinct n-grams of the lower-case text with single spaces; the whole text where it is no longer than n."""
    t = squeeze(F.lower(_col(text)))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(F.array_distinct(grams))


def ngram_jaccard(a, b, n: int = 3) -> Column:
    return set_jaccard(char_ngrams(a, n), char_ngrams(b, n))


def hits(text, patterns: Column) -> Column:
    """The patterns that the text contains, in their order; case matters."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.filter(patterns, lambda p: (p != "") & F.contains(t, p))


def first_trigger(text, triggers: list[str]) -> Column:
    """struct(trigger, begin, end) of the first trigger in list order that stands in the text, whatever its case, or null."""
    low = F.lower(_col(text))
    out = F.lit(None).cast("struct<trigger:string,begin:int,end:int>")
    for t in reversed([t for t in triggers if t.strip()]):
        at = F.instr(low, t.lower())
        out = F.when(at > 0, F.struct(F.lit(t).alias("trigger"), (at - 1).alias("begin"), (at - 1 + len(t)).alias("end"))).otherwise(out)
    return out


def stable_id(prefix: str, *parts) -> Column:
    """prefix and the first twelve hexadecimal digits of the SHA-1 of the parts, stripped and joined by bars."""
    joined = F.concat_ws("|", *[F.coalesce(strip(_col(p).cast("string")), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, 12))


def rel_type(prop) -> Column:
    """Relationship type of a property identifier."""
    return F.concat(F.lit("WIKI_"), F.replace(F.upper(_col(prop)), F.lit(":"), F.lit("_")))


def rel_type_text(predicate) -> Column:
    """Relationship type of a predicate in words."""
    words = F.regexp_replace(_col(predicate), r"[^\p{L}\p{N}_]+", "_")
    bare = F.substring(F.upper(F.regexp_replace(words, "^_+|_+$", "")), 1, 36)
    return F.concat(F.lit("EXT_"), F.when(bare == "", "REL").otherwise(bare))


def pick_label(labels, fallback) -> Column:
    """A label of a map by language: Chinese forms, then English, then any that isn't empty, then the identifier."""
    by = [F.nullif(F.element_at(_col(labels), lang), F.lit("")) for lang in ("zh-hans", "zh-cn", "zh", "en")]
    rest = F.get(F.filter(F.map_values(_col(labels)), lambda v: v != ""), F.lit(0))
    return F.coalesce(*by, rest, _col(fallback))


def data_value(kind, value) -> Column:
    """A data value as text: kind is its type, value a struct of the fields in use."""
    v = _col(value)
    return (
        F.when(_col(kind) == "time", v["time"])
        .when(_col(kind) == "monolingualtext", v["text"])
        .when(_col(kind) == "quantity", v["amount"])
        .when(_col(kind) == "globecoordinate", F.concat_ws(",", v["latitude"].cast("string"), v["longitude"].cast("string")))
        .otherwise(v["string"])
    )


def uri_tail(uri) -> Column:
    """The entity or property identifier at the end of an address, or an empty text."""
    return F.regexp_extract(_col(uri), r"(Q[0-9]+|P[0-9]+)\s*$", 1)


def slug(text) -> Column:
    bare = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9]+", "_")
    short = F.substring(F.regexp_replace(bare, "^_+|_+$", ""), 1, 80)
    return F.when(short == "", "source").otherwise(short)


def chars(text) -> Column:
    """The characters of the text without its whitespace."""
    return F.filter(F.split(F.regexp_replace(_col(text), f"{SPACE}+", ""), ""), lambda c: c != "")


def char_shape(c) -> Column:
    """D for a digit, A for a Latin letter, H for a Han character, S for a space, P for anything else."""
    ch = _col(c)
    return F.when(ch.rlike("^[0-9]$"), "D").when(ch.rlike("^[A-Za-z]$"), "A").when(ch.rlike("^[\\x{4e00}-\\x{9fff}]$"), "H").when(ch.rlike(f"^{SPACE}$"), "S").otherwise("P")


def slots_in_order(text, alias) -> Column:
    """Whether the parts of an alias, between its slots (…), stand in the text one behind the other."""
    quoted = F.transform(F.filter(F.split(_col(alias), "…"), lambda p: p != ""), lambda p: F.regexp_replace(p, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    return F.regexp_like(F.coalesce(_col(text), F.lit("")), F.concat(F.lit("(?s)"), F.array_join(quoted, ".*")))


def first_year(text) -> Column:
    """The first number from 1900 to 2099 that stands by itself, "" if there is none."""
    return F.regexp_extract(_col(text), r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])", 1)


def first_place(text, patterns: Column) -> Column:
    """0-based place of the earliest pattern in the text, null if none stands there."""
    t = _col(text)
    return F.array_min(F.filter(F.transform(patterns, lambda p: F.position(p, t) - 1), lambda i: i >= 0))


def places(text, needle) -> Column:
    """All 0-based places of the needle, overlapping ones too, both without whitespace."""
    h, n = F.regexp_replace(_col(text), f"{SPACE}+", ""), F.regexp_replace(_col(needle), f"{SPACE}+", "")
    last = F.length(h) - F.length(n)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(h, i + 1, F.length(n)) == n)
    return F.when((F.length(n) == 0) | (last < 0), F.array().cast("array<int>")).otherwise(at)


def overlaps(a_begin, a_end, b_begin, b_end) -> Column:
    return ~((_col(a_end) <= _col(b_begin)) | (_col(b_end) <= _col(a_begin)))


def encode_chars(text, vocabulary: Column, size: int) -> Column:
    """Character identifiers of fixed length: 1 for unknown ones, 0 behind the end."""
    ids = F.transform(F.filter(F.split(_col(text), ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(vocabulary, c), F.lit(1)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), size)), 1, size)


def score_text(x) -> Column:
    """Four decimals, and nothing for a score of 0."""
    return F.when(_col(x) == 0, "").otherwise(F.format_string("%.4f", _col(x)))


def sentences(text) -> Column:
    """The text's sentences: after Chinese stops, or after Western ones before whitespace; those of more than eight
    characters. Chinese is a text with a Han share of 0.12 or more."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "\\r", "\n")
    zh = F.split(t, f"(?<=[{ZH_STOPS}])")
    west = F.split(t, f"(?<=[.!?\\n]){SPACE}+")
    parts = F.transform(F.when(is_zh(t), zh).otherwise(west), strip)
    return F.filter(parts, lambda s: F.length(s) >= MIN_SENTENCE)


def strip_html(html) -> Column:
    """Visible text of a page: scripts and styles go, blocks become lines, tags go, common entities are decoded."""
    t = F.regexp_replace(_col(html), r"(?is)<(script|style|noscript)[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\f\x0b ]+", " ")
    return strip(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))
