"""Text that was decoded with the wrong character encoding (problem 9).

Characters are mapped back to the bytes of a legacy encoding; a byte-structure automaton finds the maximal
well-formed multibyte spans among them, and those spans alone are decoded, again where a text was garbled
twice. For encodings of one byte a character the automaton runs on the characters themselves (each stands
for one byte), for the others on the encoded bytes.

Defined results: null and empty texts have no spans; a text that shows garbled characters only as an example,
alone between quotation marks, isn't garbled; stretches with lost bytes (U+FFFD) are found and left as they
are where they can't be decoded.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

ROUNDS = 3


def _byte_chars(codec: str) -> dict[int, str]:
    """Byte -> character for the upper half; undefined bytes stand for themselves as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


class SingleByte:
    """UTF-8 read as an encoding of one byte a character."""

    def __init__(self, codec: str, also_latin1: bool = False):
        self.codec = codec
        self.back: dict[str, int] = {}
        forms: dict[int, str] = {}
        for b, ch in _byte_chars(codec).items():
            self.back[ch] = b
            forms[b] = ch
            if also_latin1:
                self.back.setdefault(chr(b), b)
                if chr(b) != ch:
                    forms[b] += chr(b)

        def cls(a: int, z: int) -> str:
            return "[" + "".join(re.escape(c) for b in range(a, z + 1) for c in forms[b]) + "]"

        cont = cls(0x80, 0xBF)
        self.find = re.compile(f"(?:{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}})+")

    def spans(self, text: str):
        for m in self.find.finditer(text):
            try:
                yield m.start(), m.end(), bytes(self.back[c] for c in m[0]).decode("utf-8")
            except UnicodeDecodeError:
                continue


SINGLE = (SingleByte("cp1252", also_latin1=True), SingleByte("cp1251"), SingleByte("mac_roman"))

_LATIN = re.compile(r"^[ -ſ]+$")
_CYRILLIC_TEXT = re.compile(r"[а-яё]")
_HAN_TEXT = re.compile(r"[㐀-鿿぀-ヿ]{20}|[㐀-鿿]{8}.*[㐀-鿿]{8}", re.DOTALL)
_CYRILLIC_LETTERS = re.compile(r"^[А-яЁё]+$")
_LETTER = re.compile(r"[A-Za-z]")
_WIDE = r"‐-‧‰-›€№™　-ヿ㐀-鿿＀-￮"
_PLAUSIBLE = re.compile(f"^[\\u00a0-\\u017f\\u0218-\\u021b\\u0391-\\u03c9\\u0401\\u0410-\\u044f\\u0451{_WIDE}\ufffd]+$")
_WIDE_ONE = re.compile(f"[{_WIDE}]")
_QUOTES = {"「": "」", "“": "”", "„": "“", "«": "»", "‘": "’", '"': '"', "'": "'", "『": "』", "`": "`", "‹": "›", "(": ")", "（": "）"}
_GBK_PAIRS = re.compile(r"(?:[¡-÷][¡-þ]){2,}")
_UTF8_IN_GBK = re.compile(rb"(?:[\xe2-\xe9\xef][\x80-\xbf]{2}|[\xc2\xc3\xc5][\x80-\xbf]){3,}")
_UTF8_NEAR_LOSS = re.compile(rb"(?:[\xe2-\xe9\xef][\x80-\xbf]{2}){2,}")
_LOSS = re.compile("[\ufffd\ue000-\uf8ff\x1a]")
_SJIS_RUN = re.compile(r"(?:[\x81-\x9f‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸà-ï][@-~\x80-ü€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]){2,}")
_CYR_ANY = re.compile(r"[À-ÿ¨¸]{2,}(?:[ ,.\-«»]+[À-ÿ¨¸]+)*")
_CYR_LETTER = re.compile(r"[Ѐ-ӿ]")
_SWAPPED_WORD = r"[а-яёЂ-џ]?[А-ЯЁЂ-Џ][А-ЯЁЂ-џ]*(?![а-я])"
_SWAPPED_HINT = re.compile(r"[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{5}")
_SWAPPED_RUN = re.compile(rf"(?<![Ѐ-ӿ]){_SWAPPED_WORD}(?:[^A-Za-zЀ-ӿ\n]{{1,6}}{_SWAPPED_WORD}){{2,}}")
_BIG5_MARKS = "﹝﹞﹜﹛ㄛㄗㄘㄐㄥㄦㄩㄨ※§＃岆腔湮悝珨祥笭摯芞"
_BIG5_ODD = re.compile(r"[ㄅ-ㄩ﹐-﹫︰-︿岆腔湮悝珨祥]")
_REPLACED = re.compile("(?:锟斤拷)+锟?|\ufffd+")
_KANA = re.compile(r"[぀-ヿ]")
_WIDE_RUN = re.compile(r"[⺀-鿿︰-﹯＀-￮‐-․-☆]+")
_SHORT_RUN = re.compile(r"(?<![㐀-鿿\ue000-\uf8ff])[㐀-鿿\ue000-\uf8ff]{1,6}(?![㐀-鿿\ue000-\uf8ff])")
_CYR_RUN = re.compile(r"[À-ÿ¨¸]{3,}(?:[ ,.\-«»]+[À-ÿ¨¸]{1,})*")


def _example(text: str, a: int, b: int) -> bool:
    """Whether the span stands alone between a pair of quotation marks, perhaps with spaces inside them."""
    left, right = text[:a].rstrip("  ")[-1:], text[b:].lstrip("  ")[:1]
    return bool(left) and _QUOTES.get(left) == right


def _common(ch: str) -> bool:
    """In everyday use: first level of GB 2312, kana, CJK punctuation, ASCII."""
    if ch < "\x80" or "　" <= ch <= "ヿ" or "＀" <= ch <= "￯" or "‐" <= ch <= "…" or ch in "·×÷°¥":
        return True
    if not "一" <= ch <= "鿿":
        return False
    try:
        b = ch.encode("gb2312")
    except UnicodeEncodeError:
        return False
    return 0xB0 <= b[0] <= 0xD7


def _share(s: str) -> float:
    s = [c for c in s if c > "\x7f"]
    return sum(map(_common, s)) / len(s) if s else 1.0


def _single_spans(text: str):
    """Spans by the encodings of one byte a character. A few Cyrillic letters alone may stand there by chance; they
    count where the text has a longer span of the same encoding."""
    cyrillic = len(_CYRILLIC_TEXT.findall(text))
    wide = bool(_HAN_TEXT.search(text))
    for codec in SINGLE:
        sure, short = [], []
        for a, b, decoded in codec.spans(text):
            if not _PLAUSIBLE.match(decoded):
                good = _PLAUSIBLE.match(re.sub(r"[\u0080-\u009fƀ-ɏͰ-֏]", "", decoded) or "?")
                if not good or len(decoded) < 4:
                    continue
            n = len(decoded)
            if n == 1 and decoded > "\u2fff" and decoded != "\ufffd" and not wide:
                continue  # one wide character alone comes about by chance, as in an accented letter before an ellipsis
            span = (a, b, decoded, codec.codec)
            if codec.codec == "cp1251" and cyrillic > 20 and n < 3:
                short.append(span)
            elif _LATIN.match(decoded) or _WIDE_ONE.search(decoded) or "\ufffd" in decoded or n >= 3:
                sure.append(span)
            else:
                short.append(span)
        yield from sure
        if any(len(s[2]) >= 3 and _CYRILLIC_TEXT.search(s[2]) for s in sure):
            yield from (s for s in short if _CYRILLIC_LETTERS.match(s[2]))


def _gbk_as_latin(text: str):
    """GBK bytes read as Latin-1: pairs of upper-half characters that decode to characters in use."""
    for m in _GBK_PAIRS.finditer(text):
        raw = m[0].encode("latin-1")
        decoded = raw.decode("gb18030", "replace")
        if len(decoded) >= 2 and _share(decoded) >= 0.8 and not decoded.isascii():
            yield m.start(), m.end(), decoded, "gbk-as-latin1"


def _sjis_as_latin(text: str):
    """Shift-JIS bytes read as cp1252: pairs that decode to kana and other characters in use."""
    back = SINGLE[0].back
    for m in _SJIS_RUN.finditer(text):
        raw = bytes(back.get(c, ord(c)) for c in m[0])
        decoded = raw.decode("cp932", "replace")
        if len(_KANA.findall(decoded)) >= (1 if _KANA.search(text) else 2) and _share(decoded) >= 0.5:
            yield m.start(), m.end(), decoded, "sjis-as-cp1252"


def _cyrillic_as_latin(text: str):
    """Cyrillic of one byte a letter read as Latin-1: runs of words that consist of upper-half letters only."""
    if sum(m.end() - m.start() for m in _CYR_RUN.finditer(text)) < 12:
        return
    runs = list(_CYR_ANY.finditer(text))
    for m in runs:
        raw = m[0].encode("latin-1")
        best = max((raw.decode(c) for c in ("cp1251", "koi8-r", "iso8859-5")), key=lambda s: len(_CYRILLIC_TEXT.findall(s)))
        if len(_CYRILLIC_TEXT.findall(best)) >= 0.6 * len(m[0].replace(" ", "")):
            yield m.start(), m.end(), best, "cyrillic-as-latin1"


def _odd_stretches(run: str):
    """(from, to) of the stretches of a wide run between characters that are out of common use, with at most two others
    between them."""
    odd = [i for i, c in enumerate(run) if not _common(c) or c in _BIG5_MARKS]
    start = None
    for i, j in zip(odd, [*odd[1:], 1 << 30], strict=False):
        start = i if start is None else start
        if j - i > 3:
            yield start, i + 1
            start = None


def _gbk_as_big5(text: str):
    """GBK bytes read as Big5: stretches of wide characters that decode to far commoner ones than those that stand there."""
    for m in _WIDE_RUN.finditer(text):
        for x, y in [(0, len(m[0]))] if _share(m[0]) < 0.5 else _odd_stretches(m[0]):
            part = m[0][x:y]
            if len(part) < 4:
                continue
            decoded = part.encode("big5hkscs", "replace").decode("gbk", "replace")
            if _share(decoded) >= 0.8 and _share(part) < 0.65:
                yield m.start() + x, m.start() + y, decoded, "gbk-as-big5"


def _vowels(s: str) -> float:
    letters = _CYR_LETTER.findall(s)
    return sum(c in "аеёиоуыэюя" for c in s.lower()) / max(len(letters), 1)


def _cyrillic_swapped(text: str):
    """Cyrillic of one byte a letter read as another such encoding: capitals and small letters change places there. A run
    of such words is garbled where another reading has small letters and the vowels of a language."""
    for m in _SWAPPED_RUN.finditer(text):
        if len(_CYR_LETTER.findall(m[0])) < 10:
            continue
        best = None
        for read, true in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
            try:
                decoded = m[0].encode(read).decode(true)
            except UnicodeError:
                continue
            small = len(_CYRILLIC_TEXT.findall(decoded)) / max(len(_CYR_LETTER.findall(decoded)), 1)
            if small > 0.8 and _vowels(decoded) > _vowels(m[0]) + 0.05 and (best is None or _vowels(decoded) > _vowels(best)):
                best = decoded
        if best:
            yield m.start(), m.end(), best, "cyrillic-swapped"


def _utf8_as_gbk(text: str):
    """UTF-8 bytes read as GBK, in runs of wide characters, and letter by letter within Latin text."""
    text = text.replace("\ufffd", "\x1a")  # a lost byte ends a span
    try:
        raw = text.encode("gb18030")
    except UnicodeEncodeError:
        raw = text.encode("gb18030", "replace")
    rx = _UTF8_NEAR_LOSS if _LOSS.search(text) else _UTF8_IN_GBK
    if rx.search(raw):
        at, starts = 0, []
        for ch in text:
            starts.append(at)
            at += len(ch.encode("gb18030", "replace"))
        starts.append(at)
        where = {p: i for i, p in enumerate(starts)}
        for m in rx.finditer(raw):
            a, b = m.start(), m.end()
            while a not in where and a < b:
                a += 1
            while b not in where:
                b += 1  # the last character's second byte is taken along
            if a >= b:
                continue
            i, j = where[a], where[b]
            decoded = raw[m.start():b].decode("utf-8", "replace").rstrip("�")
            if _share(text[i:j]) < 0.75 and _share(decoded) > 0.75:
                yield i, j, raw[a:b].decode("utf-8", "replace"), "utf8-as-gbk"
    for m in _SHORT_RUN.finditer(text):
        run = m[0]
        a, b = m.start(), m.end()
        if not "一" <= run[0] <= "鿿" and run[0] < "":
            continue
        before, after = text[a - 1:a], text[b:b + 1]
        lost = after == "\x1a"
        core = run
        try:
            bytes_ = core.encode("gb18030")
        except UnicodeEncodeError:
            continue
        if lost:
            if bytes_[:2] in (b"\xe2\x80", b"\xe2\x82", b"\xe3\x80") or (_LETTER.match(before or " ") and re.match(rb"^(?:[\xc2-\xc5][\x80-\xbf])+[\xc2-\xc5\xe2]?", bytes_)):
                yield a, b + 1, run + "�", "utf8-as-gbk"
            continue
        m2 = re.match(rb"^((?:[\xc2-\xc5][\x80-\xbf]|\xe2[\x80-\x84][\x80-\xbf])+)([\x40-\x7e])?$", bytes_)
        if not m2:
            continue
        decoded = bytes_.decode("utf-8", "replace")
        if not re.match(r"^[ -ſ‐-⁄€™]+[\x40-\x7e]?$", decoded):
            continue
        touching = _LETTER.match(before or " ") or _LETTER.match(after or " ")
        if bytes_[:2] == b"\xe2\x80" or touching:
            yield a, b, decoded, "utf8-as-gbk"


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """(from, to, decoded text, encoding) of the garbled spans, without overlaps, in order of place."""
    if not text or text.isascii():
        return []
    found = list(_single_spans(text))
    found += _gbk_as_latin(text)
    found += _sjis_as_latin(text)
    found += _cyrillic_as_latin(text)
    if re.search(r"[一-鿿-]", text):
        found += _utf8_as_gbk(text)
        if _BIG5_ODD.search(text):
            found += _gbk_as_big5(text)
    if _SWAPPED_HINT.search(text):
        found += _cyrillic_swapped(text)
    for m in _REPLACED.finditer(text):
        found.append((m.start(), m.end(), m[0], "lost"))
    found.sort(key=lambda s: (-(s[1] - s[0]), s[0]))
    taken: list = []
    for s in found:
        k = bisect.bisect(taken, s)
        if (k == 0 or taken[k - 1][1] <= s[0]) and (k == len(taken) or s[1] <= taken[k][0]):
            taken.insert(k, s)
    return taken


def inspect(text: str | None) -> list[tuple[int, int, str, str]]:
    """The garbled spans of a text, or none where all of them are examples."""
    got = spans(text or "")
    if got and all(s[1] - s[0] <= 12 and _example(text, s[0], s[1]) for s in got):
        return []
    return got


def restore(text: str) -> str:
    """The text with its garbled spans decoded, as often as it takes."""
    for _ in range(ROUNDS):
        got = inspect(text)
        fixed = text
        for a, b, decoded, _codec in reversed(got):
            fixed = fixed[:a] + decoded + fixed[b:]
        if fixed == text:
            break
        text = fixed
    return text


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the documents with any garbled stretch."""

    def run(batches):
        for batch in batches:
            ids = [d for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t and inspect(t)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint")


def restored(documents: DataFrame) -> DataFrame:
    """Every garbled document with the encodings met, the number of garbled characters, and its restored text."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = inspect(t) if t else []
                if got:
                    fixed = restore(t)
                    row = (d, sum(b - a for a, b, _, _ in got), ",".join(sorted({s[3] for s in got})), fixed, "�" not in fixed and not inspect(fixed))
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "garbled_chars", "encodings", "restored", "whole"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, garbled_chars int, encodings string, restored string, whole boolean")


def summary(documents: DataFrame) -> DataFrame:
    """How many documents of each source are garbled, and how many of them could be restored whole."""
    done = restored(documents).select("doc_id", "garbled_chars", "whole")
    return (
        documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
        .join(done, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("docs"), F.count("garbled_chars").alias("garbled"), F.coalesce(F.sum(F.col("whole").cast("int")), F.lit(0)).alias("restored_whole"))
    )
