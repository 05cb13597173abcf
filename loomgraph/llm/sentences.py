"""Sentence boundaries across languages and scripts (problem 4).

Statistics are learned without labels, per language, over every row: how often a token type carries a
period, which types begin sentences, which types follow ordinals. Abbreviations, sentence starters and
ordinal collocations are chosen by log-likelihood ratios; each period is then classified with them. Quoted
speech is followed through nested quotes, so it stays in one sentence with the words around it.

Rows are split in blocks of a source's sentence indexes. What a block leaves open is worked out from its last rows
first and checked against the whole block afterwards; where it differs, the next block is split again, so the result is
that of one pass over the whole source, whatever the size of blocks.

Defined results: null and empty sentences give no rows; a row without a row before it (same source_id,
sentence_idx less 1) never gets start_char -1; of several rows before it the one with the least row_id counts; repeated
rows each get their own result; row_id is unique, as stated for the table; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import script_lang, spread, written

#: A type is judged from so many events on; fewer show nothing, whatever the size of the corpus.
LEAST_SEEN = 3
ABBREV_SCORE = 0.3
STARTER_LLR = 20.0
COLLOCATION_LLR = 7.88
#: Log odds from which a pair of wide characters may begin a sentence behind an ellipsis.
WIDE_START = -1.5
#: Rows of a source are laid out in blocks of so many sentence indexes; of so many rows at a block's end it is told
#: first what the block leaves open.
BLOCK = 256
LEAD = 8

_OPEN = "“«„「『‹（(【"
_CLOSE = "”»」』›）)】"
_LEAD = "“\"«„‘'「『‹（([¿¡—–-•*"
_TAIL = "”\"»“’'」』›）)],;:，；：、"
_TOKEN = re.compile(r"\S+")
_NUM = re.compile(r"^[\d.,:/%°]+$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々〆]")
_LATIN_TAIL = re.compile(r"([A-Za-z]+)(\.?)$")
_CJK_RUN = re.compile(r"[぀-ヿ㐀-鿿々〆ー]+")
_EVENT = re.compile(r"[.!?。！？…‥“”„«»「」『』‹›（）()【】\"\n]")
_ENDERS = ".!?。！？…‥"
_CJK_START = re.compile(r"[。！？!?][”」』»）)]*\s*[“「『]?([぀-ヿ㐀-鿿]{2})")
_CJK_END = re.compile(r"([぀-ヿ㐀-鿿]{2})[。！？]")

STATS_SCHEMA = "kind string, lang string, a string, b string, n bigint"


@lru_cache(1 << 16)
def _type(token: str) -> tuple[str, bool, str]:
    """(lower-case type without its final period, whether it had one, the token without outer marks)."""
    core = token.lstrip(_LEAD)
    core = core.rstrip(_TAIL)
    dot = core.endswith(".") and not core.endswith("..")
    if dot:
        core = core[:-1]
    core = core.rstrip("!?…。！？")
    if _NUM.match(core):
        return "##", dot, core
    return core.lower(), dot, core


@lru_cache(1 << 16)
def _ends(token: str) -> str:
    """The last sentence-ending mark of a token, or ""."""
    t = token.rstrip("”\"»“’'」』›）)]")
    return t[-1] if t and t[-1] in _ENDERS else ""


#: A token that ends a sentence, and the next token with a letter or digit.
_END_PAIR = re.compile(r"(?<!\S)(\S*[.!?…‥][”\"»“’'」』›）)\]]*)\s+(?=(?:[^\w\s]+\s+)*(\S+))")


def count_row(text: str, out: Counter) -> None:
    """Adds a row's events to out: P/N a type with and without a period, S a type that begins a sentence,
    C a capitalised type anywhere, F the follower of a type with period, E/M an end or other use of a word;
    for scripts without spaces S, E and B (any) over pairs of characters. Whole tokens are counted first (T) and
    taken apart once for each different token."""
    lang = script_lang(text)
    if not lang:
        return
    if not text.isascii() and _CJK.search(text):
        _count_wide(text, lang, out)
        return
    tokens = text.split()
    if not tokens:
        return
    out.setdefault(("T", lang), Counter()).update(tokens)
    kind, _, core = _type(tokens[0])
    if core and core[0].isupper():
        out["S", lang, kind, ""] += 1
    for token, follower in _END_PAIR.findall(text):
        before = _type(token)[0]
        kind, _, core = _type(follower)
        if not core:
            continue
        upper = core[0].isupper()
        if _ends(token) == ".":
            out["F", lang, before, kind if upper else "0" if core[0].isdigit() else "a"] += 1
        elif upper:
            out["S", lang, kind, ""] += 1


def _token_events(lang: str, tokens: Counter, out: Counter) -> None:
    for token, n in tokens.items():
        kind, dot, core = _type(token)
        if core:
            out["P" if dot else "N", lang, kind, ""] += n
            out["E" if _ends(token) else "M", lang, kind, ""] += n
            if core[0].isupper():
                out["C", lang, kind, ""] += n


def _count_wide(text: str, lang: str, out: Counter) -> None:
    for first in _CJK_START.findall(text):
        out["S", lang, first, ""] += 1
    for last in _CJK_END.findall(text):
        out["E", lang, last, ""] += 1
    if lang in ("zh", "ja"):
        pairs = out.setdefault(("B", lang), Counter())
        for run in _CJK_RUN.findall(text):
            pairs.update(map(add, run, run[1:]))
    before, end = None, "start"
    for token in text.split():
        if not token.isascii() and _CJK.search(token):
            # In running text without spaces only "No." and its like matter: a Latin word and a period before a space.
            tail = _LATIN_TAIL.search(token)
            if tail:
                kind = tail[1].lower()
                out["P" if tail[2] else "N", lang, kind, ""] += 1
                before, end = (kind, ".") if tail[2] else (None, "")
                if tail[2]:
                    out["E", lang, kind, ""] += 1
            else:
                if before and end == ".":
                    out["F", lang, before, "0" if token[0].isdigit() else "C"] += 1
                before, end = None, ""
            continue
        kind, dot, core = _type(token)
        if not core:
            continue
        first = core[0]
        upper = first.isupper()
        if before and end == ".":
            out["F", lang, before, kind if upper else "0" if first.isdigit() else "a"] += 1
        if end and end != "." and upper:
            out["S", lang, kind, ""] += 1
        if upper:
            out["C", lang, kind, ""] += 1
        out["P" if dot else "N", lang, kind, ""] += 1
        mark = _ends(token)
        out["E" if mark else "M", lang, kind, ""] += 1
        before, end = (kind, mark) if mark else (None, "")


def collect_stats(rows: DataFrame) -> DataFrame:
    """Counts over all rows, summed per partition before the shuffle."""

    def count(batches):
        out: Counter = Counter()
        for batch in batches:
            for text in batch.column("sentence").to_pylist():
                if text:
                    count_row(text, out)
            if len(out) + sum(len(c) for k, c in out.items() if len(k) == 2) > 400_000:
                yield _stats_batch(out)
                out = Counter()
        yield _stats_batch(out)

    counted = spread(rows.select("sentence")).mapInArrow(count, STATS_SCHEMA)
    return counted.groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n"))


def _stats_batch(out: Counter) -> pa.RecordBatch:
    for kind, lang in [k for k in out if len(k) == 2]:  # tokens and pairs of characters are counted apart
        counts = out.pop((kind, lang))
        if kind == "T":
            _token_events(lang, counts, out)
        else:
            for pair, n in counts.items():
                out["B", lang, pair, ""] = n
    keys = list(out)
    cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(list(out.values()), pa.int64())], ["kind", "lang", "a", "b", "n"])


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of k1 of n1 against k2 of n2."""

    def ll(k, n, p):
        q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    p = (k1 + k2) / F.greatest(n1 + n2, F.lit(1))
    return 2 * (ll(k1, n1, k1 / F.greatest(n1, F.lit(1))) + ll(k2, n2, k2 / F.greatest(n2, F.lit(1))) - ll(k1, n1, p) - ll(k2, n2, p))


class Lexicon:
    """What is learned: per language abbreviations, starters, ordinal collocations and pairs of wide characters that may
    begin a sentence, those accepted only; and for the row at hand the log odds of ends and starts that its line breaks
    and ellipses need."""

    def __init__(self):
        self.abbrev: set = set()
        self.starters: set = set()
        self.ordinal: set = set()
        self.wide_starts: set = set()
        self.start_odds: dict = {}
        self.end_odds: dict = {}


def learn(stats: DataFrame) -> tuple[Lexicon, DataFrame]:
    """(lexicon, odds): every type is scored as a row of a table; accepted types alone reach the driver, whose number is
    bounded by the vocabulary of abbreviations and sentence starters. odds: lang, a, start_odds, end_odds of all types."""
    lex = Lexicon()
    spark = stats.sparkSession
    sums = {(r["kind"], r["lang"]): r["n"] for r in stats.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in sums})
    table = spark.createDataFrame([(la, *(float(sums.get((k, la), 0)) for k in "PNSCEB")) for la in langs], "lang string, " + ", ".join(f"t{k} double" for k in "PNSCEB"))
    whole = F.broadcast(table)
    one = F.lit(1.0)
    flat = stats.filter("b = ''").groupBy("lang", "a").pivot("kind", ["P", "N", "S", "C", "E", "M", "B"]).agg(F.sum("n")).na.fill(0)
    types = flat.filter(F.greatest("P", "N", "S", "B", "E") >= LEAST_SEEN).join(whole, "lang")
    c = F.col
    wide = c("a").rlike("^[぀-ヿ㐀-鿿々〆]")
    mid = F.greatest(c("C") - c("S"), F.lit(0))
    zero = F.lit(0)
    wide_odds = lambda k: F.log((c(k) + 0.1) / (F.greatest(c("B") - c(k), zero) + 1) * F.greatest(c("tB"), one) / F.greatest(c("t" + k), one))
    n_start, n_mid = F.greatest(c("tS"), one), F.greatest(c("tC") - c("tS"), one)
    types = written(types.withColumns({
        "start_odds": F.when(wide, wide_odds("S")).otherwise(F.log((c("S") + 0.5) / (mid + 0.5))),
        "end_odds": F.when(wide, wide_odds("E")).otherwise(F.log((c("E") + 0.5) / (c("M") + 0.5))),
        "starts": ~wide & (c("S") > 0) & (_llr(c("S"), n_start, mid, n_mid) > STARTER_LLR) & (c("S") / n_start > mid / n_mid),
    }), "types")
    odds = types.select("lang", "a", "start_odds", "end_odds")
    starters = types.filter("starts").select("lang", c("a").alias("b"), F.lit(1).alias("starts"))
    events = stats.filter("kind = 'F'").join(starters, ["lang", "b"], "left")
    low = c("b").isin("a", "0")
    follow = events.groupBy("lang", "a").agg(F.sum("n").alias("f_all"), F.sum(F.when(low, c("n")).otherwise(0)).alias("f_low"), F.sum(F.when(c("starts") == 1, c("n")).otherwise(0)).alias("f_start"))
    judged = types.filter((c("P") > 0) & (c("a") != "##")).join(follow.filter(c("f_all") >= LEAST_SEEN), ["lang", "a"])
    p = F.least(F.greatest(c("tP") / F.greatest(c("tP") + c("tN"), one), F.lit(1e-6)), F.lit(0.98))
    letters = F.length(F.replace("a", F.lit("."), F.lit("")))
    ratio = 2 * (c("P") * F.log(0.99 / p) + c("N") * F.log(0.01 / (1 - p)))
    score = ratio * F.exp(-letters) * (F.length("a") - letters + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -F.least(c("N"), F.lit(50)).cast("double"))
    few = (c("f_all") < 10) | c("lang").isin("zh", "ja")  # too few, or Latin words in passing: only followers that can't begin a sentence count
    no_start = (c("f_low") / c("f_all") > 0.5) & (c("P") > 3 * c("N") / F.greatest(F.length("a"), F.lit(1)))
    start = c("f_start") / c("f_all")
    abbrevs = judged.filter(no_start | ~few & ((score > ABBREV_SCORE) & (start < 0.08) | (letters <= 4) & (c("P") > c("N")) & (start < 0.03)))
    after = stats.filter("kind = 'F' and a = '##'").filter(~c("b").isin("a", "0", "C") & ~c("lang").isin("zh", "ja"))
    after = after.join(types.select("lang", c("a").alias("b"), c("C").alias("seen"), "starts"), ["lang", "b"], "left").filter("not coalesce(starts, false)").join(follow.filter("a = '##'").select("lang", "f_all"), "lang").join(whole, "lang")
    seen = F.coalesce("seen", "n")
    ordinals = after.filter((c("n") > 0.3 * seen) & (_llr(c("n"), c("f_all"), F.greatest(seen - c("n"), zero), F.greatest(c("tC"), one)) > COLLOCATION_LLR))
    picked = abbrevs.select(F.lit("a").alias("k"), "lang", "a").unionByName(starters.select(F.lit("s").alias("k"), "lang", c("b").alias("a"))).unionByName(ordinals.select(F.lit("o").alias("k"), "lang", c("b").alias("a")))
    picked = picked.unionByName(odds.filter(wide & (c("start_odds") > WIDE_START)).select(F.lit("w").alias("k"), "lang", "a"))
    into = {"a": lex.abbrev, "s": lex.starters, "o": lex.ordinal, "w": lex.wide_starts}
    for r in picked.distinct().collect():
        into[r["k"]].add((r["lang"], r["a"]))
    return lex, odds


class State:
    """Where a row stops: open quotes, each with whether words introduced it, and what the junction looks like."""

    __slots__ = ("quote_first", "stack", "tail")

    def __init__(self):
        self.stack: list = []
        self.tail = ""
        self.quote_first = False

    def text(self) -> str:
        return json.dumps([[[s[0], int(s[1])] for s in self.stack], self.tail, int(self.quote_first)], ensure_ascii=False)

    @classmethod
    def of(cls, text: str) -> State:
        out = cls()
        stack, out.tail, first = json.loads(text)
        out.stack, out.quote_first = [(ch, bool(intro), -1) for ch, intro in stack], bool(first)
        return out


_PAIR = {"”": "“", "»": "«", "」": "「", "』": "『", "›": "‹", "）": "（", ")": "(", "】": "【"}
_SKIP = re.compile(r"[\s]*")
_LEFT = re.compile(r"(\S+)$")


def _next_word(text: str, at: int) -> tuple[str, str]:
    """(first letter or digit from at on, the word it begins)."""
    m = re.compile(r"[\w]").search(text, at, at + 12)
    if not m:
        return "", ""
    w = re.compile(r"[^\s.,;:!?…。！？，；：”»」]+").match(text, m.start())
    return m[0], w[0] if w else m[0]


class Splitter:
    def __init__(self, lex: Lexicon):
        self.lex = lex

    def breaks(self, text: str, before: State | None = None) -> tuple[list[int], bool, State]:
        """(starts of further sentences, whether the row continues the one before it, its own final state)."""
        lang = script_lang(text)
        lex = self.lex
        continued = False
        stack: list = []
        sent_from = 0
        if before is not None and (before.tail or before.stack):
            continued = self._continues(text, before, lang)
            if continued:
                stack = list(before.stack)
                sent_from = -1 if not before.quote_first else 0
        starts: list[int] = []
        state = State()
        intro_here = None
        n = len(text)
        pos = 0
        closed_intro = None
        closed_at = -1
        while True:
            m = _EVENT.search(text, pos)
            if not m:
                break
            i = m.start()
            ch = text[i]
            pos = i + 1
            if ch in "“„«「『‹（(【" or ch == '"':
                german_close = ch == "“" and stack and stack[-1][0] == "„"
                english_close = ch == '"' and stack and stack[-1][0] == '"'
                if not german_close and not english_close:
                    lead = text[max(sent_from, 0):i].strip()
                    mark = lead[-1:] if lead else ""
                    introduced = bool(lead) and (mark in ":：" or (mark == "," and ch not in "「『")) or sent_from < 0
                    if ch in "「『":
                        introduced = bool(lead)
                    stack.append((ch, introduced, i))
                    continue
                top = stack.pop()
                closed_intro, closed_at = top[1], i
            elif ch in "”»」』›）)】":
                want = _PAIR[ch]
                if stack and (stack[-1][0] == want or (want == "“" and stack[-1][0] in "„“") or (want == "«" and stack[-1][0] == "„")):
                    top = stack.pop()
                    closed_intro, closed_at = top[1], i
                elif ch == "»" or stack and stack[-1][0] not in "（(" or ch in "）)":
                    if any(s[0] == want for s in stack):
                        while stack and stack[-1][0] != want:
                            stack.pop()
                        top = stack.pop()
                        closed_intro, closed_at = top[1], i
                continue
            if ch == "\n":
                if stack and all(s[0] not in "（(" for s in stack) and re.match(r"\n\s*\n", text[i:i + 8]):
                    stack = []
                if stack:
                    continue
                left = text[:i].rstrip()
                if not left or left[-1] in _ENDERS or left[-1] in _TAIL:
                    continue
                at = _SKIP.match(text, i).end()
                if at < n and self._lost_stop(text, left, at, lang):
                    starts.append(at)
                    sent_from = at
                continue
            if ch in "“”\"":
                continue
            # a mark that may end a sentence: take the whole run with its closing marks
            j = i + 1
            while j < n and text[j] in _ENDERS:
                j += 1
            inside = list(stack)
            quote_closed = None
            k = j
            while k < n:
                gap = k
                if text[gap] in "   " and gap + 1 < n and text[gap + 1] in "»›":
                    gap += 1
                c = text[gap]
                if c in "”»」』›）)】" or (c == "“" and inside and inside[-1][0] == "„") or (c == '"' and inside and inside[-1][0] == '"'):
                    if inside:
                        quote_closed = inside.pop()
                    k = gap + 1
                    continue
                if c in "’']":
                    k = gap + 1
                    continue
                break
            if inside:
                pos = max(j, i + 1)
                if quote_closed:
                    stack = inside
                    pos = k
                continue
            pos = k
            stack = inside
            at = _SKIP.match(text, k).end()
            if at >= n:
                continue
            if self._boundary(text, i, j, k, at, lang, quote_closed):
                starts.append(at)
                sent_from = at
        state.stack = stack
        tail = text.rstrip()
        state.tail = tail[-60:]
        lead = text[max(sent_from, 0):].lstrip()
        state.quote_first = bool(lead) and (lead[0] in "“«„「『\"—" or sent_from >= 0 and self._quote_opens(lead)) and not (continued and sent_from <= 0)
        return sorted(set(starts)), continued, state

    @staticmethod
    def _quote_opens(lead: str) -> bool:
        """Whether the sentence consists of a quote, at most after a connector with a comma, that introducing words don't precede."""
        m = re.search(r"[“「『«„]", lead[:24])
        return bool(m) and lead[m.start() - 1:m.start()] in ("，", "、")

    def _boundary(self, text, i, j, k, at, lang, quote_closed, across: bool = False) -> bool:
        ch = text[j - 1]
        nxt = text[at]
        first, word = _next_word(text, at)
        left = _LEFT.search(text[max(0, i - 40):i])
        if nxt in ",;:，；：、)）]】”」』。.!?！？":
            return False
        if nxt in "—–-":
            after = text[at + 1:at + 3].strip()
            if after and (after[0].islower() or not (after[0].isupper() or after[0] in "¿¡“«„")):
                return False
        if first and first.islower() and not _CJK.match(first):
            return False
        if quote_closed and quote_closed[0] not in "（(【":
            if nxt in "とってとい" and lang == "ja" or text[at:at + 1] in ("と",):
                return False
            if not quote_closed[1] and _CJK.match(first or " "):
                return nxt in "“「『" 
            if not quote_closed[1] and quote_closed[0] in "「『":
                return False
            if ch == "." or ch in "!?…":
                return True
            return True
        if quote_closed:  # a bracket
            return ch in "。！？" and bool(first)
        if ch in "…‥" or j - i >= 2 and text[i:j].strip(".") == "":
            if _CJK.match(first or " "):
                pair = (lang, text[at:at + 2])
                begins = pair in self.lex.wide_starts or not _CJK.match(pair[1][1:] or " ") if across else self.lex.start_odds.get(pair, 0.0) > WIDE_START
                return begins or nxt in "“「『"
            if first.isdigit():
                return True
            return bool(first) and (first.isupper() or first.isdigit())
        if ch in "!?。！？":
            return True
        # a single period
        if at == k and k == j:  # nothing between: a decimal, an abbreviation with inner periods, an address, or a change of script
            return bool(first) and bool(_CJK.match(first)) and not (left and self._abbrev(left[1], lang))
        if not left:
            return True
        token = left[1]
        if self._abbrev(token, lang):
            if first.isdigit() or nxt in "(（" or not first:
                return False
            return (lang, word.lower()) in self.lex.starters and not _title_like(token) and len(token.lstrip(_LEAD)) > 3
        kind = _type(token)[0]
        if kind == "##" and (lang, word.lower()) in self.lex.ordinal:
            return False
        return True

    def _abbrev(self, token: str, lang: str) -> bool:
        kind = _type(token + ".")[0]
        if _CJK.search(kind):
            tail = re.search(r"[a-z]+$", kind)
            kind = tail[0] if tail else kind
        if (lang, kind) in self.lex.abbrev:
            return True
        core = token.lstrip(_LEAD)
        if len(core) == 1 and core.isalpha() and not _CJK.match(core):
            return True
        if "." in kind and all(len(p) <= 2 for p in kind.split(".")) and not kind[0].isdigit():
            return True
        return lang in ("zh", "ja") and any((la, kind) in self.lex.abbrev for la in ("zh", "en", "ja"))

    def _lost_stop(self, text, left, at, lang) -> bool:
        """Whether a line break without a stop before it parts two sentences."""
        first, word = _next_word(text, at)
        if not first or first.islower() and not _CJK.match(first):
            return False
        if _CJK.match(first) and _CJK.match(left[-1]):
            return self.lex.end_odds.get((lang, left[-2:]), 0.0) + self.lex.start_odds.get((lang, text[at:at + 2]), 0.0) > 0
        if bool(_CJK.match(first)) != bool(_CJK.match(left[-1])):
            return True
        if first.isdigit() and not text[at] in "“«„":
            return False
        token = _LEFT.search(left[-40:])
        end = self.lex.end_odds.get((lang, _type(token[1])[0]), -2.0) if token else 0.0
        return end + self.lex.start_odds.get((lang, word.lower()), -1.0) > 0

    def _continues(self, text, before: State, lang) -> bool:
        """Whether a row goes on with the sentence that the row before it leaves open."""
        if before.stack:
            return True
        tail = before.tail
        at = _SKIP.match(text, 0).end()
        if at >= len(text) or not tail:
            return False
        nxt = text[at]
        first, word = _next_word(text, at)
        if nxt in ",;:，；：、)）]】。.”」』":
            return True
        if first and first.islower() and not _CJK.match(first):
            return True
        if nxt in "—–" and re.match(r"[—–]\s*[^\W\d_]", text[at:at + 3]) and text[at + 1:at + 3].strip()[:1].islower():
            return True
        core = tail.rstrip("”»“’'」』›）)】\"  ")
        last = tail[-1]
        if last in ";；,，、:：":
            return True
        closed = core != tail and last not in "）)】"
        if not core:
            return False
        mark = core[-1]
        if mark not in _ENDERS:
            if last in "）)】」』”»“":
                return bool(_CJK.match(first or " ")) and False
            return False
        if closed:
            if nxt == "と":
                return True
            if before.quote_first and _CJK.match(first or " ") and nxt not in "“「『":
                return mark in "！？!?。…" and len(tail) < 60 or _CJK.match(first) is not None and "：" not in tail and ":" not in tail
            return False
        joined = tail + " " + text[at:at + 60]
        i = len(core) - 1
        while i > 0 and joined[i - 1] in _ENDERS:
            i -= 1
        return not self._boundary(joined, i, len(core), len(tail), len(tail) + 1, script_lang(joined) or lang, None, across=True)


def _title_like(token: str) -> bool:
    core = token.lstrip(_LEAD)
    return bool(core) and core[0].isupper() and "." not in core


_LINE_OR_ELLIPSIS = r"[\n…‥]|\.\."


def odds_keys(text: str) -> set[tuple[str, str]]:
    """(language, type) of what stands at a text's line breaks and behind its ellipses."""
    lang = script_lang(text)
    out = set()
    for m in re.finditer(_LINE_OR_ELLIPSIS, text):
        at = _SKIP.match(text, m.end()).end()
        while at < len(text) and (text[at] in _ENDERS or text[at] in _TAIL or text[at].isspace()):
            out.add((lang, text[at:at + 2]))
            at += 1
        out.add((lang, text[at:at + 2]))
        if m[0] == "\n":
            left = text[:m.start()].rstrip()
            token = _LEFT.search(left[-40:])
            out.add((lang, left[-2:]))
            if token:
                out.add((lang, _type(token[1])[0]))
            out.add((lang, _next_word(text, _SKIP.match(text, m.start()).end())[1].lower()))
    return {k for k in out if k[1]}


ODDS = "array<struct<a:string,start_odds:double,end_odds:double>>"


def with_odds(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """rows with odds: for those with line breaks or ellipses the types there, with their odds, joined by type."""

    def keys(batches):
        for batch in batches:
            out = [(i, lang, a) for i, t in zip(batch.column("row_id").to_pylist(), batch.column("sentence").to_pylist(), strict=True) for lang, a in odds_keys(t)]
            cols = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["row_id", "lang", "a"])

    need = F.col("sentence").rlike(_LINE_OR_ELLIPSIS)
    known = rows.filter(need).select("row_id", "sentence").mapInArrow(keys, "row_id bigint, lang string, a string").join(odds, ["lang", "a"])
    each = known.groupBy("row_id").agg(F.collect_set(F.struct("a", "start_odds", "end_odds")).alias("odds"))
    return rows.filter(need).join(each, "row_id", "left").unionByName(rows.filter(~need).withColumn("odds", F.lit(None).cast(ODDS)))


SPLIT = "source_id string, block bigint, row_id bigint, start_char int, state string"


def _split(shared, block_size: int):
    """Splits rows that come sorted by source, block, index and row: (row_id, start_char) of each start, and for each block
    what its last index leaves open (state). A row without text carries the state that the block before it leaves."""

    def split(batches):
        lex = shared.value
        splitter = Splitter(lex)
        key = None
        last_idx, last_state, cur_idx, cur_state = None, None, None, None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for rid, src, idx, text, odds, blk, state in zip(*(batch.column(c).to_pylist() for c in ("row_id", "source_id", "sentence_idx", "sentence", "odds", "block", "state")), strict=True):
                if (src, blk) != key:
                    key, last_idx, last_state, cur_idx, cur_state = (src, blk), None, None, None, None
                if idx != cur_idx:
                    last_idx, last_state, cur_idx, cur_state = cur_idx, cur_state, idx, None
                if text is None:
                    cur_state = State.of(state)
                    continue
                lang = script_lang(text) if odds else ""
                lex.start_odds = {(lang, o["a"]): o["start_odds"] for o in odds or ()}
                lex.end_odds = {(lang, o["a"]): o["end_odds"] for o in odds or ()}
                before = last_state if src is not None and idx is not None and last_idx == idx - 1 else None
                starts, continued, left = splitter.breaks(text, before)
                for at in [-1, *starts] if continued else starts:
                    for c, v in zip(out, (src, blk, rid, at, None), strict=True):
                        c.append(v)
                if cur_state is None:
                    cur_state = left
                    if src is not None and idx is not None and idx % block_size == block_size - 1:
                        for c, v in zip(out, (src, blk, None, None, left.text()), strict=True):
                            c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["source_id", "block", "row_id", "start_char", "state"])

    return split


def _edges(states: DataFrame) -> DataFrame:
    """The states that blocks leave, as rows in front of the blocks behind them."""
    behind = F.col("block") + 1
    return states.select(F.lit(None).cast("bigint").alias("row_id"), "source_id", (behind * BLOCK - 1).cast("int").alias("sentence_idx"), F.lit(None).cast("string").alias("sentence"), F.lit(None).cast(ODDS).alias("odds"), behind.cast("bigint").alias("block"), "state")


def found(sentences: DataFrame, scan_prefix: str | None = "file:scans/") -> DataFrame:
    """(row_id, start_char) of every further sentence start, -1 for rows that begin in the middle of a sentence."""
    rows = sentences.select("row_id", "source_id", "sentence_idx", "sentence").filter("row_id is not null and coalesce(sentence, '') <> ''")
    if scan_prefix:
        rows = rows.filter(~F.coalesce(F.col("source_id"), F.lit("")).startswith(scan_prefix))
    stats = collect_stats(rows).persist()
    lex, odds = learn(stats)
    stats.unpersist()
    split = _split(sentences.sparkSession.sparkContext.broadcast(lex), BLOCK)
    # rows without source or index stand alone, so they are spread over blocks of their own
    alone = F.col("source_id").isNull() | F.col("sentence_idx").isNull()
    block = F.when(alone, -1_000_000 - F.pmod(F.xxhash64("row_id"), F.lit(4096))).otherwise(F.floor(F.col("sentence_idx") / BLOCK)).cast("bigint")
    placed = rows.withColumn("block", block)

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("source_id", "block").sortWithinPartitions("source_id", "block", "sentence_idx", "row_id").mapInArrow(split, SPLIT)

    none = F.lit(None).cast("string")
    full = with_odds(placed, odds).withColumn("state", none)
    ends = with_odds(placed.filter(F.pmod("sentence_idx", F.lit(BLOCK)) >= BLOCK - min(LEAD, BLOCK)), odds).withColumn("state", none)
    assumed = written(by_block(ends).filter("state is not null").select("source_id", "block", "state"), "block-ends")
    done = written(by_block(full.unionByName(_edges(assumed))), "starts")
    while True:
        left = done.filter("state is not null").select("source_id", "block", "state")
        wrong = written(left.join(assumed.withColumnRenamed("state", "was"), ["source_id", "block"], "left").filter("was is null or was <> state").drop("was"), "block-ends")
        again = wrong.select("source_id", (F.col("block") + 1).alias("block"))
        if wrong.isEmpty():
            break
        # what these blocks leave open reaches further back than the rows that it was told from
        redone = by_block(full.join(again, ["source_id", "block"], "left_semi").unionByName(_edges(wrong)))
        done = written(done.join(again, ["source_id", "block"], "left_anti").unionByName(redone), "starts")
        assumed = left
    return done.filter("row_id is not null").select("row_id", "start_char")


def units(sentences: DataFrame) -> DataFrame:
    """(source_id, row_id, unit, sentence): the pieces of whole sentences of every row, scanned ones included; continues
    says that the piece goes on with the last one of the row before."""
    starts = found(sentences, scan_prefix=None)
    cuts = starts.groupBy("row_id").agg(F.sort_array(F.collect_set(F.when(F.col("start_char") > 0, F.col("start_char")))).alias("cuts"), F.max(F.col("start_char") == -1).alias("continues"))
    rows = sentences.filter(F.col("sentence").isNotNull()).select("row_id", "source_id", "sentence_idx", "sentence").join(cuts, "row_id", "left")
    begin = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")))
    end = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.length("sentence")))
    each = rows.select("row_id", "source_id", "sentence_idx", "sentence", F.coalesce("continues", F.lit(False)).alias("continues"), F.posexplode(F.arrays_zip(begin.alias("a"), end.alias("b"))).alias("unit", "span"))
    piece = F.trim(F.substring(F.col("sentence"), F.col("span.a") + 1, F.col("span.b") - F.col("span.a")))
    return each.select("row_id", "source_id", "sentence_idx", "unit", piece.alias("sentence"), (F.col("continues") & (F.col("unit") == 0)).alias("continues"))
