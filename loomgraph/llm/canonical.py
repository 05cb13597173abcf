"""Free-entered values mapped to a list of known entities (problem 5).

A prefix-filter set-similarity join: every value and every listed alias becomes a few normal forms, a form a set
of character grams ordered by global rarity; only the rare prefixes are joined, with length and positional
filters, and the Jaccard similarity of the pairs left is computed exactly. How similar two forms must be follows from
the edits that their lengths allow: an edit changes at most EDIT_GRAMS grams, so prefixes are short, and no pair within
the edits is missed. An edit-distance check follows, and the most similar alias of each value is kept; a value with none
is reported with the empty id.

Defined results: null and empty mentions, and those that no alias reaches, get ""; repeated mentions each get
the same id; of equally good entities the one with the smallest id is taken; aliases without an id count as
not listed; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .unify import INVISIBLE, LOOK_ALIKES

#: Grams of a form that one edit or swap of neighbours can change at most.
EDIT_GRAMS = 3
#: Ranks of grams are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_ROWS = 200_000
COMMON_SHARE = 0.003
LABELS = ("PER", "ORG", "LOC")

_LIKE = {ord(a): b for x, y in LOOK_ALIKES for a, b in zip(x, y, strict=True)}
_HIDDEN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), INVISIBLE))
_PAREN = re.compile(r"[(（][^()（）]*[)）]?")
_QUOTES = re.compile("[《》“”„\"«»「」『』‘’'\\[\\]]")
_HAN = re.compile(r"[㐀-鿿]")
_WIDE_CH = re.compile(r"[぀-ヿ㐀-鿿]")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
#: What people put before or after a name, and short forms of the words in names of institutions.
TITLES = frozenset("dr prof professor mr mrs ms sir herr frau the of near town city area region".split())
SHORT_FORMS = {"u": "university", "uni": "university", "univ": "university", "inst": "institute", "obs": "observatory", "lib": "library", "comp": "computation"}
ZH_AFTER = re.compile(r"(?:先生|女士|小姐|教授|博士|院士)?等?$")
ZH_PLACE = re.compile(r"(?:市|城|镇|县|一带|地区|附近)$")
ZH_POSSESSIVE = re.compile(r"(?<=[㐀-鿿])的(?=[㐀-鿿])")


def plain(value: str) -> str:
    """Lower case without accents, invisible characters and differences of look-alike letters."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", value)).translate(_LIKE).lower().translate(_LIKE)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("ø", "o").replace("ß", "ss").strip()


def common_words(entity_map: DataFrame) -> tuple[list[str], list[str]]:
    """Words that stand in COMMON_SHARE of the aliases, and names that are a single edit from one of them or from a
    title. The first are so many at most as the words of an alias allow, the second as a word has neighbours."""
    rows = entity_map.select("alias").filter("alias is not null")
    split = F.array_distinct(F.split(F.lower("alias"), r"[^\p{L}]+"))
    words = rows.select(F.explode(split).alias("w")).filter(F.length("w") >= 3).groupBy("w").agg(F.count("*").alias("n")).persist()
    common = [r["w"] for r in words.filter(F.length("w") >= 4).filter(F.col("n") > max(2, COMMON_SHARE * rows.count())).collect()]
    known = F.array(*[F.lit(w) for w in sorted({*common, *TITLES, *SHORT_FORMS})])
    bare = F.translate("w", "àáâäåãçèéêëìíîïñòóôöõøùúûüšž", "aaaaaaceeeeiiiinoooooouuuusz")
    close = words.filter(~F.array_contains(known, F.col("w"))).filter(F.exists(known, lambda k: F.levenshtein(bare, k) <= 1))
    names = [r["w"] for r in close.select("w").collect()]
    words.unpersist()
    return common, names


class Words:
    """Corrects slips in words that many aliases share and in what people put around names; names are left alone."""

    def __init__(self, common: list[str], names: list[str]):
        self.known = {plain(w) for w in common} | set(TITLES) | set(SHORT_FORMS)
        self.seen: dict[str, str] = {plain(w): plain(w) for w in names}

    def fix(self, w: str) -> str:
        if w in self.known or len(w) < 2:
            return w
        if w not in self.seen:
            self.seen[w] = w
            for t in sorted(self.known, key=lambda t: (-len(t), t)):
                if len(t) < 2 or abs(len(t) - len(w)) > 1:
                    continue
                d = distance(w, t, 1 if len(t) < 9 else 2)
                close = d <= 1 and (len(t) >= 4 or sorted(w) == sorted(t) or len(w) > len(t) and set(w) == set(t) or len(t) == 3 and t[0] == w[0])
                if close or d == 2 and len(t) >= 9:
                    self.seen[w] = t
                    break
        return self.seen[w]


def forms(value: str, listed: bool = False, fixer: Words | None = None) -> list[tuple[str, str, str]]:
    """(form, initials, kind) of a value: kind "full", or "sur" for a listed person's last name alone.

    Words are put in order, so that "Holpio, Wynné" and "Wynné Holpio" have one form; single letters are initials.
    """
    text = _QUOTES.sub("", plain(_PAREN.sub(" ", value)) or plain(value)).strip(" .,;:、，。")
    if not text:
        return []
    out = []
    if _WIDE_CH.search(text):
        text = ZH_POSSESSIVE.sub("", ZH_AFTER.sub("", text))
        initials = "".join(re.findall(r"(?<![a-z])([a-z])(?![a-z])", text))
        parts = [p for p in re.split(r"[^぀-ヿ㐀-鿿ー]+", text) if p]
        if not parts:
            return []
        whole = "".join(parts)
        out.append((whole, initials, "full"))
        short = ZH_PLACE.sub("", whole)
        if short and short != whole:
            out.append((short, initials, "place"))
        if listed and len(parts) == 2:
            out.append((parts[1], parts[0][0], "sur"))
        return out
    found_words = _WORDS.findall(text)
    if fixer and len(found_words) > 1:
        found_words = [fixer.fix(w) for w in found_words]
    words = [SHORT_FORMS.get(w, w) for w in found_words]
    kept = [w for w in words if w not in TITLES]
    words = kept or words
    full = [w for w in words if len(w) > 1]
    initials = "".join(w for w in words if len(w) == 1)
    if not full:
        return []
    out.append((" ".join(sorted(full)), initials, "full"))
    if len(full) == 1 and listed:
        out.append((full[0], initials, "place"))
    if listed and len(full) == 2 and not initials:
        out.append((full[1], full[0][0], "sur"))
    if "county" in full and len(full) > 1:
        out.append((" ".join(sorted(w for w in full if w != "county")), initials, "place"))
    return list(dict.fromkeys(out))


def grams(form: str) -> list[str]:
    """The set of grams: for wide scripts characters and pairs, else pairs within padded words."""
    if _WIDE_CH.search(form):
        return sorted(set(form) | {form[i:i + 2] for i in range(len(form) - 1)})
    padded = "^" + form.replace(" ", "$^") + "$"
    return sorted({padded[i:i + 2] for i in range(len(padded) - 1)} - {"$^"})


def distance(a: str, b: str, limit: int) -> int:
    """Edits (with swaps of neighbours) from a to b; limit + 1 where there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return one[-1]


def allowed(form: str) -> int:
    """Edits that may part a value from its alias, by length."""
    n = len(form)
    if _WIDE_CH.search(form):
        return 0 if n < 3 else 1 if n < 12 else 2
    return 0 if n < 4 else 1 if n < 8 else 2


def _form_rows(df: DataFrame, column: str, keys: list[str], listed: bool, common: tuple | None = None) -> DataFrame:
    schema = ", ".join([*(f"{k} string" for k in keys), "form string", "initials string", "kind string", "grams array<string>"])

    def run(batches):
        fixer = Words(*common) if common is not None else None
        for batch in batches:
            cols: list[list] = [[] for _ in range(len(keys) + 4)]
            for row in zip(batch.column(column).to_pylist(), *(batch.column(k).to_pylist() for k in keys), strict=True):
                for form, initials, kind in forms(row[0], listed, fixer):
                    for c, v in zip(cols, (*row[1:], form, initials, kind, grams(form)), strict=True):
                        c.append(v)
            kinds = [pa.string()] * (len(keys) + 3) + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return df.mapInArrow(run, schema)


def _edits(form: str):
    """The same as allowed(), as a Column."""
    n, wide = F.length(form), F.col(form).rlike("[぀-ヿ㐀-鿿]")
    return F.when(wide, F.when(n < 3, 0).when(n < 12, 1).otherwise(2)).otherwise(F.when(n < 4, 0).when(n < 8, 1).otherwise(2))


def _prefixes(df: DataFrame, rank: DataFrame, name: str) -> DataFrame:
    """One row for each gram of the prefix: form, gram, its place, the size of the set, the edits allowed. Grams are in
    order of rarity; a gram that no alias has counts as rarest. Of each form name is the prefix of its columns."""
    each = df.select("form", F.explode("grams").alias("gram")).join(rank, "gram", "left")
    ordered = each.groupBy("form").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
    sized = ordered.select("form", F.size("g").alias("n"), _edits("form").alias("edits"), "g")
    cut = F.slice("g", F.lit(1), F.least(F.col("n"), EDIT_GRAMS * F.col("edits") + 1))
    return sized.select(F.col("form").alias(f"{name}_form"), F.col("n").alias(f"{name}_n"), F.col("edits").alias(f"{name}_edits"), F.posexplode(cut).alias(f"{name}_at", "g")).withColumn("gram", F.col("g.gram")).drop("g")


def pairs(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """Set-similarity join of forms: (v_form, a_form, jaccard) of all pairs of distinct forms that share a gram and lack at
    most EDIT_GRAMS grams of the larger set for each edit that both forms allow. values and aliases: form, grams."""
    v = values.groupBy("form").agg(F.first("grams").alias("grams"))
    a = aliases.groupBy("form").agg(F.first("grams").alias("grams"))
    rank = written(a.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")), "ranks")
    rank = F.broadcast(rank) if rank.count() <= BROADCAST_ROWS else rank
    pv, pa_ = _prefixes(v, rank, "v"), _prefixes(a, rank, "a")
    need = F.greatest("v_n", "a_n") - EDIT_GRAMS * F.least("v_edits", "a_edits")
    # length filter: neither set can have more grams than the other's and what edits add
    length = F.least("v_n", "a_n") >= need
    # positional filter: what is left behind the common gram must suffice
    left = 1 + F.least(F.col("v_n") - F.col("v_at") - 1, F.col("a_n") - F.col("a_at") - 1)
    met = pv.join(pa_, "gram").filter(length).groupBy("v_form", "a_form").agg(F.max(left >= need).alias("fits"), F.first(need).alias("need")).filter("fits")
    both = met.join(v.select(F.col("form").alias("v_form"), F.col("grams").alias("v_grams")), "v_form").join(a.select(F.col("form").alias("a_form"), F.col("grams").alias("a_grams")), "a_form")
    common = F.size(F.array_intersect("v_grams", "a_grams"))
    jaccard = common / (F.size("v_grams") + F.size("a_grams") - common)
    return both.filter(common >= F.greatest("need", F.lit(1))).select("v_form", "a_form", jaccard.alias("jaccard"))


def _checked(df: DataFrame) -> DataFrame:
    """pairs with their edit distance, those within what their length allows."""

    def run(batches):
        for batch in batches:
            v, a, j = (batch.column(c).to_pylist() for c in ("v_form", "a_form", "jaccard"))
            keep, edits = [], []
            for i, (x, y) in enumerate(zip(v, a, strict=True)):
                limit = min(allowed(x), allowed(y))
                d = distance(x, y, limit)
                # the last character of a wide form tells what kind of thing it names
                if d <= limit and not (d and _HAN.match(x[-1]) and len(x) == len(y) and x[-1] != y[-1] and len(x) < 4):
                    keep.append(i)
                    edits.append(d)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.string()), pa.array([a[i] for i in keep], pa.string()), pa.array([j[i] for i in keep], pa.float64()), pa.array(edits, pa.int32())], ["v_form", "a_form", "jaccard", "edits"])

    return df.mapInArrow(run, "v_form string, a_form string, jaccard double, edits int")


def entities(entity_map: DataFrame) -> DataFrame:
    """alias, id (without spaces), kind in lower case (of any line of the entity), initials of the entity's first names."""
    rows = entity_map.select("alias", F.regexp_replace("wikidata_id", r"\s+", "").alias("id"), F.lower(F.trim("kind")).alias("kind"))
    rows = rows.filter(F.col("alias").isNotNull() & (F.trim("alias") != "") & F.col("id").isNotNull() & (F.col("id") != ""))
    kinds = rows.groupBy("id").agg(F.max("kind").alias("kind"))
    return rows.drop("kind").distinct().join(kinds, "id").select("alias", "id", F.coalesce("kind", F.lit("")).alias("sort"))


def mapped(mentions: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Distinct (mention, label) with the id of the best alias, for those that have one. mentions: mention, label."""
    distinct = mentions.filter(F.col("mention").isNotNull() & (F.trim("mention") != "")).groupBy("mention", "label").agg(F.lit(1).alias("one")).drop("one")
    vf = written(_form_rows(distinct, "mention", ["mention", "label"], False, common_words(entity_map)), "value-forms")
    ents = entities(entity_map)
    af = written(_form_rows(ents, "alias", ["id", "sort", "alias"], True), "alias-forms")
    near = _checked(pairs(vf, af))
    first_names = af.filter("kind = 'sur'").groupBy("id").agg(F.collect_set("initials").alias("firsts"))
    with_alias = near.join(af.select(F.col("form").alias("a_form"), "id", "sort", F.col("kind").alias("a_kind"), F.col("initials").alias("a_initials")), "a_form").join(first_names, "id", "left")
    all_pairs = vf.select("mention", "label", F.col("form").alias("v_form"), F.col("initials").alias("v_initials"), F.col("kind").alias("v_kind")).join(with_alias, "v_form")
    fits_label = (
        ((F.col("label") == "PER") & F.col("sort").isin("person", ""))
        | ((F.col("label") == "LOC") & F.col("sort").isin("location", ""))
        | ((F.col("label") == "ORG") & ~F.col("sort").isin("person", "location"))
    )
    # an initial in the mention must be one of the entity's first names' or stand in the alias; a name without initials may
    # be a last name alone only where the alias list has it so, or where just one entity has that last name
    v_first = F.substring("v_initials", 1, 1)
    known = F.col("firsts").isNull() | (F.size(F.filter("firsts", lambda c: c.rlike("[a-z]"))) == 0) | F.array_contains("firsts", v_first)
    initials_fit = (
        F.when(F.col("v_initials") == "", F.col("a_initials").isin("",) | (F.col("a_kind") == "sur"))
        .when(F.col("a_kind") == "sur", known)
        .when(F.col("a_initials") != "", F.col("a_initials").contains(v_first) | F.col("v_initials").contains(F.substring("a_initials", 1, 1)))
        .otherwise(F.col("v_form").contains(" ") | known)
    )
    place_fit = (F.col("v_kind") != "place") | (F.col("label") == "LOC")
    ok = all_pairs.filter(fits_label & initials_fit & place_fit & ((F.col("a_kind") != "place") | (F.col("label") == "LOC")))
    sur_owner = af.filter("kind = 'sur'").groupBy("form").agg(F.countDistinct("id").alias("owners"))
    ok = ok.join(sur_owner.select(F.col("form").alias("a_form"), "owners"), "a_form", "left").filter((F.col("a_kind") != "sur") | (F.col("owners") == 1) | (F.col("v_initials") != ""))
    cost = F.struct((-F.col("jaccard")).alias("j"), (F.col("a_kind") == "sur").alias("derived"), "edits", "id")
    return ok.groupBy("mention", "label").agg(F.min(cost).getField("id").alias("id"))


def found(resolved: DataFrame, entity_map: DataFrame) -> DataFrame:
    """(row_id, wikidata_id) of every row with a PER, ORG or LOC label and no chosen_qid."""
    rows = resolved.filter(F.col("ner_label").isin(*LABELS) & (F.coalesce(F.trim("chosen_qid"), F.lit("")) == "")).select("row_id", "mention", F.col("ner_label").alias("label"))
    ids = mapped(rows.select("mention", "label"), entity_map)
    return rows.join(ids, ["mention", "label"], "left").select("row_id", F.coalesce("id", F.lit("")).alias("wikidata_id"))


def unmatched(resolved: DataFrame, entity_map: DataFrame) -> DataFrame:
    """The mentions that no alias reaches, with how many rows have them, most frequent first by rank."""
    done = found(resolved, entity_map).filter("wikidata_id = ''").select("row_id")
    counted = resolved.join(done, "row_id", "left_semi").groupBy("ner_label", "mention").agg(F.count("*").alias("rows"))
    # ranks are worked out over the different counts only, which are few, however many mentions there are
    levels = counted.select("ner_label", "rows").distinct()
    ranked = levels.withColumn("rank", F.dense_rank().over(Window.partitionBy("ner_label").orderBy(F.desc("rows"))))
    return counted.join(ranked, ["ner_label", "rows"]).select("ner_label", "mention", "rows", "rank")
