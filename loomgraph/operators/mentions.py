"""Mentions in sentences: rules, gazetteer, models behind a protocol, spans from tags and tags from spans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = ("PER", "ORG", "LOC", "TIME", "DATE", "MONEY", "PERCENT")
#: Labels of general models and the labels used here.
MODEL_LABELS = {"PERSON": "PER", "PER": "PER", "GPE": "LOC", "LOC": "LOC", "FAC": "LOC", "ORG": "ORG", "DATE": "DATE", "TIME": "TIME", "MONEY": "MONEY", "PERCENT": "PERCENT"}
#: Expressions of numeric mentions, in the order in which their matches are listed.
NUMERIC = (
    ("DATE", r"((?:19|20)\d{2}年\d{1,2}月\d{1,2}[日号]|(?:19|20)\d{2}年\d{1,2}月|(?:19|20)\d{2}年)"),
    ("TIME", r"(\d{1,2}[时點点]\d{1,2}分?|\d{1,2}[时點点]|\d{1,2}:\d{2})"),
    ("PERCENT", r"(\d+(?:\.\d+)?\s*%)"),
    ("MONEY", r"([¥￥]\s*\d+(?:\.\d+)?|£\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*(?:元|人民币|美元|英镑))"),
)
#: Places that small models often miss.
GAZETTEER = ("英国", "伦敦", "英格兰", "苏格兰", "威尔士", "爱尔兰", "曼彻斯特", "普林斯顿", "剑桥", "帕丁顿", "布莱切利")


def map_label(label) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODEL_LABELS.items() for x in kv])
    return F.element_at(table, F.upper(F.col(label) if isinstance(label, str) else label))


def numeric(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric mentions of each sentence: keys, ord, mention, ner_label; each mention and label once in a sentence."""

    def of(label: str):
        return lambda m: F.struct(T.mention(m).alias("mention"), F.lit(label).alias("ner_label"))

    found = F.concat(*[F.transform(F.regexp_extract_all("sentence", F.lit(rx), F.lit(1)), of(label)) for label, rx in NUMERIC])
    kept = F.filter(F.array_distinct(found), lambda m: m["mention"] != "")
    return sentences.select(*keys, F.posexplode(kept).alias("ord", "m")).select(*keys, "ord", "m.mention", "m.ner_label")


def gazetteer(sentences: DataFrame, keys: list[str], names: Iterable[str] = GAZETTEER, label: str = "LOC") -> DataFrame:
    listed = F.array(*[F.lit(n) for n in names])
    return sentences.select(*keys, F.posexplode(T.hits("sentence", listed)).alias("ord", "mention")).withColumn("ner_label", F.lit(label))


#: Labels of listed entities by their kind; what is no person and no place counts as an organisation.
KIND_LABELS = {"person": "PER", "location": "LOC"}
#: Aliases are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_ALIASES = 200_000


def by_aliases(sentences: DataFrame, keys: list[str], listed: DataFrame) -> DataFrame:
    """Mentions of listed aliases (alias in lower case, qid, kind): keys, ord, mention, ner_label, qid, char_start, char_end.
    Aliases of other scripts than wide ones stand as whole words; an alias within a longer one at its place is left out.
    Found by equality on pairs of characters, so no sentence meets all aliases."""
    low = F.lower("sentence")
    starts = F.when(F.length(low) >= 2, F.sequence(F.lit(1), F.length(low) - 1)).otherwise(F.array().cast("array<int>"))
    rows = sentences.filter("sentence is not null").select(*keys, "sentence").distinct()
    pairs = rows.select(*keys, "sentence", F.explode(starts).alias("at")).withColumn("head", F.substring(low, F.col("at"), F.lit(2)))
    known = listed.filter(F.length("alias") >= 2).select("alias", "qid", "kind", F.substring("alias", 1, 2).alias("head"))
    hint = F.broadcast if known.count() <= BROADCAST_ALIASES else (lambda d: d)
    size = F.length("alias")
    met = pairs.join(hint(known), "head").filter(F.substring(low, F.col("at"), size) == F.col("alias"))
    word = "^[\\p{L}\\p{N}_]$"
    wide = F.col("alias").rlike("[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]")
    free = ~F.when(F.col("at") > 1, F.substring("sentence", F.col("at") - 1, F.lit(1))).otherwise("").rlike(word) & ~F.substring("sentence", F.col("at") + size, F.lit(1)).rlike(word)
    label = F.lit("ORG")
    for kind, lab in KIND_LABELS.items():
        label = F.when(F.lower(F.trim(F.coalesce("kind", F.lit("")))) == kind, lab).otherwise(label)
    spans = met.filter(wide | free).select(*keys, (F.col("at") - 1).alias("char_start"), (F.col("at") - 1 + size).alias("char_end"), F.substring("sentence", F.col("at"), size).alias("mention"), label.alias("ner_label"), "qid")
    all_ = spans.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end", "mention", "ner_label", "qid"))).alias("all"))
    inside = lambda m: F.exists("all", lambda o: (o["char_start"] <= m["char_start"]) & (o["char_end"] >= m["char_end"]) & (o["char_end"] - o["char_start"] > m["char_end"] - m["char_start"]))
    return all_.select(*keys, F.posexplode(F.filter("all", lambda m: ~inside(m))).alias("ord", "m")).select(*keys, "ord", "m.mention", "m.ner_label", "m.qid", "m.char_start", "m.char_end")


def drop_unlinked(rows: DataFrame, root: str = "seed_qid") -> DataFrame:
    """Mentions without those of persons, organisations and places that are linked to nothing or to the root itself;
    numbers and dates stay, as they are never linked. rows: ner_label, qid, and the column root."""
    qid = F.coalesce("qid", F.lit(""))
    return rows.filter(~F.col("ner_label").isin("PER", "ORG", "LOC") | (qid != "") & (qid != F.coalesce(root, F.lit(""))))


def of_tagger(spans: DataFrame, sentences: DataFrame, group: list[str], root: str = "seed_qid") -> DataFrame:
    """Spans of a tagger, which tells only their sentence's text: mentions of two characters or more, each entity, mention
    and label once in a group; what isn't linked stays as a literal; the sentence's index is that of the first equal
    sentence of the group, -1 where there is none. spans: group, ord, mention, ner_label, qid, evidence, root."""
    qid = F.when(F.col("ner_label").isin("PER", "ORG", "LOC") & (F.coalesce("qid", F.lit("")) != F.coalesce(root, F.lit(""))), F.coalesce("qid", F.lit(""))).otherwise("")
    rows = spans.withColumns({"mention": T.strip("mention"), "qid": qid, "said": T.strip("evidence")}).filter(F.length("mention") >= 2)
    first = rows.groupBy(*group, "qid", F.lower("mention").alias("low"), "ner_label").agg(F.min(F.struct("ord", "mention", "said")).alias("f")).select(*group, "qid", "ner_label", "f.ord", "f.mention", "f.said")
    places = sentences.groupBy(*group, T.strip("sentence").alias("said")).agg(F.min("sentence_idx").alias("sentence_idx"))
    return first.join(places, [*group, "said"], "left").select(*group, "ord", "mention", "ner_label", "qid", F.coalesce("sentence_idx", F.lit(-1)).alias("sentence_idx"))


Backend = Callable[[], Callable[[list[str]], list[list[tuple[str, str, int, int]]]]]


def by_model(sentences: DataFrame, keys: list[str], backend: Backend) -> DataFrame:
    """Mentions by a model. backend is called once in each worker and gives a function from sentences to lists of
    (mention, model label, begin, end); labels that aren't known here are dropped."""
    fields = {f.name: f.dataType.simpleString() for f in sentences.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), "ord int, mention string, model_label string, char_start int, char_end int"])

    def run(batches: Iterator[pa.RecordBatch]):
        tag = backend()
        for batch in batches:
            texts = [t or "" for t in batch.column("sentence").to_pylist()]
            rows = [(i, j, *m) for i, spans in enumerate(tag(texts)) for j, m in enumerate(spans)]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(k).take(at) for k in keys]
            rest = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.int32()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *rest], [*keys, "ord", "mention", "model_label", "char_start", "char_end"])

    found = sentences.select(*keys, "sentence").mapInArrow(run, schema)
    return found.withColumn("ner_label", map_label("model_label")).filter("ner_label is not null").drop("model_label")


def choose_backend(source_id, overrides: dict[str, str], default: str = "rules") -> Column:
    """The backend of a source: by its exact key, else by a file name that is part of the key, whatever its case."""
    s = F.col(source_id) if isinstance(source_id, str) else source_id
    out = F.lit(default)
    for key, backend in reversed(list(overrides.items())):
        if key.startswith("file:"):
            out = F.when(F.contains(F.lower(s), F.lit(key[len("file:"):].lower())), backend).otherwise(out)
    for key, backend in overrides.items():
        out = F.when(s == key, backend).otherwise(out)
    return out


def first_in_group(mentions: DataFrame, group: list[str], key: Iterable[str], order: list[str]) -> DataFrame:
    """Of equal mentions in a group the first one stays."""
    rank = F.row_number().over(Window.partitionBy(*group, *[F.lower(k) if k == "mention" else F.col(k) for k in key]).orderBy(*order))
    return mentions.withColumn("nth", rank).filter("nth = 1").drop("nth")


def suppress_roots(persons: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Person spans without those that overlap an anchor span of their sentence, and without those in sentences that
    have no anchor. persons and anchors: keys, char_start, char_end."""
    a = anchors.select(*keys, F.col("char_start").alias("a0"), F.col("char_end").alias("a1"))
    spans = a.groupBy(*keys).agg(F.collect_set(F.struct("a0", "a1")).alias("spans"))
    both = persons.join(spans, keys)
    return both.filter(~F.exists("spans", lambda s: T.overlaps(F.col("char_start"), F.col("char_end"), s["a0"], s["a1"]))).drop("spans")


def drop_self(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.coalesce("qid", F.lit("")) != F.col("seed_qid"))


def spans_from_tags(tags: DataFrame, keys: list[str], text: str = "token") -> DataFrame:
    """Spans of BIO tags: keys, pos, tag and the token give keys, label, begin, end, mention. A stray I, or one of
    another label, belongs to no span; unknown labels are skipped."""
    order = Window.partitionBy(*keys).orderBy("pos")
    label = F.regexp_extract("tag", "^[BI]-(.+)$", 1)
    marked = tags.withColumn("label", label).withColumn("head", F.substring("tag", 1, 1))
    prev = F.lag(F.struct("head", "label")).over(order)
    # a new run begins at every B, O or change of label; only runs that begin with B are spans
    fresh = (F.col("head") != "I") | prev.isNull() | (prev["label"] != F.col("label")) | (prev["head"] == "O")
    runs = marked.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(order)).filter("head <> 'O'")
    whole = runs.groupBy(*keys, "run", "label").agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end"), F.min_by("head", "pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", F.col(text).alias("t")))).alias("parts"))
    known = whole.filter((F.col("first") == "B") & F.col("label").isin(*LABELS))
    return known.select(*keys, "label", "begin", "end", F.array_join(F.col("parts.t"), "").alias("mention"))


def tags_from_mentions(sentences: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Weak BIO tags of a sentence's characters: longer mentions first, a mention that meets a tagged place is refused.

    The fold over a sentence's mentions depends on their order, so it runs in Arrow batches; each batch holds whole
    sentences with all their mentions, gathered by key.
    """
    gathered = mentions.filter("mention <> ''").groupBy(*keys).agg(F.collect_set(F.struct("mention", "ner_label")).alias("found"))
    rows = sentences.join(gathered, keys, "left").select(*keys, T.chars("sentence").alias("letters"), "found")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), "letters array<string>, tags array<string>"])

    def run(batches):
        for batch in batches:
            out = []
            for letters, found in zip(batch.column("letters").to_pylist(), batch.column("found").to_pylist(), strict=True):
                tags = ["O"] * len(letters or [])
                joined = "".join(letters or [])
                for m in sorted(found or [], key=lambda m: (-len(m["mention"]), m["mention"], m["ner_label"])):
                    name = "".join(m["mention"].split())
                    at = joined.find(name)
                    while name and at >= 0:
                        if all(t == "O" for t in tags[at:at + len(name)]):
                            tags[at:at + len(name)] = [f"B-{m['ner_label']}"] + [f"I-{m['ner_label']}"] * (len(name) - 1)
                        at = joined.find(name, at + 1)
                out.append(tags)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("letters"), pa.array(out, pa.list_(pa.string()))], [*keys, "letters", "tags"])

    return rows.mapInArrow(run, schema)


def char_features(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Features of each character: itself, its shape, its neighbours and the pairs with them; BOS and EOS at the ends."""
    letters = T.chars("sentence")
    each = sentences.select(*keys, letters.alias("l")).select(*keys, "l", F.posexplode("l").alias("pos", "c"))
    before = F.when(F.col("pos") == 0, "BOS").otherwise(F.get("l", F.col("pos") - 1))
    after = F.when(F.col("pos") == F.size("l") - 1, "EOS").otherwise(F.get("l", F.col("pos") + 1))
    return each.select(*keys, "pos", "c", T.char_shape("c").alias("shape"), before.alias("before"), after.alias("after"), F.concat(before, F.col("c")).alias("pair_before"), F.concat(F.col("c"), after).alias("pair_after"))
