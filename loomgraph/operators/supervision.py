"""Distant supervision: bags of sentences, labels from claims, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SPLIT_SEED = "42"


def bag_cells(resolved: DataFrame, sentences: DataFrame, min_zh: float = 0.3) -> DataFrame:
    """Sentences of bags: linked mentions other than the seed in their sentences, one row for each bag and sentence, with
    the first mention and label. Both sides are put together by (source_id, sentence_idx)."""
    linked = resolved.filter(F.coalesce("chosen_qid", F.lit("")).startswith("Q") & (F.col("chosen_qid") != F.col("seed_qid")))
    rows = linked.select("source_id", "sentence_idx", "seed_id", "seed_qid", F.col("chosen_qid").alias("object_qid"), "mention", "ner_label")
    once = sentences.filter(T.zh_ratio("sentence") >= min_zh).groupBy("source_id", "sentence_idx").agg(F.min("sentence").alias("sentence"))
    both = rows.join(once, ["source_id", "sentence_idx"])
    bag = F.concat_ws("|", "source_id", "seed_id", "object_qid")
    return both.withColumn("bag_id", bag).groupBy("bag_id", "source_id", "seed_id", F.col("seed_qid").alias("subject_qid"), "object_qid", "sentence_idx").agg(F.min("sentence").alias("sentence"), F.min("mention").alias("mention"), F.min("ner_label").alias("ner_label"))


def bags(cells: DataFrame) -> DataFrame:
    """One row for each bag: its mentions and its instances in the order of their sentences. The sentences of a bag are
    those of one source about one entity."""
    return cells.groupBy("bag_id", "source_id", "seed_id", "subject_qid", "object_qid").agg(
        F.sort_array(F.collect_set("mention")).alias("object_mention_set"),
        F.sort_array(F.collect_list(F.struct("sentence_idx", "sentence", "mention", "ner_label"))).alias("instances"),
    )


def label_space(seeds: DataFrame, by_type: DataFrame, by_seed: DataFrame | None = None) -> DataFrame:
    """seed_id, space: the properties allowed for a seed, by itself or by its type. by_type: seed_type, prop_id."""
    typed = seeds.join(by_type.groupBy("seed_type").agg(F.sort_array(F.collect_set("prop_id")).alias("space")), "seed_type", "left")
    if by_seed is None:
        return typed.select("seed_id", "seed_type", F.coalesce("space", F.array().cast("array<string>")).alias("space"))
    own = by_seed.groupBy("seed_id").agg(F.sort_array(F.collect_set("prop_id")).alias("own"))
    return typed.join(own, "seed_id", "left").select("seed_id", "seed_type", F.coalesce("own", "space", F.array().cast("array<string>")).alias("space"))


def labels(bag_keys: DataFrame, facts: DataFrame, spaces: DataFrame) -> DataFrame:
    """Bags with labels_space and labels_pos, the properties of facts (subject, prop_id, target_qid) within it."""
    spaced = bag_keys.join(F.broadcast(spaces), "seed_id", "left").withColumn("space", F.coalesce("space", F.array().cast("array<string>")))
    pairs = spaced.select("subject_qid", "object_qid").distinct()
    held = facts.select(F.col("subject").alias("subject_qid"), F.col("target_qid").alias("object_qid"), "prop_id").join(pairs, ["subject_qid", "object_qid"], "left_semi").groupBy("subject_qid", "object_qid").agg(F.sort_array(F.collect_set("prop_id")).alias("held"))
    both = spaced.join(held, ["subject_qid", "object_qid"], "left")
    pos = F.coalesce(F.array_intersect("held", "space"), F.array().cast("array<string>"))
    return both.withColumn("labels_pos", pos).withColumnRenamed("space", "labels_space").drop("held")


def multiclass(labelled: DataFrame, keep_several: bool = False) -> DataFrame:
    """One label for each bag: its only positive one, NA without any; bags with several go, or keep the first."""
    n = F.size("labels_pos")
    rows = labelled if keep_several else labelled.filter(n <= 1)
    return rows.withColumn("label", F.when(F.size("labels_pos") > 0, F.get("labels_pos", F.lit(0))).otherwise("NA"))


def by_hash(df: DataFrame, key: str, seed: str = SPLIT_SEED):
    return df.withColumn("draw", F.sha1(F.concat_ws("|", F.col(key), F.lit(seed))))


def _place(df: DataFrame, key: str, group: list[str] | None = None, bins: int = 1024) -> DataFrame:
    """df with place, the 0-based rank by the hash of its key: counted by bins first, so no window sees all rows."""
    drawn = by_hash(df, key).withColumn("bin", (F.conv(F.substring("draw", 1, 5), 16, 10).cast("bigint") * bins / (1 << 20)).cast("int"))
    counts = drawn.groupBy("bin").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    ranked = drawn.join(F.broadcast(before), "bin")
    return ranked.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("draw", key)) - 1).drop("bin", "before", "draw")


def down_sample(dataset: DataFrame, ratio: float = 3.0, most_without: int = 200) -> DataFrame:
    """All positive bags and, by hash, ratio times as many without a label; most_without where there is no positive one."""
    pos = dataset.filter("label <> 'NA'")
    n = pos.count()
    keep = 0 if ratio <= 0 else int(n * ratio) if n else most_without
    na = _place(dataset.filter("label = 'NA'"), "bag_id").filter(F.col("place") < keep).drop("place")
    return pos.unionByName(na)


def split(dataset: DataFrame, train: float = 0.8, dev: float = 0.1, key: str = "bag_id") -> DataFrame:
    """dataset with split: by the hash of the key, the first share train, the next dev, the rest test."""
    n = dataset.count()
    a, b = int(n * train), int(n * dev)
    placed = _place(dataset, key)
    return placed.withColumn("split", F.when(F.col("place") < a, "train").when(F.col("place") < a + b, "dev").otherwise("test")).drop("place")


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """c, n, id: characters by frequency, then by themselves; identifiers begin at 2. As many rows as characters in use."""
    each = texts.select(F.explode(F.filter(F.split(column, ""), lambda c: c != "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return each.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "c")) + 1).cast("int"))


def entity_places(text, anchors, mention):
    """(e1, e2): places of the seed's earliest anchor (0 without one) and of the mention (1 without it, or the last
    place), apart from each other and within the text."""
    last = F.greatest(F.length(text) - 1, F.lit(0))
    e1 = F.coalesce(T.first_place(text, anchors), F.lit(0))
    at = F.instr(text, F.col(mention)) - 1 if isinstance(mention, str) else F.position(mention, F.col(text)) - 1
    e2 = F.when(at >= 0, at).otherwise(F.least(F.lit(1), last))
    apart = F.when(e1 == e2, F.least(e1 + 1, last)).otherwise(e2)
    return F.least(F.least(e1, apart), last), F.least(F.greatest(e1, apart), last)
