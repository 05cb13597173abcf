"""Sentences routed to seeds: weighted hits, best seeds, fallback, expansion to neighbours.

Keys are (source_id, sentence_idx); neighbours are found by equality joins on shifted indexes, so that a source with
a large share of all sentences spreads over all tasks. Null sentences have no hits; repeated keys count once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Sources are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_SOURCES = 1_000_000


@dataclass(frozen=True)
class Seed:
    seed_id: str
    qid: str
    type: str
    anchors: tuple[str, ...]
    triggers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Routing:
    top_k: int = 2
    min_score: float = 0.25
    window: int = 1
    anchor: float = 1.0
    trigger: float = 0.35
    nearby: float = 0.15
    max_reasons: int = 8
    fallback_seed: str = ""
    keys: tuple[str, str] = field(default=("source_id", "sentence_idx"))


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def hits(sentences: DataFrame, seeds: list[Seed], how: Routing = Routing()) -> DataFrame:
    """One row for each sentence and seed with an anchor or a trigger: anchor_hits, trigger_hits."""
    source, idx = how.keys
    per_seed = F.array(*[
        F.struct(
            F.lit(s.seed_id).alias("seed_id"), F.lit(s.qid).alias("seed_qid"), F.lit(i).alias("seed_ord"),
            T.hits("sentence", _array(s.anchors)).alias("anchor_hits"), T.hits("sentence", _array(s.triggers)).alias("trigger_hits"),
        )
        for i, s in enumerate(seeds)
    ])
    once = sentences.filter(F.col(source).isNotNull() & F.col(idx).isNotNull()).groupBy(source, idx).agg(F.min("sentence").alias("sentence"))
    found = F.filter(per_seed, lambda s: (F.size(s["anchor_hits"]) > 0) | (F.size(s["trigger_hits"]) > 0))
    return once.select(source, idx, F.explode(found).alias("s")).select(source, idx, "s.*")


def scores(sentences: DataFrame, seeds: list[Seed], how: Routing = Routing()) -> DataFrame:
    """hits with nearby_anchor and score; sentences whose only merit is an anchor next to them are among the rows."""
    source, idx = how.keys
    own = hits(sentences, seeds, how)
    anchored = own.filter(F.size("anchor_hits") > 0)
    near = anchored.select(source, F.explode(F.array(F.col(idx) - 1, F.col(idx) + 1)).alias(idx), "seed_id", "seed_qid", "seed_ord").distinct()
    near = near.join(sentences.select(source, idx).distinct(), [source, idx], "left_semi").withColumn("nearby_anchor", F.lit(True))
    keys = [source, idx, "seed_id", "seed_qid", "seed_ord"]
    both = own.join(near, keys, "full_outer")
    empty = F.array().cast("array<string>")
    a, t = F.coalesce("anchor_hits", empty), F.coalesce("trigger_hits", empty)
    n = F.coalesce("nearby_anchor", F.lit(False))
    score = F.size(a) * how.anchor + F.size(t) * how.trigger + n.cast("int") * how.nearby
    return both.select(*keys, score.alias("score"), F.slice(a, 1, how.max_reasons).alias("anchor_hits"), F.slice(t, 1, how.max_reasons).alias("trigger_hits"), n.alias("nearby_anchor")).filter("score > 0")


def top_seeds(scored: DataFrame, how: Routing = Routing()) -> DataFrame:
    """The best seeds of each sentence; ties go to the seed that is configured first."""
    source, idx = how.keys
    order = Window.partitionBy(source, idx).orderBy(F.desc("score"), "seed_ord")
    return scored.filter(F.col("score") >= how.min_score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(how.top_k, 1))


def fallback(sentences: DataFrame, assigned: DataFrame, seed: Seed, how: Routing = Routing(), score: float | None = None) -> DataFrame:
    """All sentences of sources without any assignment go to one seed: (source, idx, seed_id, score)."""
    source, idx = how.keys
    taken = assigned.select(source).distinct()
    rest = sentences.select(source, idx).distinct().join(F.broadcast(taken) if taken.count() <= BROADCAST_SOURCES else taken, source, "left_anti")
    return rest.select(source, idx, F.lit(seed.seed_id).alias("seed_id"), F.lit(seed.qid).alias("seed_qid"), F.lit(score).cast("double").alias("score"))


def expand(assigned: DataFrame, sentences: DataFrame, how: Routing = Routing()) -> DataFrame:
    """Assigned sentences and their neighbours within the window: (source, idx, seed_id, is_base)."""
    source, idx = how.keys
    around = assigned.select(source, "seed_id", F.col(idx).alias("base"), F.explode(F.sequence(F.col(idx) - how.window, F.col(idx) + how.window)).alias(idx))
    there = around.join(sentences.select(source, idx).distinct(), [source, idx], "left_semi")
    return there.groupBy(source, idx, "seed_id").agg(F.max(F.col("base") == F.col(idx)).alias("is_base"))


def derived(assigned: DataFrame, sentences: DataFrame, how: Routing = Routing()) -> DataFrame:
    """What a sentence gets from the window: its own score, or the best base score nearby (ties: the lowest index)."""
    source, idx = how.keys
    around = assigned.select(source, "seed_id", "score", F.col(idx).alias("base"), F.explode(F.sequence(F.col(idx) - how.window, F.col(idx) + how.window)).alias(idx))
    there = around.join(sentences.select(source, idx).distinct(), [source, idx], "left_semi")
    best = there.groupBy(source, idx, "seed_id").agg(F.min(F.struct((F.col("base") != F.col(idx)).alias("other"), (-F.col("score")).alias("minus"), "base")).alias("b"))
    return best.select(source, idx, "seed_id", (-F.col("b.minus")).alias("score"), F.col("b.other").alias("window_expanded"), F.when(F.col("b.other"), F.col("b.base")).alias("window_from_sentence_idx"))


def routing_rows(sentences: DataFrame, top: DataFrame, how: Routing = Routing()) -> DataFrame:
    """One row for each sentence with the array of its assignments, in order of rank."""
    source, idx = how.keys
    reasons = F.struct("anchor_hits", "trigger_hits", "nearby_anchor")
    each = top.groupBy(source, idx).agg(F.sort_array(F.collect_list(F.struct("rank", "seed_id", "seed_qid", "score", reasons.alias("reasons")))).alias("assigned"))
    once = sentences.groupBy(source, idx).agg(F.min("sentence").alias("sentence"))
    return once.join(each, [source, idx], "left").withColumn("assigned", F.coalesce("assigned", F.expr("cast(array() as array<struct<rank:int,seed_id:string,seed_qid:string,score:double,reasons:struct<anchor_hits:array<string>,trigger_hits:array<string>,nearby_anchor:boolean>>>)")))


def lookup(assigned: Column, seed_id: Column) -> Column:
    """The first assignment of a seed in an array of assignments, or null."""
    return F.get(F.filter(assigned, lambda a: a["seed_id"] == seed_id), F.lit(0))
