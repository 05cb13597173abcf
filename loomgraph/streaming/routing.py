"""Sentences routed as they arrive, and windowed counts of what was found: an extension, the batch runs don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.routing import Routing, Seed, hits


def sentences(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of sentence files, one file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def own_scores(stream: DataFrame, seeds: list[Seed], how: Routing = Routing()) -> DataFrame:
    """Scores without what neighbours add, which may not have arrived."""
    per_seed = F.array(*[
        F.struct(F.lit(s.seed_id).alias("seed_id"), (F.size(T.hits("sentence", F.array(*[F.lit(a) for a in s.anchors]))) * how.anchor + F.size(T.hits("sentence", F.array(*[F.lit(t) for t in s.triggers]))) * how.trigger).alias("score"))
        for s in seeds
    ])
    each = stream.select("*", F.explode(F.filter(per_seed, lambda s: s["score"] >= how.min_score)).alias("s"))
    return each.select(*stream.columns, "s.*")


def counts(stream: DataFrame, seeds: list[Seed], at: str = "ingested_at", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sentences and mean score for each seed and tumbling window; rows later than the watermark are left out."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    scored = own_scores(timed.withWatermark(at, late), seeds)
    return scored.groupBy(F.window(at, width).alias("w"), "seed_id").agg(F.count("*").alias("sentences"), F.round(F.avg("score"), 6).alias("mean_score")).select(F.col("w.start").alias("day"), "seed_id", "sentences", "mean_score")


__all__ = ["counts", "hits", "own_scores", "sentences"]
