"""Triples of one statement fused into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LIST = 32
#: Fields that the first row of a statement gives.
FIRST = ("subject_qid", "object_qid", "object_mention", "ner_label", "citation_key", "seed_qid", "predicate_prop_id", "object_is_literal", "reasons")


def object_key() -> Column:
    """The object's identity: its QID, or for literals label and text."""
    qid = F.coalesce(F.trim("object_qid"), F.lit(""))
    return F.when(qid != "", F.concat(F.lit("qid:"), qid)).otherwise(F.concat(F.lit("lit:"), F.coalesce("ner_label", F.lit("")), F.lit(":"), F.lower(F.coalesce(F.trim("object_mention"), F.lit("")))))


def _longest(column: str, order: str) -> Column:
    return F.max_by(column, F.struct(F.length(F.coalesce(column, F.lit(""))), -F.col(order)))


def merge(triples: DataFrame, order: str = "row_id", by_source: bool = True) -> DataFrame:
    """One row for each statement: highest scores, all methods, the longest evidence, the first row's other fields.

    Statements are of one source by default; by_source=False leaves the source out of the key. Empty and unreadable
    scores don't count; null fields are as empty ones.
    """
    rows = triples.withColumn("obj", object_key())
    keys = ["seed_id", "sentence_idx", "predicate", "obj", *(["source_url"] if by_source else [])]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(F.try_to_number(F.nullif(F.trim("relevance_score"), F.lit("")), F.lit("9999999.9999")).cast("double")).alias("relevance"),
        F.max(F.try_to_number(F.nullif(F.trim("link_score"), F.lit("")), F.lit("9999999.9999")).cast("double")).alias("link"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("extraction_method", F.lit("")))), "|").alias("methods"),
        _longest("evidence_sentence", order).alias("evidence_sentence"),
        _longest("snippet", order).alias("snippet"),
        F.min_by(F.struct(*[c for c in FIRST if c in rows.columns]), order).alias("f"),
        F.min(order).alias("first_row"),
    )
    return out.select(*keys, "n", "relevance", "link", "methods", "evidence_sentence", "snippet", "f.*", "first_row")


REASONS = "anchor_hits array<string>, trigger_hits array<string>, nearby_anchor boolean, window_expanded boolean, window_from_sentence_idx int"
LISTS = ("anchor_hits", "trigger_hits")


def merge_reasons(triples: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """Reasons (JSON) fused: lists united up to MAX_LIST entries in order, flags by or, numbers by maximum. Text that isn't
    whole JSON gives nothing. Entries are made distinct, ranked and cut before they are gathered."""
    parsed = triples.withColumn("r", F.from_json(F.when(F.try_parse_json("reasons").isNotNull(), F.col("reasons")), REASONS))
    out = parsed.groupBy(*keys).agg(
        F.max(F.coalesce("r.nearby_anchor", F.lit(False))).alias("nearby_anchor"), F.max(F.coalesce("r.window_expanded", F.lit(False))).alias("window_expanded"),
        F.max("r.window_from_sentence_idx").alias("window_from_sentence_idx"),
    )
    same = lambda other: [F.col(f"o.{k}").eqNullSafe(other[f"k_{k}"]) for k in keys]
    for name in LISTS:
        each = parsed.select(*keys, order, F.posexplode(f"r.{name}").alias("at", "v"))
        once = each.groupBy(*keys, "v").agg(F.min(F.struct(order, "at")).alias("o"))
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("o"))
        cut = once.withColumn("nth", nth).filter(F.col("nth") <= MAX_LIST)
        lists = cut.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias(name))
        out = out.alias("o").join(lists, same(lists), "left").drop(*[f"k_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select(*keys, *LISTS, "nearby_anchor", "window_expanded", "window_from_sentence_idx")


def reasons_json(merged: DataFrame) -> DataFrame:
    """Fused reasons written as JSON again (column reasons); fields without a value are left out."""
    return merged.withColumn("reasons", F.to_json(F.struct(*LISTS, "nearby_anchor", "window_expanded", "window_from_sentence_idx"))).drop(*LISTS, "nearby_anchor", "window_expanded", "window_from_sentence_idx")
