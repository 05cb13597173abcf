"""Outputs: stage files, graph and triple tables, summaries, tags, and tables ready for a graph database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = ("subject_qid", "seed_id", "seed_qid", "sentence_idx", "relevance_score", "reasons", "evidence_sentence", "predicate", "predicate_prop_id", "object_mention", "object_qid", "object_is_literal", "ner_label", "link_score", "citation_key", "source_url", "snippet", "extraction_method")
SNIPPET, PROP_TEXT, PROPS_JSON = 500, 2000, 4000


def stage(df: DataFrame, path: str) -> None:
    """One stage as lines of JSON; what stood there is replaced."""
    df.write.mode("overwrite").json(path)


def label_cell(labels) -> Column:
    own = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(F.when(F.array_contains(own, "Entity"), F.array().cast("array<string>")).otherwise(F.array(F.lit("Entity"))), own), lambda x: x != ""), ";")


def node_rows(nodes: DataFrame, extras: list[str] = ()) -> DataFrame:
    """Nodes as they stand in nodes.csv; extras are the props that get a column."""
    more = [F.substring(F.coalesce(F.element_at("props", k), F.lit("")), 1, PROP_TEXT).alias(k) for k in extras]
    return nodes.select(F.col("id").alias("id:ID"), F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), F.coalesce("extra", F.lit("")).alias("extra"), label_cell("labels").alias(":LABEL"), *more)


def edge_rows(edges: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Edges as they stand in relationships.csv."""
    shown = F.coalesce("prop_id", F.lit(""))
    for prop, label in (labels or {}).items():
        shown = F.when(F.col("prop_id") == prop, label).otherwise(shown)
    line = F.substring(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\r?\n", " "), 1, SNIPPET)
    return edges.select(F.col("start_id").alias(":START_ID"), F.col("end_id").alias(":END_ID"), F.col("rel_type").alias(":TYPE"), "prop_id", shown.alias("prop_label"), F.lit("OUT").alias("direction"), "provenance", "layer", "citation_key", line.alias("snippet"), "source_url", "edge_id")


def csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A table with a header, which stands there even where there are no rows. one_file puts small ones into one part."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def graph_csv(nodes: DataFrame, edges: DataFrame, folder: str, extras: list[str] = (), labels: dict[str, str] | None = None) -> None:
    csv(node_rows(nodes, extras), f"{folder}/nodes.csv")
    csv(edge_rows(edges, labels), f"{folder}/relationships.csv")


def triples_csv(triples: DataFrame, path: str) -> None:
    more = [c for c in triples.columns if c not in TRIPLE]
    csv(triples.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*TRIPLE, *more)]), path)


def summary(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """One row: the root and the numbers of nodes and edges, by layer and by provenance."""
    n = nodes.agg(F.count("*").alias("nodes"))
    by = edges.groupBy("layer", "provenance").agg(F.count("*").alias("n"))
    e = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("provenance", "n")))).alias("by_provenance"), F.coalesce(F.sum(F.when(F.col("layer") == "facts", F.col("n"))), F.lit(0)).alias("facts"))
    return n.join(F.broadcast(e)).select(F.lit(root).alias("root"), "nodes", "edges", "facts", "by_provenance")


def database_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a graph database can take: labels and relationship types of letters, digits and underscores
    only, each node and edge once, props as JSON. An edge of another type raises an error where it is computed."""
    word = "^[A-Za-z_][A-Za-z0-9_]*$"
    n = nodes.groupBy("id").agg(F.min(F.struct("name", "extra", F.filter("labels", lambda x: x.rlike(word)).alias("labels"))).alias("n")).select("id", "n.*")
    checked = F.when(F.col("rel_type").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.col("rel_type")).otherwise(F.raise_error(F.concat(F.lit("not a relationship type: "), F.coalesce("rel_type", F.lit("null")))))
    e = edges.groupBy("edge_id").agg(F.min(F.struct("start_id", "end_id", checked.alias("rel_type"), "prop_id", "provenance", "layer", "citation_key", "snippet", "source_url")).alias("e")).select("edge_id", "e.*")
    return n, e.withColumn("props", F.substring(F.to_json(F.struct("citation_key", "snippet", "source_url")), 1, PROPS_JSON))


def conll(tagged: DataFrame, path: str) -> None:
    """letters and tags of sentences as lines of token and tag, an empty line behind each sentence."""
    lines = F.array_join(F.transform(F.arrays_zip("letters", "tags"), lambda z: F.concat(z["letters"], F.lit("\t"), z["tags"])), "\n")
    tagged.select(F.concat(lines, F.lit("\n"))).write.mode("overwrite").text(path)
