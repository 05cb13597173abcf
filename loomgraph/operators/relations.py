"""Relations by templates, and the triples that they and linked mentions give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Expression with one slot, predicate, property, method.
ZH_TEMPLATES = (
    (r"毕业于([^。！？；\n]{2,50})", "educated_at", "P69", "zh_template"),
    (r"就读于([^。！？；\n]{2,50})", "educated_at", "P69", "zh_template"),
    (r"出生于([^。！？；\n]{2,50})", "place_of_birth", "P19", "zh_template"),
    (r"逝世于([^。！？；\n]{2,50})", "place_of_death", "P20", "zh_template"),
    (r"在([^。！？；\n]{2,40})工作", "work_location", "P937", "zh_template"),
    (r"任职于([^。！？；\n]{2,50})", "employer", "P108", "zh_template"),
)
_NAME = r"((?:[A-ZÀ-ſ][\wÀ-ſ'-]*)(?: (?:of|the|and|[A-ZÀ-ſ][\wÀ-ſ'-]*))*)"
#: Surface forms that stand for a parser: a verb, its preposition, and a name after them.
EN_TEMPLATES = (
    (rf"\bborn (?:in|at) {_NAME}", "place_of_birth", "P19", "en_surface"),
    (rf"\b(?:work(?:s|ed)?|serv(?:es|ed)|lectur(?:es|ed)) (?:at|in|for) {_NAME}", "employer", "P108", "en_surface"),
    (rf"\bjoined {_NAME}", "employer", "P108", "en_surface"),
    (rf"\b(?:studied|read|graduated) (?:at|in|from) {_NAME}", "educated_at", "P69", "en_surface"),
    (rf"\b(?:lived|resided|stayed) (?:at|in) {_NAME}", "residence", "P551", "en_surface"),
    (rf"\bdied (?:at|in) {_NAME}", "place_of_death", "P20", "en_surface"),
)


def slots(sentences: DataFrame, keys: list[str], templates=ZH_TEMPLATES) -> DataFrame:
    """Every match: keys, ord, slot, predicate, prop_id, method. Slots of fewer than two characters are dropped."""

    def of(predicate: str, prop: str, method: str):
        return lambda m: F.struct(T.zh_slot(m).alias("slot"), F.lit(predicate).alias("predicate"), F.lit(prop).alias("prop_id"), F.lit(method).alias("method"))

    found = F.concat(*[F.transform(F.regexp_extract_all("sentence", F.lit(rx), F.lit(1)), of(*rest)) for rx, *rest in templates])
    each = sentences.select(*keys, F.posexplode(found).alias("ord", "m")).select(*keys, "ord", "m.*")
    return each.filter(F.length("slot") >= 2)


def pattern_relations(matched: DataFrame, links: DataFrame, keys: list[str], root: str = "") -> DataFrame:
    """Matches whose slot is linked (links: mention, qid), each entity and predicate once in a sentence."""
    linked = matched.join(links.select(F.col("mention").alias("slot"), "qid"), "slot").filter((F.col("qid") != "") & (F.col("qid") != root))
    return linked.groupBy(*keys, "qid", "predicate").agg(F.min(F.struct("ord", F.substring("slot", 1, 120).alias("object_mention"), "prop_id", "method")).alias("f")).select(*keys, "qid", "predicate", "f.object_mention", "f.prop_id", "f.method")


def anchored(rows: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """The rows whose sentence has one of the anchors."""
    return rows.filter(F.size(T.hits("sentence", F.array(*[F.lit(a) for a in anchors]))) > 0) if anchors else rows.limit(0)


def of_group(rows: DataFrame, links, group: list[str], zh=ZH_TEMPLATES, en=EN_TEMPLATES, min_zh: float = 0.12) -> DataFrame:
    """Relations of the sentences of each group (such as a source and a seed): the group's whole text decides on one
    language, whose templates are tried; of equal entity, predicate and mention (its first 40 characters) in a group the
    first one stays. rows: group, sentence_idx, sentence, root. links: a function from mentions to (mention, qid)."""
    han = F.regexp_count("sentence", F.lit("[\\x{4e00}-\\x{9fff}]"))
    kept = rows.filter(F.trim(F.coalesce("sentence", F.lit(""))) != "").select(*group, "sentence_idx", T.strip("sentence").alias("sentence"), "root")
    share = kept.groupBy(*group).agg((F.sum(han) / F.greatest(F.sum(F.length("sentence")) + F.count("*") - 1, F.lit(1)) >= min_zh).alias("is_zh"))
    told = kept.join(share, group)
    keys = [*group, "sentence_idx"]
    found = slots(told.filter("is_zh"), keys, zh).unionByName(slots(told.filter("not is_zh"), keys, en))
    linked = found.join(links(found.select(F.col("slot").alias("mention"))).select(F.col("mention").alias("slot"), "qid"), "slot").join(kept.select(*keys, "root").distinct(), keys)
    linked = linked.filter((F.coalesce("qid", F.lit("")) != "") & (F.col("qid") != F.coalesce("root", F.lit("")))).withColumn("short", F.substring("slot", 1, 40))
    first = linked.groupBy(*group, "qid", "predicate", "short").agg(F.min(F.struct("sentence_idx", "ord", "slot", "prop_id", "method", "root")).alias("f"))
    return first.select(*group, "f.sentence_idx", "qid", "predicate", F.substring("f.slot", 1, 120).alias("object_mention"), "f.prop_id", "f.method", "f.root")


def edge_rows(relations: DataFrame) -> DataFrame:
    """Relations as contributions of edges, for a run that takes them into the graph (off by default): rows for graph.edges.
    relations: root, qid, prop_id, predicate, method, sentence, source_label, source_url, citation_key."""
    snippet = F.concat(F.lit("["), F.coalesce("source_label", F.lit("")), F.lit("] "), F.substring("sentence", 1, 280), F.lit(" | link=1.00 method="), "method")
    return relations.select(F.col("root").alias("start_id"), F.col("qid").alias("end_id"), "prop_id", "predicate", F.lit("pattern_relation_extraction").alias("provenance"), "citation_key", snippet.alias("snippet"), "source_url")


def triples(rows: DataFrame) -> DataFrame:
    """The eighteen columns of a triple, all of them text. rows: subject_qid, seed_id, seed_qid, sentence_idx, relevance,
    reasons, sentence, predicate, prop_id, mention, qid, ner_label, score, citation_key, source_url, source_label, method."""
    literal = F.coalesce("qid", F.lit("")) == ""
    return rows.select(
        "subject_qid", "seed_id", "seed_qid", F.col("sentence_idx").cast("string").alias("sentence_idx"),
        F.coalesce(T.score_text("relevance"), F.lit("")).alias("relevance_score"), F.coalesce("reasons", F.lit("")).alias("reasons"),
        F.substring("sentence", 1, 500).alias("evidence_sentence"), "predicate", F.coalesce("prop_id", F.lit("")).alias("predicate_prop_id"),
        F.col("mention").alias("object_mention"), F.coalesce("qid", F.lit("")).alias("object_qid"), F.when(literal, "1").otherwise("0").alias("object_is_literal"),
        F.coalesce("ner_label", F.lit("")).alias("ner_label"), F.coalesce(T.score_text("score"), F.lit("")).alias("link_score"), F.coalesce("citation_key", F.lit("")).alias("citation_key"),
        "source_url", F.concat(F.lit("["), F.coalesce("source_label", F.lit("")), F.lit("] "), F.substring("sentence", 1, 480)).alias("snippet"), F.col("method").alias("extraction_method"),
    )
