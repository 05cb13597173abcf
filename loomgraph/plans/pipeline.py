"""Whole runs: from texts, from curated stages, and from an exported graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from ..operators import events, fusion, graph, inference, linking, mentions, relations, routing, supervision
from ..sources import readers, sinks


def linked_sentences(resolved: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences with a mention, for each seed with the array of what is linked there, in the order of rows."""
    one = F.struct("row_id", F.coalesce("chosen_qid", F.lit("")).alias("qid"), F.col("mention"), F.coalesce("ner_label", F.lit("")).alias("ner_label"))
    rows = resolved.filter("mention is not null").groupBy("source_id", "seed_id", "seed_qid", "sentence_idx").agg(F.sort_array(F.collect_list(one)).alias("l"))
    once = sentences.groupBy("source_id", "sentence_idx").agg(F.min("sentence").alias("sentence"))
    both = rows.join(once, ["source_id", "sentence_idx"])
    return both.withColumn("linked", F.transform("l", lambda m: F.struct(m["qid"].alias("qid"), m["mention"].alias("mention"), m["ner_label"].alias("ner_label")))).drop("l")


def names(entity_map: DataFrame) -> DataFrame:
    """mention, qid of listed aliases as they are written."""
    rows = entity_map.select("line_no", F.trim("alias").alias("mention"), F.regexp_replace("wikidata_id", r"\s+", "").alias("qid"))
    return rows.filter("coalesce(mention, '') <> '' and coalesce(qid, '') <> ''").groupBy("mention").agg(F.max_by("qid", "line_no").alias("qid"))


EDGE = ("edge_id", "start_id", "end_id", "prop_id", "rel_type", "provenance", "layer", "citation_key", "snippet", "source_url")


def event_edges(found: DataFrame) -> DataFrame:
    """Edges from canonical events to their arguments, in the columns of all edges."""
    e = events.edges(found)
    return e.select(T.stable_id("", "start_id", "end_id", "rel_type", "provenance").alias("edge_id"), "start_id", "end_id", F.lit("").alias("prop_id"), "rel_type", "provenance", F.lit("evidence").alias("layer"), *[F.lit("").alias(c) for c in ("citation_key", "snippet", "source_url")])


def assembled(all_edges: DataFrame, canon: DataFrame, claims: DataFrame, entity_map: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Nodes of all edges: names and kinds of listed entities, canonical events, literals by their mention, contributions of
    the structured layer (more: id, name, extra, labels, ord), and for entities without a kind what their types give."""
    ends = all_edges.select(F.col("start_id").alias("id")).unionByName(all_edges.select(F.col("end_id").alias("id"))).distinct()
    none, nothing = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")

    def part(df, ord_no, name=None, labels=None, extra=None, props=None):
        text = F.lit("")
        return df.select("id", (text if name is None else name).alias("name"), (text if extra is None else extra).alias("extra"), (none if labels is None else labels).alias("labels"), (nothing if props is None else props).alias("props"), F.lit(ord_no).alias("ord"))

    listed = names(entity_map).groupBy(F.col("qid").alias("id")).agg(F.min("mention").alias("name")).join(ends, "id", "left_semi")
    kinds = linking.kinds(entity_map).withColumnRenamed("qid", "id").join(ends, "id", "left_semi")
    found = canon.withColumnRenamed("can_id", "id")
    rows = [
        part(ends, 0), part(listed, 1, name=F.col("name")), part(kinds, 2, labels=F.array(F.initcap(F.trim("kind")))),
        part(found, 3, name=F.col("name"), labels=F.array(F.lit("Event"), F.col("event_type")), props=F.create_map(F.lit("evidence_count"), F.col("evidence_count").cast("string"))),
        part(ends.filter(F.col("id").startswith("LIT_")), 4, labels=F.array(F.lit("Literal"))),
    ]
    if more is not None:
        rows.append(more.select("id", "name", "extra", "labels", nothing.alias("props"), "ord"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    typed = graph.labels_of_types(claims.filter(F.col("prop_id").isin("P31", "P279")).join(ends.select(F.col("id").alias("subject")), "subject", "left_semi"))
    return graph.enrich_kinds(graph.nodes(every), typed)


def from_curated(sentences: DataFrame, resolved: DataFrame, triples: DataFrame, entity_map: DataFrame, claims: DataFrame, person_seed: str, concept_seed: str) -> dict[str, DataFrame]:
    """Events, fused triples, nodes and edges from stages that are at hand; what several results need is written first."""
    claims = written(claims, "claims")
    found = written(events.extract(linked_sentences(resolved, sentences), names(entity_map), person_seed, concept_seed), "events")
    canon = written(events.canonical(found), "canonical")
    all_edges = written(graph.outgoing(claims).select(*EDGE).unionByName(event_edges(found)), "edges")
    return {"events": found, "canonical": canon, "triples": fusion.merge(triples), "nodes": assembled(all_edges, canon, claims, entity_map), "edges": all_edges}


KEYS = ["source_id", "sentence_idx", "seed_id"]


def items(sentences: DataFrame, seeds: list, how: routing.Routing = routing.Routing()) -> DataFrame:
    """The sentences of each seed: those attributed to it, with score and reasons of what they were attributed by, and all
    sentences of sources without any attribution for the first seed. Columns: those of sentences, seed_id, seed_qid,
    relevance, reasons."""
    spark = sentences.sparkSession
    place = ["source_id", "sentence_idx"]
    table = F.broadcast(spark.createDataFrame([(s.seed_id, s.qid) for s in seeds], "seed_id string, seed_qid string"))
    top = written(routing.top_seeds(routing.scores(sentences, seeds, how), how), "routing")
    given = routing.derived(top, sentences, how).withColumn("base", F.coalesce("window_from_sentence_idx", "sentence_idx"))
    why = top.select("source_id", "seed_id", F.col("sentence_idx").alias("base"), "anchor_hits", "trigger_hits", "nearby_anchor")
    told = given.join(why, ["source_id", "seed_id", "base"], "left")
    reasons = F.to_json(F.struct("anchor_hits", "trigger_hits", "nearby_anchor", "window_expanded", "window_from_sentence_idx"))
    own = told.select(*place, "seed_id", F.col("score").alias("relevance"), reasons.alias("reasons"))
    rest = routing.fallback(sentences, top, seeds[0], how).select(*place, "seed_id", F.lit(0.0).alias("relevance"), F.lit('{"unattributed":true}').alias("reasons"))
    once = sentences.groupBy(*place).agg(F.min(F.struct("sentence", "source_url", "source_label", "citation_key")).alias("s")).select(*place, "s.*")
    return own.unionByName(rest).join(once, place).join(table, "seed_id")


def recognised(rows: DataFrame, entity_map: DataFrame, backend: mentions.Backend | None = None) -> DataFrame:
    """Mentions of the items: listed aliases, numbers and dates, and those of a model where one is given. Columns: those of
    the items, ord, mention, ner_label."""
    place = ["source_id", "sentence_idx"]
    listed = linking.aliases(entity_map).join(linking.kinds(entity_map), "qid", "left").select("alias", "qid", "kind")
    once = rows.select(*place, "sentence").distinct()
    found = mentions.by_aliases(once, place, listed).select(*place, "ord", "mention", "ner_label")
    if backend is not None:
        found = found.unionByName(mentions.by_model(once, place, backend).select(*place, (F.col("ord") + 10_000).alias("ord"), T.mention("mention").alias("mention"), "ner_label"))
    numbers = mentions.numeric(once, place).select(*place, (F.col("ord") + 20_000).alias("ord"), "mention", "ner_label")
    return found.unionByName(numbers).join(rows, place)


def resolved_of(found: DataFrame, entity_map: DataFrame, claims: DataFrame, min_score: float = linking.MIN_SCORE, props: tuple = ("P31", "P279", "P361", "P17", "P27", "P108", "P166")) -> DataFrame:
    """Mentions with their entities: links with their audit, joint choice within windows where there are candidates, numbers
    as literals; mentions of the seed itself and unlinked names are left out, of equal ones in a source and seed the first
    stays. Columns: row_id, those of resolved mentions, and sentence, relevance, reasons of their item."""
    names_ = found.filter(F.col("ner_label").isin("PER", "ORG", "LOC"))
    links = written(linking.audited(names_.select("mention", F.col("sentence").alias("context")), linking.aliases(entity_map), min_score), "links")
    both = names_.join(links.withColumnRenamed("context", "sentence"), ["mention", "sentence"], "left")
    nodes = both.filter(F.size("candidate_scores") > 0).select(*KEYS, "mention", F.transform("candidate_scores", lambda c: F.struct(c["qid"], c["score"])).cast("array<struct<qid:string,score:double>>").alias("cands")).distinct()
    asked = nodes.select(F.explode("cands.qid").alias("qid")).distinct()
    decoded = linking.collective(nodes, linking.neighbour_sets(claims, asked, list(props)))
    link = both.groupBy(*KEYS, "mention").agg(F.min("chosen_qid").alias("qid"), F.max("chosen_score").alias("score"))
    rows = linking.resolved_rows(found, link, decoded, [*KEYS, "mention"])
    kept = mentions.drop_unlinked(mentions.drop_self(rows.withColumn("qid", F.col("chosen_qid"))))
    literal = F.when(F.col("qid") == "", F.col("ner_label")).otherwise(F.col("qid"))
    first = mentions.first_in_group(kept.withColumn("what", literal), ["source_id", "seed_id"], ["what", "mention"], ["sentence_idx", "ord"])
    return first.drop("what", "qid").withColumnRenamed("source", "linked_by").withColumn("row_id", F.xxhash64(*KEYS, "mention", "ner_label"))


def text_triples(resolved: DataFrame, rows: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Triples of linked mentions and of templates, in the eighteen columns, with row_id for their order."""
    own = resolved.select(
        F.col("seed_qid").alias("subject_qid"), "seed_id", "seed_qid", "sentence_idx", "relevance", "reasons", "sentence", F.lit("cooccurrence_linked").alias("predicate"), F.lit("").alias("prop_id"), "mention",
        F.col("chosen_qid").alias("qid"), "ner_label", F.when(F.col("chosen_qid") == "", 1.0).otherwise(F.col("scores.total")).alias("score"), "citation_key", "source_url", "source_label", F.concat(F.lit("ner_entity_linking:"), "linked_by").alias("method"),
    )
    listed = linking.aliases(entity_map)
    told = relations.of_group(rows.withColumn("root", F.col("seed_qid")), lambda m: linking.alias_override(m, listed), ["source_id", "seed_id"])
    placed = told.join(rows, KEYS)
    by_rule = placed.select(
        F.col("seed_qid").alias("subject_qid"), "seed_id", "seed_qid", "sentence_idx", "relevance", "reasons", "sentence", "predicate", "prop_id", F.col("object_mention").alias("mention"), "qid", F.lit("").alias("ner_label"),
        F.lit(1.0).alias("score"), "citation_key", "source_url", "source_label", "method",
    )
    return relations.triples(own.unionByName(by_rule))


def with_predictions(triples: DataFrame, predictions: DataFrame, schema: DataFrame, taus: dict[str, float] | None = None) -> DataFrame:
    """Triples of the text and those of predictions above their threshold, fused into one row for each statement."""
    both = triples.unionByName(inference.prediction_triples(predictions, schema, taus))
    return fusion.merge(both.withColumn("row_id", F.xxhash64(*both.columns)))


def full(chunks: DataFrame, seeds: list, entity_map: DataFrame, claims: DataFrame, schema: DataFrame | None = None, predictions: DataFrame | None = None, how: routing.Routing = routing.Routing(), backend: mentions.Backend | None = None, person_seed: str = "", concept_seed: str = "", taus: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """The whole run: sentences, items of each seed, mentions, resolved mentions, triples, events, bags, and the graph of
    structured facts, events and predictions. Names of listed entities are found by their aliases; backend adds a model's.
    Every stage that others read is written as a table first, so each is worked out once."""
    claims = written(claims, "claims")
    sentences = written(readers.sentence_rows(chunks), "sentences")
    rows = written(items(sentences, seeds, how), "items")
    found = written(recognised(rows, entity_map, backend), "mentions")
    resolved = written(resolved_of(found, entity_map, claims), "resolved")
    made = written(text_triples(resolved, rows, entity_map), "triples")
    out = graph_of(resolved, sentences, made, seeds, entity_map, claims, schema, predictions, person_seed, concept_seed, taus)
    return {"sentences": sentences, "items": rows, "mentions": found, "resolved": resolved} | out


def graph_of(resolved: DataFrame, sentences: DataFrame, made: DataFrame, seeds: list, entity_map: DataFrame, claims: DataFrame, schema: DataFrame | None = None, predictions: DataFrame | None = None, person_seed: str = "", concept_seed: str = "", taus: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """What follows from resolved mentions and their triples: events, bags, fused triples, nodes, edges."""
    found_events = written(events.extract(linked_sentences(resolved, sentences), names(entity_map), person_seed, concept_seed), "events")
    canon = events.canonical(found_events)
    contributions, facts = graph.structured(claims, seeds)
    facts, contributions, canon = written(facts, "facts"), written(contributions, "contributions"), written(canon, "canonical")
    all_edges = facts.select(*EDGE).unionByName(event_edges(found_events))
    merged = fusion.merge(made.withColumn("row_id", F.xxhash64(*made.columns)))
    if predictions is not None and schema is not None:
        merged = with_predictions(made, predictions, schema, taus)
        all_edges = all_edges.unionByName(graph.without_edges(predicted_edges(predictions, schema, entity_map, facts, taus), all_edges, ["start_id", "end_id", "prop_id"]))
    all_edges = written(all_edges, "edges")
    bags = supervision.bags(supervision.bag_cells(resolved, sentences))
    return {"triples": merged, "events": found_events, "canonical": canon, "bags": bags, "nodes": assembled(all_edges, canon, claims, entity_map, contributions), "edges": all_edges}


def predicted_edges(predictions: DataFrame, schema: DataFrame, entity_map: DataFrame, facts: DataFrame, taus: dict[str, float] | None = None) -> DataFrame:
    """Edges of the predictions that pass all gates. facts: edges of the structured layer."""
    spaces = schema.select(F.explode("subject_types").alias("seed_type"), "prop_id")
    kinds = linking.kinds(entity_map).select(F.col("qid").alias("id"), F.array(F.initcap(F.trim("kind"))).alias("labels"))
    held = facts.select(F.col("start_id").alias("subject"), "prop_id", F.col("end_id").alias("target_qid"))
    best = inference.prediction_edges(predictions, schema, spaces, kinds, held, taus)
    rows = best.select(F.col("subject_qid").alias("start_id"), F.col("object_qid").alias("end_id"), "prop_id", F.lit("text_re").alias("provenance"), F.coalesce("best.citation_key", F.lit("")).alias("citation_key"), F.coalesce("best.top_sentence", F.lit("")).alias("snippet"), F.coalesce("best.source_url", F.lit("")).alias("source_url"))
    return graph.edges(rows).select(*EDGE)


def rebuilt(sentences: DataFrame, routed: DataFrame, seeds: list, entity_map: DataFrame, backend: mentions.Backend | None = None) -> DataFrame:
    """Mentions and links made anew from sentences and their routing: no window around routed sentences and no joint choice;
    of a source without any routing all sentences go to the first seed; equal source, seed, entity, mention and label count
    once. routed: source_id, sentence_idx, seed_id."""
    place = ["source_id", "sentence_idx"]
    table = sentences.sparkSession.createDataFrame([(s.seed_id, s.qid) for s in seeds], "seed_id string, seed_qid string")
    own = routed.select(*KEYS).distinct()
    rest = routing.fallback(sentences.filter("source_id is not null and sentence_idx is not null"), own, seeds[0]).select(*KEYS)
    once = sentences.filter("sentence is not null").groupBy(*place).agg(F.min("sentence").alias("sentence"))
    rows = own.unionByName(rest).join(once, place).join(F.broadcast(table), "seed_id")
    found = written(recognised(rows, entity_map, backend), "mentions")
    links = linking.audited(found.filter(F.col("ner_label").isin("PER", "ORG", "LOC")).select("mention", F.col("sentence").alias("context")), linking.aliases(entity_map))
    both = found.join(links.select("mention", F.col("context").alias("sentence"), F.col("chosen_qid").alias("qid"), "chosen_score"), ["mention", "sentence"], "left").withColumn("qid", F.coalesce("qid", F.lit("")))
    kept = mentions.drop_self(mentions.drop_unlinked(both))
    first = kept.groupBy("source_id", "seed_id", "seed_qid", "qid", F.lower("mention").alias("low"), "ner_label").agg(F.min(F.struct("sentence_idx", "ord", "mention")).alias("f"), F.max(F.coalesce("chosen_score", F.lit(1.0))).alias("score"))
    return first.select("source_id", "seed_id", "seed_qid", "f.sentence_idx", "f.mention", "ner_label", F.col("qid").alias("chosen_qid"), "score")


def rebuilt_events(sentences: DataFrame, routed: DataFrame, resolved: DataFrame, entity_map: DataFrame, person_seed: str, concept_seed: str) -> DataFrame:
    """Events made anew from curated stages: of routed sentences, with what is linked there."""
    own = resolved.join(routed.select(*KEYS).distinct(), KEYS, "left_semi")
    return events.extract(linked_sentences(own, sentences), names(entity_map), person_seed, concept_seed)


def export_only(spark: SparkSession, folder: str, more_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an exported graph, with further edges that aren't there yet."""
    nodes, edges = readers.graph_csv(spark, folder)
    if more_edges is not None:
        edges = edges.unionByName(graph.without_edges(more_edges, edges, ["edge_id"]), allowMissingColumns=True)
    return nodes, edges


def export(run: dict[str, DataFrame], folder: str, root: str = "", labels: dict[str, str] | None = None) -> None:
    """Writes a run: its stages and events as lines of JSON, graph and triples as tables with a header, and a summary."""
    for name in ("sentences", "mentions", "resolved", "events", "bags"):
        if name in run:
            sinks.stage(run[name], f"{folder}/{name}.jsonl")
    sinks.graph_csv(run["nodes"], run["edges"], folder, ["evidence_count"], labels or graph.PROP_LABELS)
    merged = run["triples"]
    shown = merged.withColumns({"relevance_score": F.coalesce(F.format_string("%.4f", "relevance"), F.lit("")), "link_score": F.coalesce(F.format_string("%.4f", "link"), F.lit("")), "extraction_method": F.col("methods")})
    sinks.triples_csv(shown.select(*[F.col(c) if c in shown.columns else F.lit("").alias(c) for c in sinks.TRIPLE]), f"{folder}/triples_extracted.csv")
    sinks.stage(sinks.summary(run["nodes"], run["edges"], root), f"{folder}/graph_summary.json")
