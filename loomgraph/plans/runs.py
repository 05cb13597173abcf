"""Queries of whole runs and of the operators between their stages, with SQL where SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ship
from ..functions import text as T
from ..functions.tables import written
from ..operators import graph, inference, linking, mentions, relations, routing
from ..sources import readers, sinks
from . import config, pipeline
from .registry import _ALIASES, _CELLS, _EDGES, _TYPES, QUERIES, ROUTED, SP, SQL, _alias_nodes, _labelled, _scores, _t, _triple_edges, kb_query, query  # noqa: F401

TABLES = ("wiki_chunk", "entity_map", "relation_schema", "re_predictions")


def _chunks(c: DataFrame) -> DataFrame:
    rows = c.filter("source_id is not null")
    return rows.select(F.col("chunk_id").alias("chunk_ord"), "lang", "title", "provenance", "citation_key", F.col("url").alias("source_url"), "source_id", F.col("title").alias("source_label"), "text")


_RUNS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _run(spark, folder: str) -> dict[str, DataFrame]:
    """The whole run over the fetched texts; its stages are tables, so queries of one session share them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RUNS:
        _RUNS[key] = _whole(spark, folder)
    return _RUNS[key]


def _whole(spark, folder: str) -> dict[str, DataFrame]:
    ship(spark)
    chunks, emap, schema, found = (_t(spark, folder, t) for t in TABLES)
    return pipeline.full(_chunks(chunks), config.WORLD, emap, config.claims(spark, folder), schema, found, person_seed=config.PERSON_SEED, concept_seed=config.CONCEPT_SEED)


def _stage(name: str, of):
    QUERIES[name] = lambda spark, folder: of(_run(spark, folder))


_stage("run_mentions", lambda r: r["mentions"].select("source_id", "sentence_idx", "seed_id", "ord", "mention", "ner_label"))
_stage("run_resolved", lambda r: r["resolved"].select("row_id", "source_id", "sentence_idx", "seed_id", "mention", "ner_label", "chosen_qid", F.round("scores.total", 6).alias("total"), "linked_by"))
_stage("run_triples", lambda r: r["triples"].select("seed_id", "sentence_idx", "predicate", "obj", "source_url", "n", "methods"))
_stage("run_events", lambda r: r["events"].select("event_id", "event_type", "seed_id", "source_id", "sentence_idx", "trigger"))
_stage("run_nodes", lambda r: r["nodes"].select("id", "name", F.array_join("labels", ";").alias("labels"), "extra"))
_stage("run_edges", lambda r: r["edges"].select("edge_id", "start_id", "end_id", "prop_id", "rel_type", "provenance", "layer"))
_stage("run_summary", lambda r: sinks.summary(r["nodes"], r["edges"], config.WORLD[0].qid).select("root", "nodes", "edges", "facts"))

_SPLIT_ALL = SQL["sentence_split"]


@query("run_sentences", "wiki_chunk", sql=f"with s as ({_SPLIT_ALL}) select source_id, (row_number() over (partition by source_id order by s.chunk_id, s.idx)-1)::int as sentence_idx, s.sentence from s join wiki_chunk c using (chunk_id) where source_id is not null")
def _(c):
    return readers.sentence_rows(_chunks(c)).select("source_id", "sentence_idx", "sentence")


# --- routing and mentions -----------------------------------------------------------------------------------------------


@query("route_lookup", "sentences", sql=f"with {ROUTED} select source_id, sentence_idx, round(score,6) as score from top where seed_id='seed_machine'")
def _(s):
    rows = routing.routing_rows(s.filter("source_id is not null and sentence_idx is not null"), routing.top_seeds(_scores(s)))
    one = routing.lookup(F.col("assigned"), F.lit("seed_machine"))
    return rows.withColumn("one", one).filter("one is not null").select("source_id", "sentence_idx", F.round("one.score", 6).alias("score"))


_KINDS = "kd as (select qid, arg_min(kind,line_no) kind from (select line_no, regexp_replace(wikidata_id,'\\s+','','g') qid, trim(kind) kind from entity_map) where coalesce(qid,'')<>'' and coalesce(kind,'')<>'' group by qid)"


@query("alias_mentions", "sentences", "entity_map", sql=f"""with {_ALIASES}, {_KINDS}, s as (select row_id, sentence, lower(sentence) low from sentences where sentence is not null),
 h as (select row_id, sentence, low, unnest(range(1,length(low))) p0 from s), m as (select row_id, p0-1 b, p0-1+length(alias) e, substr(sentence,p0,length(alias)) mention, al.qid, alias, case when p0>1 then substr(sentence,p0-1,1) else '' end x, substr(sentence,p0+length(alias),1) y from h join al on length(alias)>=2 and substr(alias,1,2)=substr(low,p0,2) and substr(low,p0,length(alias))=alias),
 k as (select distinct row_id, b, e, mention, m.qid, case lower(trim(kind)) when 'person' then 'PER' when 'location' then 'LOC' else 'ORG' end ner_label from m left join kd on kd.qid=m.qid where regexp_matches(alias,'[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') or not (regexp_matches(x,'^[\\p{{L}}\\p{{N}}_]$') or regexp_matches(y,'^[\\p{{L}}\\p{{N}}_]$')))
 select row_id, mention, ner_label, qid, b::int as char_start, e::int as char_end from k where not exists (select 1 from k o where o.row_id=k.row_id and o.b<=k.b and o.e>=k.e and o.e-o.b>k.e-k.b)""")
def _(s, e):
    listed = linking.aliases(e).join(linking.kinds(e), "qid", "left").select("alias", "qid", "kind")
    return mentions.by_aliases(s, ["row_id"], listed).select("row_id", "mention", "ner_label", "qid", "char_start", "char_end")


@query("unlinked_dropped", "resolved", sql="select row_id from resolved where coalesce(ner_label,'') not in ('PER','ORG','LOC') and ner_label is not null or (coalesce(chosen_qid,'')<>'' and coalesce(chosen_qid,'')<>coalesce(seed_qid,'')) and ner_label is not null")
def _(r):
    return mentions.drop_unlinked(r.filter("ner_label is not null").withColumn("qid", F.col("chosen_qid"))).select("row_id")


@query("self_dropped", "resolved", sql="select row_id from resolved where coalesce(chosen_qid,'')<>seed_qid")
def _(r):
    return mentions.drop_self(r.withColumn("qid", F.col("chosen_qid"))).select("row_id")


@query("tagger_mentions", "resolved", "sentences", sql=f"""with s0 as (select source_id, sentence_idx, min(sentence) sentence from sentences where sentence is not null group by 1,2), r0 as (select r.source_id, seed_id, seed_qid, row_id, regexp_replace(mention,'^{SP}+|{SP}+$','','g') mention, ner_label, case when ner_label in ('PER','ORG','LOC') and coalesce(chosen_qid,'')<>coalesce(seed_qid,'') then coalesce(chosen_qid,'') else '' end qid, regexp_replace(sentence,'^{SP}+|{SP}+$','','g') said from resolved r join s0 using (source_id, sentence_idx) where mention is not null and ner_label is not null and seed_id is not null),
 f as (select source_id, seed_id, qid, lower(mention) low, ner_label, min(row_id) row_id from r0 where length(mention)>=2 group by all), pl as (select source_id, regexp_replace(sentence,'^{SP}+|{SP}+$','','g') said, min(sentence_idx) sentence_idx from s0 group by 1,2)
 select f.source_id, f.seed_id, r0.mention, f.ner_label, f.qid, coalesce(pl.sentence_idx,-1)::int as sentence_idx from f join r0 using (row_id) left join pl on pl.source_id=f.source_id and pl.said=r0.said""")
def _(r, s):
    once = s.filter("sentence is not null").groupBy("source_id", "sentence_idx").agg(F.min("sentence").alias("sentence"))
    rows = r.filter("mention is not null and ner_label is not null and seed_id is not null").join(once, ["source_id", "sentence_idx"])
    spans = rows.select("source_id", "seed_id", "seed_qid", F.col("row_id").alias("ord"), "mention", "ner_label", F.col("chosen_qid").alias("qid"), F.col("sentence").alias("evidence"))
    seeds = rows.select("source_id", "seed_id").distinct()
    return mentions.of_tagger(spans, once.join(seeds, "source_id"), ["source_id", "seed_id"]).select("source_id", "seed_id", "mention", "ner_label", "qid", "sentence_idx")


# --- linking, relations -------------------------------------------------------------------------------------------------


@query("link_audit", "resolved", "entity_map", sql=f"""with {_ALIASES}, p as (select distinct mention from resolved where mention is not null),
 ov as (select mention, qid, alias from (select p.mention, al.qid, al.alias, row_number() over (partition by p.mention order by length(al.alias) desc, al.line_no) r from p join al on length(al.alias)>=2 and contains(lower(p.mention),al.alias)) where r=1 and length(trim(mention))>=2)
 select mention, alias as matched_key, qid as chosen_qid, 1.0::double as chosen_score, 'entity_map' as source, 0 as candidates from ov""")
def _(r, e):
    rows = linking.audited(r.select("mention", F.lit("").alias("context")), linking.aliases(e))
    return rows.filter("override_hit is not null").select("mention", "override_hit.matched_key", "chosen_qid", "chosen_score", "override_hit.source", F.size("candidate_scores").alias("candidates"))


@query("link_candidates_audited", "triples_extracted", "entity_map")
def _(t, e):
    rows = linking.audited(t.select(F.col("object_mention").alias("mention"), F.col("evidence_sentence").alias("context")), linking.aliases(e))
    top = F.get("candidate_scores", F.lit(0))
    return rows.filter("override_hit is null").select("mention", "context", "chosen_qid", F.round("chosen_score", 6).alias("chosen_score"), F.size("candidate_scores").alias("candidates"), top["breakdown"]["label"].alias("label"))


@query("ner_el_rebuild", "sentences", "entity_map")
def _(s, e):
    routed = routing.top_seeds(_scores(s))
    return pipeline.rebuilt(s, routed, config.WORLD, e)


@query("events_rebuild", "sentences", "resolved", "entity_map")
def _(s, r, e):
    found = pipeline.rebuilt_events(s, routing.top_seeds(_scores(s)), r, e, config.PERSON_SEED, config.CONCEPT_SEED)
    return found.select("event_id", "event_type", "seed_id", "source_id", "sentence_idx", "trigger")


def _grouped(s: DataFrame, e: DataFrame, anchors: tuple = ()) -> DataFrame:
    rows = s.filter("sentence is not null and source_id is not null").groupBy("source_id", "sentence_idx").agg(F.min("sentence").alias("sentence"))
    rows = (relations.anchored(rows, anchors) if anchors else rows).withColumn("root", F.lit(config.WORLD[0].qid))
    return relations.of_group(rows, lambda m: linking.alias_override(m, linking.aliases(e)), ["source_id"])


def _group_sql(anchors: tuple = ()) -> str:
    only = f" and ({' or '.join(f'contains(sentence,{a!r})' for a in anchors)})" if anchors else ""
    one = lambda k, t, zh: " union all ".join(f"select source_id, sentence_idx, {k + i} k, generate_subscripts(m,1) j, unnest(m) v, '{p}' predicate, '{q}' prop_id from (select source_id, sentence_idx, regexp_extract_all(sentence,'{rx.replace(chr(39), chr(39) * 2)}',1) m from s1 where is_zh={zh})" for i, (rx, p, q, _) in enumerate(t))
    return f"""with {_ALIASES}, s00 as (select source_id, sentence_idx, min(sentence) sentence from sentences where sentence is not null and source_id is not null group by 1,2), s0 as (select source_id, sentence_idx, regexp_replace(sentence,'^{SP}+|{SP}+$','','g') sentence from s00 where trim(sentence)<>''{only}),
 z as (select source_id, sum(length(regexp_replace(sentence,'[^\\x{{4e00}}-\\x{{9fff}}]','','g')))::double/greatest(sum(length(sentence))+count(*)-1,1)>=0.12 is_zh from s0 group by 1), s1 as (select s0.*, is_zh from s0 join z using (source_id)),
 m as ({one(0, relations.ZH_TEMPLATES, 'true')} union all {one(0, relations.EN_TEMPLATES, 'false')}),
 c as (select source_id, sentence_idx, predicate, prop_id, row_number() over (partition by source_id, sentence_idx order by k, j)-1 ord, substr(trim(regexp_replace(regexp_replace(regexp_replace(v,'^{SP}+|{SP}+$','','g'),'^[，,、]+|[，,、]+$','','g'),'(?s)[等及其].*$',''),' '),1,80) slot from m), sl as (select * from c where length(slot)>=2),
 ov as (select slot, qid from (select d.slot, al.qid, row_number() over (partition by d.slot order by length(al.alias) desc, al.line_no) r from (select distinct slot from sl) d join al on length(al.alias)>=2 and contains(lower(d.slot),al.alias)) where r=1)
 select source_id, sentence_idx, qid, predicate, substr(slot,1,120) as object_mention, prop_id from (select *, row_number() over (partition by source_id, qid, predicate, substr(slot,1,40) order by sentence_idx, ord) n from sl join ov using (slot) where qid<>'{config.WORLD[0].qid}') where n=1"""


_COLUMNS = ("source_id", "sentence_idx", "qid", "predicate", "object_mention", "prop_id")


@query("relations_of_groups", "sentences", "entity_map", sql=_group_sql())
def _(s, e):
    return _grouped(s, e).select(*_COLUMNS)


@query("relations_at_anchors", "sentences", "entity_map", sql=_group_sql(config.WORLD[0].anchors))
def _(s, e):
    return _grouped(s, e, config.WORLD[0].anchors).select(*_COLUMNS)


@query("relation_edges", "sentences", "entity_map")
def _(s, e):
    once = s.filter("sentence is not null").groupBy("source_id", "sentence_idx").agg(F.min(F.struct("sentence", "source_label", "source_url", "citation_key")).alias("s")).select("source_id", "sentence_idx", "s.*")
    return graph.edges(relations.edge_rows(_grouped(s, e).join(once, ["source_id", "sentence_idx"]))).select("edge_id", "start_id", "end_id", "rel_type", "provenance", "layer")


# --- graph --------------------------------------------------------------------------------------------------------------

_ROOTS = [f"Q{config.CUSTOMER + k}" for k in (1, 2, 101)]


@kb_query("root_extra", sql=f"x as (select subject, 'P569: '||literal v from claims where prop_id='P569' and subject in ({','.join(repr(r) for r in _ROOTS)})) select subject as id, array_to_string(list_sort(list(distinct v)),' | ') as extra from x group by 1")
def _(c):
    return graph.birth_and_death(c, c.sparkSession.createDataFrame([(r,) for r in _ROOTS], "id string"))


_SEEDS = [routing.Seed("a", f"Q{config.NATION + 1}", "Location", ()), routing.Seed("b", f"Q{config.SUPPLIER + 1}", "Organization", ()), routing.Seed("c", "", "Person", ())]
_FOCAL = {f"Q{config.NATION + 1}": (("P27",), 50)}


@kb_query("structured_edges", sql=f"""o as (select subject start_id, target_qid end_id, prop_id from claims where value_type='wikibase-entityid' and subject in ('{_SEEDS[0].qid}','{_SEEDS[1].qid}')),
 i as (select distinct subject start_id, target_qid end_id, prop_id from claims where prop_id='P27' and target_qid='{_SEEDS[0].qid}' order by subject limit 50) select * from o union select * from i""")
def _(c):
    return graph.structured(written(c, "claims"), _SEEDS, _FOCAL)[1].select("start_id", "end_id", "prop_id")


@kb_query("structured_nodes")
def _(c):
    rows = graph.structured(written(c, "claims"), _SEEDS, _FOCAL)[0].withColumn("props", F.create_map().cast("map<string,string>"))
    return graph.nodes(rows).select("id", F.array_join("labels", ",").alias("labels"), "extra")


@query("provenance_replaced", "triples_extracted", sql=f"with {_EDGES} select provenance, count(distinct edge_id) as edges from ed where provenance<>'wikidata' group by 1 union all select 'wikidata', count(*) from (select distinct edge_id from ed where provenance='wikidata' and start_id='Q910000803') having count(*)>0")
def _(t):
    all_ = _triple_edges(t)
    fresh = all_.filter("provenance = 'wikidata' and start_id = 'Q910000803'")
    return graph.by_provenance(graph.replace_provenance(all_, fresh, "wikidata"))


@query("names_filled", "entity_map", sql=f"with {_ALIASES}, nm as (select qid id, min(alias) name from al group by 1) select id, case when hash_is then 'label '||id else name end as name from (select id, name, (substr(id,2)::bigint%3=0) hash_is from nm)")
def _(e):
    third = F.substring("id", 2, 20).cast("bigint") % 3 == 0
    nodes = _alias_nodes(e).withColumn("name", F.when(third, F.col("id")).otherwise(F.col("name")))
    entities = nodes.select("id", F.create_map(F.lit("zh"), F.lit(""), F.lit("en"), F.concat(F.lit("label "), "id")).alias("labels"))
    return graph.fill_names(nodes, entities)


@query("graph_supporting_evidence", "triples_extracted", "entity_map", sql=f"""with {_EDGES}, {_ALIASES}, nm as (select qid id, min(alias) name from al group by 1), d as (select edge_id, min(start_id) start_id, min(end_id) end_id, min(prop_id) prop_id, min(layer) layer, min(provenance) provenance from ed group by 1), f as (select distinct start_id, end_id, prop_id from d where provenance='wikidata')
 select edge_id, a.name as start_name, b.name as end_name, round((length(edge_id)+ascii(edge_id))::double/100,6) as score from d join f using (start_id, end_id, prop_id) join nm a on a.id=start_id join nm b on b.id=end_id where provenance='text_re' order by score desc, edge_id limit 100""")
def _(t, e):
    rows = graph.supported(_triple_edges(t)).withColumn("score", (F.length("edge_id") + F.ascii("edge_id")) / 100)
    return graph.supporting_evidence(rows, _alias_nodes(e)).select("edge_id", "start_name", "end_name", F.round("score", 6).alias("score"))


# --- statistics ---------------------------------------------------------------------------------------------------------


@query("stats_by_relation", "triples_extracted", sql="select coalesce(predicate_prop_id,'') as prop_id, extraction_method, count(*) as triples, count(distinct subject_qid) as subjects from triples_extracted group by 1,2")
def _(t):
    return t.groupBy(F.coalesce("predicate_prop_id", F.lit("")).alias("prop_id"), "extraction_method").agg(F.count("*").alias("triples"), F.countDistinct("subject_qid").alias("subjects"))


@query("stats_by_prediction", "re_predictions", sql="select predicted_label, seed_type, count(*) as bags, round(avg(predicted_prob),6) as mean_prob from re_predictions group by 1,2")
def _(p):
    return p.groupBy("predicted_label", "seed_type").agg(F.count("*").alias("bags"), F.round(F.avg("predicted_prob"), 6).alias("mean_prob"))


@kb_query("stats_by_node_label", sql=f"{_TYPES}, x as (select id, unnest(string_split(labels,',')) label from lb) select label, count(*) as nodes from x group by 1")
def _(c):
    return graph.labels_of_types(c).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("nodes"))


@query("stats_by_layer", "triples_extracted", sql=f"with {_EDGES} select layer, provenance, count(distinct edge_id) as edges from ed group by rollup(layer, provenance) having layer is not null or provenance is null")
def _(t):
    return _triple_edges(t).rollup("layer", "provenance").agg(F.count("*").alias("edges"))


# --- predictions --------------------------------------------------------------------------------------------------------

_TAUS = {"Person": 0.5, "Award": 0.4}
_TAU_SQL = "case seed_type when 'Person' then 0.5 when 'Award' then 0.4 else 0.6 end"
_PRED_SQL = f"""select subject_qid, coalesce(seed_id,'') as seed_id, case when top_sentence_idx>=0 then top_sentence_idx::varchar else '' end as sentence_idx, printf('%.4f',predicted_prob) as relevance_score, substr(coalesce(top_sentence,''),1,500) as evidence_sentence,
 coalesce(nullif(trim(label_zh),''),nullif(trim(label),''),predicted_label) as predicate, predicted_label as predicate_prop_id, coalesce(object_qid,'') as object_qid, coalesce(citation_key,'') as citation_key, coalesce(p.source_url,'') as source_url,
 '['||coalesce(nullif(model,''),'pcnn_mil')||'] '||substr(coalesce(top_sentence,''),1,400) as snippet, coalesce(nullif(model,''),'pcnn_mil')||':'||predicted_label as extraction_method from re_predictions p left join relation_schema on prop_id=predicted_label where predicted_label<>'NA' and predicted_prob>={_TAU_SQL}"""
_PRED_COLUMNS = ("subject_qid", "seed_id", "sentence_idx", "relevance_score", "evidence_sentence", "predicate", "predicate_prop_id", "object_qid", "citation_key", "source_url", "snippet", "extraction_method")


@query("prediction_triples", "re_predictions", "relation_schema", sql=_PRED_SQL)
def _(p, schema):
    return inference.prediction_triples(p, schema, _TAUS, 0.6).select(*_PRED_COLUMNS)


@query("prediction_triples_fused", "triples_extracted", "re_predictions", "relation_schema")
def _(t, p, schema):
    fused = pipeline.with_predictions(t.select(*sinks.TRIPLE), p, schema, _TAUS)
    return fused.select("seed_id", "sentence_idx", "predicate", "obj", "source_url", "n", "methods")


@query("prediction_edges", "re_predictions", "relation_schema", "entity_map", "triples_extracted")
def _(p, schema, e, t):
    facts = _triple_edges(t).filter("provenance = 'wikidata'")
    return pipeline.predicted_edges(p, schema, e, facts, _TAUS).select("edge_id", "start_id", "end_id", "prop_id", "rel_type", "layer")


@query("data_values", "events", sql="select event_id, case event_type when 'click' then '+'||user_id when 'view' then user_id||','||event_id when 'signup' then 't'||user_id else props end as value from events")
def _(e):
    kind = F.when(F.col("event_type") == "click", "quantity").when(F.col("event_type") == "view", "globecoordinate").when(F.col("event_type") == "signup", "time").otherwise("string")
    text = F.col("user_id").cast("string")
    value = F.struct(F.concat(F.lit("t"), text).alias("time"), text.alias("text"), F.concat(F.lit("+"), text).alias("amount"), F.col("user_id").alias("latitude"), F.col("event_id").alias("longitude"), F.col("props").alias("string"))
    return e.withColumn("kind", kind).withColumn("v", value).select("event_id", T.data_value("kind", "v").alias("value"))
