"""All queries of the core, by name: callables of (spark, sf_dir), and the SQL that says the same.

Each query runs over its whole tables. Lists come out as joined text, doubles rounded to six places, so results compare
by value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ship
from ..functions import text as T
from ..operators import events, fusion, graph, inference, linking, mentions, relations, routing, supervision
from . import config, pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}
SP = T.SPACE
MARKS = "\"''“”‘’()（）\\[\\]【】"


def _t(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a query over the named tables."""

    def add(f):
        def run(spark, folder: str) -> DataFrame:
            ship(spark)
            return f(*(_t(spark, folder, t) for t in tables))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def kb_query(name: str, sql: str | None = None):
    """Registers a query over the claims that the star schema gives."""

    def add(f):
        QUERIES[name] = lambda spark, folder: f(config.claims(spark, folder))
        if sql:
            SQL[name] = f"with {config.CLAIMS_SQL}, {sql}"
        return f

    return add


def _zh(x: str) -> str:
    return f"(length(regexp_replace(coalesce({x},''),'[^\\x{{4e00}}-\\x{{9fff}}]','','g'))::double/greatest(length(coalesce({x},'')),1))"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x},'{SP}+',' ','g'),' ')"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}),'[^\\p{{L}}\\p{{N}}_]+',' ','g'),' '),' '),lambda w: length(w)>1))"


def _grams(x: str) -> str:
    q = _squeeze(f"lower({x})")
    return f"case when {q}='' then []::varchar[] when length({q})<=3 then [{q}] else list_distinct(list_transform(range(1,length({q})-1),lambda i: substr({q},i::int,3))) end"


def _jac(a: str, b: str) -> str:
    return f"case when len({a})=0 or len({b})=0 then 0.0 else len(list_intersect({a},{b}))::double/len(list_distinct(list_concat({a},{b}))) end"


# --- text ---------------------------------------------------------------------------------------------------------------

_SPLIT = f"""select chunk_id, i-1 as idx, s as sentence from (
 select chunk_id, unnest(p) s, generate_subscripts(p,1) i from (select chunk_id, list_filter(list_transform(case when {_zh('t')}>=0.12
  then string_split(regexp_replace(t,'([。！？；\\n])','\\1'||chr(1),'g'),chr(1)) else string_split(regexp_replace(t,'([.!?\\n]){SP}+','\\1'||chr(1),'g'),chr(1)) end,
  lambda x: regexp_replace(x,'^{SP}+|{SP}+$','','g')),lambda x: length(x)>=9) p from (select chunk_id, replace(coalesce(text,''),chr(13),chr(10)) t from wiki_chunk)))"""


@query("sentence_split", "wiki_chunk", sql=_SPLIT)
def _(chunks):
    return chunks.select("chunk_id", F.posexplode(T.sentences("text")).alias("idx", "sentence"))


@query("zh_ratio_gate", "sentences", sql=f"select row_id, round({_zh('sentence')},6) as ratio, {_zh('sentence')}>=0.12 as is_zh from sentences")
def _(s):
    return s.select("row_id", F.round(T.zh_ratio("sentence"), 6).alias("ratio"), T.is_zh("sentence").alias("is_zh"))


@query("mention_normalize", "resolved", sql=f"select row_id, trim(regexp_replace({_squeeze('mention')},'^[{MARKS}]+|[{MARKS}]+$','','g'),' ') as norm from resolved")
def _(r):
    return r.select("row_id", T.mention("mention").alias("norm"))


@query("literal_normalize", "resolved", sql=f"select row_id, trim(regexp_replace({_squeeze('lower(mention)')},'^[{MARKS}《》]+|[{MARKS}《》]+$','','g'),' ') as norm from resolved")
def _(r):
    return r.select("row_id", T.literal("mention").alias("norm"))


@query("slug", "part", sql="select p_partkey, case when s='' then 'source' else s end as slug from (select p_partkey, substr(regexp_replace(regexp_replace(lower(trim(p_name)),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),1,80) s from part)")
def _(p):
    return p.select("p_partkey", T.slug("p_name").alias("slug"))


@query("rel_type", "relation_schema", sql="select prop_id, 'WIKI_'||replace(upper(prop_id),':','_') as by_prop, 'EXT_'||case when w='' then 'REL' else w end as by_text from (select prop_id, substr(upper(regexp_replace(regexp_replace(coalesce(label,''),'[^\\p{L}\\p{N}_]+','_','g'),'^_+|_+$','','g')),1,36) w from relation_schema)")
def _(r):
    return r.select("prop_id", T.rel_type("prop_id").alias("by_prop"), T.rel_type_text(F.coalesce("label", F.lit(""))).alias("by_text"))


@query("uri_tail", "entity_map", sql="select line_no, regexp_extract('http://kb.example/entity/'||coalesce(wikidata_id,''),'(Q[0-9]+|P[0-9]+)\\s*$',1) as tail from entity_map")
def _(e):
    return e.select("line_no", T.uri_tail(F.concat(F.lit("http://kb.example/entity/"), F.coalesce("wikidata_id", F.lit("")))).alias("tail"))


@query("token_jaccard", "triples_extracted", sql=f"select row_id, round({_jac('a','b')},6) as jaccard from (select row_id, {_tokens('coalesce(evidence_sentence,chr(32))')} a, {_tokens('coalesce(snippet,chr(32))')} b from triples_extracted)")
def _(t):
    return t.select("row_id", F.round(T.token_jaccard(F.coalesce("evidence_sentence", F.lit(" ")), F.coalesce("snippet", F.lit(" "))), 6).alias("jaccard"))


@query("char_ngram_jaccard", "resolved", sql=f"select row_id, round({_jac('a','b')},6) as jaccard from (select row_id, {_grams('coalesce(mention,chr(32))')} a, {_grams('coalesce(seed_id,chr(32))||mention')} b from resolved where mention is not null)")
def _(r):
    return r.filter("mention is not null").select("row_id", F.round(T.ngram_jaccard("mention", F.concat(F.coalesce("seed_id", F.lit(" ")), "mention")), 6).alias("jaccard"))


@query("stable_ids", "triples_extracted", sql="select row_id, 'EVT_'||substr(sha1(concat_ws('|',coalesce(trim(seed_id),''),coalesce(trim(sentence_idx),''),coalesce(trim(predicate),''))),1,12) as ident from triples_extracted")
def _(t):
    return t.select("row_id", T.stable_id("EVT_", "seed_id", "sentence_idx", "predicate").alias("ident"))


@query("zh_slot", "sentences", sql="select row_id, substr(trim(regexp_replace(regexp_replace(trim(sentence,' '||chr(10)||chr(13)||chr(9)),'^[，,、]+|[，,、]+$','','g'),'(?s)[等及其].*$',''),' '),1,80) as slot from sentences where sentence is not null")
def _(s):
    return s.filter("sentence is not null").select("row_id", T.zh_slot("sentence").alias("slot"))


@query("first_year", "sentences", sql="select row_id, regexp_extract(coalesce(sentence,''),'(?:^|[^\\p{L}\\p{N}_])((?:19|20)[0-9]{2})(?:[^\\p{L}\\p{N}_]|$)',1) as year from sentences")
def _(s):
    return s.select("row_id", T.first_year(F.coalesce("sentence", F.lit(""))).alias("year"))


@query("score_text", "resolved", sql="select row_id, case when scores.total_score=0 then '' else printf('%.4f',scores.total_score) end as score from resolved where scores.total_score is not null")
def _(r):
    return r.filter("scores.total_score is not null").select("row_id", T.score_text("scores.total_score").alias("score"))


_PAGE = "'<html><script>var a = 1;</script><body><p>'||coalesce(title,'')||'</p><div>'||text||' &amp; more</div></body></html>'"


@query("html_strip", "documents", sql=f"""select doc_id, regexp_replace(regexp_replace(regexp_replace(t,'[ \\t\\f\\x0b\\x{{a0}}]+',' ','g'),' ?\\n[ \\n]*',chr(10),'g'),'^{SP}+|{SP}+$','','g') as visible from (
 select doc_id, replace(regexp_replace(regexp_replace(regexp_replace({_PAGE},'(?is)<script[^>]*>.*?</script\\s*>',' ','g'),'(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>',chr(10),'g'),'(?s)<[^>]+>',' ','g'),'&amp;','&') t
 from documents where text is not null)""")
def _(d):
    html = F.concat(F.lit("<html><script>var a = 1;</script><body><p>"), F.coalesce("title", F.lit("")), F.lit("</p><div>"), "text", F.lit(" &amp; more</div></body></html>"))
    return d.filter("text is not null").select("doc_id", T.strip_html(html).alias("visible"))


# --- routing ------------------------------------------------------------------------------------------------------------

_SEED_VALUES = ",".join(f"({i},'{s.seed_id}','{s.qid}',[{','.join(repr(a) for a in s.anchors)}]::varchar[],[{','.join(repr(a) for a in s.triggers)}]::varchar[])" for i, s in enumerate(config.WORLD))
ROUTED = f"""seeds(seed_ord,seed_id,seed_qid,anchors,triggers) as (values {_SEED_VALUES}),
 s as (select source_id, sentence_idx, min(sentence) sentence from sentences where source_id is not null and sentence_idx is not null group by 1,2),
 h as (select source_id, sentence_idx, seed_ord, seed_id, seed_qid, list_filter(anchors,lambda a: contains(coalesce(sentence,''),a)) a, list_filter(triggers,lambda a: contains(coalesce(sentence,''),a)) t from s, seeds),
 n as (select *, coalesce(lag(case when len(a)>0 then sentence_idx end) over w = sentence_idx-1,false) or coalesce(lead(case when len(a)>0 then sentence_idx end) over w = sentence_idx+1,false) near from h window w as (partition by source_id, seed_id order by sentence_idx)),
 sc as (select *, len(a)*1.0::double+len(t)*0.35::double+near::int*0.15::double score from n),
 top as (select * from (select *, row_number() over (partition by source_id, sentence_idx order by score desc, seed_ord) rank from sc where score>=0.25) where rank<=2)"""


def _scores(s: DataFrame) -> DataFrame:
    return routing.scores(s, config.WORLD)


@query("seed_hits", "sentences", sql=f"with {ROUTED} select source_id, sentence_idx, seed_id, array_to_string(a[1:8],',') as anchor_hits, array_to_string(t[1:8],',') as trigger_hits, near as nearby_anchor, round(score,6) as score from sc where score>0")
def _(s):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _scores(s).select("source_id", "sentence_idx", "seed_id", joined("anchor_hits"), joined("trigger_hits"), "nearby_anchor", F.round("score", 6).alias("score"))


@query("seed_route_topk", "sentences", sql=f"with {ROUTED} select source_id, sentence_idx, seed_id, rank, round(score,6) as score from top")
def _(s):
    return routing.top_seeds(_scores(s)).select("source_id", "sentence_idx", "seed_id", "rank", F.round("score", 6).alias("score"))


@query("seed_route_stats", "sentences", sql=f"with {ROUTED} select seed_id, rank, count(*) as sentences, round(avg(score),6) as mean_score from top group by all")
def _(s):
    return routing.top_seeds(_scores(s)).groupBy("seed_id", "rank").agg(F.count("*").alias("sentences"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("route_window_expand", "sentences", sql=f"with {ROUTED} select x.source_id, x.sentence_idx, x.seed_id, max(x.base=x.sentence_idx) as is_base from (select source_id, seed_id, sentence_idx base, unnest([sentence_idx-1,sentence_idx,sentence_idx+1]) sentence_idx from top) x join s using (source_id, sentence_idx) group by 1,2,3")
def _(s):
    return routing.expand(routing.top_seeds(_scores(s)), s)


@query("route_derived", "sentences", sql=f"""with {ROUTED}, e as (select x.*, s.source_id is not null from (select source_id, seed_id, score, sentence_idx base, unnest([sentence_idx-1,sentence_idx,sentence_idx+1]) sentence_idx from top) x join s using (source_id, sentence_idx))
 select source_id, sentence_idx, seed_id, round(score,6) as score, base<>sentence_idx as window_expanded, case when base<>sentence_idx then base end as window_from_sentence_idx from (select *, row_number() over (partition by source_id, sentence_idx, seed_id order by base<>sentence_idx, score desc, base) r from e) where r=1""")
def _(s):
    return routing.derived(routing.top_seeds(_scores(s)), s).withColumn("score", F.round("score", 6))


@query("route_fallback", "sentences", sql=f"with {ROUTED} select distinct source_id, sentence_idx, 'seed_person' as seed_id from s where source_id not in (select source_id from top)")
def _(s):
    return routing.fallback(s.filter("source_id is not null and sentence_idx is not null"), routing.top_seeds(_scores(s)), config.WORLD[0]).select("source_id", "sentence_idx", "seed_id")


@query("route_rows", "sentences", sql=f"with {ROUTED} select source_id, sentence_idx, coalesce(string_agg(seed_id,',' order by rank),'') as seeds from s left join top using (source_id, sentence_idx) group by 1,2")
def _(s):
    rows = routing.routing_rows(s.filter("source_id is not null and sentence_idx is not null"), routing.top_seeds(_scores(s)))
    return rows.select("source_id", "sentence_idx", F.array_join(F.transform("assigned", lambda a: a["seed_id"]), ",").alias("seeds"))


# --- mentions -----------------------------------------------------------------------------------------------------------

_NUM = " union all ".join(f"select row_id, {i} k, generate_subscripts(m,1) j, unnest(m) v, '{label}' ner_label from (select row_id, regexp_extract_all(coalesce(sentence,''),'{rx}',1) m from sentences)" for i, (label, rx) in enumerate(mentions.NUMERIC))


@query("numeric_mentions", "sentences", sql=f"""with m as ({_NUM}), c as (select row_id, ner_label, trim(regexp_replace({_squeeze('v')},'^[{MARKS}]+|[{MARKS}]+$','','g'),' ') mention, k, j from m),
 f as (select row_id, ner_label, mention, min(k*100000+j) o from c where mention<>'' group by 1,2,3) select row_id, (row_number() over (partition by row_id order by o)-1)::int as ord, mention, ner_label from f""")
def _(s):
    return mentions.numeric(s.withColumn("sentence", F.coalesce("sentence", F.lit(""))), ["row_id"])


_PLACES = ("利瓦格拉", "文米敦", "谢甘勒", "Lyvagra", "Venmidun", "Šeganrö")


@query("gazetteer_mentions", "sentences", sql=f"select row_id, (i-1)::int as ord, v as mention, 'LOC' as ner_label from (select row_id, unnest(m) v, generate_subscripts(m,1) i from (select row_id, list_filter([{','.join(repr(p) for p in _PLACES)}],lambda p: contains(coalesce(sentence,''),p)) m from sentences))")
def _(s):
    return mentions.gazetteer(s, ["row_id"], _PLACES)


@query("mention_first", "resolved", sql="select row_id from (select row_id, row_number() over (partition by source_id, seed_id, lower(mention), ner_label order by sentence_idx, row_id) n from resolved) where n=1")
def _(r):
    return mentions.first_in_group(r, ["source_id", "seed_id"], ["mention", "ner_label"], ["sentence_idx", "row_id"]).select("row_id")


@query("backend_choice", "sentences", sql="select distinct source_id, case when source_id='https://zh.kgwiki.example/wiki/hub' then 'spacy' when contains(lower(source_id),'scans/') then 'crf' else 'rules' end as backend from sentences")
def _(s):
    return s.select("source_id", mentions.choose_backend("source_id", {"https://zh.kgwiki.example/wiki/hub": "spacy", "file:SCANS/": "crf"}).alias("backend")).distinct()


_TAG = "case when regexp_matches(c,'^[0-9]$') then case when i%4=1 then 'B-DATE' else 'I-DATE' end when regexp_matches(c,'^[A-Z]$') then 'B-PER' when regexp_matches(c,'^[a-z]$') then 'I-PER' else 'O' end"


@query("bio_decode", "sentences", sql=f"""with c as (select row_id, unnest(string_split(sentence,'')) c, generate_subscripts(string_split(sentence,''),1)-1 i from sentences where sentence<>''),
 t as (select row_id, i, c, {_TAG} tag from c), l as (select *, tag[1:1] head, regexp_extract(tag,'^[BI]-(.+)$',1) label from t),
 p as (select *, lag(head) over w ph, lag(label) over w pl from l window w as (partition by row_id order by i)),
 r as (select *, sum(case when head<>'I' or ph is null or pl<>label or ph='O' then 1 else 0 end) over (partition by row_id order by i) run from p)
 select row_id, label, min(i)::int as begin, (max(i)+1)::int as "end", string_agg(c,'' order by i) as mention from r where head<>'O' group by row_id, run, label having arg_min(head,i)='B'""")
def _(s):
    letters = F.filter(F.split("sentence", ""), lambda c: c != "")
    each = s.filter("sentence <> ''").select("row_id", F.posexplode(letters).alias("pos", "token"))
    digit = F.when(F.col("pos") % 4 == 1, "B-DATE").otherwise("I-DATE")
    tag = F.when(F.col("token").rlike("^[0-9]$"), digit).when(F.col("token").rlike("^[A-Z]$"), "B-PER").when(F.col("token").rlike("^[a-z]$"), "I-PER").otherwise("O")
    return mentions.spans_from_tags(each.withColumn("tag", tag), ["row_id"])


@query("bio_weak_label", "sentences", "resolved")
def _(s, r):
    keys = ["source_id", "sentence_idx"]
    once = s.filter("sentence is not null").groupBy(*keys).agg(F.min("sentence").alias("sentence"))
    tagged = mentions.tags_from_mentions(once, r.filter("mention is not null and ner_label is not null"), keys)
    return tagged.select(*keys, F.array_join("tags", " ").alias("tags"))


@query("char_features", "sentences", sql=f"""with c as (select row_id, unnest(l) c, generate_subscripts(l,1)-1 i, len(l) n, l from (select row_id, list_filter(string_split(regexp_replace(sentence,'{SP}+','','g'),''),lambda x: x<>'') l from sentences where sentence is not null))
 select row_id, i::int as pos, c, case when regexp_matches(c,'^[0-9]$') then 'D' when regexp_matches(c,'^[A-Za-z]$') then 'A' when regexp_matches(c,'^[\\x{{4e00}}-\\x{{9fff}}]$') then 'H' else 'P' end as shape, case when i=0 then 'BOS' else l[i] end as before, case when i=n-1 then 'EOS' else l[i+2] end as after, case when i=0 then 'BOS' else l[i] end||c as pair_before, c||case when i=n-1 then 'EOS' else l[i+2] end as pair_after from c""")
def _(s):
    return mentions.char_features(s.filter("sentence is not null"), ["row_id"])


# --- linking ------------------------------------------------------------------------------------------------------------

_ALIASES = f"al as (select alias, arg_max(qid,line_no) qid, max(line_no) line_no from (select line_no, regexp_replace(lower(alias),'^{SP}+|{SP}+$','','g') alias, regexp_replace(wikidata_id,'\\s+','','g') qid from entity_map) where coalesce(alias,'')<>'' and coalesce(qid,'')<>'' group by alias)"


@query("alias_override_link", "resolved", "entity_map", sql=f"""with {_ALIASES}, m as (select distinct mention from resolved where mention is not null)
 select mention, qid, alias from (select m.mention, al.qid, al.alias, row_number() over (partition by m.mention order by length(al.alias) desc, al.line_no) r from m join al on length(al.alias)>=2 and contains(lower(m.mention),al.alias)) where r=1""")
def _(r, e):
    return linking.alias_override(r, linking.aliases(e))


@query("alias_kinds", "entity_map", sql="select qid, arg_min(kind,line_no) as kind from (select line_no, regexp_replace(wikidata_id,'\\s+','','g') qid, trim(kind) kind from entity_map) where coalesce(qid,'')<>'' and coalesce(kind,'')<>'' group by qid")
def _(e):
    return linking.kinds(e)


_NAMED = "select row_id, replace(replace(sentence,'Selrusø','Turing'),'塞尔鲁瑟','图灵') context from sentences where sentence is not null"
_WORKED_CONTEXTS = [(-1, "a universal Turing machine"), (-2, "the Turing Award of 1966"), (-3, "Alan M. Turing, of Lyvagra"), (-4, "图灵机"), (-5, "probabilistic turing machines"), (-6, "Turing (1912)"), (-7, "")]


def _rule_sql(rules) -> str:
    return "case " + " ".join(f"when lower(trim(mention))='{m}' and regexp_matches(context,'{rx}') then '{q}'" for m, rx, q in rules) + " end"


@query("context_override", "sentences", sql=f"""with t as ({_NAMED} union all values {','.join(f"({i},'{c}')" for i, c in _WORKED_CONTEXTS)}), m as (select row_id, context, case when contains(context,'图灵') and row_id>0 or context like '图%' then '图灵' else ' Turing ' end mention from t)
 select row_id, {_rule_sql(linking.CONTEXT_RULES)} as qid from m""")
def _(s):
    named = s.filter("sentence is not null").select("row_id", F.replace(F.replace("sentence", F.lit("Selrusø"), F.lit("Turing")), F.lit("塞尔鲁瑟"), F.lit("图灵")).alias("context"))
    rows = named.unionByName(s.sparkSession.createDataFrame(_WORKED_CONTEXTS, "row_id bigint, context string"))
    wide = F.contains("context", F.lit("图灵")) & (F.col("row_id") > 0) | F.col("context").startswith("图")
    return rows.withColumn("mention", F.when(wide, "图灵").otherwise(" Turing ")).select("row_id", linking.context_override("mention", "context").alias("qid"))


# The search table: for each mention the entities whose aliases begin as it does, the ten that fit it best.
_SEARCH = f"""{_ALIASES}, mm as (select distinct mention, evidence_sentence context from (select object_mention mention, evidence_sentence from triples_extracted) where length(mention)>=2),
 mk as (select distinct mention, lower(trim(mention,' ')) low, {_grams('mention')} mg from mm), ax as (select qid, alias, {_grams('alias')} lg from al where length(alias)>=2),
 ft as (select mention, qid id, alias label, case when alias=low then 0 when contains(alias,low) then 1 else 2 end fit, -({_jac('mg','lg')}) minus from mk join ax on lower(substr(mention,1,2))=substr(alias,1,2)),
 be as (select * from (select *, row_number() over (partition by mention, id order by fit, minus, label) o from ft) where o=1), ix as (select *, row_number() over (partition by mention order by fit, minus, label, id)-1 rank from be),
 cd as (select mm.mention, context, id, label, rank ord, '' description from mm join ix on ix.mention=mm.mention where rank<10)"""


def _search(t: DataFrame, e: DataFrame) -> DataFrame:
    pairs = t.select(F.col("object_mention").alias("mention"), F.col("evidence_sentence").alias("context")).filter("length(mention) >= 2").distinct()
    hits = linking.search(pairs, linking.aliases(e)).select("mention", "id", "label", F.col("rank").alias("ord"), F.lit("").alias("description"))
    return linking.with_mention_sets(pairs).join(linking.with_candidate_sets(hits), "mention")


_SCORE = f"""sx as (select mention, context, id, ord, b + 0.55*{_jac('ca','la')} + 0.35*{_jac('mg','lg')} + greatest(0.0,0.12-0.015*ord) score from (
 select *, case when lower(label)=lower(trim(mention)) then 0.4 when label<>'' and contains(lower(label),lower(trim(mention))) then 0.22 else 0.0 end b, {_tokens("coalesce(context,'')")} ca, {_tokens("label||' '")} la, {_grams('mention')} mg, {_grams('label')} lg from cd))"""


@query("candidate_score", "triples_extracted", "entity_map", sql=f"with {_SEARCH}, {_SCORE} select mention, context, id, ord, round(score,6) as score from sx")
def _(t, e):
    return linking.scored(_search(t, e)).select("mention", "context", "id", "ord", F.round("score", 6).alias("score"))


@query("link_accept", "triples_extracted", "entity_map", sql=f"with {_SEARCH}, {_SCORE}, rk as (select *, row_number() over (partition by mention, context order by score desc, ord, id) r, count(distinct id) over (partition by mention, context) n from sx) select mention, context, case when score>=0.5 or n=1 then id end as qid, n from rk where r=1")
def _(t, e):
    return linking.accepted(linking.scored(_search(t, e)), ["mention", "context"], 0.5).select("mention", "context", "qid", "n")


@query("candidate_topk", "triples_extracted", "entity_map", sql=f"with {_SEARCH} select mention, (row_number() over (partition by mention order by o, id)-1)::int as ord, id from (select mention, id, min(ord) o from cd group by 1,2)")
def _(t, e):
    found = _search(t, e).select("mention", F.lit(0).alias("lang_ord"), F.col("ord").alias("rank"), "id", "label", "description").distinct()
    return linking.candidates(found).select("mention", "ord", "id")


@kb_query("neighbor_sets", sql="select subject as qid, array_to_string(list_sort(list(distinct target_qid)),',') as near from claims where prop_id in ('P27','P17','P361','P176') group by 1".join(["x as (", ") select * from x"]))
def _(c):
    return linking.neighbour_sets(c, c.select(F.col("subject").alias("qid")), ["P27", "P17", "P361", "P176"]).select("qid", F.array_join("near", ",").alias("near"))


@kb_query("coherence_pairs", sql="n as (select subject qid, list_sort(list(distinct target_qid)) near from claims where prop_id='P176' group by 1) select a.qid as qid, b.qid as other, round(len(list_intersect(a.near,b.near))::double/len(list_distinct(list_concat(a.near,b.near))),6) as coherence from n a join n b on b.qid='Q'||(substr(a.qid,2)::bigint+1)")
def _(c):
    near = linking.neighbour_sets(c, c.select(F.col("subject").alias("qid")), ["P176"])
    other = near.select(F.col("qid").alias("other"), F.col("near").alias("other_near"))
    both = near.withColumn("other", F.concat(F.lit("Q"), (F.substring("qid", 2, 20).cast("bigint") + 1).cast("string"))).join(other, "other")
    return both.select("qid", "other", F.round(linking.coherence("near", "other_near"), 6).alias("coherence"))


@query("collective_decode", "resolved", "entity_map", "triples_extracted")
def _(r, e, t):
    chosen = r.filter("chosen_qid like 'Q%' and mention is not null and sentence_idx is not null")
    by_name = chosen.groupBy("mention", F.col("chosen_qid").alias("qid")).agg(F.avg("scores.local_score").alias("score"))
    cands = by_name.groupBy("mention").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "qid", "score"))), 1, 6).alias("c"))
    best = cands.select("mention", F.transform("c", lambda x: F.struct(x["qid"].alias("qid"), x["score"].alias("score"))).alias("cands"))
    nodes = chosen.select("source_id", "seed_id", "sentence_idx", "mention").distinct().join(best, "mention")
    near = t.filter("object_qid like 'Q%'").groupBy(F.col("object_qid").alias("qid")).agg(F.sort_array(F.collect_set("subject_qid")).alias("near"))
    out = linking.collective(nodes, near)
    return out.select("source_id", "seed_id", "sentence_idx", "mention", "qid", F.round("total", 6).alias("total"), "changed_from")


# --- relations and events -----------------------------------------------------------------------------------------------

_WORLD_TEMPLATES = (*relations.ZH_TEMPLATES, (r"获得([^，。]{2,30})，", "award_received", "P166", "zh_template"), (r"于[0-9]{4}年至[0-9]{4}年间在([^。]{2,20})重新建造", "location", "P276", "zh_template"))
def _slots_sql(templates) -> str:
    """CTEs s0, m, c: the slots of all templates with their place among a sentence's matches."""
    each = " union all ".join(
        f"select source_id, sentence_idx, {i} k, generate_subscripts(m,1) j, unnest(m) v, '{p}' predicate, '{q}' prop_id, '{method}' as method from (select source_id, sentence_idx, regexp_extract_all(coalesce(sentence,''),'{rx.replace(chr(39), chr(39) * 2)}',1) m from s0)"
        for i, (rx, p, q, method) in enumerate(templates)
    )
    return f"""s0 as (select source_id, sentence_idx, min(sentence) sentence from sentences group by 1,2), m as ({each}),
 c as (select source_id, sentence_idx, predicate, prop_id, method, row_number() over (partition by source_id, sentence_idx order by k, j)-1 ord, substr(trim(regexp_replace(regexp_replace(regexp_replace(v,'^{SP}+|{SP}+$','','g'),'^[，,、]+|[，,、]+$','','g'),'(?s)[等及其].*$',''),' '),1,80) slot from m)"""


@query("pattern_slots", "sentences", sql=f"with {_slots_sql(_WORLD_TEMPLATES)} select source_id, sentence_idx, ord::int as ord, slot, predicate, prop_id from c where length(slot)>=2")
def _(s):
    once = s.groupBy("source_id", "sentence_idx").agg(F.min("sentence").alias("sentence"))
    return relations.slots(once.withColumn("sentence", F.coalesce("sentence", F.lit(""))), ["source_id", "sentence_idx"], _WORLD_TEMPLATES).drop("method")


@query("pattern_relations", "sentences", "entity_map", sql=f"""with {_slots_sql((*_WORLD_TEMPLATES, *relations.EN_TEMPLATES))}, {_ALIASES}, sl as (select * from c where length(slot)>=2),
 ov as (select slot, qid from (select d.slot, al.qid, row_number() over (partition by d.slot order by length(al.alias) desc, al.line_no) r from (select distinct slot from sl) d join al on length(al.alias)>=2 and contains(lower(d.slot),al.alias)) where r=1)
 select source_id, sentence_idx, qid, predicate, substr(arg_min(slot,ord),1,120) as object_mention, arg_min(prop_id,ord) as prop_id, arg_min(method,ord) as method from sl join ov using (slot) group by 1,2,3,4""")
def _(s, e):
    keys = ["source_id", "sentence_idx"]
    once = s.filter("sentence is not null").groupBy(*keys).agg(F.min("sentence").alias("sentence"))
    found = relations.slots(once, keys, (*_WORLD_TEMPLATES, *relations.EN_TEMPLATES))
    return relations.pattern_relations(found, linking.alias_override(found.select(F.col("slot").alias("mention")), linking.aliases(e)), keys)


def _events(s: DataFrame, r: DataFrame, e: DataFrame) -> DataFrame:
    return events.extract(pipeline.linked_sentences(r, s), pipeline.names(e), config.PERSON_SEED, config.CONCEPT_SEED)


@query("trigger_events", "sentences", "resolved", "entity_map")
def _(s, r, e):
    return _events(s, r, e).select("event_id", "event_type", "seed_id", "source_id", "sentence_idx", "trigger", F.array_join(F.transform("args", lambda a: F.concat_ws(":", a["role"], a["qid"], a["mention"])), ";").alias("args"))


def _case(triggers: list[str]) -> str:
    return "case " + " ".join(f"when contains(lower(sentence),'{t}') then '{t}'" for t in triggers) + " end"


_T = events.TRIGGERS


@query("post_events", "sentences", "resolved", "entity_map", sql=f"""with s0 as (select source_id, sentence_idx, min(sentence) sentence from sentences group by 1,2),
 l as (select source_id, seed_id, seed_qid, sentence_idx, list({{'q':coalesce(chosen_qid,''),'m':mention,'n':coalesce(ner_label,'')}} order by row_id) l from resolved where mention is not null group by 1,2,3,4),
 b as (select *, {_zh('sentence')}<0.08 en from l join s0 using (source_id, sentence_idx)),
 t as (select *, case when en then {_case(_T['EmploymentEvent']['en'])} else {_case(_T['EmploymentEvent']['zh'])} end emp, case when en then {_case(_T['EducationEvent']['en'])} else {_case(_T['EducationEvent']['zh'])} end edu,
  list_filter(l,lambda x: x.n='ORG' and starts_with(x.q,'Q'))[1] org, list_filter(l,lambda x: x.n='PER' and starts_with(x.q,'Q'))[1] per from b)
 select source_id, seed_id, sentence_idx, case when emp is not null then 'EmploymentEvent' else 'EducationEvent' end as event_type, coalesce(emp,edu) as trigger, case when seed_id='seed_person' then seed_qid else per.q end as person, org.q as organization
 from t where coalesce(emp,edu) is not null and org is not null and (seed_id='seed_person' or per is not null)""")
def _(s, r, e):
    found = events.post_events(pipeline.linked_sentences(r, s), config.PERSON_SEED)
    arg = lambda role: F.get(F.filter("args", lambda a: a["role"] == role), F.lit(0))["qid"]
    return found.select("source_id", "seed_id", "sentence_idx", "event_type", "trigger", arg("Person").alias("person"), arg("Organization").alias("organization"))


_LINKED = f"""s0 as (select source_id, sentence_idx, min(sentence) sentence from sentences group by 1,2),
 l as (select source_id, seed_id, seed_qid, sentence_idx, list({{'q':coalesce(chosen_qid,''),'m':mention,'n':coalesce(ner_label,'')}} order by row_id) l from resolved where mention is not null group by 1,2,3,4),
 b as (select *, {_zh('sentence')}<0.08 en, list_filter(l,lambda x: x.n='PER' and starts_with(x.q,'Q')) pers, regexp_extract(sentence,'(?:^|[^\\p{{L}}\\p{{N}}_])((?:19|20)[0-9]{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)',1) as yr from l join s0 using (source_id, sentence_idx))"""


def _triggers_sql(event: str) -> str:
    return f"case when en then {_case(_T[event]['en'])} else {_case(_T[event]['zh'])} end"


#: Lists of winners, which the tables' sentences don't have: linked names, one in other case, and two that aren't linked.
_LISTS = [("list", "seed_award", "Q910017729", 1, "The prize was won by Ganwyn Selrusø (in 1950), Ekly Nobody (in 1951).", "Ekly Zuwynbri"), ("list", "seed_award", "Q910017729", 2, "Awarded to ganwyn lyvagra (in 1960).", "Someone"), ("list", "seed_award", "Q910017729", 3, "It was won by Nobody Known (in 1970).", "Other One")]
_LIST_NAMES = [("Ganwyn Selrus", "Q910000803"), ("ganwyn lyvagra", "Q77")]
_LISTED_SQL = f"{_LINKED}, bb as (select source_id, seed_id, seed_qid, sentence_idx, sentence, en, pers, yr from b union all select s, i, q, x, t, true, [{{'q':'Q1','m':p,'n':'PER'}}], regexp_extract(t,'((?:19|20)[0-9]{{2}})',1) from (values {','.join(str(r) for r in _LISTS)}) v(s,i,q,x,t,p))"


@query("award_events", "sentences", "resolved", "entity_map", sql=f"""with {_LISTED_SQL}, nm(name,qid) as (values {','.join(str(n) for n in _LIST_NAMES)}), t as (select *, {_triggers_sql('AwardEvent')} as trigger from bb),
 p as (select t.*, unnest(regexp_extract_all(sentence,'{events.LISTED.replace("'", "''")}',1)) name, unnest(regexp_extract_all(sentence,'{events.LISTED.replace("'", "''")}',2)) py from t where trigger is not null), ov as (select name, qid from (select n.name, nm.qid, row_number() over (partition by n.name order by length(nm.name) desc, nm.qid) r from (select distinct name from p) n join nm on contains(lower(n.name),lower(nm.name))) where r=1), st as (select p.*, ov.qid from p join ov using (name))
 select source_id, seed_id, sentence_idx, trigger, qid as recipient, seed_qid as award, py as year from st union all select source_id, seed_id, sentence_idx, trigger, unnest(pers[1:2]).q, seed_qid, yr from t where trigger is not null and not exists (select 1 from st where st.source_id=t.source_id and st.seed_id=t.seed_id and st.seed_qid=t.seed_qid and st.sentence_idx=t.sentence_idx)""")
def _(s, r, e):
    arg = lambda role, field: F.coalesce(F.get(F.filter("args", lambda a: a["role"] == role), F.lit(0))[field], F.lit(""))
    spark = s.sparkSession
    lists = spark.createDataFrame([(*x[:5], [("Q1", x[5], "PER")]) for x in _LISTS], "source_id string, seed_id string, seed_qid string, sentence_idx int, sentence string, linked array<struct<qid:string,mention:string,ner_label:string>>")
    names = spark.createDataFrame(_LIST_NAMES, "mention string, qid string")
    found = events.award_events(pipeline.linked_sentences(r, s).unionByName(lists), names)
    return found.select("source_id", "seed_id", "sentence_idx", "trigger", arg("Recipient", "qid").alias("recipient"), arg("Award", "qid").alias("award"), arg("Time", "mention").alias("year"))


_PHRASE = f"trim(regexp_replace(trim(case when en then regexp_extract(sentence,'(?i)\\b(?:proposed|introduced|published)\\b\\s+(?:the\\s+|a\\s+|an\\s+)?([^,.;]{{3,80}})',1) else regexp_extract(sentence,'(?:提出|发表|发表于)([^。；，]{{2,60}})',1) end,' '),'^[{MARKS}]+|[{MARKS}]+$','','g'),' ')"


@query("publication_events", "sentences", "resolved", "entity_map", sql=f"""with {_LINKED}, nm as (select mention, arg_max(qid,line_no) qid from (select line_no, trim(alias,' ') mention, regexp_replace(wikidata_id,'\\s+','','g') qid from entity_map) where coalesce(mention,'')<>'' and coalesce(qid,'')<>'' group by 1),
 t as (select *, {_triggers_sql('PublicationEvent')} as trigger, {_PHRASE} phrase, case when seed_id='seed_person' then seed_qid else pers[1].q end person from b), u as (select t.*, nm.qid nq, list_filter(l,lambda x: starts_with(x.q,'Q') and x.q<>person and x.n in ('ORG','LOC'))[1] other from t left join nm on nm.mention=phrase where trigger is not null and person is not null),
 v as (select *, case when seed_id='seed_machine' then seed_qid else coalesce(nq,other.q,'') end object_qid, case when seed_id='seed_machine' then seed_qid when nq is not null then phrase else coalesce(other.m,phrase) end object_mention from u)
 select source_id, seed_id, sentence_idx, trigger, person, object_qid, object_mention, yr as year from v where object_qid<>'' or object_mention<>''""")
def _(s, r, e):
    arg = lambda role, field: F.coalesce(F.get(F.filter("args", lambda a: a["role"] == role), F.lit(0))[field], F.lit(""))
    found = events.publication_events(pipeline.linked_sentences(r, s), pipeline.names(e), config.PERSON_SEED, config.CONCEPT_SEED)
    return found.select("source_id", "seed_id", "sentence_idx", "trigger", arg("Person", "qid").alias("person"), arg("WorkOrConcept", "qid").alias("object_qid"), arg("WorkOrConcept", "mention").alias("object_mention"), arg("Time", "mention").alias("year"))


# Events of the stream table stand for found ones where SQL shall check keys, counts and edges.
_EV = """ev as (select event_id, case event_type when 'click' then 'AwardEvent' when 'view' then 'EmploymentEvent' when 'signup' then 'EducationEvent' else 'PublicationEvent' end event_type, 'Q'||user_id k1, 'Q'||(500000+event_id%97) k2, case when event_id%5=0 then '' else '20'||lpad((event_id%30)::varchar,2,'0') end k3 from events),
 ck as (select *, 'EVT_CAN_'||substr(sha1(concat_ws('|',event_type,k1,k2,k3)),1,12) can_id from ev)"""


def _stream_events(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "AwardEvent").when(F.col("event_type") == "view", "EmploymentEvent").when(F.col("event_type") == "signup", "EducationEvent").otherwise("PublicationEvent")
    rows = df.withColumn("event_type", kind)
    first = F.when(F.col("event_type") == "AwardEvent", "Recipient").otherwise("Person")
    second = F.when(F.col("event_type") == "AwardEvent", "Award").when(F.col("event_type").isin("EmploymentEvent", "EducationEvent"), "Organization").otherwise("WorkOrConcept")
    year = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("20"), F.lpad((F.col("event_id") % 30).cast("string"), 2, "0")))
    none = F.lit("")
    args = F.array(
        F.struct(first.alias("role"), F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("qid"), none.alias("mention"), none.alias("ner_label")),
        F.struct(second.alias("role"), F.concat(F.lit("Q"), (500000 + F.col("event_id") % 97).cast("string")).alias("qid"), none.alias("mention"), none.alias("ner_label")),
        F.struct(F.lit("Time").alias("role"), none.alias("qid"), year.alias("mention"), none.alias("ner_label")),
    )
    return rows.select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.lit("events").alias("source_id"), F.col("event_id").alias("sentence_idx"), F.lit("t").alias("trigger"), args.alias("args"))


@query("event_canonical", "events", sql=f"with {_EV} select can_id, event_type, count(*) as evidence_count, 't' as name, string_agg(event_id::varchar,',' order by event_id) filter (n<=10) as evidence, any_value(case when event_type='AwardEvent' then 'Award|'||k2||'|,Recipient|'||k1||'|' when event_type='PublicationEvent' then 'Person|'||k1||'|,'||case when k3<>'' then 'Time||'||k3||',' else '' end||'WorkOrConcept|'||k2||'|' else 'Organization|'||k2||'|,Person|'||k1||'|' end||case when k3<>'' and event_type<>'PublicationEvent' then ',Time||'||k3 else '' end) as args from (select *, row_number() over (partition by can_id order by event_id) n from ck) group by 1,2")
def _(e):
    rows = events.canonical(_stream_events(e))
    return rows.select("can_id", "event_type", "evidence_count", "name", F.array_join(F.transform("evidence", lambda x: x["event_id"]), ",").alias("evidence"), F.array_join(F.filter("args", lambda a: a != "Time||"), ",").alias("args"))


@query("event_edges", "events", sql=f"with {_EV} select distinct can_id as start_id, k1 as end_id from ck union select distinct can_id, k2 from ck union select distinct can_id, 'LIT_'||substr(sha1('literal|'||k3),1,12) from ck where k3<>''")
def _(e):
    return events.edges(_stream_events(e)).select("start_id", "end_id")


# --- graph --------------------------------------------------------------------------------------------------------------


@kb_query("kb_item_edges", sql="x as (select subject, prop_id, target_qid from claims where prop_id like 'P%' and value_type='wikibase-entityid' and target_qid like 'Q%') select * from x")
def _(c):
    return graph.item_edges(c)


@kb_query("kb_literals", sql="x as (select 1) select subject, prop_id, literal from claims where value_type<>'wikibase-entityid' and coalesce(literal,'')<>''")
def _(c):
    return graph.literals(c)


@kb_query("kb_neighbourhood", sql=f"""e as (select subject, prop_id, target_qid from claims where value_type='wikibase-entityid'), f as (select * from e where subject='Q{config.NATION + 1}')
 select subject, prop_id, target_qid, 1 as steps from f union all select e.*, 2 from e where subject in (select target_qid from f) and subject<>'Q{config.NATION + 1}'""")
def _(c):
    return graph.neighbourhood(c, c.sparkSession.createDataFrame([(f"Q{config.NATION + 1}",)], "id string"))


_TYPES = f"tl(q,label) as (values {','.join(f'({q!r},{label!r})' for label, qs in graph.TYPE_LABELS.items() for q in qs)}), pl(label,parent) as (values {','.join(f'({c!r},{p!r})' for p, cs in graph.PARENTS.items() for c in cs)}), ty as (select distinct subject id, target_qid q from claims where prop_id in ('P31','P279')), o as (select id, label from ty join tl using (q)), lb as (select id, array_to_string(list_sort(list(distinct label)),',') labels from (select * from o union all select id, parent from o join pl using (label) union all select id, 'Concept' from ty where id not in (select id from o)) group by 1)"


@kb_query("type_labels", sql=f"{_TYPES} select id, labels from lb")
def _(c):
    return graph.labels_of_types(c).select("id", F.array_join("labels", ",").alias("labels"))


@kb_query("coarse_kinds", sql=f"{_TYPES} select id, case when regexp_matches(labels,'(^|,)Person(,|$)') then 'Person' when regexp_matches(labels,'(^|,)Award(,|$)') then 'Award' when regexp_matches(labels,'(^|,)Organization(,|$)') then 'Organization' when regexp_matches(labels,'(^|,)Location(,|$)') then 'Location' else 'Concept' end as kind from lb")
def _(c):
    return graph.labels_of_types(c).select("id", graph.coarse_kind("labels").alias("kind"))


@kb_query("kind_enrich", sql=f"{_TYPES}, nd as (select distinct target_qid id from claims where target_qid is not null and prop_id<>'P31') select id, case when substr(id,2)::bigint%2=0 then 'Person' else coalesce(labels,'') end as labels from nd left join lb using (id)")
def _(c):
    ids = graph.item_edges(c).filter("prop_id <> 'P31'").select(F.col("target_qid").alias("id")).distinct()
    even = F.substring("id", 2, 20).cast("bigint") % 2 == 0
    nodes = ids.withColumn("labels", F.when(even, F.array(F.lit("Person"))).otherwise(F.array().cast("array<string>")))
    return graph.enrich_kinds(nodes, graph.labels_of_types(c)).select("id", F.array_join("labels", ",").alias("labels"))


@kb_query("incoming_topk", sql=f"""f(target_qid,most) as (values ('Q{config.NATION + 1}',50),('Q{config.NATION + 2}',45)), i as (select distinct subject, prop_id, target_qid from claims where prop_id in ('P27','P17')),
 r as (select i.*, most, row_number() over (partition by target_qid order by subject, prop_id) n from i join f using (target_qid)) select subject as start_id, target_qid as end_id, prop_id from r where n<=most and prop_id<>'P17'""")
def _(c):
    focal = {f"Q{config.NATION + 1}": (("P27", "P17"), 50), f"Q{config.NATION + 2}": (("P27", "P17"), 45)}
    known = graph.item_edges(c).filter("prop_id = 'P17'").select(F.col("subject").alias("start_id"), F.col("target_qid").alias("end_id"), "prop_id")
    return graph.incoming(c, known, focal).select("start_id", "end_id", "prop_id")


@query("node_upsert", "entity_map", sql="""with c as (select regexp_replace(wikidata_id,'\\s+','','g') id, line_no ord, trim(coalesce(alias,'')) name, lower(trim(kind)) kind from entity_map where coalesce(trim(wikidata_id),'')<>'')
 select id, coalesce(arg_min(name,ord) filter (name<>'' and name<>id),id) as name, array_to_string(list_sort(list(distinct kind) filter (kind is not null)),',') as labels, max_by(name,ord) as last_alias from c group by id""")
def _(e):
    kind = F.lower(F.trim("kind"))
    rows = e.filter("coalesce(trim(wikidata_id), '') <> ''").select(F.regexp_replace("wikidata_id", r"\s+", "").alias("id"), F.col("line_no").alias("ord"), F.trim(F.coalesce("alias", F.lit(""))).alias("name"), F.lit("").alias("extra"), F.when(kind.isNotNull(), F.array(kind)).alias("labels"), F.create_map(F.lit("alias"), F.trim(F.coalesce("alias", F.lit("")))).alias("props"))
    return graph.nodes(rows).select("id", "name", F.array_join("labels", ",").alias("labels"), F.element_at("props", "alias").alias("last_alias"))


def _triple_edges(t: DataFrame) -> DataFrame:
    rows = t.filter("object_qid like 'Q%'").select(F.col("subject_qid").alias("start_id"), F.col("object_qid").alias("end_id"), F.col("predicate_prop_id").alias("prop_id"), "predicate", F.when(F.col("row_id") % 3 == 0, "wikidata").otherwise("text_re").alias("provenance"), "source_url", F.coalesce("snippet", F.lit("")).alias("snippet"), F.lit("").alias("citation_key"))
    return graph.edges(rows)


_EDGES = f"""ed as (select distinct start_id, end_id, prop_id, provenance, source_url, snippet, rel_type, substr(sha1(concat_ws('|',coalesce(trim(start_id),''),coalesce(trim(end_id),''),rel_type,provenance,coalesce(trim(source_url),''),regexp_replace(snippet,'^{SP}+|{SP}+$','','g'))),1,12) edge_id, case when provenance in ('wikidata','wikidata_incoming') then 'facts' else 'evidence' end layer from (
 select subject_qid start_id, object_qid end_id, predicate_prop_id prop_id, case when row_id%3=0 then 'wikidata' else 'text_re' end provenance, source_url, coalesce(snippet,'') snippet, case when regexp_matches(coalesce(predicate_prop_id,''),'^P[0-9]+$') then 'WIKI_'||upper(predicate_prop_id)
 else 'EXT_'||substr(upper(regexp_replace(regexp_replace(predicate,'[^\\p{{L}}\\p{{N}}_]+','_','g'),'^_+|_+$','','g')),1,36) end rel_type from triples_extracted where object_qid like 'Q%'))"""


@query("edge_ids", "triples_extracted", sql=f"with {_EDGES} select edge_id, min(rel_type) as rel_type, min(layer) as layer from ed group by 1")
def _(t):
    return _triple_edges(t).select("edge_id", "rel_type", "layer")


@query("layer_counts", "triples_extracted", sql=f"with {_EDGES} select provenance, count(distinct edge_id) as edges from ed group by 1")
def _(t):
    return graph.by_provenance(_triple_edges(t))


@query("edge_antijoin", "triples_extracted", "re_predictions", sql="select distinct subject_qid as start_id, object_qid as end_id, predicted_label as prop_id from re_predictions p where predicted_label<>'NA' and not exists (select 1 from triples_extracted t where t.subject_qid=p.subject_qid and t.object_qid=p.object_qid and t.predicate_prop_id=p.predicted_label)")
def _(t, p):
    known = t.select(F.col("subject_qid").alias("start_id"), F.col("object_qid").alias("end_id"), F.col("predicate_prop_id").alias("prop_id"))
    rows = p.filter("predicted_label <> 'NA'").select(F.col("subject_qid").alias("start_id"), F.col("object_qid").alias("end_id"), F.col("predicted_label").alias("prop_id")).distinct()
    return graph.without_edges(rows, known, ["start_id", "end_id", "prop_id"])


@query("graph_root_facts", "triples_extracted", "entity_map", sql=f"with {_EDGES}, {_ALIASES}, nm as (select qid, min(alias) name from al group by 1), e1 as (select edge_id, min(rel_type) rel_type, min(end_id) end_id from ed where layer='facts' and start_id='Q910000803' group by 1) select rel_type, end_id, name as end_name, edge_id from e1 join nm on qid=end_id order by rel_type, end_id, edge_id limit 100")
def _(t, e):
    return graph.root_facts(_triple_edges(t), _alias_nodes(e), "Q910000803").select("rel_type", "end_id", "end_name", "edge_id")


def _alias_nodes(e: DataFrame) -> DataFrame:
    return linking.aliases(e).groupBy(F.col("qid").alias("id")).agg(F.min("alias").alias("name"))


@query("graph_find_nodes", "entity_map", sql=f"with {_ALIASES}, nm as (select qid as id, min(alias) as name from al group by 1) select * from nm where id='Q910000803' or contains(lower(name),'lyv') order by id limit 20")
def _(e):
    return graph.find_nodes(_alias_nodes(e), "Q910000803", "LYV")


@query("graph_evidence_topk", "re_predictions", sql="select row_id, round(predicted_prob,6) as score from re_predictions order by predicted_prob desc, row_id limit 100")
def _(p):
    rows = p.select("row_id", F.lit("evidence").alias("layer"), F.col("predicted_prob").alias("score"), F.lpad(F.col("row_id").cast("string"), 20, "0").alias("edge_id"))
    return graph.top_evidence(rows).select("row_id", F.round("score", 6).alias("score"))


@query("graph_support", "triples_extracted", sql=f"with {_EDGES}, d as (select edge_id, min(start_id) start_id, min(end_id) end_id, min(prop_id) prop_id, min(layer) layer, min(provenance) provenance from ed group by 1), f as (select distinct start_id, end_id, prop_id from d where provenance='wikidata') select edge_id, (f.start_id is not null)::int as is_supporting_fact from d left join f using (start_id, end_id, prop_id) where layer='evidence'")
def _(t):
    return graph.supported(_triple_edges(t)).select("edge_id", "is_supporting_fact")


@query("label_stats_rollup", "resolved", sql="select coalesce(ner_label,'(none)') as ner_label, case when coalesce(chosen_qid,'')='' then 'literal' else 'linked' end as kind, count(*) as mentions, count(distinct source_id) as sources from resolved group by rollup(coalesce(ner_label,'(none)'), case when coalesce(chosen_qid,'')='' then 'literal' else 'linked' end)")
def _(r):
    rows = r.select(F.coalesce("ner_label", F.lit("(none)")).alias("ner_label"), F.when(F.coalesce("chosen_qid", F.lit("")) == "", "literal").otherwise("linked").alias("kind"), "source_id")
    return rows.rollup("ner_label", "kind").agg(F.count("*").alias("mentions"), F.countDistinct("source_id").alias("sources"))


# --- supervision --------------------------------------------------------------------------------------------------------

_CELLS = f"""s0 as (select source_id, sentence_idx, min(sentence) sentence from sentences where {_zh('sentence')}>=0.3 group by 1,2),
 cells as (select source_id||'|'||seed_id||'|'||chosen_qid bag_id, source_id, seed_id, seed_qid subject_qid, chosen_qid object_qid, sentence_idx, min(sentence) sentence, min(mention) mention, min(ner_label) ner_label from resolved join s0 using (source_id, sentence_idx) where chosen_qid like 'Q%' and chosen_qid<>seed_qid group by 1,2,3,4,5,6)"""


@query("bag_instances", "resolved", "sentences", sql=f"with {_CELLS} select bag_id, sentence_idx, mention, ner_label from cells")
def _(r, s):
    return supervision.bag_cells(r, s).select("bag_id", "sentence_idx", "mention", "ner_label")


@query("bag_build", "resolved", "sentences", sql=f"with {_CELLS} select bag_id, array_to_string(list_sort(list(distinct mention)),',') as mentions, count(*) as instances, string_agg(sentence_idx::varchar,',' order by sentence_idx) as idx from cells group by 1")
def _(r, s):
    b = supervision.bags(supervision.bag_cells(r, s))
    return b.select("bag_id", F.array_join("object_mention_set", ",").alias("mentions"), F.size("instances").cast("bigint").alias("instances"), F.array_join(F.transform("instances", lambda x: x["sentence_idx"].cast("string")), ",").alias("idx"))


_FACTS = "facts as (select distinct subject_qid subject, predicate_prop_id prop_id, object_qid target_qid from triples_extracted where predicate_prop_id<>'' and object_qid like 'Q%')"
_SPACE = "space as (select t seed_type, list_sort(list(distinct prop_id)) space from (select prop_id, unnest(subject_types) t from relation_schema) group by 1), seeds(seed_id,seed_type) as (values ('seed_person','Person'),('seed_machine','Concept'),('seed_award','Award'))"
_DS = f"""{_CELLS}, {_FACTS}, {_SPACE}, bg as (select distinct bag_id, seed_id, subject_qid, object_qid from cells),
 ds as (select bag_id, seed_id, list_sort(list_intersect(coalesce(h.held,[]),coalesce(space,[]))) pos from bg left join seeds using (seed_id) left join space using (seed_type) left join (select subject, target_qid, list(distinct prop_id) held from facts group by 1,2) h on h.subject=bg.subject_qid and h.target_qid=bg.object_qid)"""


def _labelled(r, s, t, schema) -> DataFrame:
    keys = supervision.bag_cells(r, s).select("bag_id", "seed_id", "subject_qid", "object_qid").distinct()
    facts = t.filter("predicate_prop_id <> '' and object_qid like 'Q%'").select(F.col("subject_qid").alias("subject"), F.col("predicate_prop_id").alias("prop_id"), F.col("object_qid").alias("target_qid")).distinct()
    by_type = schema.select(F.explode("subject_types").alias("seed_type"), "prop_id")
    seeds = r.sparkSession.createDataFrame([(x.seed_id, x.type) for x in config.WORLD], "seed_id string, seed_type string")
    return supervision.labels(keys, facts, supervision.label_space(seeds, by_type))


_DS_TABLES = ("resolved", "sentences", "triples_extracted", "relation_schema")


@query("ds_labels", *_DS_TABLES, sql=f"with {_DS} select bag_id, array_to_string(pos,',') as labels_pos from ds")
def _(*tables):
    return _labelled(*tables).select("bag_id", F.array_join(F.sort_array("labels_pos"), ",").alias("labels_pos"))


@query("ds_multiclass", *_DS_TABLES, sql=f"with {_DS} select bag_id, case when len(pos)>0 then pos[1] else 'NA' end as label from ds where len(pos)<=1")
def _(*tables):
    return supervision.multiclass(_labelled(*tables)).select("bag_id", "label")


@query("na_downsample", *_DS_TABLES, sql=f"with {_DS}, mc as (select bag_id, case when len(pos)>0 then pos[1] else 'NA' end as label from ds where len(pos)<=1), n as (select count(*) n from mc where label<>'NA') select bag_id, label from mc where label<>'NA' union all select bag_id, label from (select *, row_number() over (order by sha1(bag_id||'|42'), bag_id) r from mc where label='NA') where r<=(select case when n>0 then n*3 else 200 end from n)")
def _(*tables):
    return supervision.down_sample(supervision.multiclass(_labelled(*tables)).select("bag_id", "label"))


@query("split_assign", "resolved", "sentences", sql=f"with {_CELLS}, b as (select distinct bag_id from cells), r as (select bag_id, row_number() over (order by sha1(bag_id||'|42'), bag_id)-1 i, count(*) over () n from b) select bag_id, case when i<floor(n*0.8) then 'train' when i<floor(n*0.8)+floor(n*0.1) then 'dev' else 'test' end as split from r")
def _(r, s):
    return supervision.split(supervision.bag_cells(r, s).select("bag_id").distinct())


@query("char_vocab", "sentences", sql="select c, n, (row_number() over (order by n desc, c)+1)::int as id from (select c, count(*) n from (select unnest(string_split(sentence,'')) c from sentences where sentence is not null) where c<>'' group by 1)")
def _(s):
    return supervision.vocabulary(s.filter("sentence is not null"), "sentence")


@query("pcnn_positions", "resolved", "sentences", sql=f"""with {_CELLS}, p as (select bag_id, sentence_idx, sentence, mention, list_min(list_filter([instr(sentence,a)-1 for a in ['塞尔鲁瑟','停机引理','金质奖章']],lambda x: x>=0)) a, instr(sentence,mention)-1 m, greatest(length(sentence)-1,0) last from cells where mention is not null),
 q as (select *, coalesce(a,0) e1, case when m>=0 then m else least(1,last) end e2 from p), w as (select *, case when e1=e2 then least(e1+1,last) else e2 end e3 from q) select bag_id, sentence_idx, least(least(e1,e3),last) as e1, least(greatest(e1,e3),last) as e2 from w""")
def _(r, s):
    cells = supervision.bag_cells(r, s).filter("mention is not null")
    e1, e2 = supervision.entity_places("sentence", F.array(*[F.lit(x) for x in ("塞尔鲁瑟", "停机引理", "金质奖章")]), F.col("mention"))
    return cells.select("bag_id", "sentence_idx", e1.alias("e1"), e2.alias("e2"))


# --- inference ----------------------------------------------------------------------------------------------------------


@query("mil_threshold", "re_predictions", sql="select row_id from re_predictions where predicted_label<>'NA' and predicted_prob>=case seed_type when 'Person' then 0.5 when 'Award' then 0.4 else 0.6 end")
def _(p):
    return inference.above_threshold(p, {"Person": 0.5, "Award": 0.4}, 0.6).select("row_id")


@query("mil_threshold_v1", "re_predictions", sql="select row_id, label, round(score,6) as score from (select row_id, unnest(class_probs).label label, unnest(class_probs).score score from re_predictions) where label<>'NA' and score>=case label when 'P91004' then 0.3 else 0.35 end")
def _(p):
    return inference.above_threshold_by_label(p, {"P91004": 0.3}, 0.35).select("row_id", "label", F.round("score", 6).alias("score"))


@query("mil_space", "re_predictions", "relation_schema", sql="select row_id from re_predictions where exists (select 1 from relation_schema where prop_id=predicted_label and list_contains(subject_types,seed_type))")
def _(p, schema):
    return inference.in_space(p, schema.select(F.explode("subject_types").alias("seed_type"), "prop_id")).select("row_id")


#: The real properties stand for those of the tables, taken in turn; their aliases in part, beside worked sentences.
_REAL = ["P19", "P20", "P27", "P551", "P17", "P276", "P69", "P108", "P1416", "P361", "P127", "P137", "P166", "P800", "P279", "P31", "P106"]
_REAL_SQL = f"[{','.join(repr(p) for p in _REAL)}][try_cast(substr(predicted_label,2) as bigint)%{len(_REAL)}+1]"
_REAL_ALIASES = {"P19": ["出生于", "生于"], "P27": ["国籍", "公民", "属于…国"], "P551": ["居住于", "生活在"], "P17": ["国家", "位于…国", "在…"], "P276": ["地点", "位于", "在…"], "P69": ["毕业于", "在…学习"], "P108": ["任职于", "在…工作", "加入"], "P1416": ["隶属于", "所属"], "P166": ["获得", "获", "被授予"], "P361": ["属于", "是…的一部分"], "P31": ["是", "属于"], "P127": ["由…拥有"]}
_WORKED_TEXTS = [(-1, "P108", "他在大学学习并加入学会"), (-2, "P108", "他加入学会"), (-3, "P19", "他生于利瓦格拉"), (-4, "P27", "属于某某"), (-5, "P1416", "就读时隶属于学会"), (-6, "P69", "在利瓦格拉学习"), (-7, "P69", "学习在利瓦格拉"), (-8, "P137", "x"), (-9, "P20", "他走了"), (-10, "P31", "")]


def _real(p: DataFrame) -> DataFrame:
    prop = F.element_at(F.array(*[F.lit(x) for x in _REAL]), (F.pmod(F.substring("predicted_label", 2, 12).try_cast("bigint"), F.lit(len(_REAL))) + 1).cast("int"))
    return p.filter("predicted_label <> 'NA'").withColumn("predicted_label", prop)


_KIND_SQL = "k as (select qid id, upper(kind[1:1])||lower(kind[2:]) kind from (select regexp_replace(wikidata_id,'\\s+','','g') qid, arg_min(trim(kind),line_no) filter (coalesce(trim(kind),'')<>'') kind from entity_map where coalesce(trim(wikidata_id),'')<>'' group by 1))"
_IN_RANGE = "case " + " ".join(f"when label in ({','.join(repr(p) for p in ps)}) then coalesce(kind,'')='{kind}'" for kind, ps in inference.RANGES.items()) + " else true end"


@query("mil_range", "re_predictions", "entity_map", sql=f"with {_KIND_SQL}, p as (select *, {_REAL_SQL} as label from re_predictions where predicted_label<>'NA') select row_id, label from p left join k on id=object_qid where {_IN_RANGE}")
def _(p, e):
    labels = linking.kinds(e).select(F.col("qid").alias("id"), F.array(F.initcap("kind")).alias("labels"))
    return inference.range_fits(_real(p), labels).select("row_id", F.col("predicted_label").alias("label"))


def _likes() -> str:
    words = lambda ws: "|".join(ws)
    places = ",".join(repr(p) for p in inference.PLACE_PROPS)
    return f"coalesce(top_sentence,'')<>'' and (coalesce(len(aliases_zh),0)<=0 or len(list_filter(aliases_zh,lambda a: regexp_matches(top_sentence,'(?s)'||array_to_string(list_transform(list_filter(string_split(a,'…'),lambda p: p<>''),lambda p: regexp_escape(p)),'.*'))))>0) and not (predicted_label in ('P108','P1416') and regexp_matches(top_sentence,'{words(inference.STUDY_WORDS)}')) and (predicted_label not in ({places}) or regexp_matches(top_sentence,'{words(inference.PLACE_WORDS)}'))"


_ALIAS_VALUES = ",".join(f"('{p}',[{','.join(repr(a) for a in al)}])" for p, al in _REAL_ALIASES.items())


@query("mil_text_gate", "re_predictions", sql=f"with sc(prop_id,aliases_zh) as (values {_ALIAS_VALUES}), p as (select row_id, {_REAL_SQL} as predicted_label, top_sentence from re_predictions where predicted_label<>'NA' union all values {','.join(str(w) for w in _WORKED_TEXTS)}) select row_id, predicted_label as label from p left join sc on prop_id=predicted_label where {_likes()}")
def _(p):
    spark = p.sparkSession
    schema = spark.createDataFrame(list(_REAL_ALIASES.items()), "prop_id string, aliases_zh array<string>")
    rows = _real(p).select("row_id", "predicted_label", "top_sentence").unionByName(spark.createDataFrame(_WORKED_TEXTS, "row_id bigint, predicted_label string, top_sentence string"))
    return inference.text_fits(rows, schema).select("row_id", F.col("predicted_label").alias("label"))


@query("mil_argmax", "re_predictions", sql="select subject_qid, object_qid, predicted_label as prop_id, round(max(predicted_prob),6) as score, arg_min(row_id,(-predicted_prob,row_id)) as best_row, count(*) as n, count(distinct top_sentence) as texts, coalesce(array_to_string(list_sort(list(distinct top_sentence) filter (top_sentence is not null))[1:8],'¦'),'') as evidence from re_predictions where predicted_label<>'NA' group by 1,2,3")
def _(p):
    best = inference.best_of_each(p.filter("predicted_label <> 'NA'"))
    return best.select("subject_qid", "object_qid", "prop_id", F.round("score", 6).alias("score"), F.col("best.row_id").alias("best_row"), "n", "texts", F.array_join("evidence", "¦").alias("evidence"))


@query("mil_support", "re_predictions", "triples_extracted", sql=f"with {_FACTS}, st as (select distinct subject_qid, object_qid, predicted_label prop_id from re_predictions where predicted_label<>'NA') select st.*, (f.subject is not null)::int as is_supporting_fact from st left join facts f on f.subject=st.subject_qid and f.target_qid=st.object_qid and f.prop_id=st.prop_id")
def _(p, t):
    rows = p.filter("predicted_label <> 'NA'").select("subject_qid", "object_qid", F.col("predicted_label").alias("prop_id")).distinct()
    facts = t.filter("predicate_prop_id <> '' and object_qid like 'Q%'").select(F.col("subject_qid").alias("subject"), F.col("predicate_prop_id").alias("prop_id"), F.col("object_qid").alias("target_qid"))
    return inference.with_support(rows, facts)


@query("pcnn_predict", *_DS_TABLES)
def _(r, s, t, schema):
    cells = supervision.bag_cells(r, s).filter("mention is not null")
    e1, e2 = supervision.entity_places("sentence", F.array(F.lit("塞尔鲁瑟"), F.lit("停机引理")), F.col("mention"))
    cell = F.struct("sentence_idx", "sentence", e1.cast("int").alias("e1"), e2.cast("int").alias("e2"))
    bags = cells.groupBy("bag_id").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    pick = lambda k, name: F.transform("c", lambda x: x[k]).alias(name)
    known = {x["c"]: x["id"] for x in supervision.vocabulary(cells, "sentence").select("c", "id").collect()}
    tensors = inference.tensors(bags.select("bag_id", pick("sentence", "texts"), pick("e1", "e1"), pick("e2", "e2")), known)
    seeds = r.sparkSession.createDataFrame([(x.seed_id, x.type) for x in config.WORLD], "seed_id string, seed_type string")
    spaces = supervision.label_space(seeds, schema.select(F.explode("subject_types").alias("seed_type"), "prop_id"))
    labels = ["NA", *sorted(x["p"] for x in spaces.select(F.explode("space").alias("p")).distinct().collect())]
    model = inference.Encoder(labels, len(known) + 2)
    chosen = inference.sample(supervision.multiclass(_labelled(r, s, t, schema)))
    rows = tensors.join(F.broadcast(chosen), "bag_id").orderBy("bag_id").collect()
    if rows:
        inference.train(model, [(np.array(x["ids"]), np.array(x["e1"]), np.array(x["e2"]), labels.index(x["label"])) for x in rows])
    out = inference.predict(tensors, model)
    return out.select("bag_id", "predicted_label", F.round("predicted_prob", 4).alias("predicted_prob"), "top_instance")


# --- fusion -------------------------------------------------------------------------------------------------------------

_KEY = "seed_id, sentence_idx, predicate, case when coalesce(trim(object_qid),'')<>'' then 'qid:'||trim(object_qid) else 'lit:'||coalesce(ner_label,'')||':'||lower(coalesce(trim(object_mention),'')) end as obj, source_url"
_MERGED = f"""select seed_id, sentence_idx, predicate, obj, source_url, count(*) as n, round(max(try_cast(nullif(trim(relevance_score),'') as double)),6) as relevance, round(max(try_cast(nullif(trim(link_score),'') as double)),6) as link,
 coalesce(array_to_string(list_sort(list(distinct nullif(extraction_method,'')) filter (nullif(extraction_method,'') is not null)),'|'),'') as methods, arg_max(evidence_sentence,(length(coalesce(evidence_sentence,'')),-row_id)) as evidence_sentence, min(row_id) as first_row from (select *, {_KEY.split(', ', 3)[3].rsplit(', ', 1)[0]} from triples_extracted) group by 1,2,3,4,5"""


@query("triple_merge", "triples_extracted", sql=_MERGED)
def _(t):
    return fusion.merge(t).select("seed_id", "sentence_idx", "predicate", "obj", "source_url", "n", F.round("relevance", 6).alias("relevance"), F.round("link", 6).alias("link"), "methods", "evidence_sentence", "first_row")


def _hits_sql(name: str) -> str:
    return f"""{name} as (select seed_id, source_url, string_agg(v,',' order by o) l from (select *, row_number() over (partition by seed_id, source_url order by o) n from (select seed_id, source_url, v, min(row_id*10000+i) o from
 (select row_id, seed_id, source_url, unnest(l) v, generate_subscripts(l,1) i from (select *, json_extract_string(r,'$.{name}[*]') l from p)) group by 1,2,3)) where n<={fusion.MAX_LIST} group by 1,2)"""


@query("reason_merge", "triples_extracted", sql=f"""with p as (select row_id, seed_id, source_url, case when json_valid(reasons) then reasons end r from triples_extracted), {_hits_sql('anchor_hits')}, {_hits_sql('trigger_hits')},
 g as (select seed_id, source_url, max(coalesce((r->>'nearby_anchor')::boolean,false)) nearby_anchor, max(coalesce((r->>'window_expanded')::boolean,false)) window_expanded, max((r->>'window_from_sentence_idx')::int) window_from_sentence_idx from p group by 1,2)
 select g.*, coalesce(a.l,'') as anchor_hits, coalesce(t.l,'') as trigger_hits from g left join anchor_hits a on a.seed_id is not distinct from g.seed_id and a.source_url is not distinct from g.source_url left join trigger_hits t on t.seed_id is not distinct from g.seed_id and t.source_url is not distinct from g.source_url""")
def _(t):
    out = fusion.merge_reasons(t, ["seed_id", "source_url"])
    return out.select("seed_id", "source_url", F.array_join("anchor_hits", ",").alias("anchor_hits"), F.array_join("trigger_hits", ",").alias("trigger_hits"), "nearby_anchor", "window_expanded", "window_from_sentence_idx")


@query("triple_project", "resolved", "sentences", sql="""with s0 as (select source_id, sentence_idx, min(sentence) sentence from sentences group by 1,2) select row_id, coalesce(chosen_qid,'') as object_qid, case when coalesce(chosen_qid,'')='' then '1' else '0' end as object_is_literal, case when scores.total_score=0 then '' else printf('%.4f',scores.total_score) end as link_score, substr(sentence,1,500) as evidence_sentence, '['||coalesce(source_label,'')||'] '||substr(sentence,1,480) as snippet from resolved join s0 using (source_id, sentence_idx) where scores.total_score is not null""")
def _(r, s):
    once = s.groupBy("source_id", "sentence_idx").agg(F.min("sentence").alias("sentence"))
    both = r.filter("scores.total_score is not null").join(once, ["source_id", "sentence_idx"]).withColumn("subject_qid", F.col("seed_qid")).withColumn("relevance", F.lit(0.0)).withColumn("predicate", F.lit("cooccurrence_linked")).withColumn("prop_id", F.lit("")).withColumn("qid", F.col("chosen_qid")).withColumn("score", F.col("scores.total_score")).withColumn("method", F.lit("ner"))
    made = relations.triples(both.withColumn("reasons", F.col("row_id").cast("string")))
    return made.select(F.col("reasons").cast("bigint").alias("row_id"), "object_qid", "object_is_literal", "link_score", "evidence_sentence", "snippet")
