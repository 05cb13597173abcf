"""Events of sentences: award, employment, education, publication; their canonical forms and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .linking import alias_override

#: Triggers by event and language, in the order in which they are tried.
TRIGGERS = {
    "AwardEvent": {"en": ["have been awarded", "was awarded", "were awarded", "won", "recipient", "awarded", "honor", "prize"], "zh": ["获奖", "得主", "授予", "颁发"]},
    "EmploymentEvent": {"en": ["worked at", "joined", "employed by", "professor at", "lecturer at", "served at"], "zh": ["任职", "就职", "受雇", "加入", "在", "工作于"]},
    "EducationEvent": {"en": ["studied at", "educated at", "graduated from", "attended", "student at"], "zh": ["就读", "毕业", "入学", "在", "学习于"]},
    "PublicationEvent": {"en": ["proposed", "introduced", "published", "paper", "article"], "zh": ["提出", "发表", "发表于", "论文", "文章"]},
}
EN_BELOW = 0.08
ARG = "struct<role:string,qid:string,mention:string,ner_label:string>"
EVIDENCE = 10
#: The roles that tell one event from another, by type; events without both aren't canonical.
KEY_ROLES = {"AwardEvent": ("Recipient", "Award"), "EmploymentEvent": ("Person", "Organization"), "EducationEvent": ("Person", "Organization"), "PublicationEvent": ("Person", "WorkOrConcept")}
#: A name and a year in a list of award winners, whatever its case; the phrase behind a publication's trigger.
LISTED = r"(?i)([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)+)\s*\(\s*in\s*((?:19|20)\d{2})\s*\)"
PUBLISHED_EN = r"(?i)\b(?:proposed|introduced|published)\b\s+(?:the\s+|a\s+|an\s+)?([^,.;]{3,80})"
PUBLISHED_ZH = r"(?:提出|发表|发表于)([^。；，]{2,60})"


def _arg(role: str, qid, mention, label: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(qid, F.lit("")).alias("qid"), F.coalesce(mention, F.lit("")).alias("mention"), F.lit(label).alias("ner_label"))


def trigger(text, event: str, triggers=TRIGGERS) -> Column:
    by = triggers[event]
    return F.when(T.zh_ratio(text) < EN_BELOW, T.first_trigger(text, by["en"])).otherwise(T.first_trigger(text, by["zh"]))


def _of(label: str) -> Column:
    return F.filter("linked", lambda m: (m["ner_label"] == label) & m["qid"].startswith("Q"))


def _distinct_args(args: Column) -> Column:
    """Arguments of equal role, entity and mention (whatever its case) count once; the first stays."""
    key = lambda a: F.concat_ws("\u0001", a["role"], a["qid"], F.lower(a["mention"]))
    return F.transform(F.array_distinct(F.transform(args, key)), lambda k: F.get(F.filter(args, lambda a: key(a) == k), F.lit(0)))


def _rows(df: DataFrame, event: Column | str, trig: Column, args: Column, method: str) -> DataFrame:
    out = df.withColumn("event_type", F.lit(event) if isinstance(event, str) else event).withColumn("trig", trig).withColumn("args", _distinct_args(F.filter(args, lambda a: a.isNotNull())))
    ident = T.stable_id("EVT_", "seed_id", "source_id", "sentence_idx", "event_type", F.col("trig.trigger"), F.array_join(F.transform("args", lambda a: F.concat(a["role"], F.lit("="), F.when(a["qid"] != "", a["qid"]).otherwise(a["mention"]))), ";"))
    return out.select(ident.alias("event_id"), "event_type", "seed_id", "seed_qid", "source_id", "sentence_idx", "sentence", F.col("trig.trigger").alias("trigger"), F.array("trig.begin", "trig.end").alias("trigger_span"), "args", F.lit(method).alias("method"))


def award_events(df: DataFrame, names: DataFrame) -> DataFrame:
    """Award events. df: source_id, seed_id, seed_qid, sentence_idx, sentence, linked (array of qid, mention, ner_label).
    names (mention, qid) links the names of lists such as 'Name (in YEAR)', by the longest one that stands in what the list
    has, since a list's first name may have words before it; where none is linked the sentence's first two persons count."""
    t = trigger("sentence", "AwardEvent")
    rows = df.withColumn("t", t).filter("t is not null").withColumn("n", F.regexp_extract_all("sentence", F.lit(LISTED), F.lit(1))).withColumn("y", F.regexp_extract_all("sentence", F.lit(LISTED), F.lit(2)))
    pairs = rows.filter(F.size("n") > 0).withColumn("p", F.explode(F.arrays_zip("n", "y"))).withColumn("name", F.trim("p.n"))
    known = names.groupBy(F.lower(F.trim("mention")).alias("alias")).agg(F.min("qid").alias("qid")).withColumn("line_no", F.lit(0))
    strong = pairs.join(alias_override(pairs.select(F.col("name").alias("mention")), known).select(F.col("mention").alias("name"), "qid"), "name")
    listed = _rows(strong, "AwardEvent", F.col("t"), F.array(_arg("Recipient", F.col("qid"), F.col("name"), "PER"), _arg("Award", F.col("seed_qid"), F.col("seed_qid"), ""), _arg("Time", F.lit(""), F.col("p.y"), "DATE")), "award_list_rule")
    year = T.first_year("sentence")
    keys = ["source_id", "seed_id", "seed_qid", "sentence_idx"]
    rest = rows.filter(F.size("n") == 0).unionByName(rows.filter(F.size("n") > 0).join(strong.select(*keys).distinct(), keys, "left_anti"))
    plain = rest.withColumn("person", F.explode(F.slice(_of("PER"), 1, 2)))
    args = F.array(_arg("Recipient", F.col("person.qid"), F.col("person.mention"), "PER"), _arg("Award", F.col("seed_qid"), F.col("seed_qid"), ""), F.when(year != "", _arg("Time", F.lit(""), year, "DATE")))
    return listed.unionByName(_rows(plain, "AwardEvent", F.col("t"), args, "award_linked_rule"))


def _person(person_seed: str) -> tuple[Column, Column]:
    first = F.get(_of("PER"), F.lit(0))
    own = (F.col("seed_id") == person_seed) & F.col("seed_qid").startswith("Q")
    qid = F.when(own, F.col("seed_qid")).otherwise(first["qid"])
    return qid, F.when(own, F.col("seed_qid")).otherwise(first["mention"])


def post_events(df: DataFrame, person_seed: str) -> DataFrame:
    """Employment events, and where their triggers aren't met education events; both need a linked organisation."""
    emp, edu = trigger("sentence", "EmploymentEvent"), trigger("sentence", "EducationEvent")
    qid, men = _person(person_seed)
    year = T.first_year("sentence")
    rows = df.withColumn("t", F.coalesce(emp, edu)).withColumn("kind", F.when(emp.isNotNull(), "EmploymentEvent").otherwise("EducationEvent")).withColumn("org", F.get(_of("ORG"), F.lit(0))).withColumn("pq", qid).withColumn("pm", men)
    rows = rows.filter("t is not null and org is not null and pq is not null")
    args = F.array(_arg("Person", F.col("pq"), F.col("pm"), "PER"), _arg("Organization", F.col("org.qid"), F.col("org.mention"), "ORG"), F.when(year != "", _arg("Time", F.lit(""), year, "DATE")))
    return _rows(rows, F.col("kind"), F.col("t"), args, "employment_education_rule")


def publication_events(df: DataFrame, names: DataFrame, person_seed: str, concept_seed: str) -> DataFrame:
    """Publication events: the object is the concept seed, else the linked phrase behind the trigger, else a linked
    organisation or place, else the phrase as a literal; without any there is no event."""
    qid, men = _person(person_seed)
    en = T.zh_ratio("sentence") < EN_BELOW
    phrase = F.when(en, F.regexp_extract("sentence", PUBLISHED_EN, 1)).otherwise(F.regexp_extract("sentence", PUBLISHED_ZH, 1))
    rows = df.withColumn("t", trigger("sentence", "PublicationEvent")).withColumn("pq", qid).withColumn("pm", men).filter("t is not null and pq is not null").withColumn("phrase", F.trim(T.strip_marks(F.trim(phrase))))
    rows = rows.join(names.select(F.col("mention").alias("phrase"), F.col("qid").alias("o_qid")), "phrase", "left")
    other = F.get(F.filter("linked", lambda m: m["qid"].startswith("Q") & (m["qid"] != F.col("pq")) & m["ner_label"].isin("ORG", "LOC")), F.lit(0))
    own = (F.col("seed_id") == concept_seed) & F.col("seed_qid").startswith("Q")
    rows = rows.withColumn("oq", F.when(own, F.col("seed_qid")).otherwise(F.coalesce("o_qid", other["qid"], F.lit("")))).withColumn("om", F.when(own, F.col("seed_qid")).when(F.col("o_qid").isNotNull(), F.col("phrase")).otherwise(F.coalesce(other["mention"], F.col("phrase"))))
    rows = rows.filter("oq <> '' or om <> ''")
    year = T.first_year("sentence")
    args = F.array(_arg("Person", F.col("pq"), F.col("pm"), "PER"), _arg("WorkOrConcept", F.col("oq"), F.col("om"), ""), F.when(year != "", _arg("Time", F.lit(""), year, "DATE")))
    return _rows(rows, "PublicationEvent", F.col("t"), args, "publication_rule")


def extract(df: DataFrame, names: DataFrame, person_seed: str, concept_seed: str) -> DataFrame:
    return award_events(df, names).unionByName(post_events(df, person_seed)).unionByName(publication_events(df, names, person_seed, concept_seed))


def _value(role: str) -> Column:
    a = F.get(F.filter("args", lambda x: x["role"] == role), F.lit(0))
    return F.when(a["qid"] != "", a["qid"]).otherwise(T.literal(a["mention"]))


def with_key(events: DataFrame) -> DataFrame:
    """Events with their canonical identifier; those that lack one of the telling arguments are dropped."""
    first, second = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (a, b) in KEY_ROLES.items():
        first = F.when(F.col("event_type") == kind, _value(a)).otherwise(first)
        second = F.when(F.col("event_type") == kind, _value(b)).otherwise(second)
    keyed = events.withColumn("k1", first).withColumn("k2", second).withColumn("k3", F.coalesce(_value("Time"), F.lit("")))
    return keyed.filter("coalesce(k1, '') <> '' and coalesce(k2, '') <> ''").withColumn("can_id", T.stable_id("EVT_CAN_", "event_type", "k1", "k2", "k3"))


def canonical(events: DataFrame) -> DataFrame:
    """One row for each canonical event over all sources: count, name, united arguments, first evidence. Evidence is ranked
    and cut, and arguments are made distinct, before anything is gathered, so a common event is no large row."""
    keyed = with_key(events)
    order = F.struct("source_id", "sentence_idx", "event_id")
    whole = keyed.groupBy("can_id", "event_type").agg(F.count("*").alias("evidence_count"), F.min_by("trigger", order).alias("name"))
    once = keyed.select("can_id", "source_id", "sentence_idx", "event_id").distinct()
    nth = F.row_number().over(Window.partitionBy("can_id").orderBy("source_id", "sentence_idx", "event_id"))
    first = once.withColumn("nth", nth).filter(F.col("nth") <= EVIDENCE).groupBy("can_id").agg(F.array_sort(F.collect_list(order)).alias("evidence"))
    each = keyed.select("can_id", F.explode("args").alias("a")).select("can_id", F.concat_ws("|", "a.role", "a.qid", F.lower("a.mention")).alias("arg")).distinct()
    args = each.groupBy("can_id").agg(F.array_sort(F.collect_list("arg")).alias("args"))
    return whole.join(first, "can_id").join(args, "can_id", "left")


def edges(events: DataFrame) -> DataFrame:
    """Edges from canonical events to their arguments, or to literal nodes; one for each event and target, the first
    argument's role."""
    each = with_key(events).select("can_id", F.posexplode("args").alias("ord", "a"))
    target = F.when(F.col("a.qid") != "", F.col("a.qid")).otherwise(T.stable_id("LIT_", F.lit("literal"), T.literal(F.col("a.mention"))))
    named = each.withColumn("end_id", target).filter((F.col("a.qid") != "") | (T.literal(F.col("a.mention")) != ""))
    return named.groupBy(F.col("can_id").alias("start_id"), "end_id").agg(F.min(F.struct("ord", F.col("a.role").alias("role"), F.lower("a.mention").alias("mention"))).alias("f")).select("start_id", "end_id", F.lit("EVENT_ARG").alias("rel_type"), "f.role", F.lit("event_extraction").alias("provenance"))
