"""The property graph: claims, neighbourhoods, node types, upserts, edges, and queries over them.

Nodes are contributions (id, name, extra, labels, props, ord) that are folded by id; edges are rows with a stable
edge_id. Claims: subject, prop_id, snaktype, value_type, target_qid, literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DROPPED_PROPS = ("P910", "P1424")
LIFE_PROPS = ("P569", "P570")
TOP_KINDS = ("Person", "Award", "Concept", "Organization", "Location", "Work")
FACTS = ("wikidata", "wikidata_incoming")
#: Display labels of properties.
PROP_LABELS = {"P31": "实例", "P279": "子类", "P361": "隶属于", "P127": "所有者", "P137": "运营方", "P17": "国家", "P276": "地点", "P800": "主要作品", "P166": "所获奖项", "P921": "作品主题", "P1343": "记载于", "P366": "有用途", "P1535": "使用者", "P2579": "研究学科", "P1344": "参与者"}
#: Properties of incoming edges and their number at most, by focal entity.
INCOMING = {"Q163310": (("P800", "P921", "P1343", "P361", "P366", "P2579", "P1535"), 50), "Q185667": (("P166", "P1343", "P921", "P361", "P1344"), 45)}
#: Labels that types (instance of, subclass of) give, one line for each label.
TYPE_LABELS = {
    "Person": ("Q5",),
    "Award": ("Q618779", "Q11448906", "Q19020", "Q20006438"),
    "Fellowship": ("Q20006438",),
    "Prize": ("Q19020",),
    "Organization": ("Q43229", "Q484652", "Q79913", "Q327333", "Q96888669", "Q1194970", "Q891723", "Q1589009", "Q129492653"),
    "GovernmentAgency": ("Q327333",),
    "Company": ("Q1194970", "Q891723"),
    "MediaCompany": ("Q1589009",),
    "Publisher": ("Q96888669",),
    "MilitaryOrganization": ("Q129492653",),
    "University": ("Q3918", "Q902104", "Q15936437"),
    "School": ("Q2418495", "Q269770", "Q1713379", "Q5155053", "Q9842"),
    "Archive": ("Q27032435",),
    "Library": ("Q1574516",),
    "Location": ("Q17334923", "Q2221906", "Q515", "Q6256", "Q82794", "Q33742", "Q1288568", "Q34770", "Q3957", "Q2755753", "Q4919932", "Q157570", "Q7265244"),
    "Country": ("Q6256", "Q1288568"),
    "City": ("Q515", "Q3957", "Q2755753"),
    "Facility": ("Q4919932", "Q7265244", "Q157570"),
    "Work": ("Q13442814", "Q10383930", "Q3331189", "Q10870555", "Q21114848", "Q41298"),
    "ScholarlyArticle": ("Q13442814",),
    "Paper": ("Q13442814",),
    "Journal": ("Q10383930",),
    "Periodical": ("Q21114848", "Q41298"),
    "WorkVersion": ("Q3331189",),
    "Report": ("Q10870555",),
    "Concept": ("Q151885", "Q7184903", "Q33104279", "Q28640", "Q12737077", "Q11862829", "Q1047113", "Q483394", "Q24034552", "Q1936384", "Q123370638", "Q112193867", "Q31629", "Q4830453", "Q137172521", "Q101352", "Q12308941", "Q14204246", "Q16695773", "Q51539995", "Q10823887", "Q14827288", "Q33120876", "Q136375263"),
    "Profession": ("Q28640",),
    "Occupation": ("Q12737077",),
    "Discipline": ("Q11862829", "Q4671286"),
    "Field": ("Q1047113", "Q1936384", "Q123370638"),
    "Science": ("Q7991", "Q901"),
    "Mathematics": ("Q901", "Q1936384"),
    "ComputerScience": ("Q123370638",),
    "Logic": ("Q816264",),
    "MathematicalConcept": ("Q24034552",),
    "MathematicsBranch": ("Q1936384",),
    "ComputerScienceBranch": ("Q123370638",),
    "DiseaseClass": ("Q112193867",),
    "SportType": ("Q31629",),
    "Business": ("Q4830453",),
    "Machine": ("Q137172521",),
    "Automaton": ("Q137172521",),
    "Name": ("Q101352", "Q12308941"),
    "FamilyName": ("Q101352",),
    "GivenName": ("Q12308941",),
    "Wikimedia": ("Q14204246", "Q16695773", "Q51539995", "Q10823887", "Q14827288", "Q33120876", "Q136375263"),
    "WikiProject": ("Q16695773", "Q51539995"),
}
#: The label that finer labels bring with them.
PARENTS = {
    "Organization": ("University", "School", "Company", "Publisher", "GovernmentAgency", "Archive", "Library", "MediaCompany", "MilitaryOrganization"),
    "Location": ("Country", "City", "Facility"),
    "Work": ("ScholarlyArticle", "Paper", "Journal", "Periodical", "WorkVersion", "Report"),
}


def claims_from_entities(entities: DataFrame) -> DataFrame:
    """Claims of entities whose claims are a map from property to statements. entities: id, claims map<string,
    array<struct<snaktype, value_type, target_qid, literal>>>."""
    each = entities.select(F.col("id").alias("subject"), F.explode(F.map_entries("claims")).alias("p"))
    return each.select("subject", F.col("p.key").alias("prop_id"), F.explode("p.value").alias("s")).select("subject", "prop_id", "s.*")


def item_edges(claims: DataFrame) -> DataFrame:
    """Claims between entities: the property begins with P, the value is an entity that begins with Q."""
    return claims.filter(F.col("prop_id").startswith("P") & (F.col("snaktype") == "value") & (F.col("value_type") == "wikibase-entityid") & F.col("target_qid").startswith("Q")).select("subject", "prop_id", "target_qid")


def literals(claims: DataFrame, props: list[str] | None = None) -> DataFrame:
    """Claims whose value isn't an entity."""
    out = claims.filter((F.col("snaktype") == "value") & (F.col("value_type") != "wikibase-entityid") & (F.coalesce("literal", F.lit("")) != ""))
    return (out.filter(F.col("prop_id").isin(props)) if props else out).select("subject", "prop_id", "literal")


def neighbourhood(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots' edges and those of their targets, with the number of steps (1 or 2). roots: id."""
    e = item_edges(claims)
    first = e.join(roots.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi").withColumn("steps", F.lit(1))
    onward = first.select(F.col("target_qid").alias("subject")).distinct().join(roots.select(F.col("id").alias("subject")).distinct(), "subject", "left_anti")
    return first.unionByName(e.join(onward, "subject", "left_semi").withColumn("steps", F.lit(2)))


def _type_table(spark, rules: dict[str, tuple[str, ...]], parents: dict[str, tuple[str, ...]]) -> DataFrame:
    """type_qid, labels: what each type gives, with the labels that those bring along."""
    by: dict[str, set[str]] = {}
    for label, qids in rules.items():
        for q in qids:
            by.setdefault(q, set()).update({label, *(p for p, cs in parents.items() if label in cs)})
    return spark.createDataFrame([(q, sorted(labels)) for q, labels in by.items()], "type_qid string, given array<string>")


def labels_of_types(claims: DataFrame, rules: dict | None = None, parents: dict | None = None) -> DataFrame:
    """id, labels: what an entity's types (P31, P279) give, with the labels that those bring along; Concept where an
    entity has types but none is known. One pass over the claims and one exchange."""
    table = _type_table(claims.sparkSession, rules or TYPE_LABELS, parents or PARENTS)
    types = item_edges(claims.filter(F.col("prop_id").isin("P31", "P279"))).select(F.col("subject").alias("id"), F.col("target_qid").alias("type_qid"))
    none = F.array(F.lit(None).cast("string"))
    each = types.join(F.broadcast(table), "type_qid", "left").select("id", F.explode(F.coalesce("given", none)).alias("label"))
    labels = each.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return labels.withColumn("labels", F.when(F.size("labels") == 0, F.array(F.lit("Concept"))).otherwise(F.col("labels")))


def coarse_kind(labels) -> Column:
    """The first of Person, Award, Organization, Location, Concept among the labels, Concept otherwise."""
    c = F.col(labels) if isinstance(labels, str) else labels
    out = F.lit("Concept")
    for kind in ("Location", "Organization", "Award", "Person"):
        out = F.when(F.array_contains(c, kind), kind).otherwise(out)
    return out


def outgoing(claims: DataFrame) -> DataFrame:
    """Facts edges of claims, without properties that only serve to navigate."""
    e = item_edges(claims).filter(~F.col("prop_id").isin(*DROPPED_PROPS))
    return edges(e.select(F.col("subject").alias("start_id"), F.col("target_qid").alias("end_id"), "prop_id", F.lit("wikidata").alias("provenance")))


def birth_and_death(claims: DataFrame, roots: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id, extra: the roots' birth and death (P569, P570) as "label: value", joined in order. roots: id; names: id, label."""
    own = literals(claims.filter(F.col("prop_id").isin(*LIFE_PROPS))).join(roots.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi")
    shown = own.join(names.select(F.col("id").alias("prop_id"), "label"), "prop_id", "left") if names is not None else own.withColumn("label", F.lit(None).cast("string"))
    part = F.concat(F.coalesce("label", "prop_id"), F.lit(": "), F.col("literal"))
    return shown.select(F.col("subject").alias("id"), part.alias("part")).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("part")), " | ").alias("extra"))


def seed_labels(seeds: list, ord_no: int = 90) -> list[tuple]:
    """Contributions that give seeds their type as a label: (id, name, extra, labels, ord)."""
    return [(s.qid, "", "", [s.type], ord_no) for s in seeds if s.qid.startswith("Q") and s.type.strip()]


def structured(claims: DataFrame, seeds: list, focal: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(contributions, edges) of the structured layer for all seeds at once: their own claims, what the targets are,
    births and deaths, the seeds' types, and the edges that come in at focal entities."""
    spark = claims.sparkSession
    roots = spark.createDataFrame([(s.qid,) for s in seeds if s.qid.startswith("Q")] or [("",)], "id string")
    own = claims.join(F.broadcast(roots.select(F.col("id").alias("subject"))), "subject", "left_semi")
    out = outgoing(own)
    every = out.unionByName(incoming(claims, out, INCOMING if focal is None else focal))
    ends = every.select(F.col("start_id").alias("id")).unionByName(every.select(F.col("end_id").alias("id"))).unionByName(roots.filter("id <> ''")).distinct()
    typed = labels_of_types(claims.filter(F.col("prop_id").isin("P31", "P279")).join(ends.select(F.col("id").alias("subject")), "subject", "left_semi"))
    lives = birth_and_death(claims, roots)
    empty = F.array().cast("array<string>")
    rows = ends.join(typed, "id", "left").join(lives, "id", "left").select("id", F.lit("").alias("name"), F.coalesce("extra", F.lit("")).alias("extra"), F.coalesce("labels", empty).alias("labels"), F.lit(0).alias("ord"))
    own_types = spark.createDataFrame(seed_labels(seeds), "id string, name string, extra string, labels array<string>, ord int")
    return rows.unionByName(own_types), every


def incoming(claims: DataFrame, known: DataFrame, focal: dict = INCOMING) -> DataFrame:
    """Edges that come in at focal entities, the first of each entity's limit by subject and property, without those
    that known (start_id, end_id, prop_id) has already. Each focal entity's edges are filtered, made distinct and cut to
    its limit by a top-k of its own, so an entity with very many of them is no large task."""
    out = None
    for q, (props, most) in focal.items():
        own = item_edges(claims.filter((F.col("target_qid") == q) & F.col("prop_id").isin(*props))).distinct()
        first = own.orderBy("subject", "prop_id").limit(most)
        out = first if out is None else out.unionByName(first)
    if out is None:
        out = item_edges(claims).limit(0)
    named = out.select(F.col("subject").alias("start_id"), F.col("target_qid").alias("end_id"), "prop_id", F.lit("wikidata_incoming").alias("provenance"))
    near = known.filter(F.col("end_id").isin(*focal)).select("start_id", "end_id", "prop_id").distinct()
    return edges(named.join(near, ["start_id", "end_id", "prop_id"], "left_anti"))


def layer(provenance) -> Column:
    return F.when((F.col(provenance) if isinstance(provenance, str) else provenance).isin(*FACTS), "facts").otherwise("evidence")


def edges(rows: DataFrame) -> DataFrame:
    """Edges with relationship type, stable identifier and layer, each identifier once. rows: start_id, end_id, prop_id,
    provenance, and where they have them predicate, citation_key, snippet, source_url."""
    have = set(rows.columns)
    full = rows.select("*", *[F.lit("").alias(c) for c in ("predicate", "citation_key", "snippet", "source_url") if c not in have])
    by_prop = F.coalesce("prop_id", F.lit("")).rlike(r"^P[0-9]+$")
    kind = F.when(by_prop, T.rel_type("prop_id")).otherwise(T.rel_type_text("predicate"))
    ident = T.stable_id("", "start_id", "end_id", kind, "provenance", "source_url", "snippet")
    out = full.withColumn("rel_type", kind).withColumn("edge_id", ident).withColumn("layer", layer("provenance"))
    keep = [c for c in out.columns if c != "edge_id"]
    return out.groupBy("edge_id").agg(F.min(F.struct(*keep)).alias("e")).select("edge_id", "e.*")


def nodes(contributions: DataFrame) -> DataFrame:
    """Nodes folded from contributions in their order (ord): the first name that is more than the identifier, the last
    extra text that isn't empty, all labels, of each property the last value that isn't null."""
    name = F.coalesce("name", F.lit(""))
    good = F.when((name != "") & (name != F.col("id")), F.struct("ord", name.alias("name")))
    extra = F.when(F.coalesce("extra", F.lit("")) != "", F.struct("ord", "extra"))
    named = contributions.groupBy("id").agg(F.min(good).alias("n"), F.max(extra).alias("e"))
    labels = contributions.select("id", F.explode("labels").alias("label")).filter("label is not null").distinct().groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    base = named.join(labels, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    props = contributions.select("id", "ord", F.explode(F.map_entries("props")).alias("p")).filter("p.value is not null").groupBy("id", "p.key").agg(F.max_by("p.value", "ord").alias("value"))
    maps = props.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("props"))
    return base.join(maps, "id", "left").select("id", F.coalesce("n.name", "id").alias("name"), F.coalesce("e.extra", F.lit("")).alias("extra"), "labels", "props")


def add_labels(graph_nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Labels united with more (id, labels), for nodes that exist."""
    m = more.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("more"))
    return graph_nodes.join(m, "id", "left").withColumn("labels", F.array_sort(F.array_union("labels", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


def enrich_kinds(graph_nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """Q nodes without any top kind get the labels of their types."""
    lacking = F.col("id").rlike("^Q[0-9]+$") & ~F.arrays_overlap("labels", F.array(*[F.lit(k) for k in TOP_KINDS]))
    return add_labels(graph_nodes, graph_nodes.filter(lacking).select("id").join(typed, "id"))


def fill_names(graph_nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Names that are empty or the identifier are taken from the entities' labels."""
    e = entities.select("id", T.pick_label("labels", "id").alias("label"))
    return graph_nodes.join(e, "id", "left").withColumn("name", F.when((F.col("name") == "") | (F.col("name") == F.col("id")), F.coalesce("label", "name")).otherwise(F.col("name"))).drop("label")


def without_edges(graph_edges: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Edges of which known has none with equal columns."""
    return graph_edges.join(known.select(*by).distinct(), by, "left_anti")


def replace_provenance(graph_edges: DataFrame, fresh: DataFrame, provenance: str = "wikidata_incoming") -> DataFrame:
    return graph_edges.filter(F.col("provenance") != provenance).unionByName(fresh, allowMissingColumns=True)


def find_nodes(graph_nodes: DataFrame, node_id: str = "", part: str = "", most: int = 20) -> DataFrame:
    """Nodes of an identifier or with a part of a name, whatever its case; the first by identifier."""
    hit = (F.col("id") == node_id) | (F.contains(F.lower("name"), F.lit(part.lower())) if part else F.lit(False))
    return graph_nodes.filter(hit).orderBy("id").limit(most)


def root_facts(graph_edges: DataFrame, graph_nodes: DataFrame, root: str, most: int = 100) -> DataFrame:
    own = graph_edges.filter((F.col("layer") == "facts") & (F.col("start_id") == root))
    return own.join(graph_nodes.select(F.col("id").alias("end_id"), F.col("name").alias("end_name")), "end_id").orderBy("rel_type", "end_id", "edge_id").limit(most)


def top_evidence(graph_edges: DataFrame, most: int = 100) -> DataFrame:
    return graph_edges.filter(F.col("layer") == "evidence").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "edge_id").limit(most)


def supported(graph_edges: DataFrame) -> DataFrame:
    """Edges from text with a flag whether a fact states the same."""
    facts = graph_edges.filter(F.col("provenance") == "wikidata").select("start_id", "end_id", "prop_id").distinct().withColumn("known", F.lit(True))
    text = graph_edges.filter(F.col("layer") == "evidence")
    return text.join(facts, ["start_id", "end_id", "prop_id"], "left").withColumn("is_supporting_fact", F.coalesce("known", F.lit(False)).cast("int")).drop("known")


def supporting_evidence(graph_edges: DataFrame, graph_nodes: DataFrame, most: int = 100, provenance: str = "text_re") -> DataFrame:
    """Text edges that a fact supports with the names of both ends, the best scores first (ties: edge_id). graph_edges:
    is_supporting_fact and score among the columns."""
    hit = graph_edges.filter((F.col("provenance") == provenance) & (F.col("is_supporting_fact") == 1))
    names = lambda end: graph_nodes.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
    both = hit.join(names("start"), "start_id").join(names("end"), "end_id")
    return both.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "edge_id").limit(most)


def by_provenance(graph_edges: DataFrame) -> DataFrame:
    return graph_edges.groupBy("provenance").agg(F.count("*").alias("edges"))
