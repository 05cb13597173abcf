"""Seeds, property spaces and claims for the tables at hand; all operators take them as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import TYPE_LABELS
from ..operators.routing import Seed

#: The seeds of a history of computing.
SEEDS = [
    Seed("turing_person", "Q7251", "Person", ("艾伦·图灵", "阿兰·图灵", "图灵", "Alan Turing", "Alan Mathison Turing", "A. M. Turing", "Turing"), ("密码", "破译", "二战", "英国", "数学家", "计算机科学家", "codebreaker", "cryptanalysis", "mathematician", "computer scientist")),
    Seed("turing_machine", "Q163310", "Concept", ("图灵机", "Turing machine"), ("可计算", "停机", "自动机", "算法", "形式语言", "计算模型", "computability", "halting", "automaton", "computation model")),
    Seed("turing_award", "Q185667", "Award", ("图灵奖", "Turing Award"), ("得主", "获奖", "颁奖", "ACM", "奖项", "年度", "recipient", "award", "ACM")),
]
#: Seeds of the test tables' world.
WORLD = [
    Seed("seed_person", "Q910000803", "Person", ("甘威恩·塞尔鲁瑟", "塞尔鲁瑟", "Ganwyn Selrusø", "Selrusø"), ("密码", "定理", "计算员", "cipher", "theorem", "clerk")),
    Seed("seed_machine", "Q910014913", "Concept", ("停机引理", "二型机", "halting lemma", "Mark II"), ("纸带", "继电器", "档案", "tape", "relay", "archive")),
    Seed("seed_award", "Q910017729", "Award", ("金质奖章", "奖委员会", "Gold Medal", "Prize committee"), ("获得", "工作", "received", "although")),
]
PERSON_SEED, CONCEPT_SEED = "seed_person", "seed_machine"
#: First identifiers of the tables that stand for entities.
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = (k * 100_000_000 for k in range(1, 7))
#: Types of the tables' rows: persons, companies, countries, continents-like places, reports; parts take all known types in
#: turn, and one that isn't known.
TYPE_OF = {"customer": "Q5", "supplier": "Q1194970", "nation": "Q6256", "region": "Q82794", "orders": "Q10870555"}
PART_TYPES = [*sorted({q for qs in TYPE_LABELS.values() for q in qs}), "Q999999999"]


def _q(base: int, column: str):
    return F.concat(F.lit("Q"), (F.lit(base) + F.col(column)).cast("string"))


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of the star schema: persons, companies, places, things and orders with their relations and dates."""
    t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")

    def item(df, s, prop, o):
        return df.select(s.alias("subject"), F.lit(prop).alias("prop_id"), F.lit("value").alias("snaktype"), F.lit("wikibase-entityid").alias("value_type"), o.alias("target_qid"), F.lit(None).cast("string").alias("literal"))

    customer, supplier, nation, region, part, orders = t("customer"), t("supplier"), t("nation"), t("region"), t("part"), t("orders")
    made = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = [
        item(customer, _q(CUSTOMER, "c_custkey"), "P27", _q(NATION, "c_nationkey")),
        item(supplier, _q(SUPPLIER, "s_suppkey"), "P17", _q(NATION, "s_nationkey")),
        item(nation, _q(NATION, "n_nationkey"), "P361", _q(REGION, "n_regionkey")),
        item(orders, _q(ORDER, "o_orderkey"), "P710", _q(CUSTOMER, "o_custkey")),
        item(made, _q(PART, "l_partkey"), "P176", _q(SUPPLIER, "l_suppkey")),
    ]
    kind = {name: F.lit(q) for name, q in TYPE_OF.items()}
    kind["part"] = F.element_at(F.array(*[F.lit(q) for q in PART_TYPES]), (F.pmod("p_partkey", F.lit(len(PART_TYPES))) + 1).cast("int"))
    for name, df, base, key in (("customer", customer, CUSTOMER, "c_custkey"), ("supplier", supplier, SUPPLIER, "s_suppkey"), ("nation", nation, NATION, "n_nationkey"), ("region", region, REGION, "r_regionkey"), ("part", part, PART, "p_partkey"), ("orders", orders, ORDER, "o_orderkey")):
        parts.append(item(df, _q(base, key), "P31", kind[name]))
    dates = orders.select(_q(ORDER, "o_orderkey").alias("subject"), F.lit("P571").alias("prop_id"), F.lit("value").alias("snaktype"), F.lit("time").alias("value_type"), F.lit(None).cast("string").alias("target_qid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("literal"))
    births = customer.select(_q(CUSTOMER, "c_custkey").alias("subject"), F.lit("P569").alias("prop_id"), F.lit("value").alias("snaktype"), F.lit("time").alias("value_type"), F.lit(None).cast("string").alias("target_qid"), F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")).alias("literal"))
    out = dates.unionByName(births)
    for p in parts:
        out = out.unionByName(p)
    return out


#: The same in SQL.
CLAIMS_SQL = f"""claims as (
 select 'Q'||({CUSTOMER}+c_custkey) subject,'P27' prop_id,'value' snaktype,'wikibase-entityid' value_type,'Q'||({NATION}+c_nationkey) target_qid,null::varchar literal from customer
 union all select 'Q'||({SUPPLIER}+s_suppkey),'P17','value','wikibase-entityid','Q'||({NATION}+s_nationkey),null from supplier
 union all select 'Q'||({NATION}+n_nationkey),'P361','value','wikibase-entityid','Q'||({REGION}+n_regionkey),null from nation
 union all select 'Q'||({ORDER}+o_orderkey),'P710','value','wikibase-entityid','Q'||({CUSTOMER}+o_custkey),null from orders
 union all select distinct 'Q'||({PART}+l_partkey),'P176','value','wikibase-entityid','Q'||({SUPPLIER}+l_suppkey),null::varchar from lineitem
 union all select 'Q'||({CUSTOMER}+c_custkey),'P31','value','wikibase-entityid','{TYPE_OF["customer"]}',null from customer
 union all select 'Q'||({SUPPLIER}+s_suppkey),'P31','value','wikibase-entityid','{TYPE_OF["supplier"]}',null from supplier
 union all select 'Q'||({NATION}+n_nationkey),'P31','value','wikibase-entityid','{TYPE_OF["nation"]}',null from nation
 union all select 'Q'||({REGION}+r_regionkey),'P31','value','wikibase-entityid','{TYPE_OF["region"]}',null from region
 union all select 'Q'||({PART}+p_partkey),'P31','value','wikibase-entityid',[{','.join(repr(q) for q in PART_TYPES)}][p_partkey%{len(PART_TYPES)}+1],null from part
 union all select 'Q'||({ORDER}+o_orderkey),'P31','value','wikibase-entityid','{TYPE_OF["orders"]}',null from orders
 union all select 'Q'||({ORDER}+o_orderkey),'P571','value','time',null,strftime(o_orderdate,'%Y-%m-%d') from orders
 union all select 'Q'||({CUSTOMER}+c_custkey),'P569','value','time',null,'19'||lpad((c_custkey%100)::varchar,2,'0') from customer)"""
