"""One spelling for text that looks the same (problem 2).

DuckDB runs inside the Arrow partitions: nfc_normalize, translate, replace and regular expressions in one
embedded SQL statement map compatibility forms, invisible characters and look-alike letters. Two keys come
out of it: the plain form, and the skeleton, in which letters of different scripts that look alike are one.
A value that isn't its own plain spelling gets the listed spelling with its skeleton.

Defined results: null values have null forms and are no case; empty values stay empty; a value whose skeleton
no listed spelling has is no case; where several listed spellings share a skeleton, the one that has most
characters in common with the value is taken, and of equals the first in order.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Listed spellings are broadcast up to this number; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000

#: Blocks whose compatibility forms look like the characters they stand for (fixed values, first and last code point).
COMPAT_BLOCKS = ((0x00A0, 0x00A0), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x2100, 0x214F), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0x3000, 0x3000),
                 (0x3131, 0x318E), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFE30, 0xFE4F), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF))
#: Tags of decompositions that a reader can see, which make another text.
VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>", "<small>")
#: Letters and marks of other scripts, each beside the one that it looks like.
LOOK_ALIKES = (
    ("АВСЕНІЈКМОРЅТХУҮԌԚԜӀ", "ABCEHIJKMOPSTXYYGQWI"),
    ("асеіјорѕхуһԛԝԁӏ", "aceijopsxyhqwdl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("ανορικυϲ", "avopikuc"),
    ("ЁёЇї", "ËëÏï"),
    ("‐‑‒−", "----"),
    ("•‧∙⋅・･ᐧ", "·······"),
    ("ıɑɡ", "iag"),
)
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"


def _compat() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of COMPAT_BLOCKS with one plain character, and those with several."""
    one, more = {}, {}
    for a, z in COMPAT_BLOCKS:
        for c in map(chr, range(a, z + 1)):
            tag = unicodedata.decomposition(c).split(" ")[0]
            plain = unicodedata.normalize("NFKC", c)
            if plain == c or tag in VISIBLE_TAGS or not plain.strip() and c not in " 　" and plain != " ":
                continue
            (one if len(plain) == 1 else more)[c] = plain
    return one, {c: p for c, p in more.items() if c in "ﬀﬁﬂﬃﬄﬅﬆ№℡ℹ" or 0x2160 <= ord(c) <= 0x217F}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def forms_sql(column: str, source: str) -> str:
    """SQL that adds plain and skeleton to the rows of source."""
    one, more = _compat()
    mapped = f"translate(nfc_normalize({column}), {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for c, p in more.items():
        mapped = f"replace({mapped}, {_quoted(c)}, {_quoted(p)})"
    blocks = "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in COMPAT_BLOCKS)
    first = f"case when regexp_matches({column}, '[{blocks}]') then {mapped} else nfc_normalize({column}) end"
    clean = f"trim(nfc_normalize(regexp_replace({first}, '{INVISIBLE}', '', 'g')), ' ')"
    like, plain = ("".join(x[k] for x in LOOK_ALIKES) for k in (0, 1))
    return f"select *, translate(plain, {_quoted(like)}, {_quoted(plain)}) as skeleton from (select *, {clean} as plain from {source})"


def with_forms(df: DataFrame, column: str) -> DataFrame:
    """df with columns plain and skeleton of the column, computed by DuckDB in each Arrow batch."""
    sql = forms_sql(f'"{column}"', "batch_rows")
    names = df.columns

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            con.register("batch_rows", pa.Table.from_batches([batch]))
            out = con.sql(sql).to_arrow_table()
            con.unregister("batch_rows")
            table = pa.Table.from_arrays([*(out.column(n) for n in names), out.column("plain"), out.column("skeleton")], [*names, "plain", "skeleton"])
            yield from table.combine_chunks().to_batches()

    return df.mapInArrow(run, f"{_ddl(df)}, plain string, skeleton string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _shared_chars(a, b):
    """How many of a's characters b has at the same place: decides between spellings with one skeleton."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))


def values(resolved: DataFrame, entity_map: DataFrame, relation_schema: DataFrame) -> DataFrame:
    """All values of the three fields: tab, rec_key, pos, value, and the scope in which a relation's spellings stand."""
    r = resolved.select(F.lit("resolved").alias("tab"), F.col("row_id").cast("string").alias("rec_key"), F.lit(0).alias("pos"), F.col("mention").alias("value"))
    e = entity_map.select(F.lit("entity_map").alias("tab"), F.col("line_no").cast("string").alias("rec_key"), F.lit(0).alias("pos"), F.col("alias").alias("value"))
    a = relation_schema.select(F.lit("relation_schema").alias("tab"), F.col("prop_id").alias("rec_key"), F.posexplode("aliases_zh").alias("pos", "value"))
    return r.unionByName(e).unionByName(a).filter(F.col("value").isNotNull() & (F.trim("value") != ""))


#: A word in which scripts meet isn't in the ordinary characters of one script; Greek is no script of these lists.
_MIXED = r"[A-Za-zÀ-ɏ][̀-ͯ]*[Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]|[Ͱ-Ͽ]"


def forms(resolved: DataFrame, entity_map: DataFrame, relation_schema: DataFrame) -> DataFrame:
    """Every value with its plain form and skeleton."""
    return with_forms(values(resolved, entity_map, relation_schema), "value")


def listed(formed: DataFrame) -> DataFrame:
    """The spellings in ordinary characters: scope ("" for entity_map, else the relation), skeleton, clean."""
    bare = F.trim("value")
    ordinary = (bare == F.col("plain")) & ~F.col("plain").rlike(_MIXED) & ~F.col("plain").rlike("[•‧∙⋅･]|[㐀-鿿]・")
    scope = F.when(F.col("tab") == "entity_map", "").otherwise(F.col("rec_key"))
    return formed.filter(F.col("tab") != "resolved").filter(ordinary).select(scope.alias("scope"), "skeleton", F.col("plain").alias("clean")).distinct()


def found(resolved: DataFrame, entity_map: DataFrame, relation_schema: DataFrame) -> DataFrame:
    """(tab, rec_key, pos, clean) of the values that look like a listed spelling but consist of other characters."""
    small = with_forms(values(resolved.limit(0), entity_map, relation_schema), "value")
    spellings = listed(small).persist()
    bounded = spellings.count() <= BROADCAST_ROWS
    every = forms(resolved, entity_map, relation_schema).withColumn("bare", F.trim("value"))
    suspect = every.filter((F.col("bare") != F.col("plain")) | (F.col("plain") != F.col("skeleton")) | F.col("plain").rlike("[Ѐ-ӿ]"))
    hint = F.broadcast if bounded else (lambda d: d)
    shared = spellings.filter("scope = ''").drop("scope")
    own = spellings.filter("scope <> ''").withColumnRenamed("scope", "rec_key")
    by_map = suspect.join(hint(shared), "skeleton")
    by_own = suspect.filter("tab = 'relation_schema'").join(hint(own), ["rec_key", "skeleton"])
    cols = ["tab", "rec_key", "pos", "bare", "clean"]
    hits = by_map.select(cols).unionByName(by_own.select(cols))
    best = hits.withColumn("alike", _shared_chars(F.col("bare"), F.col("clean")))
    one = best.groupBy("tab", "rec_key", "pos", "bare").agg(F.min(F.struct(-F.col("alike"), "clean")).getField("clean").alias("clean"))
    return one.filter(F.col("bare") != F.col("clean")).select("tab", "rec_key", F.col("pos").cast("int").alias("pos"), "clean")


def unified(resolved: DataFrame, entity_map: DataFrame, relation_schema: DataFrame) -> DataFrame:
    """Every value of the three fields in its one spelling: the listed one where there is one, else the plain form."""
    every = forms(resolved, entity_map, relation_schema)
    clean = found(resolved, entity_map, relation_schema)
    return every.join(clean, ["tab", "rec_key", "pos"], "left").select("tab", "rec_key", "pos", "value", F.coalesce("clean", "plain").alias("clean"))
