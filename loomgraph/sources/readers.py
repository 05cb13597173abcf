"""Inputs: article folders, excerpts, volumes, stage files, graph and triple tables, dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK = ("chunk_ord", "lang", "title", "provenance", "citation_key", "source_url", "source_id", "source_label", "text")
#: How the first line of an excerpt begins, and what source that tells (citation key, address).
EXCERPT_SOURCES = (
    ("三联生活周刊", "sanlian_lifeweek_turing_ai_father", ""),
    ("Alan Turing", "wikipedia_zh_snippet_alan_turing", "https://en.wikipedia.org/wiki/Alan_Turing"),
    ("纽约时报", "nytcn_turing_morphogenesis_2018", "https://cn.nytimes.com/"),
    ("BBC", "bbc_cn_turing_banknote_2019", "https://www.bbc.com/zhongwen/simp"),
)
#: What the first line of the last of these sources holds besides, and words that its title line has by preference.
BBC_ALSO, BBC_TITLE_WORDS = "中文", ("图灵", "英镑")
#: Lines at which an excerpt begins.
EXCERPT_STARTS = r"(?m)(?=^(?:https://\S+|三联生活周刊[^\n]*|Alan Turing\(|纽约时报中文网$|BBC news中文$))"


def front_matter(text) -> tuple[Column, Column]:
    """(map of the fields between leading --- lines, keys in lower case; the text behind them). Without such a block the
    map is empty and the text stays whole."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\r\n", "\n")
    rx = r"(?s)^\s*---[ \t]*\n(.*?)\n---[ \t]*\n(.*)$"
    block, body = F.regexp_extract(t, rx, 1), F.regexp_extract(t, rx, 2)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    # of fields named twice the last one holds
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    meta = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))
    return F.when(t.rlike(rx), meta).otherwise(F.create_map().cast("map<string,string>")), F.when(t.rlike(rx), body).otherwise(t)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a folder of .txt files, README.TXT left out, in the order of their names."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    meta, body = front_matter("raw")
    rows = raw.filter(F.upper("file") != "README.TXT").select("file", meta.alias("m"), body.alias("body"))
    names = rows.select("file").withColumn("chunk_ord", F.row_number().over(Window.orderBy("file")) - 1)
    stem = F.regexp_replace("file", r"\.txt$", "")
    return rows.join(names, "file").select(
        "chunk_ord", F.when(T.is_zh("body"), "zh").otherwise("en").alias("lang"), F.coalesce(F.col("m")["title"], stem).alias("title"), F.lit("article").alias("provenance"),
        F.coalesce(F.col("m")["cite"], stem).alias("citation_key"), F.coalesce(F.col("m")["url"], F.lit("")).alias("source_url"),
        F.concat(F.lit("file:"), "file").alias("source_id"), F.concat(F.lit("article:"), F.coalesce(F.col("m")["title"], stem)).alias("source_label"), T.strip("body").alias("text"),
    )


def excerpt_source(chunk) -> tuple[Column, Column, Column]:
    """(citation key, address, title) that an excerpt's first lines tell."""
    lines = F.filter(F.transform(F.split(F.col(chunk), "\n"), T.strip), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    cite, url, title = F.lit("user_excerpt"), F.lit(""), F.substring(first, 1, 120)
    long = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: F.length(x) >= 10)
    later = F.coalesce(F.get(long, F.lit(0)), first)
    told = F.get(F.filter(long, lambda x: F.contains(x, F.lit(BBC_TITLE_WORDS[0])) | F.contains(x, F.lit(BBC_TITLE_WORDS[1]))), F.lit(0))
    bbc = F.contains(first, F.lit("BBC")) & F.contains(first, F.lit(BBC_ALSO))
    for start, key, address in reversed(EXCERPT_SOURCES):
        hit = bbc if start == "BBC" else first.startswith(start)
        cite, url = F.when(hit, key).otherwise(cite), F.when(hit, address).otherwise(url)
    title = F.when(first.startswith("纽约时报"), F.substring(later, 1, 120)).when(bbc, F.substring(F.coalesce(told, later), 1, 120)).otherwise(title)
    web = first.startswith("http")
    cite, url = F.when(web, "zhihu_zhuanlan_turing_bio").otherwise(cite), F.when(web, F.substring_index(first, " ", 1)).otherwise(url)
    rest = F.trim(F.regexp_replace(first, r"^\S+\s*", ""))
    return cite, url, F.when(web, F.when(rest == "", "article").otherwise(F.substring(rest, 1, 120))).otherwise(title)


def excerpts(raw: DataFrame) -> DataFrame:
    """Excerpts of texts that hold several, one after another; what stands before the first one is dropped. A text with
    front matter that names its source, or without any start line, is one excerpt. raw: text_id, text."""
    meta, body = front_matter("text")
    rows = raw.select("text_id", meta.alias("m"), body.alias("body"), T.strip("text").alias("text"))
    own = F.col("m")["cite"].isNotNull() & (T.strip("body") != "")
    parts = F.split("text", EXCERPT_STARTS)
    starts = F.regexp_like("text", F.lit(EXCERPT_STARTS))
    first_is_start = F.regexp_like(F.get(parts, F.lit(0)), F.lit(EXCERPT_STARTS))
    cut = F.when(~starts, parts).when(first_is_start, parts).otherwise(F.slice(parts, 2, 1 << 20))
    each = rows.select("text_id", "m", "body", own.alias("own"), starts.alias("starts"), F.posexplode(F.when(own, F.array(T.strip("body"))).otherwise(F.filter(F.transform(cut, T.strip), lambda x: x != ""))).alias("ord", "chunk"))
    cite, url, title = excerpt_source("chunk")
    pick = lambda mine, none, found: F.when(F.col("own"), mine).when(~F.col("starts"), none).otherwise(found)
    return each.select(
        "text_id", "ord", "chunk", pick(F.coalesce(F.col("m")["cite"], F.lit("user")), F.lit("user_excerpt_monolith"), cite).alias("citation_key"),
        pick(F.coalesce(F.col("m")["url"], F.lit("")), F.lit(""), url).alias("source_url"), pick(F.coalesce(F.col("m")["title"], F.lit("excerpt")), F.lit("book_excerpt"), title).alias("title"),
    )


def volume_pages(spark: SparkSession, pattern: str, sources: DataFrame, extract: Callable[[bytes, int, int | None], str]) -> DataFrame:
    """Chunks of binary files: extract gives the text of a page range. sources: pdf_relative_path, cite_key, page_start,
    page_end, label, enabled."""
    # the relative path is a file's path from some folder on, so every tail of the path is a key
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    names = spark.read.format("binaryFile").load(pattern).select("path")
    on = sources.filter(F.coalesce("enabled", F.lit(True))).select(*[c for c in ("pdf_relative_path", "cite_key", "page_start", "page_end", "label") if c in sources.columns])
    wanted = names.select("path", F.explode(tails).alias("pdf_relative_path")).join(on, "pdf_relative_path")
    both = spark.read.format("binaryFile").load(pattern).select("path", "content").join(wanted, "path")
    kept = ("pdf_relative_path", "cite_key", "page_start", "page_end", "label")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(c, a, b) for c, a, b in zip(*(batch.column(n).to_pylist() for n in ("content", "page_start", "page_end")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "text"])

    both = both.select(*kept, "content").mapInArrow(run, "pdf_relative_path string, cite_key string, page_start int, page_end int, label string, text string")
    name = F.concat(F.lit("file:"), "pdf_relative_path", F.lit("#pages="), F.coalesce(F.col("page_start").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("")))
    return both.select(F.lit(None).cast("int").alias("chunk_ord"), F.lit(None).cast("string").alias("lang"), F.col("label").alias("title"), F.lit("pdf").alias("provenance"), F.col("cite_key").alias("citation_key"), F.lit("").alias("source_url"), name.alias("source_id"), F.concat(F.lit("pdf:"), F.coalesce("label", F.lit(""))).alias("source_label"), "text")


def collect(*parts: DataFrame) -> DataFrame:
    """Chunks of several sources, in the order of the sources and within each in its own: part, then CHUNK's columns."""
    out = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).alias("part"), *CHUNK)
        out = one if out is None else out.unionByName(one)
    return out


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """Sentences of chunks, numbered from 0 within each source in the order of its chunks."""
    each = chunks.select("source_id", "source_url", "source_label", "citation_key", "chunk_ord", T.sentences("text").alias("s")).withColumn("n", F.size("s"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_id").orderBy("chunk_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = each.select("source_id", "chunk_ord", "n").withColumn("before", before).drop("n")
    whole = each.drop("n").join(counted, ["source_id", "chunk_ord"])
    return whole.select("source_id", "source_url", "source_label", "citation_key", F.lit(0).alias("paragraph_idx"), "before", F.posexplode("s").alias("i", "sentence")).select("source_id", "source_url", "source_label", "citation_key", "paragraph_idx", (F.col("before") + F.col("i")).cast("int").alias("sentence_idx"), "sentence")


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines of JSON; those that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def graph_csv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder written by sinks.graph_csv; further columns become props."""
    n, e = _csv(spark, f"{folder}/nodes.csv"), _csv(spark, f"{folder}/relationships.csv")

    def props(df, base):
        more = [c for c in df.columns if c not in base]
        filled = F.map_filter(F.create_map(*[x for c in more for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if more else F.create_map().cast("map<string,string>")
        return filled.alias("props")

    nodes = n.select(F.col("`id:ID`").alias("id"), "name", F.coalesce("extra", F.lit("")).alias("extra"), F.filter(F.split(F.coalesce("`:LABEL`", F.lit("")), ";"), lambda x: x != "").alias("labels"), props(n, {"id:ID", "name", "extra", ":LABEL"}))
    base = {":START_ID", ":END_ID", ":TYPE", "prop_id", "provenance", "layer", "citation_key", "snippet", "source_url", "edge_id"}
    edges = e.select(F.col("`:START_ID`").alias("start_id"), F.col("`:END_ID`").alias("end_id"), F.col("`:TYPE`").alias("rel_type"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("prop_id", "provenance", "layer", "citation_key", "snippet", "source_url", "edge_id") if c in e.columns], props(e, base))
    return nodes, edges


def triples_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of triples; an empty one where the file is missing."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return _csv(spark, path)


def alias_csv(spark: SparkSession, path: str) -> DataFrame:
    """line_no, alias, wikidata_id, kind of an alias table, stripped."""
    raw = _csv(spark, path).select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    # one file after another; an alias table is small, as it is made by hand
    raw = raw.withColumn("line_no", F.row_number().over(Window.orderBy("_file", "_at")).cast("bigint"))
    return raw.select("line_no", *[T.strip(c).alias(c) for c in ("alias", "wikidata_id", "kind")])


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def conll(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, pos, token, tag of files with one token in a line and empty lines between sentences. Lines are in order by
    the split of the file that they stand in; empty lines are counted within splits and carried over, so no task gets a
    whole file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    blank = F.when(F.trim("value") == "", 1).otherwise(0)
    within = F.sum(blank).over(Window.partitionBy("file", "part").orderBy("line"))
    counts = lines.groupBy("file", "part").agg(F.sum(blank).alias("blanks"))
    before = F.coalesce(F.sum("blanks").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("file", "part", before.alias("base"))
    kept = lines.withColumn("within", within).filter(F.trim("value") != "").join(F.broadcast(base), ["file", "part"]).withColumn("sent", F.col("base") + F.col("within"))
    parts = F.split("value", "\t")
    pos = F.row_number().over(Window.partitionBy("file", "sent").orderBy("part", "line")) - 1
    return kept.select("file", "sent", pos.alias("pos"), F.get(parts, F.lit(0)).alias("token"), F.coalesce(F.get(parts, F.lit(1)), F.lit("O")).alias("tag"))


def seed_excerpts(pages_: DataFrame, seeds: list) -> DataFrame:
    """Encyclopedia pages of the seeds: for each the page named by its first Chinese and by its first English anchor; names
    without a page are skipped. pages_: lang, title, url, text."""
    def first(s, zh: bool):
        return next((a for a in s.anchors if any("\u4e00" <= c <= "\u9fff" for c in a) == zh), None)

    wanted = [(i, lang, a) for i, s in enumerate(seeds) for lang, a in (("zh", first(s, True)), ("en", first(s, False))) if a]
    names = pages_.sparkSession.createDataFrame(wanted, "seed_ord int, lang string, title string")
    one = pages_.filter("text is not null").groupBy("lang", "title").agg(F.min(F.struct("url", "text")).alias("p"))
    return names.join(one, ["lang", "title"]).select("seed_ord", "lang", "title", "p.url", "p.text")


def prediction_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Predictions of a folder: the merged file where it is there and not empty, else those of all seed types together."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/re_predictions.jsonl")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(place) and system.getContentSummary(place).getLength() > 0:
        return jsonl(spark, f"{folder}/re_predictions.jsonl", schema)
    if not system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/re_predictions_pcnn_*.jsonl")):
        return spark.createDataFrame([], schema)
    return jsonl(spark, f"{folder}/re_predictions_pcnn_*.jsonl", schema)


def query_results(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of graph query results in their JSON form: the text value of each name, null where it isn't bound."""
    fields = ", ".join(f"`{n}`: struct<value: string>" for n in names)
    raw = spark.read.option("multiLine", True).schema(f"results struct<bindings: array<struct<{fields}>>>").json(path)
    return raw.select(F.explode("results.bindings").alias("b")).select(*[F.col(f"b.`{n}`.value").alias(n) for n in names])


def pages(html: DataFrame, most: int = 250_000) -> DataFrame:
    """Visible text of fetched pages. html: url, html and what else there is."""
    return html.withColumn("text", F.substring(T.strip_html("html"), 1, most))


def search(queries: DataFrame, index: DataFrame, most: int = 10) -> DataFrame:
    """The entries of a search table for each query of two characters or more, by language. queries: query; index: query,
    language, rank, id, label, description."""
    return queries.filter(F.length("query") >= 2).select("query").distinct().join(index.filter(F.col("rank") < most), "query")


def entities(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The entries of an entity table for the ids asked for."""
    return table.join(ids.select("id").distinct(), "id", "left_semi")
