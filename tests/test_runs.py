"""Readers and writers give back what they got; whole runs; streams."""

from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.plans import config, pipeline
from loomgraph.sources import readers, sinks
from loomgraph.streaming import routing as stream


def test_articles_and_front_matter(spark, tmp_path):
    (tmp_path / "b.txt").write_text("---\ncite: key\nURL: http://x\ntitle: T: more\n---\nbody text 中文中文中文", encoding="utf-8")
    (tmp_path / "a.txt").write_text("no front matter", encoding="utf-8")
    (tmp_path / "README.TXT").write_text("no", encoding="utf-8")
    rows = readers.articles(spark, str(tmp_path)).orderBy("chunk_ord").collect()
    assert [(r["citation_key"], r["source_url"], r["title"], r["text"]) for r in rows] == [("a", "", "a", "no front matter"), ("key", "http://x", "T: more", "body text 中文中文中文")]


def test_excerpts(spark):
    text = "lost\nhttps://zhuanlan.example/1 A title\nfirst text\n纽约时报中文网\n短\n一个超过十个字的题目在这里\n第二篇"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, "---\ncite: c\n---\nbody")], "text_id int, text string")
    got = [(r["text_id"], r["citation_key"], r["title"]) for r in readers.excerpts(df).orderBy("text_id", "ord").collect()]
    assert got == [(1, "zhihu_zhuanlan_turing_bio", "A title"), (1, "nytcn_turing_morphogenesis_2018", "一个超过十个字的题目在这里"), (2, "user_excerpt_monolith", "book_excerpt"), (3, "c", "excerpt")]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("Q1", "A, \"quoted\"", "", ["Person"], {"k": "v"}), ("Q2", "", "x\ny", [], None)], "id string, name string, extra string, labels array<string>, props map<string,string>")
    edges = graph.edges(spark.createDataFrame([("Q1", "Q2", "P27", "wikidata", "two\nlines")], "start_id string, end_id string, prop_id string, provenance string, snippet string"))
    sinks.graph_csv(nodes, edges, str(tmp_path / "g"), ["k"])
    n, e = readers.graph_csv(spark, str(tmp_path / "g"))
    got = {r["id"]: (r["name"], r["labels"], r["props"].get("k")) for r in n.collect()}
    assert got == {"Q1": ("A, \"quoted\"", ["Entity", "Person"], "v"), "Q2": ("Q2", ["Entity"], None)}
    row = e.first()
    assert (row["rel_type"], row["layer"], row["snippet"], row["edge_id"]) == ("WIKI_P27", "facts", "two lines", edges.first()["edge_id"])
    again = pipeline.export_only(spark, str(tmp_path / "g"), edges)[1]
    assert again.count() == 1
    s = sinks.summary(nodes, edges, "Q1").first()
    assert (s["nodes"], s["edges"], s["facts"]) == (2, 1, 1)
    db_nodes, db_edges = sinks.database_tables(nodes, edges)
    assert db_nodes.count() == 2 and db_edges.count() == 1


def test_stage_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "s.jsonl"), "a int").count() == 2
    (tmp_path / "t.conll").write_text("艾\tB-PER\n伦\tI-PER\n\n他\tO\n")
    rows = readers.conll(spark, str(tmp_path / "t.conll")).orderBy("sent", "pos").collect()
    assert [(r["sent"], r["pos"], r["token"], r["tag"]) for r in rows] == [(0, 0, "艾", "B-PER"), (0, 1, "伦", "I-PER"), (1, 0, "他", "O")]
    assert readers.triples_csv(spark, str(tmp_path / "none.csv"), list(sinks.TRIPLE)).count() == 0
    tagged = spark.createDataFrame([(["艾", "伦"], ["B-PER", "I-PER"])], "letters array<string>, tags array<string>")
    sinks.conll(tagged, str(tmp_path / "out"))
    assert readers.conll(spark, str(tmp_path / "out")).count() == 2


def test_curated_and_full_runs(spark, folder, tmp_path):
    t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    run = pipeline.from_curated(t("sentences"), t("resolved"), t("triples_extracted"), t("entity_map"), config.claims(spark, folder), config.PERSON_SEED, config.CONCEPT_SEED)
    ids = run["nodes"].select("id")
    ends = run["edges"].select(F.explode(F.array("start_id", "end_id")).alias("id"))
    assert ends.join(ids, "id", "left_anti").count() == 0
    assert run["edges"].count() == run["edges"].select("edge_id").distinct().count()
    pipeline.export(run, str(tmp_path / "run"))
    chunks = t("wiki_chunk").select(F.col("chunk_id").cast("int").alias("chunk_ord"), "lang", "title", "provenance", "citation_key", F.col("url").alias("source_url"), "source_id", F.col("title").alias("source_label"), "text")
    done = pipeline.full(chunks.filter("source_id is not null"), config.WORLD, t("entity_map"), config.claims(spark, folder), t("relation_schema"), t("re_predictions"), person_seed=config.PERSON_SEED, concept_seed=config.CONCEPT_SEED)
    assert done["triples"].filter("predicate = 'cooccurrence_linked' and object_qid like 'Q%'").count() > 0
    linked = done["resolved"].filter("ner_label in ('PER', 'ORG', 'LOC')")
    assert linked.count() > 0 and linked.filter("chosen_qid = '' or chosen_qid = seed_qid").count() == 0
    assert done["resolved"].filter("ner_label = 'DATE' and chosen_qid <> ''").count() == 0
    assert done["edges"].select(F.explode(F.array("start_id", "end_id")).alias("id")).join(done["nodes"].select("id"), "id", "left_anti").count() == 0
    assert done["bags"].count() > 0 and done["canonical"].count() <= done["events"].count()


def test_stream(spark, folder, tmp_path):
    src = spark.read.parquet(f"{folder}/sentences.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = stream.sentences(spark, str(tmp_path / "in"), src.schema)
    q = stream.own_scores(rows, config.WORLD).writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = stream.own_scores(src, config.WORLD)
    assert spark.table("scores").count() == batch.count()
    q = stream.counts(stream.sentences(spark, str(tmp_path / "in"), src.schema), config.WORLD, late="3650 days").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(sentences) n from daily").first()["n"] == batch.count()


def test_core_does_not_need_llm():
    import os

    import loomgraph

    root = os.path.dirname(loomgraph.__file__)
    for base, _, names in os.walk(root):
        if os.sep + "llm" in base[len(root):]:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(base, n), encoding="utf-8").read(), n
