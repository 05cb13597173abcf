"""Worked cases of the operators, nulls and empty tables, and brute force where SQL can't say the same."""

import itertools
import random

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import events, fusion, graph, inference, linking, mentions, relations, routing, supervision
from loomgraph.plans import config


def one(spark, value, expr, column="x", kind="string"):
    return spark.createDataFrame([(value,)], f"{column} {kind}").select(expr.alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "剑桥大学国王学院等地", T.zh_slot("x")) == "剑桥大学国王学院"
    assert one(spark, "他1936年提出", T.first_year("x")) == ""
    assert one(spark, "In 1936, he", T.first_year("x")) == "1936"
    assert one(spark, "  “Turing　 machine” ", T.mention("x")) == "Turing machine"
    assert one(spark, None, T.zh_ratio("x")) == 0.0
    assert one(spark, "", T.sentences("x")) == []
    assert one(spark, "短。这一句话超过八个字。", T.sentences("x")) == ["这一句话超过八个字。"]
    assert one(spark, "aaa", T.places("x", F.lit("aa"))) == [0, 1]
    assert one(spark, "on", T.char_ngrams("x")) == ["on"]
    assert one(spark, "在剑桥工作", T.slots_in_order("x", F.lit("在…工作"))) is True
    assert one(spark, "工作在剑桥", T.slots_in_order("x", F.lit("在…工作"))) is False
    assert one(spark, "a(b", T.slots_in_order("x", F.lit("(…"))) is True
    labels = F.create_map(F.lit("fr"), F.lit("Machine"))
    assert one(spark, "Q1", T.pick_label(labels, "x")) == "Machine"
    assert one(spark, "!!", T.slug("x")) == "source"
    assert one(spark, "a<script>x</script><p>b &lt; c</p>", T.strip_html("x")) == "a b < c"


def test_routing_of_the_shipped_seeds(spark):
    rows = spark.createDataFrame([("s", 0, "艾伦·图灵提出图灵机"), ("s", 1, "没有"), ("t", 0, None), (None, 0, "图灵")], "source_id string, sentence_idx int, sentence string")
    top = routing.top_seeds(routing.scores(rows, config.SEEDS)).collect()
    got = {(r["source_id"], r["sentence_idx"], r["seed_id"]): r["score"] for r in top}
    assert got == {("s", 0, "turing_person"): 2.0, ("s", 0, "turing_machine"): 1.0}
    near = {(r["sentence_idx"], r["seed_id"]): r["score"] for r in routing.scores(rows, config.SEEDS).collect() if r["sentence_idx"] == 1}
    assert near[1, "turing_person"] == 0.15
    derived = routing.derived(routing.top_seeds(routing.scores(rows, config.SEEDS)), rows).filter("sentence_idx = 1").collect()
    assert {(r["seed_id"], r["score"], r["window_from_sentence_idx"]) for r in derived} == {("turing_person", 2.0, 0), ("turing_machine", 1.0, 0)}
    fb = routing.fallback(rows.filter("source_id is not null"), routing.top_seeds(routing.scores(rows, config.SEEDS)), config.SEEDS[0], score=1.0).collect()
    assert [(r["source_id"], r["score"]) for r in fb] == [("t", 1.0)]
    empty = rows.limit(0)
    assert routing.routing_rows(empty, routing.top_seeds(routing.scores(empty, config.SEEDS))).count() == 0


def test_search_ranks_all_aliases_for_each_mention(spark):
    listed = spark.createDataFrame([(f"turaa {i:02d}", f"Q{i}", i) for i in range(12)] + [("turing", "Q100", 50), ("turing machine", "Q101", 51), ("turing m.", "Q101", 52)], "alias string, qid string, line_no int")
    ms = spark.createDataFrame([("Turing",), ("turing machine",), ("Turing",), ("t",), (None,), ("zzz",)], "mention string")
    got = {}
    for r in linking.search(ms, listed).orderBy("mention", "rank").collect():
        got.setdefault(r["mention"], []).append((r["rank"], r["id"], r["label"]))
    assert set(got) == {"Turing", "turing machine"} and all([x[0] for x in v] == list(range(10)) for v in got.values())
    assert got["Turing"][:2] == [(0, "Q100", "turing"), (1, "Q101", "turing m.")] and got["turing machine"][0] == (0, "Q101", "turing machine")
    assert linking.search(ms.limit(0), listed).count() == 0


def test_link_accept_reaches_every_alias_of_a_head(spark, tmp_path):
    from loomgraph.plans import registry

    rows = [(i, f"turaa {i:02d}", f"Q{i}", "x") for i in range(12)] + [(99, "Turing", "Q100", "x")]
    spark.createDataFrame(rows, "line_no int, alias string, wikidata_id string, kind string").write.parquet(str(tmp_path / "entity_map.parquet"))
    spark.createDataFrame([("Turing", "by Turing")], "object_mention string, evidence_sentence string").write.parquet(str(tmp_path / "triples_extracted.parquet"))
    got = {q: registry.QUERIES[q](spark, str(tmp_path)).collect() for q in ("link_accept", "candidate_topk", "candidate_score")}
    assert [r["qid"] for r in got["link_accept"]] == ["Q100"] and ("Q100", 0) in {(r["id"], r["ord"]) for r in got["candidate_topk"]}
    assert "Q100" in {r["id"] for r in got["candidate_score"]} and len(got["candidate_score"]) == 10


def test_context_rules_and_longest_alias(spark):
    assert one(spark, "Turing", linking.context_override("x", F.lit("a universal Turing machine"))) == "Q163310"
    assert one(spark, "Turing", linking.context_override("x", F.lit("the Turing Award of 1966"))) == "Q185667"
    assert one(spark, "图灵", linking.context_override("x", F.lit("图灵机")) ) == "Q163310"
    emap = spark.createDataFrame([(1, "剑桥", "Q350", "place"), (2, "国王学院", "Q1", None), (3, "剑桥大学", "Q35794", ""), (4, " 剑桥大学国王学院 ", " Q2541958", "org"), (5, None, "Q9", "x"), (6, "", "Q8", "x")], "line_no int, alias string, wikidata_id string, kind string")
    ms = spark.createDataFrame([("剑桥大学国王学院",), (None,), ("x",), ("",)], "mention string")
    got = linking.alias_override(ms, linking.aliases(emap)).collect()
    assert [(r["mention"], r["qid"]) for r in got] == [("剑桥大学国王学院", "Q2541958")]


def test_tags_and_spans(spark):
    tags = ["B-PER", "I-PER", "O", "I-ORG", "B-LOC", "B-XX"]
    df = spark.createDataFrame([(1, i, t, "abcdef"[i]) for i, t in enumerate(tags)], "s int, pos int, tag string, token string")
    got = sorted((r["label"], r["begin"], r["end"], r["mention"]) for r in mentions.spans_from_tags(df, ["s"]).collect())
    assert got == [("LOC", 4, 5, "e"), ("PER", 0, 2, "ab")]
    s = spark.createDataFrame([(1, "艾伦图灵在剑桥"), (2, None), (3, "")], "k int, sentence string")
    m = spark.createDataFrame([(1, "图灵", "PER"), (1, "艾伦图灵", "PER"), (1, "剑桥", "LOC")], "k int, mention string, ner_label string")
    rows = {r["k"]: r["tags"] for r in mentions.tags_from_mentions(s, m, ["k"]).collect()}
    assert rows[1] == ["B-PER", "I-PER", "I-PER", "I-PER", "O", "B-LOC", "I-LOC"]
    assert rows[2] in (None, []) and rows[3] == []


def test_model_backend_and_suppression(spark):
    def backend():
        return lambda texts: [[(t.split()[0], "PERSON", 0, len(t.split()[0])), ("x", "WORK", 0, 1)] if t else [] for t in texts]

    s = spark.createDataFrame([(1, "Alan went"), (2, None)], "k int, sentence string")
    got = mentions.by_model(s, ["k"], backend).collect()
    assert [(r["k"], r["mention"], r["ner_label"]) for r in got] == [(1, "Alan", "PER")]
    persons = spark.createDataFrame([(1, 0, 4), (1, 5, 9), (2, 0, 3)], "k int, char_start int, char_end int")
    anchors = spark.createDataFrame([(1, 2, 6)], "k int, char_start int, char_end int")
    assert mentions.suppress_roots(persons, anchors, ["k"]).count() == 0
    far = spark.createDataFrame([(1, 20, 24)], "k int, char_start int, char_end int")
    assert mentions.suppress_roots(persons, far, ["k"]).count() == 2


def test_decoding_against_plain_ascent(spark):
    """The window decoder never ends below its start, and blocks give what one whole source gives."""
    rng = random.Random(3)
    qids = [f"Q{i}" for i in range(12)]
    near = {q: set(rng.sample(range(20), 6)) for q in qids}
    for _ in range(30):
        nodes = [{"cands": sorted(((q, rng.random()) for q in rng.sample(qids, 3)), key=lambda c: -c[1])} for _ in range(4)]
        out = linking.decode_window(nodes, near, 0.35)
        fit = lambda a, b: 0.0 if a == b else len(near[a] & near[b]) / len(near[a] | near[b])
        total = lambda ch: sum(n["cands"][k][1] for n, k in zip(nodes, ch, strict=True)) + 0.35 * sum(fit(nodes[i]["cands"][ch[i]][0], nodes[j]["cands"][ch[j]][0]) for i, j in itertools.combinations(range(4), 2))
        chosen = [next(k for k, c in enumerate(n["cands"]) if c[0] == o["qid"]) for n, o in zip(nodes, out, strict=True)]
        assert total(chosen) >= total([0] * 4) - 1e-9
    rows = [("s", "a", i, f"m{i % 5}", [(f"Q{j}", 1.0 - 0.2 * k) for k, j in enumerate(rng.sample(range(12), 3))]) for i in range(40)]
    df = spark.createDataFrame(rows, "source_id string, seed_id string, sentence_idx int, mention string, cands array<struct<qid:string,score:double>>")
    targets = spark.createDataFrame([(q, sorted(map(str, t))) for q, t in near.items()], "qid string, near array<string>")
    key = lambda r: (r["sentence_idx"], r["mention"], r["qid"], round(r["total"], 9))
    whole = sorted(map(key, linking.collective(df, targets, block=1000).collect()))
    cut = sorted(map(key, linking.collective(df, targets, block=7).collect()))
    assert whole == cut and len(whole) == 40


def test_templates_and_events(spark):
    s = spark.createDataFrame([("a", 0, "他毕业于剑桥大学等地。"), ("a", 1, ""), ("a", 2, None)], "source_id string, sentence_idx int, sentence string")
    got = relations.slots(s.filter("sentence is not null"), ["source_id", "sentence_idx"]).collect()
    assert [(r["slot"], r["prop_id"]) for r in got] == [("剑桥大学", "P69")]
    linked = spark.createDataFrame(
        [("a", "award", "Q185667", 0, "The award was won by Alan Kay (in 2003), John Cocke (in 1987).", [("Q1", "Bell Labs", "ORG")]), ("a", "award", "Q185667", 1, "He joined Bell Labs in 1950.", [("Q1", "Bell Labs", "ORG"), ("Q2", "Hamming", "PER")])],
        "source_id string, seed_id string, seed_qid string, sentence_idx int, sentence string, linked array<struct<qid:string,mention:string,ner_label:string>>",
    )
    names = spark.createDataFrame([("Alan Kay", "Q92742")], "mention string, qid string")
    got = {(r["event_type"], r["trigger"]): [(a["role"], a["qid"] or a["mention"]) for a in r["args"]] for r in events.extract(linked, names, "person", "machine").collect()}
    assert got["AwardEvent", "won"] == [("Recipient", "Q92742"), ("Award", "Q185667"), ("Time", "2003")]
    assert got["EmploymentEvent", "joined"] == [("Person", "Q2"), ("Organization", "Q1"), ("Time", "1950")]
    found = events.extract(linked, names, "person", "machine")
    assert events.canonical(found.unionByName(found)).filter("evidence_count = 2").count() == 2
    assert events.edges(found).count() == 6
    assert events.extract(linked.limit(0), names, "person", "machine").count() == 0


def test_fusion(spark):
    cols = "row_id int, seed_id string, sentence_idx string, predicate string, object_qid string, ner_label string, object_mention string, source_url string, relevance_score string, link_score string, extraction_method string, evidence_sentence string, snippet string, subject_qid string, citation_key string, reasons string"
    base = ("s", "1", "p", "Q1", "PER", "x", "u")
    rows = [(1, *base, "1.0000", "0.3000", "b", "short", None, "Q0", "c", '{"anchor_hits":["a"],"nearby_anchor":true}'), (2, *base, "", "0.9000", "a", "longer one", "sn", "Q0", "c", '{"anchor_hits":["b","a"]}'), (3, "s", "1", "p", "", "DATE", " 1936 ", "u", None, None, None, None, None, None, None, None)]
    t = spark.createDataFrame(rows, cols)
    got = {r["obj"]: r for r in fusion.merge(t).collect()}
    assert got["qid:Q1"]["link"] == 0.9 and got["qid:Q1"]["methods"] == "a|b" and got["qid:Q1"]["evidence_sentence"] == "longer one" and got["qid:Q1"]["n"] == 2
    assert got["lit:DATE:1936"]["methods"] == ""
    reasons = fusion.merge_reasons(t.filter("object_qid = 'Q1'"), ["seed_id"]).first()
    assert reasons["anchor_hits"] == ["a", "b"] and reasons["nearby_anchor"] is True


def test_graph(spark):
    rows = [("Q1", 0, "Q1", "", ["B"], {"k": "1"}), ("Q1", 1, "Name", "e1", ["A"], {"k": None}), ("Q1", 2, "Other", "", None, {"k": "2"}), ("Q2", 0, None, None, None, None)]
    n = {r["id"]: r for r in graph.nodes(spark.createDataFrame(rows, "id string, ord int, name string, extra string, labels array<string>, props map<string,string>")).collect()}
    assert (n["Q1"]["name"], n["Q1"]["extra"], n["Q1"]["labels"], n["Q1"]["props"]) == ("Name", "e1", ["A", "B"], {"k": "2"})
    assert (n["Q2"]["name"], n["Q2"]["labels"], n["Q2"]["props"]) == ("Q2", [], None)
    e = graph.edges(spark.createDataFrame([("Q1", "Q2", "P27", "wikidata_incoming")] * 2 + [("Q1", "Q2", "", "text_re")], "start_id string, end_id string, prop_id string, provenance string"))
    assert sorted((r["layer"], r["rel_type"]) for r in e.collect()) == [("evidence", "EXT_REL"), ("facts", "WIKI_P27")]
    claims = spark.createDataFrame([("Q9", "P31", "value", "wikibase-entityid", "Q515", None), ("Q8", "P31", "value", "wikibase-entityid", "Q77777", None)], "subject string, prop_id string, snaktype string, value_type string, target_qid string, literal string")
    got = {r["id"]: r["labels"] for r in graph.labels_of_types(claims).collect()}
    assert got == {"Q9": ["City", "Location"], "Q8": ["Concept"]}
    assert graph.labels_of_types(claims.limit(0)).count() == 0
    named = graph.fill_names(spark.createDataFrame([("Q1", "Q1"), ("Q2", "kept")], "id string, name string"), spark.createDataFrame([("Q1", {"zh": "图灵"})], "id string, labels map<string,string>"))
    assert {r["id"]: r["name"] for r in named.collect()} == {"Q1": "图灵", "Q2": "kept"}


def test_supervision(spark):
    d = spark.createDataFrame([("b1", ["P1", "P2"]), ("b2", []), ("b3", ["P1"])], "bag_id string, labels_pos array<string>")
    assert {r["bag_id"]: r["label"] for r in supervision.multiclass(d).collect()} == {"b2": "NA", "b3": "P1"}
    assert {r["bag_id"]: r["label"] for r in supervision.multiclass(d, True).collect()}["b1"] == "P1"
    many = spark.range(500).select(F.concat(F.lit("b"), "id").alias("bag_id"), F.when(F.col("id") < 20, "P1").otherwise("NA").alias("label"))
    kept = supervision.down_sample(many, 3.0)
    assert kept.filter("label = 'NA'").count() == 60 and kept.filter("label = 'P1'").count() == 20
    assert supervision.down_sample(many.filter("label = 'NA'"), 3.0).count() == 200
    parts = {r["split"]: r["count"] for r in supervision.split(many).groupBy("split").count().collect()}
    assert parts == {"train": 400, "dev": 50, "test": 50}
    assert supervision.split(many.limit(0)).count() == 0


def test_inference(spark):
    schema = spark.createDataFrame([("P108", ["任职于"]), ("P19", ["出生于"]), ("P5", None)], "prop_id string, aliases_zh array<string>")
    p = spark.createDataFrame([(1, "P108", "他在大学学习并任职于学会"), (2, "P108", "他任职于学会"), (3, "P19", "他出生于伦敦"), (4, "P5", "任何"), (5, "P5", ""), (6, "P5", None)], "row_id int, predicted_label string, top_sentence string")
    assert sorted(r["row_id"] for r in inference.text_fits(p, schema).collect()) == [2, 3, 4]
    model = inference.Encoder(["NA", "P1"], 50)
    ids = spark.createDataFrame([("b", [[2, 3, 4, 0], [5, 6, 0, 0]], [0, 0], [1, 1]), ("empty", [], [], [])], "bag_id string, ids array<array<int>>, e1 array<int>, e2 array<int>")
    rows = inference.predict(ids, model).collect()
    assert len(rows) == 1 and abs(sum(c["score"] for c in rows[0]["class_probs"]) - 1) < 1e-5


def test_trained_encoder_separates_classes():
    import numpy as np

    rng = np.random.default_rng(0)
    enc = inference.Encoder(["NA", "P1"], 40)
    bags = []
    for k in range(60):
        y = k % 2
        ids = rng.integers(2, 20, (2, 8)) + 20 * y
        bags.append((ids, np.zeros(2, int), np.full(2, 3), y))
    inference.train(enc, bags)
    right = sum(enc.bag(enc.encode(ids, a, b))[0].argmax() == y for ids, a, b, y in bags)
    assert right >= 55


def test_tensors_hold_whole_sentences(spark):
    import numpy as np

    long = "甲" * 150 + "乙丙"
    df = spark.createDataFrame([("b", [long, "乙?"], [0, 0], [150, 1])], "bag_id string, texts array<string>, e1 array<int>, e2 array<int>")
    row = inference.tensors(df, {"甲": 2, "乙": 3, "丙": 4}).first()
    assert row["ids"] == [[2] * 150 + [3, 4], [3, 1] + [0] * 150] and row["e2"] == [150, 1]
    enc = inference.Encoder(["NA", "P1"], 5)
    ids, e1, e2 = np.array(row["ids"]), np.array(row["e1"]), np.array(row["e2"])
    assert np.allclose(enc.encode_all(ids, e1, e2, step=1), enc.encode(ids, e1, e2)) and np.allclose(enc.encode(ids[1:, :2], e1[1:], e2[1:]), enc.encode(ids, e1, e2)[1:], atol=1e-6)
    many = spark.createDataFrame([(f"{i:03d}", "NA" if i else "P1") for i in range(150)], "bag_id string, label string")
    assert sorted((r["label"], r["count"]) for r in inference.sample(many).groupBy("label").count().collect()) == [("NA", 100), ("P1", 1)]


def test_pcnn_predict_learns_labels_from_what_follows(spark, tmp_path):
    from loomgraph.plans import registry

    fill = "塞尔鲁瑟在这里做了很多年的事情没有人知道为什么也没有人来问"
    rs, ss, ts = [], [], []
    seed = next(x for x in config.WORLD if x.seed_id == "seed_person")
    for i in range(40):
        q = f"Q9{i:03d}"
        ss.append((f"s{i}", 0, fill * 4 + ("金银铜铁锡铅" if i % 2 else "红黄蓝绿紫白") * 4 + f"甲{i}"))
        rs.append((f"s{i}", 0, "seed_person", seed.qid, q, f"甲{i}", "ORG"))
        if i % 2:
            ts.append((seed.qid, "P7", q))
    spark.createDataFrame(rs, "source_id string, sentence_idx int, seed_id string, seed_qid string, chosen_qid string, mention string, ner_label string").write.parquet(str(tmp_path / "resolved.parquet"))
    spark.createDataFrame(ss, "source_id string, sentence_idx int, sentence string").write.parquet(str(tmp_path / "sentences.parquet"))
    spark.createDataFrame(ts, "subject_qid string, predicate_prop_id string, object_qid string").write.parquet(str(tmp_path / "triples_extracted.parquet"))
    spark.createDataFrame([("P7", [seed.type]), ("P8", [seed.type])], "prop_id string, subject_types array<string>").write.parquet(str(tmp_path / "relation_schema.parquet"))
    got = {r["bag_id"]: r["predicted_label"] for r in registry.QUERIES["pcnn_predict"](spark, str(tmp_path)).collect()}
    assert len(got) == 40 and sum(got[f"s{i}|seed_person|Q9{i:03d}"] == ("P7" if i % 2 else "NA") for i in range(40)) >= 36
