from loomgraph.llm import scans, truncation

ROW = "row_id bigint, source_id string, sentence_idx int, sentence string, title string"
PDF = "pdf_relative_path string, page_start int, page_end int, label string"


def corpus():
    clean = ["The committee preferred the machine of the clerk.", "Each drum held 12 entries; the silent ones were sealed twice.", "他没有见过机器能够从来不停。", "这台机器从来没有停过。", "没有人见过机器从来不停。", "机器从来都有人看守。", "A well-oiled letter arrived."] * 8
    rows = [(i, f"book:{i % 5}", i, t, "x") for i, t in enumerate(clean)]
    v = "file:scans/v.pdf#pages=20-29"
    dirty = {
        1000: "THE SILENT DRUM OF LYVA\nEach drum held 12 entries.", 1001: "The comm-\nittee preferred\nThe Silent Drum of Lyva\nthe machine.", 1002: "the silent drum of lyva\nThe committee [21] preferred it.", 1003: "The cornmittee preferred the machine.",
        1004: "The committee preferred the machine of the clerk. - 22 -", 1005: "Each drum held\n12\nentries.", 1006: "A well-\noiled letter arrived.", 1007: "这台札器从来没有停过。", 1008: "没有人见过札器能够丛来不停。", 1009: "机器丛来都有人看守，他没有见过札器能够停。",
        1010: "The committee preferred the machine.", 1011: None, 1012: "", 1013: "Each drum [99] held 12 entries.", 1014: "The machi\xad\nne of the clerk.",
    }
    return rows + [(k, v, n, t, "x") for n, (k, t) in enumerate(dirty.items())]


def test_damage(spark):
    df = spark.createDataFrame(corpus(), ROW)
    pdf = spark.createDataFrame([("scans/v.pdf", 29, 20, "scan 3"), ("scans/other.pdf", None, None, None), (None, 1, 2, "x")], PDF)
    got = {}
    for r in scans.found(df, pdf).collect():
        got.setdefault(r["row_id"], set()).add(r["kind"])
    assert got[1000] == {"header"} and got[1001] == {"header", "broken_word"} and got[1002] == {"header", "page_number"}
    assert got[1003] == {"wrong_char"} and got[1004] == {"page_number"} and got[1014] == {"broken_word"}
    assert not {1005, 1006, 1010, 1011, 1012, 1013} & set(got)
    assert all(k >= 1000 for k in got)
    assert scans.found(df.limit(0), pdf.limit(0)).count() == 0


def test_text_is_continuous(spark):
    df = spark.createDataFrame(corpus(), ROW)
    pdf = spark.createDataFrame([("scans/v.pdf", 20, 29, "scan 3")], PDF)
    text = " ".join(r["text"] for r in scans.volume_text(df, pdf).orderBy("block", "paragraph").collect())
    assert "The committee preferred the machine. The committee" in text and "SILENT DRUM" not in text and "[21]" not in text and "[99]" in text


def test_text_has_what_was_found(spark):
    """Bare page numbers go and due numbers stay, wide characters are put right, compounds keep their hyphen."""
    v = "file:scans/v.pdf#pages=20-29"
    more = {1020: "The committee preferred\n23\nthe machine.", 1021: "The comm-\n24\nittee preferred it."}
    clean = [(2000 + i, f"book:{i % 5}", 1000 + i, t, "x") for i, t in enumerate([r[3] for r in corpus() if r[0] < 1000] * 5)]
    df = spark.createDataFrame(corpus() + clean + [(k, v, 20 + n, t, "x") for n, (k, t) in enumerate(more.items())], ROW)
    pdf = spark.createDataFrame([("scans/v.pdf", 20, 29, "scan 3")], PDF)
    text = " ".join(r["text"] for r in scans.volume_text(df, pdf).orderBy("block", "paragraph").collect())
    assert "preferred the machine" in text and "23" not in text and "24" not in text and "The committee preferred it" in text
    assert "A well-oiled letter" in text and "welloiled" not in text and "held 12 entries" in text
    assert "札" not in text and "这台机器从来没有停过" in text and "没有人见过机器" in text


def test_paragraphs_do_not_show_block_edges(spark, monkeypatch):
    rows = [("v", i, i, "x " * (i % 7) + ("The drum held twelve entries and" if i % 3 else "no more of them.")) for i in range(121)] + [("v", 50, 900, "Another row of one index."), ("w", None, 1, "No index.")]
    df = spark.createDataFrame(rows, "source_id string, idx int, row_id bigint, text string")
    monkeypatch.setattr(scans, "PARAGRAPH", 200)
    want = None
    for size in (512, 7, 1):
        monkeypatch.setattr(scans, "TEXT_BLOCK", size)
        got = sorted((r["source_id"], r["paragraph"], r["text"]) for r in scans.paragraphs(df).collect())
        want = want or got
        assert got == want and len(got) > 10
    assert all(t.endswith(".") for _, _, t in got) and "Another row" in " ".join(t for _, _, t in got)


def test_helpers():
    assert scans.page_range("file:scans/v.pdf#pages=29-20") == (20, 29)
    assert scans.page_range("file:scans/v.pdf#pages=5-") == (5, None)
    assert scans.page_range("x") == (None, None)
    assert scans.mask("[19]  The Drum 7") == scans.mask("THE DRUM 12")


def test_cut_values(spark):
    whole = ["The committee preferred the silent machine of the clerk.", "Each drum held many entries and the silent ones were sealed twice.", "这台机器从来没有停过，没有人知道为什么。"]
    sents = [(f"s{i % 4}", i, whole[i % 3]) for i in range(90)]
    s = spark.createDataFrame([*sents, ("s9", 0, None)], "source_id string, sentence_idx int, sentence string")
    rows = [(i, src, str(n), t, f"[en:x] {t}", '{"anchor_hits": []}', "x") for i, (src, n, t) in enumerate(sents)]
    bad = {3: (whole[0][:30], None, None), 7: (None, None, '{"anchor_hits": ["a'), 11: (whole[2][:9] + "...", None, None), 20: (None, "[en:x] " + whole[2][:8], None), 30: (whole[0], None, "")}
    for k, (e, sn, re_) in bad.items():
        r = list(rows[k])
        t = sents[k][2]
        r[3] = e if e is not None else t
        if e is not None and k in (3, 11, 30):
            r[1], r[2] = ("unknown", "1") if k == 11 else (r[1], r[2])
        r[4] = sn if sn is not None else r[4]
        r[5] = re_ if re_ is not None else r[5]
        rows[k] = tuple(r)
    rows.append((500, None, None, None, None, None, "x"))
    t = spark.createDataFrame(rows, "row_id bigint, source_url string, sentence_idx string, evidence_sentence string, snippet string, reasons string, lang string")
    p = spark.createDataFrame([(1, "s0", 0, whole[0][:20], "u"), (2, "s0", 0, whole[0], "u"), (3, "s1", None, None, "u")], "row_id bigint, source_id string, top_sentence_idx int, top_sentence string, source_url string")
    got = {(r["tab"], r["row_id"], r["field_name"]) for r in truncation.found(t, p, s).collect()}
    t_, e_ = "triples_extracted", "evidence_sentence"
    assert {(t_, 7, "reasons"), (t_, 11, e_), ("re_predictions", 1, "top_sentence")} <= got
    assert ("re_predictions", 2, "top_sentence") not in got and (t_, 30, "reasons") not in got and not any(k == 500 for _, k, _ in got)
    assert (t_, 0, e_) not in got and (t_, 3, "snippet") not in got
    rate = {(r["tab"], r["field_name"]): r["cut"] for r in truncation.rates(t, p, s).groupBy("tab", "field_name").agg({"cut": "sum"}).withColumnRenamed("sum(cut)", "cut").collect()}
    assert rate[t_, "reasons"] == 1
    assert truncation.found(t.limit(0), p.limit(0), s.limit(0)).count() == 0


def test_contexts_are_counted_exactly(spark):
    """Each wanted context has its own count, however many others the corpus has."""
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for _ in range(15_000)] + ["we saw the silent drum"] * 7 + ["we saw the silent drum. And then"] * 5
    rows = spark.createDataFrame([(t,) for t in texts], "v string").repartition(4)
    wanted = truncation._hashes(truncation._cps(["we saw the silent drum"])[0])[10][-1:]
    shared = spark.sparkContext.broadcast({n: truncation._end_contexts(rows, ("v",))[0][n] for n in truncation.ORDERS})
    keys, total, ends = truncation._count(rows, ("v",), shared)[10]
    at = truncation._places(wanted, keys)[0]
    assert total[at] == 5 and ends[at] == 5
    assert (truncation._places(truncation._hashes(truncation._cps(["zzzzzzzzzzzz"])[0])[10][-1:], keys) == -1).all()


def test_model_alone_on_held_out_sources(spark):
    """Thresholds fitted to half of the sources part cut values from whole ones in the other half, without any check."""
    from loomgraph.llm.common import table

    tables = [table(spark, "/root/testdata/sf0.1", n) for n in ("triples_extracted", "re_predictions", "sentences")]
    got = truncation.model_alone(*tables).groupBy().sum("cut", "said", "both").first()
    assert got[2] / got[0] > 0.95 and got[2] / got[1] > 0.95 and got[0] > 1000
