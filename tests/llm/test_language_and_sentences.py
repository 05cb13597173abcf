import pytest
from pyspark.sql import functions as F

from loomgraph.llm import encoding, language, sentences
from loomgraph.llm.common import LANGS, table

CHUNK = "chunk_id bigint, lang string, text string, extra string"
ROW = "row_id bigint, source_id string, sentence_idx int, sentence string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_documents(spark, model):
    """Documents that weren't in the training sample, each in one language, nearly all get theirs."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.filter(F.col("lang").isin(*LANGS)).select(F.lit("d").alias("tab"), F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"))
    got = language.segments(rows, model).groupBy("row_id").agg(F.first("label").alias("label"), F.max_by("lang", "confidence").alias("lang")).collect()
    assert sum(r["label"] == r["lang"] for r in got) / len(got) > 0.97


def test_segments_of_mixed_text(spark, model):
    en, de, zh = "The committee preferred the silent machine of the clerk.", "Die Maschinen wurden zwischen 1898 und 1908 in der Stadt neu gebaut.", "委员会却更喜欢那台沉默的机器，尽管它依旧是过时的。"
    rows = [(1, "t", f"{en} {de}", None), (2, "t", f"{zh}{en} {zh}", None), (3, "t", f"{en} (机器) {en}", None), (4, "t", "", None), (5, "t", None, None), (6, "t", "123 !!", None), (7, "t", en * 3000, None)]
    df = spark.createDataFrame(rows, "row_id bigint, tab string, text string, label string").select("tab", "row_id", "text", "label")
    got = {}
    for r in language.segments(df, model).orderBy("row_id", "seg_idx").collect():
        got.setdefault(r["row_id"], []).append(r["lang"])
    assert got == {1: ["en", "de"], 2: ["zh", "en", "zh"], 3: ["en"], 4: [""], 5: [""], 6: [""], 7: ["en"]}


UNKNOWN = {
    "pt": "A comissão decidiu que não havia mais tempo para discutir as contas da cidade, e por isso os vizinhos voltaram cedo para casa naquela manhã de outubro.",
    "nl": "De vrouw vertelde dat het oude huis aan het water al jaren leeg stond en dat niemand nog wist wie er vroeger gewoond had, zelfs de buren niet.",
    "pl": "Wieczorem dzieci wróciły do domu, bo nad miastem zaczął padać śnieg i żaden z sąsiadów nie chciał już zostać dłużej na zewnątrz.",
    "uk": "Увечері діти повернулися додому, бо над містом почав падати сніг, і ніхто із сусідів уже не хотів залишатися надворі довше.",
    "none": "xkq zzvw ploojf qqrt wvvx bnmkl ghhtr zxcvv qwpoi lkjhh mnbbv trewq ppoiu yttre wqqas dfggh jkkll zzxxc vvbbn mmnna",
}


def test_unknown_languages_are_rejected(spark, model):
    rows = [("d", i, t, None) for i, t in enumerate(UNKNOWN.values())]
    df = spark.createDataFrame(rows, "tab string, row_id bigint, text string, label string")
    got = {r["row_id"]: r["lang"] for r in language.segments(df, model).filter("seg_idx = 0").collect()}
    assert set(got.values()) == {"und"}, got
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter(F.col("lang").isin(*LANGS))
    docs = docs.join(encoding.found(docs), "doc_id", "left_anti")  # a garbled text is in no language
    known = language.segments(docs.select(F.lit("d").alias("tab"), F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label")), model)
    kept = known.agg(F.avg((F.col("lang") != "und").cast("int"))).first()[0]
    assert kept > 0.99


def test_cases(spark, model, monkeypatch):
    monkeypatch.setattr(language, "fit", lambda _d: model)
    en = "The committee preferred the silent machine of the clerk."
    chunks = spark.createDataFrame([(1, "EN_us", en, "x"), (2, "zh", en, "x"), (3, None, en, "x"), (4, "??", None, "x"), (2, "zh", en, "x")], CHUNK)
    rows = spark.createDataFrame([(9, "s", 0, en, "x")], ROW)
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    got = language.found(docs, chunks, rows).collect()
    assert sorted((r["tab"], r["row_id"], r["seg_idx"], r["lang"]) for r in got) == [("wiki_chunk", 2, 0, "en")] * 2 + [("wiki_chunk", 3, 0, "en")]
    assert language.found(docs, chunks.limit(0), rows.limit(0)).count() == 0


def test_training_without_documents():
    assert language.train([], []).threshold > 1


BREAKS = [
    ("Dr. Belva argued that no. It failed. “It works slowly. It never forgets.” The end", None),
]


@pytest.fixture(scope="module")
def splitter(spark):
    rows = table(spark, "/root/testdata/sf0.1", "sentences").filter("source_id not like 'file:scans/%'")
    lex, odds = sentences.learn(sentences.collect_stats(rows))
    for r in odds.collect():
        lex.start_odds[r["lang"], r["a"]], lex.end_odds[r["lang"], r["a"]] = r["start_odds"], r["end_odds"]
    return sentences.Splitter(lex)


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Dr. Thigan argued. The figures (see No. 59, St. Lyva archive) disagree by 32.2 units.", 2),
        ("“Enough!” cried the clerk, and it stopped… then it began again.  The end came.", 2),
        ("When asked, Selost replied, “It works slowly. It never forgets.” Students of it left.", 2),
        ("The notebook lists gears, valves, and so on… In 1913 it ended.", 2),
        ("委员会问起电报时，她回答：“它做得很慢。但它从不遗忘。”样机重12.6吨，约为17倍！", 2),
        ("“够了！”职员喊道，档案停了下来……接着又开始拆解。", 1),
        ("清单上写着齿轮、阀门、纸带等等……1955年，他展示了手稿。", 2),
        ("两组数字（见No. 74）相差23.4个单位。", 1),
        ("「この紙テープは夢を見るのか？」と彼が尋ねたが、誰も答えなかった。古い機械は再建された。", 2),
        ("Der Prototyp wog 1,98 Tonnen, d. h. etwa 264-mal so viel! Am 26. Mai 1917 reiste er ab.", 2),
        ("„Schlafen die Röhren jemals?“, fragte Selfe, doch man schwieg.", 1),
        ("«Спят ли они когда-нибудь?» — спросил Вару, но никто не ответил. Образец весил 2 тонны, т. е. много.", 2),
        ("—¿Duerme alguna vez el archivo? —preguntó Varu, y nadie contestó.", 1),
        ("« Le carnet dort-il jamais ? » demanda Isjan, et personne ne répondit. Le prototype pesait 3 tonnes !", 2),
        ("", 1),
    ],
)
def test_breaks(splitter, text, parts):
    assert len(splitter.breaks(text)[0]) + 1 == parts


def test_rows_that_continue(spark):
    rows = [
        (1, "s", 0, "委员会问起密码时，他回答：“它做得很慢。"), (2, "s", 1, "但它从不遗忘。”"), (3, "s", 2, "样机重12.6吨。"), (4, "s", 3, "每本机器有81个条目；"), (5, "s", 4, "其中一部分被编目。"),
        (6, "s", 5, None), (7, "s", 6, ""), (8, None, 0, "其中"), (9, "s", None, "x"), (10, "s", 4, "其中一部分被编目。"), (11, "file:scans/v", 0, "a. B"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    got = sorted((r["row_id"], r["start_char"]) for r in sentences.found(df).collect())
    assert got == [(2, -1), (5, -1), (10, -1)]
    assert sentences.found(df.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "s", i, "每本机器有81个条目；" if i % 2 == 0 else "其中一部分被编目。", "x") for i in range(60)], ROW)
    whole = sorted(map(tuple, sentences.found(df).collect()))
    monkeypatch.setattr(sentences, "BLOCK", 7)
    assert sorted(map(tuple, sentences.found(df).collect())) == whole and len(whole) == 30


def test_a_quotation_over_many_rows_in_blocks_of_any_size(spark, monkeypatch):
    """What a block leaves open reaches the next one, however far back the quotation began."""
    rows = [(0, "s", 0, "委员会问起密码时，他回答：“它做得很慢。", "x")] + [(i, "s", i, "但它从不遗忘。", "x") for i in range(1, 40)] + [(40, "s", 40, "它停了。”", "x"), (41, "s", 41, "样机重了。", "x")]
    df = spark.createDataFrame([*rows, (90, None, 3, "其中", "x"), (91, None, 4, "其中", "x"), (92, "t", None, "其中", "x")], ROW)
    whole = sorted(map(tuple, sentences.found(df).collect()))
    assert whole == [(i, -1) for i in range(1, 41)]
    for size, lead in ((2, 1), (5, 2), (16, 8)):
        monkeypatch.setattr(sentences, "BLOCK", size)
        monkeypatch.setattr(sentences, "LEAD", lead)
        assert sorted(map(tuple, sentences.found(df).collect())) == whole


def test_lexicon_does_not_shrink_with_the_corpus(spark):
    """An abbreviation that is seen a few times stays one beside any amount of other text."""
    own = ["It is in the dept. of wool, and so on."] * 6 + ["See the dept. 7 for it."] * 6
    for more in (200, 6000):
        rows = [(i, "s", i, t, "x") for i, t in enumerate(own + [f"The clerk of town number{i} never saw it again." for i in range(more)])]
        lex, _ = sentences.learn(sentences.collect_stats(spark.createDataFrame(rows, ROW)))
        assert ("en", "dept") in lex.abbrev


def test_odds_are_asked_for_where_they_are_needed():
    keys = sentences.odds_keys("他说了……接着又开始\n机器停了")
    assert {("zh", "接着"), ("zh", "开始"), ("zh", "机器")} <= keys
    assert ("en", "then") in sentences.odds_keys("He saw the drum\nThen it ended.") and sentences.odds_keys("One. Two.") == set()


def test_units_are_whole(spark):
    df = spark.createDataFrame([(1, "s", 0, "清单上写着齿轮。样机重12吨！好。", "x"), (2, "s", 1, None, "x")], ROW)
    assert [r["sentence"] for r in sentences.units(df).orderBy("unit").collect()] == ["清单上写着齿轮。", "样机重12吨！", "好。"]
