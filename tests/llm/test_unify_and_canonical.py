import random

from loomgraph.llm import canonical, unify

RES = "row_id bigint, mention string, ner_label string, chosen_qid string, clean string"
MAP = "line_no int, alias string, wikidata_id string, kind string, plain string"
REL = "prop_id string, aliases_zh array<string>"
ALIASES = [
    (1, "Ganwyn Selrusø", " Q1", "Person", "x"), (2, "Ga​nwyn Selrusø", "Q1", "Person", "x"), (3, "Lyvagra", "Q2", "location", "x"), (4, "利瓦格拉大学", "Q3", "organization", "x"),
    (5, "University of Lyvagra", "Q3 ", None, "x"), (6, "Ливагра", "Q2", "", "x"), (7, "Mark II", "Q4", "concept", "x"), (8, None, "Q5", None, "x"), (9, "", None, None, "x"), (10, "W. Holpio", "Q6", "Person", "x"), (11, "Wynné Holpio", "Q6", "Person", "x"),
]


def tables(spark, mentions, rel=()):
    return spark.createDataFrame(mentions, RES), spark.createDataFrame(ALIASES, MAP), spark.createDataFrame(list(rel), REL)


def test_one_spelling(spark):
    odd = ["Ｌｙｖａｇｒａ", "Lуvаgrа", "Ly­vagra", "利瓦格拉⼤学", "Ganwyn Selrusø", "lyvagra", "Lyvagrá", " Lyvagra ", "Лив‍агра", "Mark Ⅱ", "Mark II", "Other​", None, ""]
    res, emap, rel = tables(spark, [(i, m, "PER", None, "x") for i, m in enumerate(odd)], [("P1", ["在…立业", "在​…立业", None]), ("P2", None), ("P3", ["从⾏家", "从行家"])])
    got = {(r["tab"], r["rec_key"], r["pos"]): r["clean"] for r in unify.found(res, emap, rel).collect()}
    assert got == {
        ("resolved", "0", 0): "Lyvagra", ("resolved", "1", 0): "Lyvagra", ("resolved", "2", 0): "Lyvagra", ("resolved", "3", 0): "利瓦格拉大学", ("resolved", "8", 0): "Ливагра",
        ("resolved", "9", 0): "Mark II", ("resolved", "10", 0): "Mark II", ("entity_map", "2", 0): "Ganwyn Selrusø", ("relation_schema", "P1", 1): "在…立业", ("relation_schema", "P3", 0): "从行家",
    }
    assert unify.found(res.limit(0), emap.limit(0), rel.limit(0)).count() == 0


def test_unified_keeps_every_value(spark):
    res, emap, rel = tables(spark, [(1, "Ｌｙｖａｇｒａ", "LOC", None, "x"), (1, "Ｌｙｖａｇｒａ", "LOC", None, "x")])
    got = [r["clean"] for r in unify.unified(res, emap, rel).filter("tab = 'resolved'").collect()]
    assert set(got) == {"Lyvagra"}


def test_found_entities(spark):
    cases = [
        ("Ganwyn Selruso", "PER", "Q1"), ("SELRUSØ, GANWYN", "PER", "Q1"), ("Ganwin Selrusø", "PER", "Q1"), ("Prof. Ganwyn Selrusø", "PER", "Q1"), ("holpio, w.", "PER", "Q6"), ("X. Holpio", "PER", ""),
        ("town of Lyvagra", "LOC", "Q2"), ("Lvagra", "LOC", "Q2"), ("U. of Lyvagra", "ORG", "Q3"), ("利瓦格拉的大学", "ORG", "Q3"), ("利娃格拉大学", "ORG", "Q3"), ("Lyvagra", "PER", ""), ("various", "ORG", ""),
        ("University of Munbri", "ORG", ""), (None, "ORG", ""), ("", "LOC", ""), ("???", "ORG", ""), ("x" * 20000, "ORG", ""),
    ]
    res, emap, _ = tables(spark, [(i, m, label, None if i % 2 else "", "x") for i, (m, label, _) in enumerate(cases)] + [(99, "Lyvagra", "LOC", "Q2", "x"), (98, "1936", "DATE", None, "x")])
    got = {r["row_id"]: r["wikidata_id"] for r in canonical.found(res, emap).collect()}
    assert got == {i: q for i, (_, _, q) in enumerate(cases)}
    assert canonical.found(res.limit(0), emap).count() == 0
    assert all(r["wikidata_id"] == "" for r in canonical.found(res, emap.limit(0)).collect())


def test_pairs_against_brute_force(spark):
    """The join gives every pair within the grams that the allowed edits can change, and so every pair within the edits."""
    rng = random.Random(5)
    forms = ["lyvagra university", "lyvagra", "lvagra", "lyavgra", "munbri university", "利瓦格拉大学", "利娃格拉大学", "大学", "利瓦", "abc", "abd", "zz", "aaaaaaaaaa", "ondmipio", "odnmipoi", ""]
    for f in [f for f in forms if len(f) > 4] * 6:
        k = rng.randrange(len(f) - 1)
        forms.append(rng.choice((f[:k] + f[k + 1:], f[:k] + "x" + f[k:], f[:k] + f[k + 1] + f[k] + f[k + 2:])))
    forms = sorted({f for f in forms if f})
    df = spark.createDataFrame([(f, canonical.grams(f)) for f in forms], "form string, grams array<string>")
    got = {(r["v_form"], r["a_form"]): round(r["jaccard"], 9) for r in canonical.pairs(df, df).collect()}
    want = {}
    for a in forms:
        for b in forms:
            x, y = set(canonical.grams(a)), set(canonical.grams(b))
            limit = min(canonical.allowed(a), canonical.allowed(b))
            if len(x & y) >= max(1, max(len(x), len(y)) - canonical.EDIT_GRAMS * limit):
                want[a, b] = round(len(x & y) / len(x | y), 9)
            if canonical.distance(a, b, limit) <= limit and x & y:
                assert (a, b) in want
    assert got == want


def test_distance():
    assert canonical.distance("selrusø", "selruos", 3) == 2
    assert canonical.distance("abcd", "abdc", 2) == 1
    assert canonical.distance("abcd", "xyzw", 2) == 3
