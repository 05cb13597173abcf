import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import encoding, leakage, mixing


def plain_distance(p: str, t: str) -> int:
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_against_plain_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        masks = {}
        for k, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << k
        assert leakage.myers(masks, len(p), t, 1000) == plain_distance(p, t)


ITEMS = [
    (1, "en", "recall", "Answer the question. One inspector of Venisbri sketches 374 crooked doors, and behind each of them a switchboard that the library never dared to postpone."),
    (2, "en", None, "Answer the question. If 22 ounces of wax could close the mechanical decoder, how many of the pins would still calibrate the ledger of the auditor?"),
    (3, "en", "x", "Answer the question. Two cousins of the widow tried to memorise the wooden cabinet; the shyest, working by candle, annotated a valve instead."),
    (4, "zh", "x", "塞尔多尔敦大学的地板下面藏着一台抽象的档案，内蒙在里面锁了描述剩余部分所需的钟摆。奉命前往蒙卡皮奥的测量员数出许多借来的木箱。"),
    (5, "en", "x", None), (6, "en", "x", ""),
]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, lang string, task string, item_text string")
    own = {i: t.split(". ", 1)[-1] if t and i < 4 else t for i, _, _, t in ITEMS}
    filler = "The committee preferred the silent machine of the clerk, although nobody knew why it had been built. " * 20
    docs = [
        (1, filler + own[1] + filler), (2, own[1].upper().replace(",", " ").replace(" ", "  ")), (3, own[2].replace("mechanical", "wooden")), (4, filler + "Answer the question. " + filler), (5, own[4]),
        (6, filler + own[4][:30] + "，" + filler), (7, "One inspector of the town has doors."), (8, None), (9, ""), (10, own[1] + " " + own[3]), (11, own[1]), (12, filler * 50 + own[3] + filler * 50),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.found(df, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (5, 4), (6, 4), (10, 1), (10, 3), (11, 1), (12, 3)}
    assert leakage.found(df.limit(0), items).count() == 0 and leakage.found(df, items.limit(0)).count() == 0


def test_item_blocks_give_the_same(spark, monkeypatch):
    """Instructions that items share are counted over all items, however they are put into blocks."""
    items = spark.createDataFrame(ITEMS, "item_id bigint, lang string, task string, item_text string")
    df = spark.createDataFrame([(10 + i, t) for i, _, _, t in ITEMS if t] + [(1, "Answer the question. " * 9)], "doc_id bigint, text string")
    whole = sorted((r["doc_id"], r["item_id"], r["share"]) for r in leakage.matches(df, items).collect())
    assert [(d, i) for d, i, _ in whole] == [(11, 1), (12, 2), (13, 3), (14, 4)]
    for size in (1, 2, 3):
        monkeypatch.setattr(leakage, "ITEM_BLOCK", size)
        assert sorted((r["doc_id"], r["item_id"], r["share"]) for r in leakage.matches(df, items).collect()) == whole


def test_every_window_within_budget_is_found():
    """Brute force: with up to the budget of edits anywhere in a window, the window is always verified."""
    rng = random.Random(3)
    text = leakage.normal(ITEMS[0][3])
    for wide in (False, True):
        own = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(60)) if wide else text
        m = leakage.Matcher({1: own})
        edits = m.budget[1]
        for _ in range(200):
            w = rng.randrange(len(m.cuts[1]) - 1 - edits)
            part = list(own[m.cuts[1][w]:m.cuts[1][w + edits + 1]])
            for _ in range(edits):
                k = rng.randrange(len(part))
                part[k:k + 1] = rng.choice(([], ["q"], [part[k], "q"]))
            doc = "zz" * 30 + "".join(part) + "zz" * 30
            hits = [(k, at) for end, (size, places) in m.automaton.iter(doc) for ks in dict(places).values() for k in ks for at in [end + 1 - size]]
            masks = m._pattern(1, m.cuts[1][w], m.cuts[1][w + edits + 1])
            assert leakage.myers(masks, m.cuts[1][w + edits + 1] - m.cuts[1][w], doc, edits) <= edits
            assert hits and m.covered(1, doc, hits) >= (m.cuts[1][w + edits + 1] - m.cuts[1][w]) / len(own) - 1e-9


def test_shares(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small" if i % 2 else "other", "word " * (5 + i % 17)) for i in range(6000)] + [(9001, "big", None), (9002, None, "word"), (9003, "small", "")], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 5), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert abs(got["big"]["share"] - 0.5 / 0.9) < 0.01 and abs(got["small"]["share"] - 0.4 / 0.9) < 0.01 and got["none"]["tokens"] == 0
    assert got["big"]["most_repeats"] <= 2 and got["small"]["most_repeats"] <= 5
    rows = mixing.mix(docs, targets)
    again = mixing.mix(docs.repartition(7), targets)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    assert rows.filter("source = 'other'").count() == 0 and rows.select("doc_id", "copy").distinct().count() == rows.count()
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.shares(docs, targets.limit(0)).count() == 0


def test_poisson():
    cdf = mixing.poisson_cdf(1.5, 6)
    rng = random.Random(0)
    draws = [mixing.copies(rng.random(), cdf) for _ in range(40000)]
    assert abs(sum(draws) / len(draws) - 1.5) < 0.03 and max(draws) <= 6


TEXTS = ["Rumun Kaisø received the Néjanmun prize — “It works slowly…”", "Šefi Røtar évoqua l'été à Genève.", "据说，甘威恩·塞尔鲁瑟的一封信表明，工坊是1979年春天建造的。", "По данным архива, около 61 процента маятников пришлось проверить вручную.", "実は、試作機は46.3トンあり、目録の約234倍であった！"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1251", "mac_roman"])
def test_round_trip(text, codec):
    """UTF-8 read as a legacy encoding comes back whole, wherever that encoding has all the bytes."""
    table = {b: ch for b, ch in encoding._byte_chars(codec).items()}
    garbled = "".join(chr(b) if b < 0x80 else table[b] for b in text.encode("utf-8"))
    assert encoding.inspect(garbled), garbled
    assert encoding.restore(garbled) == text
    assert encoding.restore("clean words before " + garbled) == "clean words before " + text


def test_other_ways():
    zh = TEXTS[2]
    assert encoding.restore(zh.encode("gbk").decode("latin-1")) == zh
    assert "塞尔鲁瑟" in encoding.restore(zh.encode("utf-8").decode("gb18030", "replace"))
    assert encoding.restore("Rus酶 and Wynn茅") == "Rusø and Wynné"
    twice = TEXTS[1].encode("utf-8").decode("cp1252", "ignore")
    assert encoding.inspect(twice)
    ru = TEXTS[3]
    assert encoding.restore(ru.encode("cp1251").decode("latin-1")) == ru
    assert encoding.inspect("lost � byte") and encoding.inspect("锟斤拷锟斤拷")


@pytest.mark.parametrize("text", [*TEXTS, "", None, "plain", "l'université…”", "Er sagte „heiß“ – und „Ärger“.", "СССР» и «Ё»", "编码出错时，屏幕上会显示“Ã©”或“锟斤拷”。", "An accent is shown as “Ã©” or “â€™”.", "费阔沃 machine, No. 74"])
def test_clean_texts(text):
    assert encoding.inspect(text) == []


def test_tables(spark):
    df = spark.createDataFrame([(1, "naÃ¯ve", "s", "x"), (2, "naïve", None, "x"), (3, None, "s", "x"), (4, "", "s", "x"), (1, "naÃ¯ve", "s", "x")], "doc_id bigint, text string, source string, encodings string")
    assert [r["doc_id"] for r in encoding.found(df).collect()] == [1, 1]
    assert {r["restored"] for r in encoding.restored(df).collect()} == {"naïve"}
    assert encoding.found(df.limit(0)).count() == 0
    assert encoding.summary(df).agg(F.sum("docs")).first()[0] >= 5
