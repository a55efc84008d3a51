"""Shared spans against brute force over all windows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lorespark.llm.spans import SharedSpans

SF = "/root/testdata/sf0.01"


def brute(texts, m=200):
    at, pairs, cover = {}, set(), {}
    for i, t in texts.items():
        for p in range(len(t or "") - m + 1):
            at.setdefault(t[p : p + m], []).append((i, p))
    for found in at.values():
        ids = sorted({i for i, _ in found})
        if len(ids) > 1:
            pairs |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
            for i, p in found:
                cover.setdefault(i, set()).update(range(p, p + m))
    return pairs, {i: len(c) for i, c in cover.items()}


def check(spark, texts, **how):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("h", F.lit("clash"))
    spans = SharedSpans(df, **how)
    got = [tuple(r) for r in spans.pairs().collect()]
    pairs, cover = brute(texts)
    assert len(got) == len(set(got)) and set(got) == pairs
    spans = SharedSpans(df, every=True, **how)
    assert {tuple(r) for r in spans.pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in spans.shared(df).collect()} == {i: None if t is None else cover.get(i, 0) for i, t in texts.items()}
    return pairs


def test_made_texts(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("абвгд abc\n") for _ in range(n))
    x, y, z = word(200), word(199), word(450)
    seed = word(150)  # a long unit that many texts share without a long run
    texts = {
        1: word(300) + x + word(50), 2: x + word(400), 3: word(10) + y + "#", 4: word(500) + y + "!", 5: z, 6: word(3) + z[:230] + word(90) + z[240:], 7: z,
        8: None, 9: "", 10: "short", 11: "-" * 5000, 12: "ab" + "-" * 200 + "c", 13: "-" * 199, 14: "xy" * 130 + "Q", 15: "yx" * 400, 16: "W" + "xy" * 101,
        17: "12345" * 100 + "tail", 18: "45123" * 41 + "z", 19: x, 20: x,
    }
    texts |= {100 + i: word(60) + seed + (word(30) if i % 3 else seed[:30]) + word(80) for i in range(40)}
    pairs = check(spark, texts)
    assert (1, 2) in pairs and (3, 4) not in pairs and (5, 7) in pairs and (11, 12) in pairs
    assert check(spark, texts, direct=3) == pairs


def test_long_texts_in_parts(spark):
    from lorespark.llm import spans

    r = random.Random(3)
    word = lambda n: "".join(r.choice("абвгд abc\n") for _ in range(n))
    x = word(260)
    texts = {1: word(900) + x + word(700), 2: word(1300) + x + word(100), 3: word(50) + x[:210] + word(50), 4: "-" * 2500, 5: "-" * 300}
    whole = {t: set(zip(*(a.tolist() for a in spans.select_units([v])[::2]))) for t, v in texts.items()}
    for t, v in texts.items():
        if t != 4:
            parts = set()
            for s in range(0, len(v), 500):
                h, _, at = spans.select_units([v[s : s + 500 + 199]])
                parts |= set(zip(h.tolist(), (at + s).tolist()))
            assert parts >= whole[t]


def test_passages_of_copies(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("абвгд abc\n") for _ in range(n))
    x, twin = word(250), word(300)
    texts = {1: word(80) + x + word(40), 2: twin, 3: word(30) + x + word(60), 5: twin, 6: word(400), 8: twin, 9: word(20) + x, 12: None}
    texts[10] = texts[11] = texts[3]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for p in SharedSpans(df, every=True).passages().collect():
        got.setdefault(p.doc, set()).update(range(p.begin, p.end))
    assert {i: len(at) for i, at in got.items()} == brute(texts)[1]
    assert got[2] == got[5] == got[8] == set(range(300)) and got[10] == got[11] == set(range(len(texts[3])))


def brute_holders(texts, m=200):
    at, first = {}, {}
    for i, t in texts.items():
        for p in range(len(t or "") - m + 1):
            at.setdefault(t[p : p + m], []).append((i, p))
    for found in at.values():
        if len({i for i, _ in found}) > 1:
            for i, p in found:
                for k in range(p, p + m):
                    first[i, k] = min(first.get((i, k), i), min(found)[0])
    return first


def test_passages_by_earliest_holder(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("абвгд abc\n") for _ in range(n))
    x, y, z = word(300), word(300), word(700)
    texts = {3: word(40) + y + word(30), 4: x + y, 5: word(20) + x, 6: z, 7: z[:450] + word(50), 8: word(9) + z[250:] + y, 2: z[300:520] + word(70), 9: z, 10: z, 11: "-" * 500, 12: "a" + "-" * 300}
    texts |= {100 + i: word(30) + x[i : 280] + word(30) for i in range(8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_holders(texts)
    for direct in (64, 3):
        rows = SharedSpans(df, every=True, direct=direct).passages().collect()
        got = [((p.doc, k), p.first_doc) for p in rows for k in range(p.begin, p.end)]
        assert len(got) == len(want) and dict(got) == want
        assert {(p.begin, p.end, p.first_doc) for p in rows if p.doc == 4} == {(0, 300, 4), (300, 600, 3)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    spans = SharedSpans(df, every=True)
    assert spans.pairs().count() == 0 and spans.shared(df).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(spark, texts)
