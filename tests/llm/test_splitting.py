"""Splitting: limits, overlap, reassembly, natural cuts."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import queries as q
from lorespark.llm.splitting import BLANKS, split_item, split_oversized

SF = "/root/testdata/sf0.001"


def check(text, limit=1200, overlap=120):
    pieces = split_item(text, limit, overlap)
    assert "".join(text[core:end] for _, end, core, _ in pieces) == text.strip(BLANKS)
    for k, (start, end, core, _) in enumerate(pieces):
        assert end - start <= limit
        if k:
            assert core == pieces[k - 1][1] and start == max(pieces[0][0], core - overlap)
        else:
            assert start == core
    assert len(pieces) > 1 or len(text.strip(BLANKS)) <= limit
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abcй ё́.;!?\n\r\t ")), max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_cuts():
    r = random.Random(2)
    sentence = lambda: " ".join("слово" * r.randint(1, 2) for _ in range(r.randint(3, 12))) + "."
    para = lambda: " ".join(sentence() for _ in range(r.randint(1, 4)))
    text = "\n\n".join(para() for _ in range(40))
    assert {cut for _, _, _, cut in check(text)[:-1]} <= {"paragraph", "line", "sentence"}
    code = ";\n".join("Перем = Функция(Аргумент)" for _ in range(200))
    assert {cut for _, _, _, cut in check(code)[:-1]} == {"line"}
    assert {cut for _, _, _, cut in check("слово " * 700)[:-1]} == {"word"}
    assert {cut for _, _, _, cut in check("x" * 5000)[:-1]} == {"hard"}
    check("a" * 1200)
    check(" \r\n" + "a" * 1201 + "\t ")
    check("y" * 300_000 + ". " + "z" * 50)


def test_edges(spark):
    long = "слово. " * 400
    rows = [(1, long, "clash", None), (1, long, "", None), (None, long, " \t", None), (4, None, None, "x"), (5, "ok ", "", "x")]
    df = spark.createDataFrame(rows, "id long, text string, field string, piece string")
    got = split_oversized(df, "t", "id", ["text", "field"]).collect()
    assert len([g for g in got if g.item_id == 1 and g.field == "text" and g.piece == 0]) == 2
    assert {(g.item_id, g.field, g.text) for g in got if g.pieces == 1} == {(1, "field", "clash"), (1, "field", ""), (None, "field", ""), (5, "text", "ok"), (5, "field", "")}
    assert split_oversized(df.limit(0), "t", "id", ["text"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_found(spark):
    want = set()
    for tab, key, fields in (("skd_composition_result", "item_id", ("description", "code_snippet")), ("api_topics", "id", ("text",))):
        for r in spark.read.parquet(f"{SF}/{tab}.parquet").collect():
            want |= {(tab, r[key], f) for f in fields if len((r[f] or "").strip(BLANKS)) > 1200}
    got = [tuple(r) for r in q.p1_found(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) and want
    pieces = q.p1_pieces(spark, SF)
    assert pieces.where(F.length("text") > 1200).count() == 0
    texts = {r.id: r.text for r in spark.read.parquet(f"{SF}/api_topics.parquet").collect()}
    whole = {}
    for r in sorted(pieces.where("tab = 'api_topics'").collect(), key=lambda r: r.piece):
        whole[r.item_id] = whole.get(r.item_id, "") + texts[r.item_id][r.core : r.end]
        assert texts[r.item_id][r.start : r.end] == r.text
    assert whole == {i: t.strip(BLANKS) for i, t in texts.items() if t is not None}
