"""Repeated lines and paragraphs against brute force; representative pairs and membership against all pairs."""

import os

import pytest
from pyspark.sql import functions as F

from lorespark.llm import queries as q
from lorespark.llm.repeats import UNITS, normal_unit, remove_repeats, repeated_units

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
A, B = "x" * 45, "second line of more than forty characters in it"
TEXTS = {3: f"{A}\r\n  {B} \n{A}", 1: f"short\n{B.replace(' ', chr(160) + ' ')}\r{B}", 2: None, 5: "", 7: f"{A}\n\n{A}\n{B}\n \n{A}\n{B}", 9: "alone " * 10}


def brute(texts, unit, least):
    seen = {}
    for d in sorted(k for k in texts if texts[k]):
        for m in UNITS[unit].finditer(texts[d]):
            if len(normal_unit(m[0])) >= least:
                seen.setdefault(normal_unit(m[0]), []).append((d, m.start(), m.end()))
    return {(d, b, e, g[0][0], (d, b, e) == g[0]) for g in seen.values() if len(g) > 1 for d, b, e in g}


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_made_texts(spark, unit):
    df = spark.createDataFrame([*TEXTS.items(), (None, A)], "doc_id long, text string").withColumn("digest", F.lit("clash"))
    want = brute(TEXTS, unit, 40)
    assert want and {tuple(r) for r in repeated_units(df, unit=unit).collect()} == want
    out = {r.doc_id: r for r in remove_repeats(df, unit=unit).collect()}
    assert out.keys() == {*TEXTS, None} and out[2].text is None and out[None].text == A and out[9].text == TEXTS[9]
    for d, t in TEXTS.items():
        gone = sorted((b, e) for x, b, e, _, kept in want if x == d and not kept)
        for b, e in reversed(gone):
            t = t[:b] + t[e:]
        assert out[d].text == t and out[d].removed == len(gone)
    assert repeated_units(df.limit(0)).count() == 0 and remove_repeats(df.limit(0)).count() == 0


@data
def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {tuple(r) for r in q.p9_lines(spark, SF).collect()} == brute(texts, "line", 40)


@data
def test_links_and_copies_give_all_pairs(spark):
    links = {tuple(r) for r in q.p9_links(spark, SF).collect()}
    groups = {}
    for r in q.p9_copies(spark, SF).collect():
        groups.setdefault(r.first_doc, []).append(r.doc_id)
    every = {tuple(sorted((x, y))) for a, b in links for x in groups.get(a, [a]) for y in groups.get(b, [b])}
    every |= {(x, y) for g in groups.values() for x in g for y in g if x < y}
    assert every == {tuple(r) for r in q.p9_found(spark, SF).collect()} and every


@data
def test_containers_hold_all_tokens(spark):
    rows = q.p8_sources(spark, SF).collect()
    assert sum(r.n_docs for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.tokens == r.packed and r.pieces >= r.n_docs and r.fullest <= 4096 for r in rows)
