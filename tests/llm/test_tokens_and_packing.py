"""Encoding and packing: against the public libraries, round trip, and invariants."""

import base64
import os
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespark.llm import queries as q
from lorespark.llm.packing import containers, pack, pack_shard
from lorespark.llm.tokenizer import TOKENIZERS, VOCABULARY, count_tokens, decode, encode_block, encode_corpus

SF = "/root/testdata/sf0.001"
PATH = f"{TOKENIZERS}/{VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH) or not os.path.isdir(SF), reason="no vocabulary or data")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    sys.path.insert(0, os.path.dirname(os.path.realpath(TOKENIZERS)))
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(texts):
    ids, counts = encode_block(texts, PATH)
    ends = np.cumsum(counts)
    return [list(map(int, ids[e - c : e])) for e, c in zip(ends, counts)]


HARD = ["", " ", "  a  b ", "it's 'sabc don'T we'll''ve\n'd", "a​​​​", "-" * 500, "<|endoftext|> x", "ааа\r\n\r\n\tёй́", "\x1c\x85\xa0　x", "😀😀 中文字", "x" * 5000, "123abc456 _!?'re"]


def test_hard_texts(reference):
    assert split(HARD) == [reference.encode_ordinary(t) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'stremvld  \n\t\r.,!1 2é  Яё́中😀'\x1c\x85​")), max_size=40), max_size=8))
def test_random_texts(reference, texts):
    assert split(texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_text_in_parts(reference):
    from lorespark.llm.tokenizer import cut_long, encode_texts

    text = "Слово и слово, it's word  two\n" * 300 + "x" * 3000
    parts = cut_long(text, 500)
    assert len(parts) > 10 and "".join(parts) == text
    ids, counts = encode_texts([text], PATH, 500)
    assert list(ids) == reference.encode_ordinary(text) and list(counts) == [len(ids)]


def test_documents(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in docs.select("doc_id", "text").collect()}
    out = q.p7_ids(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert {r.doc_id: r.ids for r in out.collect()} == want
    small = encode_corpus(docs.withColumn("ids", F.lit("clash")), block_chars=700)
    assert {r.doc_id: r.ids for r in small.collect()} == want
    back = {r.doc_id: r.text for r in decode(out).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect())
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()} == {k: len(v) for k, v in want.items()}
    assert encode_corpus(docs.limit(0)).count() == 0


def test_pack_invariants(spark):
    items = [(i, int(s), ["a", "b", None][i % 3]) for i, s in enumerate(np.random.default_rng(1).integers(0, 900, 3000))] + [(9001, 4096, "a"), (9002, 9000, "b"), (9003, None, "c"), (9004, 0, "a")]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, source string").withColumn("size", F.lit("clash"))
    for shard_items in (100_000, 500):
        rows = pack(df, shard_items=shard_items).collect()
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        assert by.keys() == {i for i, _, _ in items}
        for i, s, _ in items:
            parts = sorted(by[i], key=lambda r: r.piece)
            assert sum(p.size for p in parts) == (s or 0) and all(p.pieces == len(parts) for p in parts)
            assert (len(parts) > 1) == ((s or 0) > 4096)
        used = {}
        for r in rows:
            used[r.container] = used.get(r.container, 0) + r.size
        assert max(used.values()) <= 4096
        full = sum(s or 0 for _, s, _ in items)
        least = -(-full // 4096)
        assert len(used) <= least + rows[-1].pieces + 8
    assert containers(pack(df)).agg(F.min("free")).first()[0] >= 0
    assert pack(df.limit(0)).count() == 0


def test_mixture_is_kept():
    items = [(i, 0, 1, 100, "a") for i in range(900)] + [(1000 + i, 0, 1, 100, "b") for i in range(300)]
    windows = pack_shard(items, 1000, {"a": 0.75, "b": 0.25}, {})
    got = [sum(it[-2] for it in w if it[-1] == "b") for w in windows]
    assert all(200 <= x <= 300 for x in got[:-1]) and sum(got) == 30_000


def test_rare_source_over_many_shards(spark):
    """A source of three items in eleven shards: what the shards without it owe brings it into the first window where it comes."""
    items = [(i, 100, "big") for i in range(2000)] + [(9000 + i, 100, "rare") for i in range(3)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, source string")
    rows = pack(df, capacity=1000, shard_items=200, mixture={"rare": 0.1, "big": 0.9}).collect()
    assert len(rows) == 2003 and len({r.container.split("-")[0] for r in rows}) == 11
    late = [r.container for r in rows if r.doc_id >= 9000 and not r.container.startswith("0-")]
    assert len(late) > 1 and all(c.endswith("-0") for c in late)


def test_target_mixture(spark):
    items = [(i, 100, "a") for i in range(900)] + [(1000 + i, 100, None) for i in range(900)] + [(5000 + i, 100, "other") for i in range(50)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, source string")
    source = {i: s for i, _, s in items}
    used = {}
    for r in pack(df, capacity=1000, mixture={"a": 3, None: 1}).collect():
        used.setdefault(int(r.container.split("-")[1]), []).append(source[r.doc_id])
    first = [w for k, w in used.items() if k < 100]
    share = sum(w.count("a") for w in first) / sum(map(len, first))
    assert 0.74 <= share <= 0.76 and all(6 <= w.count("a") <= 9 for w in first) and sum(map(len, used.values())) == len(items)


def test_found(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in docs.collect() if len(reference.encode_ordinary(r.text or "")) > 4096}
    got = [r.doc_id for r in q.p8_found(spark, "/root/testdata/sf0.01").collect()]
    assert set(got) == want and len(got) == len(want)
