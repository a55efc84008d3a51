"""Snapshots, hierarchies and dangling references against brute force on the small tables and on hand-made rows."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lorespark.functions.canonical import guid, json_canonical
from lorespark.functions.versions import version_key
from lorespark.operators.hierarchy import circular_descendants, descendants, resolve_hierarchy
from lorespark.operators.references import dangling_owners, dangling_relations, orphan_report
from lorespark.operators.snapshots import snapshot_changes
from lorespark.plans import core_problems as cp

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
T = dt.datetime(2024, 1, 1)


def vkey(v):
    v = (v or "").strip(" \t\r\n\xa0")
    return tuple(int(x) if x.strip().isdigit() else 0 for x in v.split(".")) if v else ()


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_version_key(spark):
    given = ["8.3", "\xa08.3.1 ", None, "", "8.x.2", "10.1", " 8.3"]
    df = spark.createDataFrame([(v,) for v in given], "v string").select("v", version_key("v").alias("k"))
    assert [(r.v, tuple(r.k)) for r in df.collect()] == [(v, vkey(v)) for v in given]


def test_json_canonical(spark):
    same = ['{"a":1,"b":[1,2]}', '{ "b" : [1, 2],\n "a": 1}', '{"b":[1,2],"\\u0061":1}']
    out = [r.c for r in spark.createDataFrame([(s,) for s in [*same, '{"a":1,"b":[2,1]}', None, "{}", "null", "{bad"]], "s string").select(json_canonical("s").alias("c")).collect()]
    assert len(set(out[:3])) == 1 and out[3] != out[0] and out[4:7] == ["{}"] * 3 and out[7] not in out[:7]


def test_guid(spark):
    g = "AB11e98b-5d8c-4f44-a0a7-000000000001"
    df = spark.createDataFrame([(x,) for x in (g, f" {{{g}}}\t", f" {g.lower()}", None, "", " ", "{00000000-0000-0000-0000-000000000000}")], "g string")
    assert [r[0] for r in df.select(guid("g")).collect()] == [g.lower()] * 3 + [None] * 4


def brute_changes(objs):
    latest = {}
    for r in objs:
        if r["id"] is None:
            continue
        snap = latest.setdefault((r["config_name"], r["config_version"]), {})
        if r["id"] not in snap or snap[r["id"]][0] < r["delivered_at"]:
            snap[r["id"]] = (r["delivered_at"], json.loads(r["attributes"] or "{}") or {})
    out = set()
    for c in {c for c, _ in latest}:
        vs = sorted((v for x, v in latest if x == c), key=vkey)
        for a, b in zip(vs, vs[1:]):
            old, new = latest[c, a], latest[c, b]
            out |= {(c, b, i, "added") for i in new.keys() - old.keys()} | {(c, b, i, "removed") for i in old.keys() - new.keys()}
            out |= {(c, b, i, "changed") for i in new.keys() & old.keys() if new[i][1] != old[i][1]}
    return out


@data
def test_snapshots_brute(spark):
    got = [tuple(r) for r in cp.p2_found(spark, SF).collect()]
    want = brute_changes(rows(spark.read.parquet(f"{SF}/objects.parquet")))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_snapshots_edges(spark):
    schema = "config_name string, config_version string, id string, attributes string, delivered_at timestamp, h string, ord int"
    late = T + dt.timedelta(days=1)
    given = [
        ("A", "1.9", "x", '{"a":1}', T, "clash", 7),
        ("A", "1.10", "x", '{"a": 1}', T, None, None),
        ("A", "1.10", "x", '{"a":2}', late, None, None),
        ("A", "1.10", "x", '{"a":2}', late, None, None),
        ("A", "1.9", "y", None, T, None, None),
        ("A", "1.10", "y", "{}", None, None, None),
        ("A", "1.10", None, "{}", T, None, None),
        (None, None, "n", "{}", T, None, None),
        (None, "1", "m", "{}", T, None, None),
    ]
    df = spark.createDataFrame(given, schema)
    assert {tuple(r) for r in snapshot_changes(df).collect()} == {("A", "1.10", "x", "changed"), (None, "1", "n", "removed"), (None, "1", "m", "added")}
    assert snapshot_changes(df.limit(0)).count() == 0


def brute_chain(parents):
    out = {}
    for n in parents:
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = parents[at] if parents[at] in parents else None
        out[n] = None if at is not None else seen[::-1]
    return out


def test_hierarchy(spark):
    edges = {"r": None, "a": "r", "b": "a", "c": "b", "d": "c", "e": "d", "f": "e", "x": "y", "y": "z", "z": "x", "w": "x", "self": "self", "lost": "nowhere", "under": "lost", "deep": "under", "deeper": "deep", "deepest": "deeper", "g": "a"}
    df = spark.createDataFrame([(n, p, n.upper(), 1) for n, p in edges.items()] + [(None, "r", "N", 1), ("g", "a", "G", 2)], "node string, parent string, label string, depth int")
    got = {r.node: r for r in resolve_hierarchy(df).collect()}
    want = brute_chain(edges)
    assert got.keys() == want.keys()
    for n, chain in want.items():
        assert got[n].cyclic == (chain is None), n
        if chain:
            assert [p.id for p in got[n].path] == chain and got[n].root == chain[0] and got[n].depth == len(chain) - 1
            assert [p.label for p in got[n].path] == [c.upper() for c in chain]
    assert got["lost"].dangling and not got["r"].dangling
    below = {(r.ancestor, r.node, r.distance) for r in descendants(resolve_hierarchy(df)).collect()}
    assert below == {(c, n, len(ch) - 1 - k) for n, ch in want.items() if ch for k, c in enumerate(ch[:-1])}
    assert resolve_hierarchy(df.limit(0)).count() == 0


def test_descendants_on_circles(spark):
    edges = {"r": None, "a": "r", "x": "y", "y": "z", "z": "x", "w": "x", "v": "w", "u": "v", "t": "u", "self": "self", "s": "self", "s2": "s"}
    edges |= {f"c{i}": f"c{(i + 1) % 21}" for i in range(21)} | {"d0": "c5"} | {f"d{i}": f"d{i - 1}" for i in range(1, 40)}
    df = spark.createDataFrame(list(edges.items()), "node string, parent string").withColumn("label", F.col("node"))
    want = set()
    for n in edges:
        at, seen = edges[n], [n]
        while at is not None and at not in seen:
            want.add((at, n, len(seen)))
            seen.append(at)
            at = edges[at]
    tree = resolve_hierarchy(df)
    got = [tuple(r) for r in descendants(tree).unionByName(circular_descendants(tree)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("w", "t", 3) in want and ("x", "y", 2) in want and circular_descendants(resolve_hierarchy(df.where("node in ('r', 'a')"))).count() == 0


@data
def test_hierarchy_brute(spark):
    import re

    def g(x):
        x = re.sub(r"^[\s{]+|[\s}]+$", "", x or "").lower()
        return x if x and x != "00000000-0000-0000-0000-000000000000" else None

    props = sorted(rows(spark.read.parquet(f"{SF}/catalog_properties.parquet")), key=lambda r: (r["loaded_at"], r["row_id"]))
    parents = {g(r["config_ref"]): None for r in rows(spark.read.parquet(f"{SF}/crawl_results.parquet"))} | {g(r["ref"]): None for r in rows(spark.read.parquet(f"{SF}/catalog_objects.parquet"))}
    parents |= {g(r["ref"]): g(r["owner"]) for r in props}
    chains = brute_chain(parents)
    want = {("catalog_properties", r["ref"]) for r in props if chains[g(r["ref"])] is None}
    toc = {r["id"]: r for r in rows(spark.read.parquet(f"{SF}/toc_chunks.parquet"))}
    tc = brute_chain({i: r["parent_id"] or None for i, r in toc.items()})
    want |= {("toc_chunks", str(i)) for i, c in tc.items() if c is None}
    for t in rows(spark.read.parquet(f"{SF}/api_topics.parquet")):
        if t["toc_id"] is not None and t["breadcrumb"]:
            chain = tc.get(t["toc_id"])
            if chain is None or t["breadcrumb"] != [toc[i]["title_en" if t["language"] == "en" else "title_ru"] for i in chain[:-1]]:
                want.add(("api_topics", str(t["id"])))
    got = [tuple(r) for r in cp.p4_found(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_references_edges(spark):
    objs = spark.createDataFrame([("a", "C", "1.2"), ("a", "C", "1.10"), ("b", "C", "1.10"), ("c", "D", "1"), (None, "C", "1"), ("n", None, None)], "id string, config_name string, config_version string")
    rel = spark.createDataFrame(
        [(1, "a", "b", "C", "1.2", T, "k"), (2, "c", None, "C", "1.2", T, None), (3, "", "0", "C", "1.2", None, None), (4, "a", "b", "C", "1.11", None, None), (5, "n", "n ", None, None, T, None), (1, "a", "b", "C", "1.2", T, "k")],
        "rel_id long, from_id string, to_id string, config_name string, config_version string, seen_at timestamp, k string",
    )
    got = sorted((r.row_id, r.field, r.kind) for r in dangling_relations(rel, objs).collect())
    assert got == [(1, "to_id", "later"), (1, "to_id", "later"), (2, "from_id", "missing"), (4, "from_id", "deleted"), (4, "to_id", "deleted"), (5, "to_id", "missing")]
    assert dangling_relations(rel.limit(0), objs).count() == 0
    assert {r.kind for r in dangling_relations(rel, objs.limit(0)).collect()} == {"missing"}
    g = "aaaaaaaa-0000-0000-0000-00000000000{}".format
    props = spark.createDataFrame([(1, g(1), g(2).upper(), T), (2, g(2), "{" + g(3) + "} ", T), (3, g(4), g(9), T), (4, g(5), None, None), (5, g(6), g(7), T), (6, g(7), g(8), T + dt.timedelta(1)), (7, g(8), g(7), None)], "row_id long, ref string, owner string, loaded_at timestamp")
    cat = spark.createDataFrame([(g(3), True, T)], "ref string, deletion_mark boolean, loaded_at timestamp")
    conf = spark.createDataFrame([(g(8),)], "config_ref string")
    found = dangling_owners(props, cat, conf)
    assert sorted((r.row_id, r.kind) for r in found.collect()) == [(2, "deleted"), (3, "missing"), (5, "later")]
    assert sum(r.n for r in orphan_report(found).collect()) == 3


def test_hot_keys_are_split(spark):
    from lorespark.util.skew import lookup_join, pair_join

    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    out = lookup_join(left, right, "k", least=50)
    assert "_part" in out._jdf.queryExecution().toString()
    assert out.count() == 3000 and out.where("w <> k * 2").count() == 0 and out.where("k is null and w is null").count() == 1000
    assert lookup_join(left, right, "k", "inner", least=50).count() == 2000
    assert lookup_join(left.select("k"), right, "k", "inner", least=50).count() == 2000
    few = spark.range(90).select(F.col("id").alias("x"), F.when(F.col("id") < 60, 7).otherwise(F.col("id")).alias("k"))
    pairs = pair_join(left, few, "k", least=50, pairs=1000)
    assert "_a" in pairs._jdf.queryExecution().toString()
    assert pairs.count() == pairs.distinct().count() == left.join(few, "k").count()


@pytest.mark.parametrize("range_bits, broadcast_ranges", [(1 << 23, 32), (1 << 12, 32), (1 << 12, 2)])
def test_bloom_has_no_false_negative(spark, range_bits, broadcast_ranges):
    from lorespark.util.bloom import Bloom

    name = F.concat(F.lit("k"), F.col("id").cast("string"))
    keys = spark.range(4000).select(name.alias("k"), F.lit("clash").alias("id"))
    b = Bloom(keys, F.col("k"), 4000, range_bits, broadcast_ranges)
    assert b.ranges == (1 if range_bits > 1 << 12 else 10) and b.filter(keys, F.col("k")).count() == 4000
    other = spark.range(4000, 24000).select(name.alias("k"))
    # about 1.2 % are not told apart, however many ranges there are
    assert b.filter(other, F.col("k")).count() < 500
    assert {r._maybe for r in b.mark(other.select(F.lit(None).cast("string").alias("k")), F.col("k")).collect()} == {None}


def test_long_chain_with_circle(spark):
    """No path is carried by what hangs on a circle, however long the chain."""
    from lorespark.operators.hierarchy import Hierarchy

    n = 400
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).otherwise(F.lit(n)).alias("parent"))
    circle = spark.createDataFrame([(n, n + 1), (n + 1, n)], "node long, parent long")
    straight = spark.range(10_000, 10_000 + n).select(F.col("id").alias("node"), F.when(F.col("id") > 10_000, F.col("id") - 1).alias("parent"))
    tree = Hierarchy(chain.unionByName(circle).unionByName(straight).withColumn("label", F.lit("x")))
    assert tree.circular().count() == n + 2 and tree.n_open in (n + 1, n + 2)
    deep = tree.resolve().where(f"node = {10_000 + n - 1}").first()
    assert deep.depth == n - 1 and [p.id for p in deep.path] == list(range(10_000, 10_000 + n))
    flat = tree.resolve(paths=False)
    assert "path" not in flat.columns and flat.where("cyclic").count() == n + 2 and flat.agg(F.max("depth")).first()[0] == n - 1
