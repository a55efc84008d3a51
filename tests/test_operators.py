"""Text columns, ranking, records and surface names on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as t
from lorespark.functions.chunks import chunk_rows, clamp
from lorespark.functions.vectors import cosine, token_hash_vector
from lorespark.operators import bm25, catalog
from lorespark.operators.fusion import places, quota_candidates, quotas, ranked, rrf
from lorespark.operators.merge import content_merge, key_changes, to_load, upsert
from lorespark.operators.quality import coverage, latency
from lorespark.operators.records import build_records, merge_members, resolve_links
from lorespark.operators.surface import candidates, owner_alias_members
from lorespark.plans.planner import plan, plans


def values(spark, given, column, kind="string"):
    return [r.x for r in spark.createDataFrame([(g,) for g in given], f"v {kind}").select(column.alias("x")).collect()]


def test_text(spark):
    v = F.col("v")
    assert values(spark, ["Метод А bc Ёлка-42 x", None, ""], t.tokens(v)) == [["метод", "bc", "ёлка", "42"], [], []]
    assert values(spark, ["Запрос запрос Query ab Ab2"], t.keywords(v)) == [["Запрос", "Query", "Ab2"]]
    assert values(spark, ["HTTPСоединение.Получить и Запрос запрос", None], t.keyword_tokens(v)) == [["HTTPСоединение.Получить", "HTTPСоединение", "Получить", "Запрос"], []]
    assert values(spark, ["ВызватьИсключение.Код", "Просто", None], t.camel_words(v)) == ["Вызвать Исключение", "", ""]
    assert values(spark, ["a  b\n c", "x" * 20], t.summary(v, 10)) == ["a b c", "x" * 7 + "..."]
    assert values(spark, ["Имя (Name)", "Имя", "Имя (имя)"], t.title_synonym(v)) == ["Name", None, None]
    assert values(spark, ["A.B.C", "C", None], t.owner_of(v)) == ["A.B", "", ""]
    assert values(spark, ["<title>T</title>", "<H1 a>x <b>y</b></H1><title>T</title>", "z", None], t.html_title(v)) == ["T", "x y", "Untitled", "Untitled"]
    assert values(spark, ["<a href='x'>1</a><A class=q HREF=\"y\">"], t.html_links(v)) == [["x", "y"]]
    assert values(spark, ["ab\x01c\n"], t.without_controls(v)) == ["ab c\n"]
    assert values(spark, ["7z failed", "HTTP 429", "qdrant upsert", "parse html", "?", None], t.error_category(v)) == ["unpack", "embed", "index", "build", "other", "other"]
    assert values(spark, ["form_x.html", "a/zif2_b", "c"], t.topic_doc_kind(v)) == ["form_help", "cli_help", "article"]
    q = ["запрос", "запрос (query)", "запрос выполнить", "запросный", "мой запрос", "нет", "запрос-2"]
    assert values(spark, q, t.title_rank("запрос", v)) == [0, 0, 1, 2, 2, 3, 1]
    assert values(spark, ["тип.запрос", "запрос", "x запрос"], t.member_order("запрос", v)) == [1, 0, 0]


def test_classifier(spark):
    code = "Процедура А() " + "x = 1; " * 20
    rows = [("Как сделать", "d", "x" * 200), ("Пример", "", code), ("Как сделать", "", code), ("t", "d" * 500, code), ("t", "", "коротко")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r[0] for r in df.select(t.snippet_or_reference("a", "b", "c")).collect()] == ["reference", "snippet", "snippet", "reference", "reference"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 1400), (2, "b" * 1401), (3, "c" * 4000), (4, " "), (5, None)], "id int, t string")
    got = {}
    for r in chunk_rows(df, "t").collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.chunk))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 2, 3: 4}
    parts = [c for _, c in sorted(got[3])]
    assert parts[0] + "".join(p[250:] for p in parts[1:]) == "c" * 4000 and clamp(9000, (400, 1900)) == 1900


def test_bm25_contract(spark):
    docs = spark.createDataFrame([(1, "кот кот пёс"), (2, "пёс"), (3, None), (4, "лиса и кот")], "id int, t string")
    hits = [r.id for r in bm25.search(docs, "id", "t", "кот", 10).collect()]
    assert hits == [1, 4] and bm25.search(docs, "id", "t", "?", 10).count() == 0
    weights = {(r.id, r.term): r.weight for r in bm25.doc_weights(docs, "id", "t").collect()}
    stats = bm25.corpus_stats(docs, "t").first()
    assert stats.n_docs == 4 and stats.avgdl == pytest.approx(6 / 4)
    assert weights[1, "кот"] == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.5)), abs=1e-6)
    assert bm25.corpus_stats(docs.limit(0), "t").first().avgdl == 0.0


def test_fusion(spark):
    legs = [spark.createDataFrame([("a", 3.0), ("b", 2.0)], "k string, s double"), spark.createDataFrame([("b", 9.0)], "k string, s double")]
    got = {r.k: r.rrf for r in rrf([ranked(x, "k", F.desc("s")) for x in legs], "k").collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61)
    hits = spark.createDataFrame([(1, "x", "t1"), (2, "y", "t2"), (3, "y", "t3"), (4, "x", "t1"), (5, "z", "t5")], "pos int, d string, t string")
    shown = quotas(hits, "d", "pos", "t", {"y": 1, "x": 1}, 4).orderBy("place").collect()
    assert [r.pos for r in shown] == [2, 1, 3, 5]


def test_merge(spark):
    rows = [(1, "ru", "A", "x ", "8.3.1", ["8.3.1"]), (2, "ru", "A", "x", "8.3.10", None), (3, None, "A", "x", "8.3", []), (4, "ru", "B", None, None, None)]
    df = spark.createDataFrame(rows, "n int, language string, name string, body string, version string, versions array<string>")
    got = {(r.language, r.last.name): r for r in content_merge(df, "language", ["name", "body"], "version", "versions", "s", F.col("n")).collect()}
    assert got["ru", "A"].n == 2 and got["ru", "A"].versions == ["8.3.10", "8.3.1"] and got["ru", "A"].last.body == "x"
    assert got["", "A"].versions == ["8.3"] and got["ru", "B"].versions == []
    a, b = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {tuple(r) for r in key_changes(a, b, "k", "v").collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    assert {tuple(r) for r in upsert(a, b, "k").collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    cache = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, indexed boolean")
    assert {r.k for r in to_load(a, cache, "k", "v").collect()} == {2, 3}


def test_catalog(spark):
    df = spark.createDataFrame([("Catalog.Товары", "Товары"), ("Document.Товары", "Товары"), ("Catalog.ТоварыСклада", "ТоварыСклада"), ("x", None)], "id string, name string")
    exact = catalog.exact_lookup(df, ["id", "name"], ["Товары"], ["id"], 5)
    assert [r.id for r in exact.collect()] == ["Catalog.Товары", "Document.Товары"]
    assert [(r.id, r.priority) for r in catalog.substring_lookup(df, ["id", "name"], "товары", ["id"], 5).collect()] == [("Catalog.Товары", 0), ("Document.Товары", 0), ("Catalog.ТоварыСклада", 1)]
    assert catalog.cascade([df.where("id = 'no'"), df.where("id = 'x'")]).first().leg == 1
    assert catalog.guess_type("какой документ") == "Document" and catalog.query_variants("А б/в") == ["а б/в", "аб/в", "а б", "в"]


def test_quality(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", None)], "g string, v double")
    r = latency(df, "g", "v").first()
    assert (r.n, r.median_ms, r.p95_ms, r.max_ms) == (4, 2.5, 10.0, 10.0)
    assert {r.field: r.pct for r in coverage(df, ["g", "v"]).collect()} == {"g": 100.0, "v": 80.0}
    assert coverage(df.limit(0), ["g"]).first().pct == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]
    assert token_hash_vector(None, 4) == [0.0] * 4 and len(token_hash_vector("а b!", 3)) == 3


def test_records(spark):
    page = "# Найти (Find)\nКратко\n## Синтаксис\nНайти(<А>)\n## Параметры\n**А** (Строка) — что\n## Возвращаемое значение\nТип: Массив, Число.\n## Пример\n```bsl\nX = 1;\n```\n## См. также\n- Запрос\n[дом](a.html)"
    rows = [("b/objects/q/methods/find.html", "Найти (Find)", page, "8.3.1", "ru", None, ["Объекты", "Запрос"]), ("b/objects/q.html", "Запрос", "# Запрос\nтекст", "8.3.1", "ru", None, None), ("b/art.html", None, "# Статья\nтекст", None, None, None, [])]
    made = build_records(spark.createDataFrame(rows, "path string, title string, text string, version string, language string, entity_type string, breadcrumb array<string>"))
    m = made["api_members"].first()
    assert (m.full_name, m.owner_name, m.syntax, m.value_types, m.aliases) == ("Запрос.Найти", "Запрос", "Найти(<А>)", ["Массив", "Число"], ["Find"]) and m.params[0].name == "А"
    assert [r.kind for r in made["api_objects"].collect()] == ["type"] and made["api_examples"].first().code == "X = 1;"
    assert [(r.title, r.kind) for r in made["api_topics"].collect()] == [("Статья", "article")]
    links = {(r.link_kind, r.target_name): r.target_lookup for r in resolve_links(made["api_links"], made["api_objects"], made["api_members"]).collect()}
    assert links == {("markdown", "дом"): None, ("see_also", "Запрос"): "full_name", ("see_also", "[дом](a.html)"): None, ("returns_type", "Массив"): None, ("returns_type", "Число"): None}
    assert merge_members(made["api_members"]).first().versions == ["8.3.1"]


def test_surface_and_plan(spark):
    assert candidates("Метаданные.Справочники.Товары.Код") == [("Справочники.Товары.Код", "exact"), ("Catalog.Товары", "object_id"), ("Товары.Код", "tail"), ("Код", "member")]
    assert candidates("") == []
    m = spark.createDataFrame([(1, "Форма", "Элементы", "Форма.Элементы", "property", "Тип: ВсеЭлементы, Число."), (2, "ВсеЭлементы", "Найти", "ВсеЭлементы.Найти", "method", None), (3, "Запрос", "Найти", "Запрос.Найти", "method", None)], "id int, owner_name string, member_name string, full_name string, kind string, returns string")
    assert [r.id for r in owner_alias_members(m, "Элементы", "Найти").collect()] == [2]
    asked = ["", "Метаданные.Документы", "Запрос.Найти", "стандарт имён", "как получить", "документ заказ", "xyz", None, "Чем заменить Найти"]
    got = plans(spark.createDataFrame([(x,) for x in asked], "x string"), "x").collect()
    assert [r.route for r in got] == ["mixed_task", "metadata_surface_chain", "platform_surface_chain", "standards_or_snippets", "conceptual_help", "metadata_exact", "mixed_task", "mixed_task", "conceptual_help"]
    assert [r.kind for r in got] == ["general"] * 4 + ["example", "general", "general", "general", "restriction"]
    assert [r.confidence for r in got] == [0.25, 0.85, 0.85, 0.35, 0.35, 0.35, 0.25, 0.25, 0.7]
    assert plan(spark, "Запрос.Найти").candidates == ["Запрос.Найти", "Запрос", "Найти"]


def test_term_counts_and_index(spark):
    rows = [(1, "яблоко яблоко груша"), (2, "груша Груша груша, x"), (3, None), (4, ""), (None, "яблоко"), (5, "слива")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("clash"))
    flat = {(r.doc_id, r.term): (r.tf, r.dl) for r in bm25.postings(docs, "doc_id", "text").collect()}
    assert flat == {(1, "груша"): (1, 3), (1, "яблоко"): (2, 3), (2, "груша"): (3, 3), (None, "яблоко"): (1, 1), (5, "слива"): (1, 1)}
    index = bm25.Index(docs, "doc_id", "text", buckets=3)
    assert (index.n_docs, index.sum_dl) == (6, 8) and index.postings.count() == 5
    for query in ("груша яблоко", "слива", "нет", "", "яблоко яблоко"):
        want = [tuple(r) for r in bm25.search(docs, "doc_id", "text", query).collect()]
        assert [tuple(r) for r in index.search(query).collect()] == want
    assert bm25.Index(docs.limit(0), "doc_id", "text").search("груша").collect() == []


def test_chain(spark):
    from lorespark.operators.graph import chain

    links = {"a": "b", "b": "c", "c": "a", "x": "a", "z": "z", **{f"n{i}": f"n{i + 1}" for i in range(12)}}
    df = spark.createDataFrame(list(links.items()) + [(None, "a")], "a string, b string")
    got = {}
    for r in chain(df, spark.createDataFrame([("x",), ("z",), ("n0",), ("lost",), (None,)], "seed string"), 8).collect():
        got.setdefault(r.seed, {})[r.step] = r.node
    assert got == {"x": dict(enumerate("xabc")), "z": {0: "z"}, "n0": {i: f"n{i}" for i in range(8)}, "lost": {0: "lost"}}


def test_places(spark):
    rows = spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 3).alias("g"))
    got = {r.id: r.place for r in places(rows, ["g", "id"]).collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (i % 3, i)))}


def test_quotas_of_all_rows(spark):
    rows = [(p, "x" if p < 90 else "y", f"t{p % 2}") for p in range(1, 100)] + [(p, "z", f"t{p % 3}") for p in range(100, 120)]
    hits = spark.createDataFrame(rows, "pos long, d string, t string")
    limits = {"y": 2, "x": 1}
    want = [tuple(r) for r in quotas(hits, "d", "pos", "t", limits, 7).orderBy("place").select("pos", "place").collect()]
    got = quotas(quota_candidates(hits, "d", "pos", "t", limits, 7), "d", "pos", "t", limits, 7).orderBy("place").select("pos", "place")
    assert [tuple(r) for r in got.collect()] == want and want[0][0] == 90
