"""Graph walks, query shapes and the remaining sources."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from lorespark.functions import queries as Q
from lorespark.operators.graph import page_sections, reach, text_diff
from lorespark.sources import files as S


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", None), ("a", "b")], "a string, b string")
    got = {r.node: r.depth for r in reach(edges, spark.createDataFrame([("a",), (None,)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in reach(edges, spark.createDataFrame([("a",)], "node string"), 1).collect()} == {"a", "b"}
    assert reach(edges, spark.createDataFrame([], "node string")).count() == 0


def test_reach_far(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(34)], "a string, b string")
    got = {r.node: r.depth for r in reach(edges, spark.createDataFrame([("0",)], "node string")).collect()}
    assert got == {str(i): i for i in range(35)}


def test_sections(spark):
    rows = [(1, 0, "Объекты", "Objects", None), (2, 1, "Методы", None, "m/index.html"), (3, 2, None, "Find", "m/find.html"), (4, 2, "", "", "m/find.html"), (5, 6, "x", None, "c.html"), (6, 5, "y", None, None)]
    df = spark.createDataFrame(rows, "id long, parent_id long, title_ru string, title_en string, html_path string")
    got = {r.key: (r.section_path, r.entity_type) for r in page_sections(df).collect()}
    assert got["m/find.html"] == got["find"] == got["m/find"] == ("Объекты/Методы", "method") and got["index"] == ("Объекты", "topic") and "c.html" not in got


def test_diff(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, None)], "l string, r string")
    got = [r["diff"] for r in text_diff(df, "l", "r").collect()]
    assert "-b" in got[0] and "+c" in got[0] and got[1:] == ["", ""]


def test_query_shapes(spark):
    assert Q.is_exact_name("Запрос.Выполнить") and not Q.is_exact_name("как Запрос.Выполнить") and not Q.is_exact_name(None)
    assert Q.is_natural_language("как получить запрос") and Q.is_natural_language("что?") and not Q.is_natural_language("Запрос")
    assert Q.significant_words("найти документ реализация товаров") == ["реализация", "товаров"] and Q.significant_words("одно") == []
    assert Q.search_variants("Реализация Товаров") == ["реализация товаров", "реализациятоваров", "реализация", "товаров"]
    assert Q.is_safe_url("https://a.b/c") and not Q.is_safe_url("file:///etc") and not Q.is_safe_url("http://u:p@h/") and not Q.is_safe_url("https://a.b", ("c.d",))
    assert Q.inside_base("x/y", "/b") and not Q.inside_base("../c", "/b") and not Q.inside_base("../bb", "/b")
    df = spark.createDataFrame([("Запрос\nтекст\nМетоды\n", "Запрос (Query)", ["Методы"]), (None, None, None)], "t string, title string, b array<string>")
    assert [r[0] for r in df.select(Q.without_title_lines("t", "title", F.col("b"))).collect()] == ["текст", ""]
    assert [r[0] for r in df.select(Q.first_fact(F.lit(" "), "title", "title", F.lit("b"))).collect()] == ["Запрос (Query)\n\nb", "b"]
    assert [r[0] for r in spark.range(1).select(Q.low_score_hint(F.lit(False), F.lit(0.3), F.lit(True))).collect()] == [True]
    hits = spark.createDataFrame([(1, "Запрос.Выполнить", "x", "y"), (2, "Выполнить", "x", "y"), (3, "Другое", "выполнить", "y"), (4, "Нет", "нет", "выполнить")], "id int, n string, t string, b string")
    order = Q.question_order("как выполнить Запрос.Выполнить", F.col("n"), F.col("t"), F.col("b"), F.col("id") * 0, F.col("id"))
    assert [r.id for r in hits.orderBy(*order).collect()] == [1, 2, 3, 4]


def test_sources(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    (d / "s.json").write_text(json.dumps([{"title": "a", "code_snippet": "x"}, {"title": "b", "source_ref": "own", "type": "reference"}]))
    assert {(r.title, r.source_ref) for r in S.read_items_json(spark, str(d)).collect()} == {("a", "s.json#0"), ("b", "own")}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a/b.html", "<html>")
    files = spark.createDataFrame([("z.zip", bytearray(buf.getvalue())), ("n.zip", bytearray(b"no"))], "path string, content binary")
    assert [(r.path, r.name, bytes(r.body)) for r in S.zip_rows(files).collect()] == [("z.zip", "a/b.html", b"<html>")]
    xml = spark.createDataFrame([("a.xml", 10, bytearray("<D><CatalogObject.Объекты>".encode())), ("b.xml", 5, bytearray(b"<x/>"))], "path string, length long, content binary")
    assert [r.path for r in S.find_exports(xml).collect()] == ["a.xml"]
    conf = spark.createDataFrame([(n, v) for n, v in (("A", "1"), ("B", "1"), ("C", "1"), ("D", "1"))], "config_name string, config_version string")
    assert tuple(S.config_label(conf).first()) == ("A, B, C, …", "1") and S.config_label(conf.limit(1)).first().label == "A"
    fields = spark.createDataFrame([(1, ["r1", "r2", "r1"]), (2, []), (3, None)], "id int, types array<string>")
    refs = spark.createDataFrame([("r1", "Товары")], "ref string, name string")
    assert {r.id: r.types for r in S.resolve_types(fields, "id", "types", refs).collect()} == {1: ["Товары", "r2"], 2: [], 3: []}
    pages = spark.createDataFrame([("методы/a.html", "<h1>Найти</h1><p>Текст страницы</p>"), ("b.html", "<p> </p>")], "path string, html string")
    row = S.index_rows(pages, "8.3", "ru").collect()
    assert len(row) == 1 and row[0].entity_type == "method" and row[0].keywords == ["Найти", "Текст", "страницы"]
    html = "<h2>A</h2><p>about</p><pre>X = 1;</pre><h2>A</h2><pre>Y</pre><h2>B</h2><p>z</p>"
    got = spark.createDataFrame([(html,)], "h string").select(S.listing_of("h").alias("x")).first().x
    assert [(i.title, i.code, i.description) for i in got] == [("A", "X = 1;", "about"), ("B", "", "z")]
