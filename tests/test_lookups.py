"""Names, embedding with failing backends, lookups with fallbacks."""

from pyspark.sql import functions as F

from lorespark.functions import names as N
from lorespark.operators import lookups as L
from lorespark.operators.embedding import embed, resilient


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    lit = F.lit
    assert one(spark, N.object_id(lit(" Catalog "), lit("Товары "))) == "Catalog.Товары"
    assert one(spark, N.accessor(lit("Document"), lit("Заказ"))) == "Документы.Заказ" and one(spark, N.accessor(lit("x"), lit("y"))) is None
    assert one(spark, N.type_display(lit("xs:string"), lit(50))) == "Строка(50)" and one(spark, N.type_display(lit("Число"), lit(15), lit(2))) == "Число(15,2)" and one(spark, N.type_display(lit("Дата"))) == "Дата"
    assert one(spark, N.union_ignore_case(F.array(lit("A"), lit("b")), F.array(lit("B "), lit("c"), lit(" "), lit("C")))) == ["A", "b", "c"]
    assert one(spark, N.language_of_file(lit("book_RU.hbk"))) == "ru" and one(spark, N.book_label(lit("shlang_ru"))) == "shlang"
    assert one(spark, N.memory_summary(lit(None), lit(""), lit(None), lit("d"), lit("c" * 400))) == "d | " + "c" * 300
    assert [one(spark, N.duration(lit(s))) for s in (45, 185, 7380)] == ["45s", "3m 05s", "2h 03m"]
    links = F.array(F.struct(lit("a.html").alias("href"), lit("x/a.md").alias("resolved")), F.struct(lit("b").alias("href"), lit(None).cast("string").alias("resolved")))
    assert one(spark, N.rewrite_links(lit("[A](a.html) [B](b)"), links)) == "[A](x/a.md) [B](b)"
    assert one(spark, N.cache_key(lit("p"), lit("8.3"), lit("ru"))).startswith("8.3|ru|")


def test_resilient():
    def flaky(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise OSError
        return [[1.0]]

    assert resilient(["a", "bad", "c"], flaky, 2, 1, 0) == [[1.0], resilient(["bad"], flaky, 2, 1, 0)[0], [1.0]]


def test_embed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, t string")
    out, new = embed(df, "t", lambda ts: [[float(len(ts)), 0.0] for _ in ts], batch=1)
    assert {r.id: r.vector for r in out.collect()} == {1: [1.0, 0.0], 2: [1.0, 0.0], 3: None, 4: [1.0, 0.0]} and new.count() == 2
    cache = new.where(F.col("text_hash") == F.sha2(F.lit("a"), 256))
    again, rest = embed(df, "t", cache=cache, dimension=2)
    assert rest.count() == 1 and {r.id for r in again.where("vector is not null").collect()} == {1, 2, 4}


def test_lookups(spark):
    items = spark.createDataFrame([(1, "a/x.html"), (2, "b/y.md"), (3, "z")], "id int, path string")
    table = spark.createDataFrame([("x.html", "by name"), ("a/x.html", "by path"), ("b/y.html", "html")], "k string, title string")
    got = L.fallback_lookup(items, "id", [F.col("path"), F.regexp_replace("path", r"\.md$", ".html"), F.substring_index("path", "/", -1)], table, "k")
    assert {r.id: r.title for r in got.collect()} == {1: "by path", 2: "html", 3: None}
    assert {r.id for r in L.unless_empty(items, F.col("id") < 3).collect()} == {3} and L.unless_empty(items, F.col("id") > 0).count() == 3
    assert [r.id for r in L.newest(items, "path", "id", 2).collect()] == [3, 2]
    hits = spark.createDataFrame([("d", i, float(i)) for i in range(5)] + [("e", 9, 1.0)], "d string, id int, s double")
    assert {r.id for r in L.domain_share(hits, "d", "s", "id", 4, 2).collect()} == {4, 3, 9}
    assert L.unchanged("a", "a", items) and not L.unchanged("a", "b", items) and not L.unchanged("a", "a", items.limit(0))
