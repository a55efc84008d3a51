"""Scorecards, counts, metrics, hierarchies and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.functions.text import any_of, contains_any, squeeze, text_or_empty
from lorespark.functions.versions import version_key
from lorespark.operators.graph import chain, page_sections, reach
from lorespark.operators.hierarchy import resolve_hierarchy
from lorespark.operators.metrics import last_n, tool_metrics, trailing_counts
from lorespark.operators.quality import coverage, hit_cards, latency, percent
from lorespark.plans._queries import Book
from lorespark.plans.core_problems import _toc_nodes
from lorespark.plans.search import VK
from lorespark.plans.tables import table
from lorespark.streaming.events import admitted

q = Book()


@q("select coalesce(kind, 'topic') kind, count(*) n from api_members group by 1")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").groupBy(F.coalesce("kind", F.lit("topic")).alias("kind")).agg(F.count("*").alias("n"))


@q("select source as name, count(*) as n from documents where source is not null group by 1 order by n desc, name limit 10")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


_FIELDS = ["summary", "description", "syntax", "returns", "version", "owner_name"]


@q(" union all ".join(f"select '{f}' field, round(100.0 * count(*) filter (trim(coalesce({f}, '')) <> '') / count(*), 1)::double pct from api_members" for f in _FIELDS) + " union all select 'params', round(100.0 * count(*) filter (len(params) > 0) / count(*), 1)::double from api_members")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(table(spark, d, "api_members"), [*_FIELDS, "params"])


@q("""with s as (select distinct topic_path p from api_objects where trim(coalesce(topic_path, '')) <> ''), t as (select distinct path p from api_topics where trim(coalesce(path, '')) <> '')
select (select count(*) from t) n_topics, (select count(*) from s) n_structured, round(100.0 * (select count(*) from s) / (select count(*) from t), 1)::double pct""")
def path_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "api_topics").where("trim(path) <> ''").agg(F.count_distinct("path").alias("n_topics"))
    s = table(spark, d, "api_objects").where("trim(topic_path) <> ''").agg(F.count_distinct("topic_path")).scalar()
    return t.select("n_topics", s.alias("n_structured"), percent(s, F.col("n_topics")).alias("pct"))


@q("select distinct p from (select topic_path p from api_objects union all select path from api_topics union all select html_path from toc_chunks) where trim(coalesce(p, '')) <> ''")
def path_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("p")) for t, c in (("api_objects", "topic_path"), ("api_topics", "path"), ("toc_chunks", "html_path"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(p) <> ''").distinct()


_EXPECTED = ["method", "property", "event", "function", "constructor", "field", "operator"]


@q(f"select gap from (select unnest({_EXPECTED!r}) gap) where gap not in (select entity_type from api_topics where entity_type is not null)")
def gap_set(spark: SparkSession, d: str) -> DataFrame:
    """Expected kinds that don't occur; the kinds present are a handful of labels."""
    have = table(spark, d, "api_topics").where("entity_type is not null").select(F.col("entity_type").alias("gap")).distinct()
    return spark.createDataFrame([(k,) for k in _EXPECTED], "gap string").join(have, "gap", "left_anti")


@q(f"select config_name, config_version, row_number() over (partition by config_name order by {VK.format(v='config_version')} desc) as place from (select distinct config_name, config_version from objects)")
def version_list(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "objects").select("config_name", "config_version").distinct()
    return v.select("config_name", "config_version", F.row_number().over(W.partitionBy("config_name").orderBy(F.desc(version_key("config_version")))).alias("place"))


_TABLES = ["api_topics", "api_objects", "api_members", "objects", "config_relations", "catalog_objects", "catalog_properties", "documents", "embeddings"]


@q(" union all ".join(f"select '{t}' as name, count(*) n from {t}" for t in _TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@q("select count(*) n_rows, count(distinct trim(version)) n_versions, count(distinct language) n_languages, min(language) first_language from api_topics")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").agg(F.count("*").alias("n_rows"), F.count_distinct(F.trim("version")).alias("n_versions"), F.count_distinct("language").alias("n_languages"), F.min("language").alias("first_language"))


# benchmark cases: (id, query, expected full name)
_CASES = [("c1", "слот", "слот"), ("c2", "DraftSlotContour.ModuleCliché", "DraftSlotContour.ModuleCliché"), ("c3", "сценарий", "сценарий"), ("c4", "token ring", "token ring"), ("c5", "СлойБуфер", "СлойБуфер")]
_N = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
_SCORE = """(case when f = qn then 100 when m = qn then 90 when starts_with(f, qn) then 70 when contains(f, qn) then 55 else 0 end
+ case when t = qn then 40 when starts_with(t, qn) then 25 when contains(t, qn) then 10 else 0 end + case when contains(s, qn) then 5 else 0 end)"""
_BENCH = f"""k(case_id, query) as (values {', '.join(f"('{i}', '{x}')" for i, x, _ in _CASES)}), kn as (select case_id, {_N.format(c='query')} qn from k),
i as (select id, {_N.format(c='full_name')} f, {_N.format(c='member_name')} m, {_N.format(c='full_name')} t, {_N.format(c='summary')} s from api_members),
x as (select case_id, id, {_SCORE} score, case when f = qn then 0 when m = qn then 1 when ends_with(f, '.' || qn) then 2 else 3 end p, f from kn, i),
r as (select case_id, id, score, row_number() over (partition by case_id order by p, score desc, f, id) place from x where score > 0)"""


def _bench(spark: SparkSession, d: str) -> DataFrame:
    """Three best records of each case; the list of cases is a parameter, every record is scored against all of it."""
    low = {c: F.lower(squeeze(n)) for c, n in (("f", "full_name"), ("m", "member_name"), ("t", "full_name"), ("s", "summary"))}
    rows = table(spark, d, "api_members").select("id", *[v.alias(k) for k, v in low.items()])
    cases = F.explode(F.array(*[F.struct(F.lit(i).alias("case_id"), F.lit(" ".join(x.split()).lower()).alias("qn")) for i, x, _ in _CASES]))
    # cases that cannot score are dropped before anything is shuffled
    x = rows.select("*", cases.alias("k")).select("*", "k.*")
    c = {n: F.col(n) for n in ("f", "m", "t", "s", "qn")}
    score = F.when(c["f"] == c["qn"], 100).when(c["m"] == c["qn"], 90).when(F.startswith(c["f"], c["qn"]), 70).when(F.contains(c["f"], c["qn"]), 55).otherwise(0)
    score = score + F.when(c["t"] == c["qn"], 40).when(F.startswith(c["t"], c["qn"]), 25).when(F.contains(c["t"], c["qn"]), 10).otherwise(0)
    score = score + F.when(F.contains(c["s"], c["qn"]), 5).otherwise(0)
    p = F.when(c["f"] == c["qn"], 0).when(c["m"] == c["qn"], 1).when(F.endswith(c["f"], F.concat(F.lit("."), c["qn"])), 2).otherwise(3)
    hit = x.select("case_id", "id", "f", "m", "qn", score.alias("score"), p.alias("p")).where("score > 0")
    # WindowGroupLimit keeps three rows per case and task before the shuffle
    place = F.row_number().over(W.partitionBy("case_id").orderBy("p", F.desc("score"), "f", "id"))
    return hit.withColumn("place", place).where("place <= 3")


@q(f"with {_BENCH} select case_id, id, score, place from r where place <= 3")
def benchmark_top3(spark: SparkSession, d: str) -> DataFrame:
    return _bench(spark, d).select("case_id", "id", "score", "place")


@q(f"""with {_BENCH}, e as (select r.case_id, place from r join i using (id) join kn using (case_id) where place <= 3 and (i.f = qn or i.m = qn)),
b as (select case_id, min(place) place from e group by 1)
select 5 as total, round(100.0 * (select count(*) from b where place = 1) / 5, 1)::double exact_top1_pct, round(100.0 * (select count(*) from b) / 5, 1)::double exact_top3_pct""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    hits = _bench(spark, d).where("f = qn or m = qn").groupBy("case_id").agg(F.min("place").alias("place"))
    n = F.lit(len(_CASES))
    return hits.agg(n.alias("total"), percent(F.count_if(F.col("place") == 1), n).alias("exact_top1_pct"), percent(F.count(F.lit(1)), n).alias("exact_top3_pct"))


@q("""with a as (select 'curated:' || item_id id, 0 leg, item_id pos from skd_composition_result where type = 'reference'), b as (select 'curated:' || item_id id, 1 leg, item_id pos from skd_composition_result),
u as (select id, leg, pos, row_number() over (partition by id order by leg, pos) rn from (select * from a union all select * from b))
select id, row_number() over (order by leg, pos) place from u where rn = 1 order by leg, pos limit 120""")
def case_union_topup(spark: SparkSession, d: str) -> DataFrame:
    """Given cases first, topped up to 120 with generated ones that are not yet there."""
    s = table(spark, d, "skd_composition_result").select(F.concat(F.lit("curated:"), F.col("item_id").cast("string")).alias("id"), "type", F.col("item_id").alias("pos"))
    every = s.where("type = 'reference'").select("id", F.lit(0).alias("leg"), "pos").unionByName(s.select("id", F.lit(1).alias("leg"), "pos"))
    one = every.groupBy("id").agg(F.min(F.struct("leg", "pos")).alias("x")).select("id", "x.*").orderBy("leg", "pos").limit(120)
    return one.select("id", F.row_number().over(W.orderBy("leg", "pos")).alias("place"))


@q("""with r as (select event_type, value, row_number() over (partition by event_type order by value) rn, count(*) over (partition by event_type) n from events where value is not null)
select event_type, n, round(avg(value) filter (rn in (floor((n + 1) / 2), floor(n / 2) + 1)), 1) median_ms, round(max(value) filter (rn = ceil(n * 0.95)), 1) p95_ms, round(max(value), 1) max_ms from r group by 1, 2""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return latency(table(spark, d, "events"), "event_type", "value")


@q("""with e as (select event_type, cast(json_extract(props, '$.k') as int) % 3 suite, value from events)
select event_type, suite, count(*) n, coalesce(round(100.0 * count(*) filter (value > 50 and value < 100) / nullif(count(*) filter (value > 50), 0), 1), 0)::double slow_pct from e group by grouping sets ((event_type), (suite), ())""")
def profile_cards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.get_json_object("props", "$.k").cast("int") % 3).alias("suite"), "value")
    return hit_cards(e, ["event_type", "suite"], {"slow_pct": (F.col("value") > 50, F.col("value") < 100)})


@q("select event_type tool, count(*) total, round(max(value), 3) max_value, count(*) filter (value > 200) errors, max(ts) filter (value > 200) last_error_at from events group by 1 order by total desc, tool")
def tool_metrics_report(spark: SparkSession, d: str) -> DataFrame:
    return tool_metrics(table(spark, d, "events").withColumnRenamed("event_type", "tool"), "tool", "value", "value > 200")


@q("select count(*) total, count(*) filter (ts >= (select max(ts) from events) - interval 1 hour) last_hour, count(*) filter (event_type = 'error') errors from events")
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts")).scalar()
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= newest - F.expr("interval 1 hour")).alias("last_hour"), F.count_if(F.col("event_type") == "error").alias("errors"))


@q()
def rate_limit_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event passes a limit of two calls of its kind in a minute; refused calls don't count."""
    return admitted(table(spark, d, "events"), "event_type", "ts", "event_id", 2)


@q("select event_id, recent, recent > 3 limited from (select event_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) recent from events)")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return trailing_counts(table(spark, d, "events"), "user_id", "ts", 60).select("event_id", "recent", (F.col("recent") > 3).alias("limited"))


@q("select event_type, event_id, rn from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) rn from events where ts > (select max(ts) from events) - interval 7 days) where rn <= 50")
def memory_last_n_ttl(spark: SparkSession, d: str) -> DataFrame:
    return last_n(table(spark, d, "events"), "event_type", "ts", "event_id", 50, 7).select("event_type", "event_id", "rn")


@q("""select event_type, count(*) filter (lower(json_extract_string(props, '$.k')) in ('1', 'error')) n_errors, count(*) filter (lower(json_extract_string(props, '$.k')) in ('2', 'warning')) n_warnings from events group by 1""")
def diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.lower(F.try_variant_get(F.try_parse_json("props"), "$.k", "string"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(k.isin("1", "error")).alias("n_errors"), F.count_if(k.isin("2", "warning")).alias("n_warnings"))


@q("""with recursive w as (select id, title_ru, parent_id, '' as path, 0 as depth from toc_chunks where parent_id = 0 or parent_id not in (select id from toc_chunks)
union all select c.id, c.title_ru, c.parent_id, case when w.path = '' then w.title_ru else w.path || '/' || w.title_ru end, w.depth + 1 from toc_chunks c join w on c.parent_id = w.id)
select id, path as breadcrumb, depth from w""")
def breadcrumb_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Titles above every entry of the contents; entries on cycles have none and are left out."""
    t = resolve_hierarchy(_toc_nodes(spark, d)).where("not cyclic")
    above = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda x: x["label"]["title_ru"])
    return t.select(F.col("node").alias("id"), F.array_join(above, "/").alias("breadcrumb"), "depth")


@q("""with recursive e as (select from_id a, max(to_id) b from config_relations where from_id is not null and to_id is not null group by 1),
w as (select a as seed, a as node, 0 as step, [a] as seen from e where starts_with(a, 'DataProcessor.') union all select seed, b, step + 1, list_append(seen, b) from w join e on e.a = w.node where not list_contains(seen, b) and step < 7)
select seed, node, step from w""")
def workflow_path(spark: SparkSession, d: str) -> DataFrame:
    """From every data processor along one link of each record, eight records at most, none twice."""
    r = table(spark, d, "config_relations").where("from_id is not null and to_id is not null")
    following = r.groupBy(F.col("from_id").alias("a")).agg(F.max("to_id").alias("b"))
    return chain(following, r.where(F.startswith("from_id", F.lit("DataProcessor."))).select(F.col("from_id").alias("seed")).distinct(), 8)


_SCRIPT = ["Процедура", "Функция", "КонецПроцедуры", "Возврат", "Если ", "Для ", "Новый ", "Запрос"]


@q("select doc_id, " + " + ".join(f"contains(coalesce(text, ''), '{w}')::int" for w in _SCRIPT) + " n_words from documents where " + " or ".join(f"contains(coalesce(text, ''), '{w}')" for w in _SCRIPT))
def script_words(spark: SparkSession, d: str) -> DataFrame:
    hits = [F.contains(text_or_empty("text"), F.lit(w)) for w in _SCRIPT]
    n = sum((h.cast("int") for h in hits), F.lit(0))
    return table(spark, d, "documents").where(any_of(hits)).select("doc_id", n.alias("n_words"))


@q("""select id, n >= 3 and summary_ok sufficient from (select id, trim(coalesce(summary, '')) <> '' summary_ok,
(trim(coalesce(summary, '')) <> '')::int + (trim(coalesce(syntax, '')) <> '')::int + (len(coalesce(params, [])) > 0)::int + (trim(coalesce(returns, '')) <> '')::int n from api_members where kind = 'method')""")
def structured_sufficient(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda c: (F.trim(text_or_empty(c)) != "").cast("int")
    n = ok("summary") + ok("syntax") + F.coalesce((F.size("params") > 0).cast("int"), F.lit(0)) + ok("returns")
    return table(spark, d, "api_members").where("kind = 'method'").select("id", ((n >= 3) & (ok("summary") == 1)).alias("sufficient"))


# extensions of the stream of events: built-in windows
@q("select date_trunc('day', ts)::timestamp as \"day\", event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def tumbling_days(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


@q("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end f from events),
s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, min(ts) start, max(ts) + interval 6 hour as "end", count(*) n from s group by user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


@q("select r_name, n_name, count(*) n, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def region_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@q("select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty, round(avg(l_discount), 6) disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def lineitem_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


@q("""with recursive e as (select distinct from_id a, to_id b from config_relations where from_id is not null and to_id is not null),
w as (select 'DataProcessor.ПланМакетРеестр' node, 0 depth union select b, depth + 1 from w join e on e.a = w.node where depth < 4)
select node, min(depth) depth from w group by 1""")
def reachable_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that the links of one record lead to within four steps, at their least distance."""
    edges = table(spark, d, "config_relations").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    seeds = spark.createDataFrame([("DataProcessor.ПланМакетРеестр",)], "node string")
    return reach(edges, seeds, 4)


@q(None)
def reachable_records_all(spark: SparkSession, d: str) -> DataFrame:
    """All records that the links of one record lead to, however far, at their least distance."""
    edges = table(spark, d, "config_relations").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return reach(edges, spark.createDataFrame([("DataProcessor.ПланМакетРеестр",)], "node string"))


@q("""with recursive w as (select id, title_ru, cast([] as varchar[]) ru from toc_chunks where parent_id = 0 or parent_id not in (select id from toc_chunks)
union all select c.id, c.title_ru, list_append(w.ru, w.title_ru) from toc_chunks c join w on c.parent_id = w.id)
select trim(html_path) as key, arg_min(array_to_string(ru, '/'), w.id) section_path from w join toc_chunks t on t.id = w.id where trim(coalesce(html_path, '')) <> '' group by 1""")
def toc_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section of each page of the contents, by its path."""
    toc = table(spark, d, "toc_chunks")
    pages = toc.select(F.trim("html_path").alias("key")).distinct()
    return page_sections(toc).select("key", "section_path").join(pages, "key", "left_semi")
