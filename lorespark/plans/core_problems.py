"""Queries of the general data-preparation operators: snapshots (p2), hierarchies (p4), dangling references (p6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.canonical import guid
from lorespark.operators.hierarchy import Hierarchy, circular_descendants, descendants
from lorespark.operators.references import dangling_owners, dangling_relations, orphan_report
from lorespark.operators.snapshots import snapshot_changes
from lorespark.plans.tables import table
from lorespark.util.bloom import Bloom
from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "objects"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("config_name", "config_version", "change").agg(F.count("*").alias("n"))


def _catalog_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node, parent, label, rank, loaded_at, tie) of every delivered property, object and configuration."""
    nobody, tie = F.lit(None).cast("string"), F.lit(None).cast("long")
    props = table(spark, d, "catalog_properties").select(guid("ref").alias("node"), guid("owner").alias("parent"), F.col("name").alias("label"), F.lit(2).alias("rank"), "loaded_at", F.col("row_id").alias("tie"))
    objs = table(spark, d, "catalog_objects").select(guid("ref").alias("node"), nobody.alias("parent"), F.col("name").alias("label"), F.lit(1).alias("rank"), "loaded_at", tie.alias("tie"))
    confs = table(spark, d, "crawl_results").select(guid("config_ref").alias("node"), nobody.alias("parent"), F.col("config_name").alias("label"), F.lit(0).alias("rank"), F.col("delivered_at").alias("loaded_at"), tie.alias("tie"))
    return props.unionByName(objs).unionByName(confs)


def _toc_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with both titles as label; parent 0 is the root of all."""
    t = table(spark, d, "toc_chunks")
    return t.select(F.col("id").alias("node"), F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent"), F.struct("title_ru", "title_en").alias("label"))


_LABEL = "struct<title_ru: string, title_en: string>"


def _trees(spark: SparkSession, d: str, scratch: Scratch | None = None, labels: bool = True) -> Hierarchy:
    """Both hierarchies together; a node is `letter|id`, the label of a catalogue node is its name, or null.

    Of a repeated ref the latest delivery counts, a property before an object before a configuration.
    """
    mark = lambda tab, c: F.concat(F.lit(tab + "|"), F.col(c).cast("string")).alias(c)
    rest = ["rank", "loaded_at", "tie"]
    label = F.struct(F.col("label").alias("title_ru"), F.lit(None).cast("string").alias("title_en")) if labels else F.lit(None)
    catalog = _catalog_nodes(spark, d).select(mark("p", "node"), mark("p", "parent"), label.cast(_LABEL).alias("label"), *rest)
    toc = _toc_nodes(spark, d).select(mark("t", "node"), mark("t", "parent"), F.col("label").cast(_LABEL).alias("label"), *[F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in rest])
    return Hierarchy(catalog.unionByName(toc), scratch, [*rest, "label"])


def _tab(node: str) -> tuple[Column, Column]:
    return F.when(F.startswith(F.col(node), F.lit("p|")), "catalog_properties").otherwise("toc_chunks"), F.substr(F.col(node), F.lit(3))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    trees = _trees(spark, d, scratch, labels=False)
    tab, node = _tab("node")
    circular, n = scratch.save_counting(trees.circular().select(tab.alias("tab"), node.alias("node")), all=F.count(F.lit(1)))
    found = circular.where("tab = 'toc_chunks'").select("tab", "node")

    # the refs as they were delivered
    names = circular.where("tab = 'catalog_properties'").select("node")
    refs = table(spark, d, "catalog_properties").select("ref", guid("ref").alias("node"))
    refs = Bloom(names, F.col("node"), n["all"]).filter(refs, F.col("node")).distinct()
    found = found.unionByName(refs.join(names, "node", "left_semi").select(F.lit("catalog_properties").alias("tab"), F.col("ref").alias("node")))

    # paths of the contents only
    topics = table(spark, d, "api_topics").where("toc_id is not null and size(breadcrumb) > 0").select("id", F.col("toc_id").cast("string").alias("node"), "breadcrumb", F.coalesce(F.col("language") == "en", F.lit(False)).alias("en"))
    above = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    toc = trees.resolve(want=F.startswith(F.col("node"), F.lit("t|"))).where("not cyclic")
    titles = toc.select(node.alias("node"), F.transform(above, lambda x: x["label"]["title_ru"]).alias("ru"), F.transform(above, lambda x: x["label"]["title_en"]).alias("titles_en"))
    met = lookup_join(topics, titles, "node")
    right = F.when(F.col("en"), F.col("titles_en")).otherwise(F.col("ru"))
    return found.unionByName(met.where(~F.col("breadcrumb").eqNullSafe(right)).select(F.lit("api_topics").alias("tab"), F.col("id").cast("string").alias("node")))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every node of both hierarchies; nulls for what hangs on a cycle."""
    tab, node = _tab("node")
    path = F.array_join(F.transform("path", lambda x: x["label"]["title_ru"]), "/", "?")
    return _trees(spark, d).resolve().select(tab.alias("tab"), node.alias("node"), _tab("root")[1].alias("root"), "depth", path.alias("path"), "cyclic", "dangling")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, node, distance) of both hierarchies, on and below circles too."""
    scratch = Scratch(spark)
    tab, node = _tab("node")
    trees = scratch.save(_trees(spark, d, scratch, labels=False).resolve())
    return descendants(trees).unionByName(circular_descendants(trees, scratch)).select(tab.alias("tab"), _tab("ancestor")[1].alias("ancestor"), node.alias("node"), "distance")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    a = dangling_relations(table(spark, d, "config_relations"), table(spark, d, "objects"), scratch)
    b = dangling_owners(table(spark, d, "catalog_properties"), table(spark, d, "catalog_objects"), table(spark, d, "crawl_results"), scratch)
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).select("tab", "row_id", "field", "kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_p6(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_summary, p4_found, p4_paths, p4_descendants, p6_found, p6_report)}

_VK = "list_transform(string_split({v}, '.'), lambda x: coalesce(try_cast(x as bigint), 0))"
_GUID = "nullif(nullif(lower(regexp_replace(regexp_replace({v}, '^[\\s{{]+', ''), '[\\s}}]+$', '')), ''), '00000000-0000-0000-0000-000000000000')"


def _guid(v: str) -> str:
    return _GUID.format(v=v)


_P6 = f"""
with o as (select config_name c, id, config_version v, {_VK.format(v="config_version")} vk from objects where id is not null group by all),
r as (select rel_id, 'from_id' field, from_id id, config_name c, config_version v, seen_at from config_relations
      union all select rel_id, 'to_id', to_id, config_name, config_version, seen_at from config_relations),
r2 as (select *, {_VK.format(v="v")} vk from r where id is not null and trim(id) not in ('', '0', '00000000-0000-0000-0000-000000000000')),
agg as (select c, id, min(vk) lo, max(vk) hi from o group by all),
a as (select 'config_relations' tab, rel_id row_id, field, case when lo < r2.vk then 'deleted' when hi > r2.vk then 'later' else 'missing' end kind, seen_at
      from r2 left join agg using (c, id) where not exists (select 1 from o where o.c = r2.c and o.id = r2.id and o.v = r2.v)),
p as (select {_guid("ref")} k, min(loaded_at) first_at from (select ref, loaded_at from catalog_properties union all select ref, loaded_at from catalog_objects) group by 1),
m as (select {_guid("ref")} k, bool_or(deletion_mark) mark from catalog_objects group by 1),
cf as (select distinct {_guid("config_ref")} k from crawl_results),
b as (select 'catalog_properties' tab, row_id, 'owner' field,
        case when p.k is null and cf.k is null then 'missing' when cf.k is not null then null when mark then 'deleted' when first_at > q.loaded_at then 'later' end kind, q.loaded_at seen_at
      from (select row_id, loaded_at, {_guid("owner")} k from catalog_properties) q left join p using (k) left join m using (k) left join cf using (k) where q.k is not null),
f as (select * from a union all select * from b where kind is not null)
"""

# a JSON value as the sorted list of its leaves and containers
_LEAVES = "(select coalesce(string_agg(fullkey || ' ' || type || ' ' || coalesce(atom ->> '$', ''), chr(1) order by fullkey), '') from json_tree(coalesce({a}, '{{}}')))"

_P2 = f"""
with s as (select config_name c, config_version v, row_number() over (partition by config_name order by {_VK.format(v="config_version")}, config_version) o from (select distinct config_name, config_version from objects)),
l as (select config_name c, config_version v, id, arg_max(coalesce(attributes, '{{}}'), delivered_at) a from objects where id is not null group by all),
e as (select c, o, id, {_LEAVES.format(a="a")} a from l join s using (c, v)),
x as (select coalesce(n.c, b.c) c, coalesce(n.o, b.o + 1) o, coalesce(n.id, b.id) id, case when b.id is null then 'added' when n.id is null then 'removed' when n.a <> b.a then 'changed' end change
      from (select * from e where o > 1) n full join (select e.* from e where o < (select max(o) from s where s.c = e.c)) b on n.c = b.c and n.o = b.o + 1 and n.id = b.id)
"""

_P4 = f"""
with recursive pr as (select {_guid("ref")} r, arg_max({_guid("owner")}, (loaded_at, row_id)) o from catalog_properties group by 1),
ob as (select distinct {_guid("ref")} r from catalog_objects), cf as (select distinct {_guid("config_ref")} r from crawl_results),
n as (select r, o from pr union all select r, null from ob where r not in (select r from pr) union all select r, null from cf where r not in (select r from pr) and r not in (select r from ob)),
ok as (select r from n where o is null or o not in (select r from n) union all select n.r from n join ok on n.o = ok.r),
t as (select id, title_ru, title_en, cast([] as varchar[]) ru, cast([] as varchar[]) en from toc_chunks where parent_id = 0 or parent_id is null or parent_id not in (select id from toc_chunks)
      union all select c.id, c.title_ru, c.title_en, list_append(t.ru, t.title_ru), list_append(t.en, t.title_en) from toc_chunks c join t on c.parent_id = t.id)
"""

# nodes of both trees with the latest parent and label
_NODES = f"""pr as (select {_guid("ref")} r, arg_max({{'o': {_guid("owner")}, 'n': name}}, (loaded_at, row_id)) x from catalog_properties where {_guid("ref")} is not null group by 1),
ob as (select {_guid("ref")} r, arg_max({{'n': name}}, (loaded_at, coalesce(name, ''))) x from catalog_objects where {_guid("ref")} is not null group by 1),
cf as (select {_guid("config_ref")} r, arg_max({{'n': config_name}}, (delivered_at, config_name)) x from crawl_results where {_guid("config_ref")} is not null group by 1),
n as (select 'catalog_properties' tab, r, x.o o, x.n nm from pr union all select 'catalog_properties', r, null, x.n from ob where r not in (select r from pr)
union all select 'catalog_properties', r, null, x.n from cf where r not in (select r from pr) and r not in (select r from ob)
union all select 'toc_chunks', cast(id as varchar), cast(nullif(parent_id, 0) as varchar), title_ru from toc_chunks)"""

ORACLE = {
    "p4_paths": f"""with recursive {_NODES},
w as (select tab, r node, r root, 0 as depth, coalesce(nm, '?') as path, o is not null dangling from n where o is null or not exists (select 1 from n m where m.tab = n.tab and m.r = n.o)
union all select n.tab, n.r, w.root, w.depth + 1, w.path || '/' || coalesce(n.nm, '?'), w.dangling from n join w on n.tab = w.tab and n.o = w.node)
select tab, node, root, depth, path, false as cyclic, dangling from w union all select tab, r, null, null, null, true, false from n where not exists (select 1 from w where w.tab = n.tab and w.node = n.r)""",
    "p4_descendants": f"""with recursive {_NODES},
e as (select n.tab, n.r, n.o from n join n m on m.tab = n.tab and m.r = n.o),
w as (select tab, o ancestor, r node, 1 as distance, [r, o] seen from e where o <> r
union all select w.tab, e.o, w.node, w.distance + 1, list_append(w.seen, e.o) from w join e on e.tab = w.tab and e.r = w.ancestor where not list_contains(w.seen, e.o))
select tab, ancestor, node, distance from w""",
    "p2_found": _P2 + "select s.c config_name, s.v config_version, id, change from x join s using (c, o) where change is not null",
    "p2_summary": _P2 + "select s.c config_name, s.v config_version, change, count(*) n from x join s using (c, o) where change is not null group by all",
    "p4_found": _P4
    + f"""select 'catalog_properties' tab, ref node from (select distinct ref from catalog_properties) where {_guid("ref")} not in (select r from ok)
union all select 'toc_chunks', cast(id as varchar) from toc_chunks where id not in (select id from t)
union all select 'api_topics', cast(a.id as varchar) from api_topics a left join t on a.toc_id = t.id where toc_id is not null and len(breadcrumb) > 0 and breadcrumb is distinct from case when language = 'en' then t.en else t.ru end""",
    "p6_found": _P6 + "select tab, row_id, field, kind from f",
    "p6_report": _P6 + "select tab, strftime(seen_at, '%Y-%m') as month, field, kind, count(*) n from f group by all",
}
