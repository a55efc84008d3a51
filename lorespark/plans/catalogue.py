"""Catalogue lookups, exact names, joins between records, merges and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.functions.canonical import guid
from lorespark.functions.text import GLOBAL_OWNERS, contains_any, help_only_bucket, is_stub_path, member_order, text_or_empty, title_rank
from lorespark.functions.versions import version_key
from lorespark.operators import catalog
from lorespark.operators.fusion import places
from lorespark.operators.merge import content_merge, key_changes, signature, to_load
from lorespark.plans._queries import Book
from lorespark.plans.core_problems import _guid
from lorespark.plans.search import CANON, VK
from lorespark.plans.tables import table
from lorespark.util.skew import lookup_join

q = Book()


@q("select ref, name, 0 priority from (select distinct ref, name, description from catalog_objects where description = 'ОбщийКаталог' or name in ('ОбщийКаталог', 'ЧекДоговорЧасть687') or ref = 'x') order by ref limit 20")
def metadata_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "catalog_objects").select("ref", "name", "description").distinct()
    return catalog.exact_lookup(rows, ["ref", "name", "description"], ["ОбщийКаталог", "ЧекДоговорЧасть687"], ["ref"], 20).select("ref", "name", F.lit(0).alias("priority"))


_RANK = "case when {a} = '{q}' or {b} = '{q}' or {c} = '{q}' then 0 when starts_with({a}, '{q}') or starts_with({b}, '{q}') or starts_with({c}, '{q}') then 1 when contains({a}, '{q}') or contains({b}, '{q}') or contains({c}, '{q}') then 2 else 3 end"


def _rank(query: str, *cols: str) -> str:
    a, b, c = [f"lower(coalesce({x}, ''))" for x in cols]
    return _RANK.format(q=query, a=a, b=b, c=c)


@q(f"""select id, config_name, config_version, priority from (select distinct id, name, full_name, config_name, config_version, {_rank('document.ста', 'id', 'name', 'full_name')} priority from objects)
where priority <= 2 order by priority, id, config_name, config_version limit 50""")
def metadata_substring_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "objects").select("id", "name", "full_name", "config_name", "config_version").distinct()
    return catalog.substring_lookup(rows, ["id", "name", "full_name"], "Document.Ста", ["id", "config_name", "config_version"], 50).select("id", "config_name", "config_version", "priority")


@q(f"""with o as (select distinct id, name, full_name from objects), a as (select id, 0 leg from o where id = 'Каталог' or name = 'Каталог' or full_name = 'Каталог' order by id limit 20),
b as (select id, 1 leg from (select id, {_rank('каталог', 'id', 'name', 'full_name')} p from o) where p <= 2 order by p, id limit 20),
u as (select id, leg from a union all select id, leg from b) select distinct id, leg from u where leg = (select min(leg) from u)""")
def metadata_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches if there are any, else by substring."""
    rows = table(spark, d, "objects").select("id", "name", "full_name").distinct()
    exact = catalog.exact_lookup(rows, ["id", "name", "full_name"], ["Каталог"], ["id"], 20).select("id")
    part = catalog.substring_lookup(rows, ["id", "name", "full_name"], "Каталог", ["id"], 20).select("id")
    return catalog.cascade([exact, part]).distinct()


_EXACT = f"""select id, full_name, priority from (
select id, full_name, case when lower(trim(full_name)) = 'стендпериод' then 0 when lower(trim(object_name)) = 'стендпериод' then 1 when list_contains(list_transform(aliases, lambda a: lower(trim(a))), 'стендпериод') then 2 else 3 end priority,
list_transform({VK.format(v='version')}, lambda x: -x) vk, topic_path from api_objects) where priority < 3 order by priority, vk, topic_path, id limit 20"""


@q(_EXACT)
def exact_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Full name, name, alias; newest version first; no fuzzy fallback."""
    name, low = "стендпериод", lambda c: F.lower(F.trim(F.col(c)))
    alias = F.coalesce(F.array_contains(F.transform("aliases", lambda a: F.lower(F.trim(a))), name), F.lit(False))
    priority = F.when(low("full_name") == name, 0).when(low("object_name") == name, 1).when(alias, 2).otherwise(3)
    rows = table(spark, d, "api_objects").select("id", "full_name", priority.alias("priority"), F.transform(version_key("version"), lambda x: -x).alias("vk"), "topic_path")
    return rows.where("priority < 3").orderBy("priority", "vk", "topic_path", "id").limit(20).select("id", "full_name", "priority")


_TR = """case when {t} = '{q}' then 0 when starts_with({t}, '{q} (') or starts_with({t}, '{q} [') or starts_with({t}, '{q} —') or starts_with({t}, '{q}:') then 0
when starts_with({t}, '{q} ') or starts_with({t}, '{q}(') then 1 when starts_with({t}, '{q}') then case when regexp_matches({t}[{n}:], '^[\\p{{L}}\\p{{N}}_]') then 2 else 1 end
when contains({t}, '{q}') then 2 else 3 end"""


def _title_rank(t: str, query: str) -> str:
    return _TR.format(t=t, q=query, n=len(query) + 1)


_TITLE = "lower(trim(coalesce(title, '')))"


@q(f"select id, title, {_title_rank(_TITLE, 'меню')} priority from api_topics where contains({_TITLE}, 'меню')")
def match_priority_rank(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.trim(text_or_empty("title")))
    return table(spark, d, "api_topics").where(F.contains(t, F.lit("меню"))).select("id", "title", title_rank("меню", t).alias("priority"))


@q(f"""with x as (select id, full_name, {_title_rank("lower(trim(coalesce(full_name, '')))", 'слот')} p, lower(coalesce(full_name, '')) fn, lower(coalesce(summary, '') || ' ' || coalesce(description, '')) body,
list_transform({VK.format(v='version')}, lambda x: -x) vk from api_members),
y as (select *, case when p < 3 then 2 when contains(fn, 'слот') then 0 when contains(body, 'слот') then 1 else 2 end c,
case when position('слот' in fn) > 1 and fn[position('слот' in fn) - 1] = '.' then 1 else 0 end m from x)
select id, p priority, c content, m member, row_number() over (order by p, c, m, vk, id) place from y order by place limit 25""")
def structured_sort(spark: SparkSession, d: str) -> DataFrame:
    """Name match, content match, members last for a plain query, newest version, id."""
    name = F.lower(text_or_empty("full_name"))
    p = title_rank("слот", F.trim(name))
    body = F.lower(F.concat(text_or_empty("summary"), F.lit(" "), text_or_empty("description")))
    content = F.when(F.col("priority") < 3, 2).when(F.contains(name, F.lit("слот")), 0).when(F.contains(body, F.lit("слот")), 1).otherwise(2)
    rows = table(spark, d, "api_members").withColumn("priority", p)
    rows = rows.select("id", "priority", content.alias("content"), member_order("слот", name).alias("member"), F.transform(version_key("version"), lambda x: -x).alias("vk"))
    top = rows.orderBy("priority", "content", "member", "vk", "id").limit(25)
    return top.select("id", "priority", "content", "member", F.row_number().over(W.orderBy("priority", "content", "member", "vk", "id")).alias("place"))


@q("""with x as (select item_id, lower(coalesce(title, '')) t, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(code_snippet, ''))) h from skd_composition_result),
y as (select item_id, case when t = 'регистр слой' then 100 when contains(t, 'регистр слой') then 40 else 0 end + 5 * contains(h, 'регистр')::int + 5 * contains(h, 'слой')::int score from x)
select item_id, score from y where score > 0 order by score desc, item_id limit 15""")
def example_lexical_score(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(text_or_empty("title"))
    hay = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in ("title", "description", "code_snippet")]))
    score = F.when(t == "регистр слой", 100).when(F.contains(t, F.lit("регистр слой")), 40).otherwise(0)
    for w in ("регистр", "слой"):
        score = score + F.when(F.contains(hay, F.lit(w)), 5).otherwise(0)
    return table(spark, d, "skd_composition_result").select("item_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "item_id").limit(15)


@q("""with n as (select config_name, config_version, id, min(name) name from objects group by all)
select rel_id, to_id, name target_name, case when name is null then 'raw' else 'structured_topic' end lookup from config_relations r left join n on r.config_name = n.config_name and r.config_version = n.config_version and r.to_id = n.id""")
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Targets of links looked up by name; hot targets are salted."""
    key = lambda i: F.to_json(F.struct(F.col("config_name").alias("a"), F.col("config_version").alias("b"), F.col(i).alias("c")))
    names = table(spark, d, "objects").groupBy(key("id").alias("k")).agg(F.min("name").alias("target_name"))
    links = table(spark, d, "config_relations").select("rel_id", "to_id", F.when(F.col("to_id").isNotNull(), key("to_id")).alias("k"))
    met = lookup_join(links, names, "k")
    return met.select("rel_id", "to_id", "target_name", F.when(F.col("target_name").isNull(), "raw").otherwise("structured_topic").alias("lookup"))


@q(f"""with t as (select {CANON.replace('path', 'html_path')} path, arg_max(title_ru, id) title_ru from toc_chunks where html_path is not null group by 1)
select id, title_ru from (select id, {CANON} path from api_topics) left join t using (path)""")
def toc_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the title of their entry in the contents, the last entry of a path counting."""
    canon = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\\", "/")), r"^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+", "")
    toc = table(spark, d, "toc_chunks").where("html_path is not null").groupBy(canon("html_path").alias("path")).agg(F.max_by("title_ru", "id").alias("title_ru"))
    return table(spark, d, "api_topics").select("id", canon("path").alias("path")).join(toc, "path", "left").select("id", "title_ru")


_BUCKET = """case when contains(p, '/shclang_') or contains(p, '/embedlang') or contains(p, '/shlang_ru/') then 'language' when contains(p, '/tables/') then 'tables' when contains(p, '/forms/') then 'forms'
when contains(p, '/objects/') and not (contains(p, '/methods/') or contains(p, '/properties/') or contains(p, '/events/') or contains(p, '/ctors/')) then 'object_overview'
when contains(p, '/query/') or contains(p, 'queries') or contains(p, '/shquery_ru/') then 'query' when contains(p, '/lang/') then 'language' else 'other_topic' end"""


@q(f"""with t as (select {CANON} p from api_topics), s as (select distinct {CANON.replace('path', 'topic_path')} p from api_objects where topic_path is not null union select distinct {CANON.replace('path', 'html_path')} from toc_chunks where html_path is not null)
select {_BUCKET} bucket, count(*) n from t where not exists (select 1 from s where s.p = t.p) group by 1""")
def help_only_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Pages that neither an object nor the contents name, by bucket."""
    canon = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\\", "/")), r"^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+", "")
    known = table(spark, d, "api_objects").select(canon("topic_path").alias("p")).unionByName(table(spark, d, "toc_chunks").select(canon("html_path").alias("p")))
    only = table(spark, d, "api_topics").select(canon("path").alias("p")).join(known.where("p is not null").distinct(), "p", "left_anti")
    return only.groupBy(help_only_bucket("p").alias("bucket")).agg(F.count("*").alias("n"))


@q("""with c as (select id, md5(coalesce(description, '')) h from api_members where version is not null)
select id from (select id, md5(coalesce(description, '')) h from api_members) t where not exists (select 1 from c where c.id = t.id and c.h = t.h)""")
def cache_changed_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Members that are not marked as indexed (those with a version) with the same digest."""
    m = table(spark, d, "api_members").select("id", F.md5(text_or_empty("description")).alias("digest"), F.col("version").isNotNull().alias("indexed"))
    return to_load(m.select("id", "digest"), m, "id", "digest").select("id")


@q("""with x as (select doc_id, updated_at, version, source from documents), a as (select doc_id, source from x where updated_at < timestamp '2024-03-01'), b as (select doc_id, case when version is null then 'new' else source end source from x where updated_at >= timestamp '2023-06-01')
select coalesce(b.doc_id, a.doc_id) doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.source is distinct from b.source then 'changed' end change
from a full join b on a.doc_id = b.doc_id where change is not null""")
def snapshot_diff_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Two states of a source listing: added, removed, changed."""
    x = table(spark, d, "documents").select("doc_id", "updated_at", "version", "source")
    before = x.where("updated_at < timestamp_ntz '2024-03-01'")
    now = x.where("updated_at >= timestamp_ntz '2023-06-01'").withColumn("source", F.when(F.col("version").isNull(), "new").otherwise(F.col("source")))
    return key_changes(before, now, "doc_id", "source")


@q(f"""with p as (select distinct {_guid('ref')} id, {_guid('owner')} owner from catalog_properties)
select o.ref id, count(p.id) n_children, min(p.id) first_child from (select distinct {_guid('ref')} ref from catalog_objects) o left join p on p.owner = o.ref group by 1""")
def children_index(spark: SparkSession, d: str) -> DataFrame:
    """Children of every object; they are combined by owner before the join, so a hot owner is one row."""
    props = table(spark, d, "catalog_properties").select(guid("ref").alias("id"), guid("owner").alias("owner")).distinct()
    kids = props.where("owner is not null").groupBy("owner").agg(F.count("id").alias("n"), F.min("id").alias("first_child"))
    objects = table(spark, d, "catalog_objects").select(guid("ref").alias("owner")).distinct()
    return objects.join(kids, "owner", "left").select(F.col("owner").alias("id"), F.coalesce("n", F.lit(0)).alias("n_children"), "first_child")


_FR = "case when n = 'слой' or s = 'слой' then 0 when starts_with(n, 'слой') or starts_with(s, 'слой') then 1 when contains(n, 'слой') or contains(s, 'слой') then 2 else 3 end"


@q(f"""with o as (select {_guid('ref')} k, min(name) object_name from catalog_objects where contains(lower(name), 'договор') group by 1),
f as (select row_id, {_guid('owner')} k, lower(coalesce(name, '')) n, lower(coalesce(synonym, '')) s, name from catalog_properties)
select row_id, object_name, name, {_FR} priority from f join o using (k) where {_FR} <= 2""")
def object_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields by name under the objects by name; hot owners are salted."""
    o = table(spark, d, "catalog_objects").where(F.contains(F.lower("name"), F.lit("договор"))).groupBy(guid("ref").alias("k")).agg(F.min("name").alias("object_name"))
    f = table(spark, d, "catalog_properties").select("row_id", guid("owner").alias("k"), "name", "synonym").withColumn("priority", catalog.match_priority([F.col("name"), F.col("synonym")], ["слой"])).where("priority <= 2")
    return lookup_join(f, o, "k", "inner").select("row_id", "object_name", "name", "priority")


@q(f"""with k as (select {_guid('ref')} k from catalog_objects union select {_guid('ref')} from catalog_properties union select {_guid('config_ref')} from crawl_results)
select 'owner' field, count(o) n_refs, count(k) n_found, count(o) - count(k) n_missing from (select {_guid('owner')} o from catalog_properties) left join k on o = k
union all select 'parent', count(o), count(k), count(o) - count(k) from (select {_guid('parent')} o from catalog_properties) left join k on o = k""")
def owner_miss_counts(spark: SparkSession, d: str) -> DataFrame:
    props = table(spark, d, "catalog_properties")
    known = table(spark, d, "catalog_objects").select(guid("ref").alias("k")).unionByName(props.select(guid("ref").alias("k"))).unionByName(table(spark, d, "crawl_results").select(guid("config_ref").alias("k"))).distinct()
    refs = props.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), guid(f).alias("k")) for f in ("owner", "parent")])).alias("e")).select("e.*").where("k is not null")
    # counted per value first, so that the join sees each value once
    per = refs.groupBy("field", "k").agg(F.count("*").alias("n")).join(known.withColumn("found", F.lit(True)), "k", "left")
    return per.groupBy("field").agg(F.sum("n").alias("n_refs"), F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0)).alias("n_found"), F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))


@q("""select kind, count(*) n, count(*) filter (len(types) > 1) n_multi, count(*) filter (len(types) = 0) n_untyped, round(100.0 * count(*) filter (indexing) / count(*), 1) indexed_pct, count(distinct ref) n_refs from catalog_properties group by 1""")
def export_profile(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "catalog_properties")
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size("types") > 1).alias("n_multi"), F.count_if(F.size("types") == 0).alias("n_untyped"), F.round(F.lit(100.0) * F.count_if(F.col("indexing")) / F.count("*"), 1).alias("indexed_pct"), F.count_distinct("ref").alias("n_refs"))


@q("""with h as (select coalesce(language, '') lang, lower(trim(coalesce(full_name, ''))) fn, coalesce(kind, '') kind, version v, versions vs, id from api_members)
select lang as language, fn, kind, count(*) n, max(id) last_id from h group by all""")
def content_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many records each name and kind has, and the last of them."""
    m = table(spark, d, "api_members")
    return m.groupBy(text_or_empty("language").alias("language"), F.lower(F.trim(text_or_empty("full_name"))).alias("fn"), text_or_empty("kind").alias("kind")).agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


_NL = r"trim(array_to_string(list_transform(string_split(replace(replace(coalesce({f}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), chr(10) || chr(9) || chr(12) || ' ')"
_CH = "sha256('{\"description\":' || to_json(" + _NL.format(f="description") + ") || ',\"full_name\":' || to_json(" + _NL.format(f="full_name") + ") || '}')"


@q(f"""with x as (select coalesce(language, '') lang, {_CH} h, id, case when len(versions) > 0 then versions else [version] end vs from api_members),
v as (select lang, h, trim(u) u from (select lang, h, unnest(vs) u from x) where trim(coalesce(u, '')) <> '' group by all),
n as (select lang, h, array_to_string(list(u order by {VK.format(v='u')} desc, u desc), ',') versions from v group by 1, 2),
c as (select lang, h, count(*) n, max(id) last_id from x group by 1, 2)
select cast(('0x' || sha256('member|' || lang || '|' || h)[1:14]) as bigint) id, lang as language, h content_hash, coalesce(versions, '') versions, n, last_id from c left join n using (lang, h)""")
def content_hash_merge(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "api_members").withColumn("rec_id", F.col("id"))
    out = content_merge(m.select("language", "full_name", "description", "version", "versions", "id"), "language", ["description", "full_name"], "version", "versions", "member", F.col("id"))
    last = content_merge_last(m)
    return out.select("id", "language", "content_hash", F.coalesce(F.array_join("versions", ","), F.lit("")).alias("versions"), "n").join(last, ["language", "content_hash"])


def content_merge_last(m: DataFrame) -> DataFrame:
    """The key of the record that wrote last, per language and content."""
    from lorespark.operators.merge import content_hash

    return m.groupBy(text_or_empty("language").alias("language"), content_hash(m, ["description", "full_name"]).alias("content_hash")).agg(F.max("id").alias("last_id"))


@q("""with l as (select doc_id || ':' || coalesce(n_chars, 0) line from documents), b as (select sha256(line)[1:3] bucket, sha256(string_agg(line, chr(10) order by line)) h from l group by 1)
select sha256(coalesce(string_agg(h, chr(10) order by bucket), '')) digest from b""")
def folder_signature(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    return signature(x, "path", "size")


@q("""with x as (select lower(regexp_replace(full_name, '\\s', '', 'g')) k, trim(version) v, max(description) t from api_members where full_name is not null group by 1, 2)
select coalesce(a.k, b.k) k, case when a.k is null then 'right_only' when b.k is null then 'left_only' when a.t is distinct from b.t then 'differs' else 'same' end state
from (select * from x where v = '8.3.20.2290') a full join (select * from x where v = '8.3.25.1546') b on a.k = b.k""")
def compare_versions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "api_members").where("full_name is not null")
    x = m.groupBy(F.lower(F.regexp_replace("full_name", r"\s", "")).alias("k"), F.trim("version").alias("v")).agg(F.max("description").alias("t"))
    a, b = x.where("v = '8.3.20.2290'").select(F.col("k").alias("ka"), F.col("t").alias("ta")), x.where("v = '8.3.25.1546'").select(F.col("k").alias("kb"), F.col("t").alias("tb"))
    met = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    state = F.when(F.col("ka").isNull(), "right_only").when(F.col("kb").isNull(), "left_only").when(~F.col("ta").eqNullSafe(F.col("tb")), "differs").otherwise("same")
    return met.select(F.coalesce("ka", "kb").alias("k"), state.alias("state"))


@q("select id, path, title from api_topics where language = 'ru' and entity_type = 'method' and trim(version) = '8.3.20.2290'")
def table_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").where("language = 'ru' and entity_type = 'method' and trim(version) = '8.3.20.2290'").select("id", "path", "title")


@q("select path, min(title) title from (select path, arg_min(title, id) title from api_topics where starts_with(lower(path), 'hclient') group by 1) group by 1 order by path limit 200")
def prefix_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "api_topics").where(F.startswith(F.lower("path"), F.lit("hclient")))
    return t.groupBy("path").agg(F.min_by("title", "id").alias("title")).orderBy("path").limit(200)


@q("select trim(path) path, arg_min(coalesce(title, ''), id) title, arg_min(coalesce(array_to_string(breadcrumb, '/'), ''), id) breadcrumb from api_topics where trim(coalesce(path, '')) <> '' group by 1 order by 1 limit 5000")
def nav_items(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "api_topics").select("id", F.trim("path").alias("path"), text_or_empty("title").alias("title"), F.coalesce(F.array_join("breadcrumb", "/"), F.lit("")).alias("breadcrumb")).where("path <> ''")
    return t.groupBy("path").agg(F.min_by("title", "id").alias("title"), F.min_by("breadcrumb", "id").alias("breadcrumb")).orderBy("path").limit(5000)


@q("select id, path from api_topics where path in ('hclient_ru/events_/cat230/StockLabelNaive163', 'hclient_ru/events_/cat230/StockLabelNaive163.md', 'hclient_ru/events_/cat230/StockLabelNaive163.html')")
def point_lookup_path(spark: SparkSession, d: str) -> DataFrame:
    p = "hclient_ru/events_/cat230/StockLabelNaive163"
    return table(spark, d, "api_topics").where(F.col("path").isin(p, p + ".md", p + ".html")).select("id", "path")


@q("select id, config_version, name from objects where config_name = 'УчетСмен' and id = 'Document.КурсНовыйВременный' order by delivered_at desc, config_version limit 1")
def point_lookup_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "objects").where("config_name = 'УчетСмен' and id = 'Document.КурсНовыйВременный'").orderBy(F.desc("delivered_at"), "config_version").limit(1).select("id", "config_version", "name")


_STUB = "(contains(lower(path), '/methods/') or contains(lower(path), '/properties/') or contains(lower(path), '/constructors/'))"


@q(f"select id, row_number() over (order by {_STUB}, id) place from (select * from api_topics where path is not null order by id limit 100)")
def stub_partition(spark: SparkSession, d: str) -> DataFrame:
    """A hit list (the first 100 by id) with the pages of members moved to the end."""
    hits = table(spark, d, "api_topics").where("path is not null").orderBy("id").limit(100)
    return hits.select("id", F.row_number().over(W.orderBy(is_stub_path("path"), "id")).alias("place"))


@q(f"select id, row_number() over (order by {_STUB}, id) place from api_topics where path is not null")
def stub_partition_all(spark: SparkSession, d: str) -> DataFrame:
    """All pages with the pages of members moved to the end."""
    pages = table(spark, d, "api_topics").where("path is not null").select("id", is_stub_path("path").alias("stub"))
    return places(pages, ["stub", "id"]).select("id", "place")


@q(f"""select id, path, p priority from (select id, path, {_STUB} stub, case when lower(trim(coalesce(title, ''))) = 'каталог' and (contains(path, '.html') or contains(path, '.md')) then 0
when lower(trim(coalesce(title, ''))) <> 'untitled' and (contains(path, '.html') or contains(path, '.md')) then 1 when lower(trim(coalesce(title, ''))) <> 'untitled' then 2 else 3 end p
from api_topics where contains(lower(coalesce(title, '')), 'каталог') and trim(coalesce(path, '')) <> '') order by p, stub, id limit 1""")
def compare_best_path(spark: SparkSession, d: str) -> DataFrame:
    title = F.lower(F.trim(text_or_empty("title")))
    page = contains_any(F.col("path"), [".html", ".md"])
    p = F.when((title == "каталог") & page, 0).when((title != "untitled") & page, 1).when(title != "untitled", 2).otherwise(3)
    t = table(spark, d, "api_topics").where(F.contains(title, F.lit("каталог")) & (F.trim(text_or_empty("path")) != ""))
    return t.select("id", "path", p.alias("priority"), is_stub_path("path").alias("stub")).orderBy("priority", "stub", "id").limit(1).drop("stub")


@q(f"""with p as (select distinct {_guid('ref')} r, {_guid('owner')} o, {_guid('parent')} pa, kind, name from catalog_properties), c as (select {_guid('ref')} o, min(name) object_name from catalog_objects group by 1)
select object_name, p.name section, count(f.r) n_fields from p join c on p.o = c.o left join p f on f.pa = p.r and f.kind = 'Реквизит' where p.kind = 'ТабличнаяЧасть' group by p.r, p.name, object_name""")
def owner_field_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Tabular sections under their objects with the number of their fields."""
    p = table(spark, d, "catalog_properties").select(guid("ref").alias("r"), guid("owner").alias("k"), guid("parent").alias("pa"), "kind", "name").distinct()
    objects = table(spark, d, "catalog_objects").groupBy(guid("ref").alias("k")).agg(F.min("name").alias("object_name"))
    fields = p.where("kind = 'Реквизит' and pa is not null").groupBy(F.col("pa").alias("r")).agg(F.count("r").alias("n"))
    sections = lookup_join(p.where("kind = 'ТабличнаяЧасть'"), objects, "k", "inner").join(fields, "r", "left")
    return sections.groupBy("r", "name", "object_name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_fields")).select("object_name", F.col("name").alias("section"), "n_fields")


@q("""select row_id, coalesce(nullif(trim(name), ''), trim(description), '') as name, coalesce(trim(synonym), '') as synonym, coalesce(indexing, false) as indexing, case when string_length > 0 then string_length end length_limit,
case when number_length > 0 or number_precision > 0 then number_length || ',' || number_precision end as "precision", nullif(trim(coalesce(types_as_string, '')), '') defined_type, coalesce(types[1], '') as type from catalog_properties""")
def field_struct(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "catalog_properties")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return p.select(
        "row_id", F.coalesce(blank("name"), F.trim("description"), F.lit("")).alias("name"), F.coalesce(F.trim("synonym"), F.lit("")).alias("synonym"), F.coalesce("indexing", F.lit(False)).alias("indexing"),
        F.when(F.col("string_length") > 0, F.col("string_length")).alias("length_limit"),
        F.when((F.col("number_length") > 0) | (F.col("number_precision") > 0), F.concat_ws(",", F.col("number_length").cast("string"), F.col("number_precision").cast("string"))).alias("precision"),
        blank("types_as_string").alias("defined_type"), F.coalesce(F.get("types", 0), F.lit("")).alias("type"),
    )


@q("select ref, config_name, row_number() over (order by ref, config_name) place from (select ref, config_name, min(loaded_at) from catalog_objects where ref <> '' group by 1, 2 order by ref, config_name limit 50)")
def first_wins_distinct(spark: SparkSession, d: str) -> DataFrame:
    one = catalog.first_wins(table(spark, d, "catalog_objects").where("ref <> ''"), ["ref", "config_name"], F.col("loaded_at"))
    top = one.orderBy("ref", "config_name").limit(50)
    return top.select("ref", "config_name", F.row_number().over(W.orderBy("ref", "config_name")).alias("place"))


@q("select full_name, arg_max(id, (loaded_at, id)) id from api_objects group by 1")
def last_wins_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_objects").groupBy("full_name").agg(F.max_by("id", F.struct("loaded_at", "id")).alias("id"))


@q("""with e as (select distinct from_id, to_id, relation_type, config_name, config_version from config_relations where from_id is not null and to_id is not null and to_id <> ''),
s as (select * from e where from_id = 'DataProcessor.ПланМакетРеестр') select to_id, min(relation_type) relation_type from s group by 1""")
def related_records(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the links of one record, each once."""
    e = table(spark, d, "config_relations").where("from_id = 'DataProcessor.ПланМакетРеестр' and to_id <> ''")
    return e.groupBy("to_id").agg(F.min("relation_type").alias("relation_type"))


@q("""select distinct from_id, to_id from config_relations r where to_id <> '' and from_id is not null and not exists (select 1 from objects o where o.id = r.to_id and o.config_name = r.config_name)""")
def unresolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Links whose target the configuration never held, each pair once; links are made distinct before the anti join."""
    links = table(spark, d, "config_relations").where("to_id <> '' and from_id is not null").select("from_id", F.col("to_id").alias("id"), "config_name").distinct()
    known = table(spark, d, "objects").select("id", "config_name").distinct()
    return links.join(known, ["id", "config_name"], "left_anti").select("from_id", F.col("id").alias("to_id")).distinct()


@q("""with o as (select lower(object_name) n, id from api_objects), m as (select lower(owner_name) o, id from api_members)
select m.id member_id, o.id object_id from m join o on m.o = o.n""")
def owner_members(spark: SparkSession, d: str) -> DataFrame:
    """Members with the objects that own them."""
    o = table(spark, d, "api_objects").select(F.lower("object_name").alias("o"), F.col("id").alias("object_id"))
    m = table(spark, d, "api_members").select(F.lower("owner_name").alias("o"), F.col("id").alias("member_id"))
    return m.join(o, "o").select("member_id", "object_id")


@q(f"select id, lower(owner_name) in ({', '.join(repr(x) for x in GLOBAL_OWNERS)}) global_owner from api_members where owner_name is not null")
def global_owner_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").where("owner_name is not null").select("id", F.lower("owner_name").isin(GLOBAL_OWNERS).alias("global_owner"))
