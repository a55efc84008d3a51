"""Keyword, vector and fused search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.functions.text import any_of, code_blocks, contains_any, keyword_tokens, keywords, text_or_empty, tokens
from lorespark.functions.versions import version_key, version_matches
from lorespark.operators import bm25
from lorespark.operators.catalog import cascade
from lorespark.operators.dense import knn
from lorespark.operators.fusion import best_per, quota_candidates, quotas, ranked, rrf
from lorespark.plans._queries import Book
from lorespark.plans.tables import table

q = Book()
QUERY = "складской регистр catalog period"
TERMS = bm25.query_terms(QUERY)

# the oracle's pieces
TOK = "list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[а-яёА-ЯЁa-zA-Z0-9]+'), lambda t: length(t) >= 2)"
VK = "(case when trim(coalesce({v}, '')) = '' then cast([] as bigint[]) else list_transform(string_split(trim({v}), '.'), lambda x: coalesce(try_cast(trim(x) as bigint), 0)) end)"
T = TOK.format(x="text")
STATS = f"t as (select doc_id, {T} t, len({T}) dl from documents), s as (select count(*) n, sum(dl) sum_dl, sum(dl) / count(*) avgdl from t)"
TF = "p as (select doc_id, dl, term, count(*) tf from (select doc_id, dl, unnest(t) term from t) group by all)"
WEIGHT = "round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6)"
IDF = "round(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)), 6)"
IN = ", ".join(f"'{t}'" for t in TERMS)
SCORED = f"""{STATS}, {TF}, d as (select term, count(*) df from p group by 1),
h as (select doc_id, round(sum({WEIGHT}::double * {IDF}), 6) score from p join d using (term), s where term in ({IN}) group by 1)"""


@q(f"with {STATS}, {TF} select n n_docs, (select count(distinct term) from p) n_terms, cast(sum_dl as bigint) sum_dl, round(avgdl, 6) avgdl from s")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats()


def _index(spark: SparkSession, d: str) -> bm25.Index:
    return bm25.index_of(table(spark, d, "documents"), "doc_id", "text")


@q(f"with {STATS}, {TF} select doc_id, term, {WEIGHT} weight from p, s")
def bm25_doc_weights(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).weights()


@q(f"with {STATS}, {TF}, d as (select term, count(*) df from p group by 1) select term, df, {IDF} idf from d, s")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).idf()


@q(f"with {SCORED} select doc_id, score from h order by score desc, doc_id limit 10")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(QUERY)


@q("""select doc_id from (select doc_id, regexp_extract_all(coalesce(text, ''), '[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]{2,}') k from documents)
where list_has_any(k, ['регистр', 'catalog', 'Запрос'])""")
def keyword_overlap_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one of the identifiers, letter case counting."""
    found = F.regexp_extract_all(text_or_empty("text"), F.lit("[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]{2,}"), F.lit(0))
    return table(spark, d, "documents").where(F.arrays_overlap(found, F.array(*map(F.lit, ["регистр", "catalog", "Запрос"])))).select("doc_id")


@q("select id, title from api_topics where contains(lower(coalesce(title, '')), 'каталог') or contains(lower(coalesce(text, '')), 'каталог')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    low = [F.lower(text_or_empty(c)) for c in ("title", "text")]
    return table(spark, d, "api_topics").where(any_of([F.contains(c, F.lit("каталог")) for c in low])).select("id", "title")


_TT = TOK.format(x="text")


@q(f"""with t as (select id, title, {_TT} t from api_topics), s as (select count(*) n, avg(len(t)) avgdl from t),
p as (select id, title, len(t) dl, len(list_filter(t, lambda x: x = 'каталог')) tf from t),
h as (select id, title, round({WEIGHT} * {IDF}, 6) score from p, s, (select count(*) df from p where tf > 0) where tf > 0 order by score desc, id limit 15)
select id, title, score, row_number() over (order by not contains(lower(coalesce(title, '')), 'каталог'), score desc, id) place from h""")
def title_boost_search(spark: SparkSession, d: str) -> DataFrame:
    """Top 15 by BM25; hits with the query in the title are then moved to the front."""
    hits = bm25.search(table(spark, d, "api_topics"), "id", "text", "каталог", 15, ["title"])
    boosted = F.contains(F.lower(text_or_empty("title")), F.lit("каталог"))
    return hits.withColumn("place", F.row_number().over(W.orderBy(~boosted, F.desc("score"), "id")))


def _query_vector(e: DataFrame) -> list[float]:
    """The vector of one row as the query; it is a parameter of the search, so it is read beforehand."""
    row = e.where("vec_id = 0").select("embedding").first()
    return list(row.embedding) if row else []


COS = "round(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 6)"


@q(f"select vec_id, {COS} score from embeddings order by score desc, vec_id limit 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return knn(e, "vec_id", "embedding", _query_vector(e))


@q(f"select vec_id, label, {COS} score from embeddings where label = 3 order by score desc, vec_id limit 10")
def knn_filtered_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return knn(e.where("label = 3"), "vec_id", "embedding", _query_vector(e), keep=["label"])


def _legs(spark: SparkSession, d: str, n_dense: int, n_sparse: int) -> tuple[DataFrame, DataFrame]:
    """Dense and keyword leg; vec_id + 100000 stands in for doc_id."""
    e = table(spark, d, "embeddings")
    dense = knn(e, "vec_id", "embedding", _query_vector(e), n_dense).select((F.col("vec_id") + 100000).alias("doc_id"), "score")
    sparse = _index(spark, d).search(QUERY, n_sparse)
    return ranked(dense, "doc_id", F.desc("score"), F.col("doc_id")), ranked(sparse, "doc_id", F.desc("score"), F.col("doc_id"))


def _legs_sql(n_dense: int, n_sparse: int) -> str:
    return f"""{SCORED}, a as (select vec_id + 100000 doc_id, {COS} score from embeddings order by score desc, vec_id limit {n_dense}),
b as (select doc_id, score from h order by score desc, doc_id limit {n_sparse}),
l as (select doc_id, row_number() over (order by score desc, doc_id) rank, 1 leg from a union all select doc_id, row_number() over (order by score desc, doc_id) rank, 2 leg from b),
f as (select doc_id, round(sum(1 / (60 + rank)), 9) rrf, max(leg = 2) keyword from l group by 1)"""


@q(f"with {_legs_sql(20, 15)} select doc_id, rrf from f order by rrf desc, doc_id limit 10")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return rrf(list(_legs(spark, d, 20, 15)), "doc_id").orderBy(F.desc("rrf"), "doc_id").limit(10)


@q(f"with {_legs_sql(15, 15)} select doc_id, source, rrf from f join documents using (doc_id) where source like 'standards%' or source like 'h%' order by rrf desc, doc_id limit 5")
def rrf_memory_with_domain(spark: SparkSession, d: str) -> DataFrame:
    fused = rrf(list(_legs(spark, d, 15, 15)), "doc_id")
    docs = table(spark, d, "documents").where("source like 'standards%' or source like 'h%'").select("doc_id", "source")
    return docs.join(F.broadcast(fused), "doc_id").select("doc_id", "source", "rrf").orderBy(F.desc("rrf"), "doc_id").limit(5)


@q(f"""with {STATS}, {TF}, d as (select term, count(*) df from p group by 1), w as (select doc_id, term, {WEIGHT} w from p, s where term in ({IN})),
r as (select doc_id, term, row_number() over (partition by term order by w desc, doc_id) rank from w)
select doc_id, round(sum(1 / (60 + rank)), 9) rrf from r where rank <= 5 group by 1 order by rrf desc, doc_id limit 10""")
def rrf_multi_token(spark: SparkSession, d: str) -> DataFrame:
    """Each term is a leg of its own with its five best documents."""
    index = _index(spark, d)
    hits = index.hits(TERMS).select("doc_id", "term", bm25.doc_weight(F.col("tf"), F.col("dl"), F.lit(index.avgdl)).alias("w"))
    best = hits.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy(F.desc("w"), "doc_id"))).where("rank <= 5")
    return rrf([best.select("doc_id", "rank")], "doc_id").orderBy(F.desc("rrf"), "doc_id").limit(10)


CANON = r"regexp_replace(lower(replace(path, '\', '/')), '^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+', '')"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Topics with a path free of version folders; the length of the text stands in for the score."""
    t = table(spark, d, "api_topics")
    path = F.regexp_replace(F.lower(F.regexp_replace("path", r"\\", "/")), r"^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+", "")
    return t.select("id", path.alias("path"), "version", version_key("version").alias("vk"), F.coalesce(F.length("text"), F.lit(0)).alias("score"))


_PATHS = f"x as (select id, {CANON} path, version, {VK.format(v='version')} vk, coalesce(length(text), 0) score from api_topics)"


def _best_sql(order: str) -> str:
    return f"with {_PATHS} select id, path, version, score from (select *, row_number() over (partition by path order by {order}) rn from x where trim(coalesce(path, '')) <> '') where rn = 1"


@q(_best_sql("vk desc, score desc, id"))
def best_per_path_newest(spark: SparkSession, d: str) -> DataFrame:
    return best_per(_paths(spark, d), "path", F.desc("vk"), F.desc("score"), F.col("id")).select("id", "path", "version", "score")


@q(_best_sql("score desc, vk desc, id"))
def best_per_path_score(spark: SparkSession, d: str) -> DataFrame:
    return best_per(_paths(spark, d), "path", F.desc("score"), F.desc("vk"), F.col("id")).select("id", "path", "version", "score")


@q(_best_sql("vk desc, id"))
def fallback_latest(spark: SparkSession, d: str) -> DataFrame:
    return best_per(_paths(spark, d), "path", F.desc("vk"), F.col("id")).select("id", "path", "version", "score")


@q(f"""with x as (select id, full_name, version, versions, {VK.format(v="version")} vk from api_members order by length(coalesce(description, '')) desc, id limit 40)
select id, full_name from x where trim(version) = '8.3.20.2290' or list_contains(versions, '8.3.20.2290')""")
def version_membership_topk(spark: SparkSession, d: str) -> DataFrame:
    """The filter on versions comes after the top 40, so fewer rows may be left."""
    m = table(spark, d, "api_members")
    top = m.orderBy(F.desc(F.length(text_or_empty("description"))), "id").limit(40)
    return top.where(version_matches(F.trim("version"), F.col("versions"), "8.3.20.2290")).select("id", "full_name")


@q("""select item_id from (select item_id, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(code_snippet, ''))) h from skd_composition_result)
where contains(h, 'регистр') or contains(h, 'запрос')""")
def any_token_match(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in ("title", "description", "code_snippet")]))
    return table(spark, d, "skd_composition_result").where(contains_any(hay, ["регистр", "запрос"])).select("item_id")


_KT = r"""with w as (select id, list_distinct(list_filter(regexp_extract_all(coalesce(title, ''), '[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*\.[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*'), lambda t: length(t) >= 5)) a,
list_filter(regexp_extract_all(coalesce(title, ''), '[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*'), lambda t: length(t) >= 3) b from api_topics),
f as (select id, lower(x) l, min(p) p, arg_min(x, p) x from (select id, unnest(b) x, generate_subscripts(b, 1) p from w) group by 1, 2),
g as (select id, list(x order by p) b from f group by 1)
select w.id, array_to_string((a || coalesce(g.b, []))[:8], ' ') tokens from w left join g using (id)"""


@q(_KT)
def keyword_tokens_of_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").select("id", F.array_join(keyword_tokens("title"), " ").alias("tokens"))


def _memory_sql(limits: list[tuple[str, int]], total: int, rows: int) -> str:
    quota = " ".join(f"when domain = '{k}' then {n}" for k, n in limits)
    group = " ".join(f"when domain = '{k}' then {i}" for i, (k, _) in enumerate(limits))
    return f"""m as (select item_id, coalesce(title, '') title, coalesce(type, '') domain, row_number() over (order by item_id) pos from skd_composition_result order by item_id limit {rows}),
a as (select *, row_number() over (partition by domain order by pos) <= case {quota} else 0 end inn from m),
b as (select *, case when inn then case {group} else {len(limits)} end else {len(limits)} end grp from a),
c as (select *, row_number() over (partition by title, domain order by grp, pos) f from b),
e as (select item_id, title, domain, pos, row_number() over (order by grp, pos) place from c where inn or f = 1 qualify place <= {total})"""


def _memory(spark: SparkSession, d: str, rows: int) -> DataFrame:
    m = table(spark, d, "skd_composition_result").select("item_id", text_or_empty("title").alias("title"), text_or_empty("type").alias("domain"), text_or_empty("description").alias("description"), text_or_empty("code_snippet").alias("code_snippet"))
    return m.orderBy("item_id").limit(rows).withColumn("pos", F.row_number().over(W.orderBy("item_id")))


@q(f"with {_memory_sql([('reference', 2), ('snippet', 2), ('', 1)], 6, 60)} select item_id, domain, place from e")
def domain_quota(spark: SparkSession, d: str) -> DataFrame:
    return quotas(_memory(spark, d, 60), "domain", "pos", "title", {"reference": 2, "snippet": 2, "": 1}, 6).select("item_id", "domain", "place")


_LIMITS = {"reference": 2, "snippet": 2, "": 1}


def _memory_all_sql(total: int) -> str:
    return _memory_sql(list(_LIMITS.items()), total, 60).replace(" order by item_id limit 60)", ")")


def _shown(spark: SparkSession, d: str, total: int, limits: dict[str, int] = _LIMITS) -> DataFrame:
    m = table(spark, d, "skd_composition_result").select("item_id", text_or_empty("title").alias("title"), text_or_empty("type").alias("domain"), text_or_empty("description").alias("description"), text_or_empty("code_snippet").alias("code_snippet"))
    return quotas(quota_candidates(m, "domain", "item_id", "title", limits, total), "domain", "item_id", "title", limits, total)


@q(f"with {_memory_all_sql(6)} select item_id, domain, place from e")
def domain_quota_all(spark: SparkSession, d: str) -> DataFrame:
    """Six by quota out of the whole table."""
    return _shown(spark, d, 6).select("item_id", "domain", "place")


@q(f"""with {_memory_sql([('reference', 2), ('snippet', 2), ('', 1)], 3, 60)},
k as (select item_id, place, contains(lower(concat_ws(' ', e.title, coalesce(s.description, ''), coalesce(code_snippet, ''))), 'склад') hit from e join skd_composition_result s using (item_id))
select item_id, place from k where case when (select bool_or(hit) from k) then hit else place <= 2 end""")
def code_answer_quota(spark: SparkSession, d: str) -> DataFrame:
    """Without help hits: three by quota, of these the ones that hold a query token, else the first two."""
    shown = quotas(_memory(spark, d, 60), "domain", "pos", "title", {"reference": 2, "snippet": 2, "": 1}, 3)
    hay = F.lower(F.concat_ws(" ", "title", "description", "code_snippet"))
    marked = shown.withColumn("hit", F.contains(hay, F.lit("склад"))).withColumn("any", F.max("hit").over(W.partitionBy()))
    return marked.where(F.when(F.col("any"), F.col("hit")).otherwise(F.col("place") <= 2)).select("item_id", "place")


@q(f"""with {_memory_all_sql(3)},
k as (select item_id, place, contains(lower(concat_ws(' ', e.title, coalesce(s.description, ''), coalesce(code_snippet, ''))), 'склад') hit from e join skd_composition_result s using (item_id))
select item_id, place from k where case when (select bool_or(hit) from k) then hit else place <= 2 end""")
def code_answer_quota_all(spark: SparkSession, d: str) -> DataFrame:
    """As code_answer_quota, out of the whole table."""
    hay = F.lower(F.concat_ws(" ", "title", "description", "code_snippet"))
    marked = _shown(spark, d, 3).withColumn("hit", F.contains(hay, F.lit("склад"))).withColumn("any", F.max("hit").over(W.partitionBy()))
    return marked.where(F.when(F.col("any"), F.col("hit")).otherwise(F.col("place") <= 2)).select("item_id", "place")


_WITH_HELP = {"reference": 1, "snippet": 1, "": 0}


@q(f"""with {_memory_sql(list(_WITH_HELP.items()), 2, 60).replace(" order by item_id limit 60)", ")")}
select item_id, place from e join skd_composition_result s using (item_id) where contains(lower(concat_ws(' ', e.title, coalesce(s.description, ''), coalesce(code_snippet, ''))), 'склад')""")
def code_answer_with_help(spark: SparkSession, d: str) -> DataFrame:
    """With help hits: two by quota out of the whole table, of these only the ones that hold a query token."""
    hay = F.lower(F.concat_ws(" ", "title", "description", "code_snippet"))
    return _shown(spark, d, 2, _WITH_HELP).where(F.contains(hay, F.lit("склад"))).select("item_id", "place")


def _section(name: str, tab: str, key: str, text: str, limit: int, terms: list[str], filters: str = "true") -> str:
    t = TOK.format(x=text)
    return f"""select '{name}' section, id, score, row_number() over (order by score desc, id) place from (
select id, round(sum({WEIGHT} * {IDF}), 6) score from (
  select *, sum(1) over (partition by term) df from (
    select {key} id, term, len(t) dl, len(list_filter(t, lambda x: x = term)) tf, avg(len(t)) over (partition by term) avgdl, count(*) over (partition by term) n
    from (select {key}, {t} t from {tab} where {filters}), (select unnest({terms!r}) term)) where tf > 0)
group by id order by score desc, id limit {limit})"""


#: Sections of the search over everything: table, key, text, hits shown for a limit of n.
SECTIONS = {
    "members": ("api_members", "id", "description", lambda n: n),
    "objects": ("api_objects", "id", "description", lambda n: max(3, min(n, 6, max(4, n // 2)))),
    "examples": ("skd_composition_result", "item_id", "description", lambda n: max(2, min(n, 4))),
    "topics": ("api_topics", "id", "text", lambda n: max(4, min(n, 8))),
}


def search_sections(spark: SparkSession, d: str, query: str, limit: int = 10, version: str | None = None, language: str | None = None, examples: bool = True) -> DataFrame:
    """(section, id, score, place): the best members, objects and examples; topics only if none of these has a hit.

    version keeps records of this version or with it among their versions, language the records of that language; examples
    have neither.
    """
    legs = {}
    for name, (tab, key, text, most) in SECTIONS.items():
        rows = table(spark, d, tab)
        if version and "version" in rows.columns:
            rows = rows.where(version_matches(F.trim("version"), F.col("versions") if "versions" in rows.columns else F.array().cast("array<string>"), version))
        if language and "language" in rows.columns:
            rows = rows.where(F.col("language") == language)
        hits = bm25.search(rows.withColumn("id", F.col(key)), "id", text, query, most(limit))
        legs[name] = hits.select(F.lit(name).alias("section"), "id", "score", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("place"))
    first = legs["members"].unionByName(legs["objects"])
    return cascade([first.unionByName(legs["examples"]) if examples else first, legs["topics"]]).drop("leg")


_WORDS = ["регистр", "register", "каталог"]


def _sections_sql(terms: list[str], limit: int, version: str | None = None, language: str | None = None) -> str:
    parts = {}
    for name, (tab, key, text, most) in SECTIONS.items():
        tests = ["true"]
        if version and name != "examples":
            tests.append(f"(trim(version) = '{version}'" + (f" or coalesce(list_contains(versions, '{version}'), false))" if name != "topics" else ")"))
        if language and name != "examples":
            tests.append(f"language = '{language}'")
        parts[name] = _section(name, tab, key, text, most(limit), terms, " and ".join(tests))
    head = " union all ".join(parts[n] for n in ("members", "objects", "examples"))
    return f"with a as ({head}), t as ({parts['topics']}) select * from a union all select * from t where not exists (select 1 from a)"


@q(_sections_sql(_WORDS, 10))
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """One query over members, objects and examples."""
    return search_sections(spark, d, " ".join(_WORDS))


@q(_sections_sql(_WORDS, 5, "8.3.20.2290", "ru"))
def unified_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same in one version and language."""
    return search_sections(spark, d, " ".join(_WORDS), 5, "8.3.20.2290", "ru")


@q(_sections_sql(["возвращаемое", "каждого"], 10))
def unified_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Words that stand in no member, object or example: the topics answer."""
    return search_sections(spark, d, "возвращаемое каждого")


@q("select doc_id, (select string_agg(trim(b, chr(10) || chr(13) || chr(9) || ' '), '|') from (select unnest(regexp_extract_all(text, '(?s)```\\w*\\s*\\n(.*?)```', 1)) b)) code from documents where text like '%```%' and len(regexp_extract_all(text, '(?s)```\\w*\\s*\\n(.*?)```', 1)) > 0")
def code_blocks_of_documents(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where("contains(text, '```')").select("doc_id", code_blocks("text").alias("b"))
    return found.where("size(b) > 0").select("doc_id", F.array_join("b", "|").alias("code"))


@q(r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]{2,}') b from documents),
f as (select doc_id, lower(x) l, min(p) p, arg_min(x, p) x from (select doc_id, unnest(b) x, generate_subscripts(b, 1) p from w) group by 1, 2),
g as (select doc_id, list(x order by p)[:50] b from f group by 1)
select doc_id, coalesce(array_to_string(b, ' '), '') keywords from documents left join g using (doc_id)""")
def keywords_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(keywords("text"), " ").alias("keywords"))
