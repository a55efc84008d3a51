"""Text columns, chunking, vectors and classification over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as t
from lorespark.functions.chunks import chunk_points, chunk_rows
from lorespark.functions.paths import without_version_prefix
from lorespark.functions.vectors import deterministic, placeholder
from lorespark.plans._queries import Book
from lorespark.plans.tables import table

q = Book()

_TRIM = "trim(coalesce({c}, ''), chr(10) || chr(13) || chr(9) || chr(12) || chr(11) || ' ')"


@q(r"""with s as (select id, unnest(string_split_regex(coalesce(full_name, ''), '[.\s]+')) w, generate_subscripts(string_split_regex(coalesce(full_name, ''), '[.\s]+'), 1) p from api_members),
x as (select id, p, regexp_extract_all(w, '[А-ЯЁ][а-яё]+|[A-Z][a-z]+') k from s), y as (select id, string_agg(array_to_string(k, ' '), ' ' order by p) words from x where len(k) > 1 group by 1)
select id, coalesce(words, '') words from api_members left join y using (id)""")
def camel_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").select("id", t.camel_words("full_name").alias("words"))


_SUM = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


@q(f"select item_id, case when length(x) <= 120 then x else rtrim(x[:117]) || '...' end summary from (select item_id, {_SUM.format(c='description')} x from skd_composition_result)")
def compact_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skd_composition_result").select("item_id", t.summary("description", 120).alias("summary"))


@q("select doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g') = coalesce(text, '') clean, length(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) n_visible from documents")
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    raw = t.text_or_empty("text")
    return table(spark, d, "documents").select("doc_id", (t.without_controls("text") == raw).alias("clean"), F.length(F.regexp_replace(raw, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")).alias("n_visible"))


@q("""with x as (select doc_id, coalesce(text, '') s, length(regexp_replace(coalesce(text, ''), '[^\\x{0400}-\\x{04ff}]', '', 'g')) cyr, length(regexp_replace(coalesce(text, ''), '[^РС]', '', 'g')) bad, length(regexp_replace(coalesce(text, ''), '[^\\x{2500}-\\x{257f}]', '', 'g')) box from documents)
select doc_id, case when length(s) < 20 or cyr < 10 then false else bad / cyr > 0.25 or box > 5 end garbled from x""")
def mojibake_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.looks_garbled("text").alias("garbled"))


@q("select id, case when trim(coalesce(title, '')) = '' then 'Untitled' else trim(title) end title from api_topics")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles read back from HTML pages made of the topics."""
    name = F.trim(t.text_or_empty("title"))
    html = F.when(name == "", F.lit("<html><body><p>x</p></body></html>")).otherwise(F.concat(F.lit("<html><head></head><body>\n<H1 class='p'><b>"), name, F.lit("</b></H1></body></html>")))
    return table(spark, d, "api_topics").select("id", t.html_title(html).alias("title"))


@q("select id, topic_path href from api_objects where coalesce(topic_path, '') <> ''")
def page_outgoing_links(spark: SparkSession, d: str) -> DataFrame:
    """Links read back from HTML made of the objects."""
    html = F.concat(F.lit("<p>see <a class=\"r\" href=\""), F.col("topic_path"), F.lit("\">x</a> <a name='n'>y</a></p>"))
    return table(spark, d, "api_objects").where("topic_path <> ''").select("id", F.explode(t.html_links(html)).alias("href"))


@q(r"select id, regexp_replace(path, '^8\.[0-9]+\.[0-9]+(\.[0-9]+)?/', '') path from api_topics")
def path_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").select("id", without_version_prefix("path").alias("path"))


_ENT = " ".join(f"when list_has_any(x, {w!r}) then '{k}'" for k, w in t.ENTITY_WORDS.items())


@q(f"""with y as (select id, list_transform(list_filter(string_split(replace(coalesce(path, ''), '\\', '/'), '/'), lambda s: s <> '') || list_filter(coalesce(breadcrumb, []), lambda s: s <> ''), lambda s: lower(trim(s))) a from api_topics),
z as (select id, a[-3:] x from y) select id, case {_ENT} else 'topic' end entity from z""")
def entity_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").select("id", t.entity_type("path", F.col("breadcrumb")).alias("entity"))


@q("""with x as (select id, lower(trim(coalesce(entity_type, ''))) e, lower(replace(coalesce(path, ''), '\\', '/')) p, trim(coalesce(title, '')) t from api_topics)
select id, case when e in ('method', 'property', 'event', 'constructor', 'function', 'field') then e
when contains(p, '/methods/') then case when contains(p, '/script functions/') or starts_with(t, 'Встроенные функции языка.') then 'function' else 'method' end
when contains(p, '/tables/') and contains(p, '/fields/') then 'field' when contains(p, '/properties/') then 'property' when contains(p, '/events/') then 'event'
when contains(p, '/ctors/') or contains(t, '.По умолчанию') then 'constructor' else 'topic' end kind,
case when starts_with(list_last(string_split(p, '/')), 'form_') then 'form_help' when regexp_matches(list_last(string_split(p, '/')), '^zif[0-9]*_') then 'cli_help' else 'article' end doc_kind from x""")
def topic_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").select("id", t.member_kind("path", "title", "entity_type").alias("kind"), t.topic_doc_kind("path").alias("doc_kind"))


_ERR = " ".join("when " + " or ".join(f"contains(x, '{w}')" for w in ws) + f" then '{k}'" for k, ws in t.ERROR_WORDS.items())


@q(f"with y as (select doc_id, lower(coalesce(text, '')) x from documents) select doc_id, case {_ERR} else 'other' end category from y")
def error_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.error_category("text").alias("category"))


@q("select doc_id, round(list_sum(list_transform(range(64), lambda i: (cast('0x' || sha256(coalesce(text, ''))[2 * (i % 32) + 1:2 * (i % 32) + 2] as int) - 128) / 128.0 * (i + 1))), 6) checksum from documents")
def placeholder_vector(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum over the vector, so that every element and its place count."""
    v = placeholder(F.col("text"), 64)
    total = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "documents").select("doc_id", F.round(total, 6).alias("checksum"))


@q()
def deterministic_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", deterministic(F.col("text"), 64).alias("vector"))


_BODY = _TRIM.format(c="code_snippet")


@q(f"""with x as (select item_id, {_BODY} b from skd_composition_result), n as (select *, case when length(b) = 0 then 0 when length(b) <= 1400 then 1 else 1 + ceil((length(b) - 1400) / 1150.0)::int end n from x),
c as (select item_id, b, n, unnest(range(n)) i from n) select item_id, i::int chunk_index, n::int chunk_total, substring(b, i::int * 1150 + 1, 1400) chunk from c""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(table(spark, d, "skd_composition_result").select("item_id", "code_snippet"), "code_snippet")


_KEY = f"sha256('snippets' || '|' || '' || '|' || coalesce(source_ref, '') || '|' || coalesce(title, '') || '|' || sha256({_BODY}[:4000])[:24])[:16]"


@q(f"""with x as (select item_id, {_BODY} b, coalesce(nullif(trim(title), ''), 'document') title, {_KEY} k from skd_composition_result), n as (select *, 1 + ceil((length(b) - 1400) / 1150.0)::int n from x where length(b) > 1400),
c as (select item_id, title, k, n, unnest(range(n)) i from n)
select item_id, title || ' · ' || (i + 1) || '/' || n title, k parent_key, 'snippets_' || sha256('snippets|' || k || '|' || i || '|' || n)[:16] point_id from c""")
def chunk_point_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunk_points(table(spark, d, "skd_composition_result"), "snippets", "code_snippet").select("item_id", "title", "parent_key", "point_id")


_SW = " or ".join(f"contains(c, '{w}')" for w in t.SCRIPT_WORDS)


@q(f"""with x as (select item_id, {_TRIM.format(c='title')} t, {_TRIM.format(c='description')} d, {_TRIM.format(c='code_snippet')} c from skd_composition_result), y as (select *, length(c) nc, length(d) nd, ({_SW}) s from x)
select item_id, case when nc < 80 then 'reference' when regexp_matches(t, '(?i)^(как\\s+|инструкция|руководство|настройка|восстановление|установка|методика|решение\\s+проблемы|ошибка|troubleshooting)') and not (s and nc > nd) then 'reference'
when s and nc > nd * 1.2 then 'snippet' when s and nc / (nc + nd) > 0.45 then 'snippet' else 'reference' end label from y""")
def snippet_vs_reference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skd_composition_result").select("item_id", t.snippet_or_reference("title", "description", "code_snippet").alias("label"))


@q(r"""with x as (select id, trim(full_name) v from api_members where full_name is not null) select id, case when contains(v, '.') then trim(regexp_extract(v, '(?s)^(.*)\.[^.]*$', 1)) else '' end as owner, trim(list_last(string_split(v, '.'))) as member from x""")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").where("full_name is not null").select("id", t.owner_of("full_name").alias("owner"), t.member_of("full_name").alias("member"))


@q("select id, length(array_to_string(list_filter([coalesce(title, ''), coalesce(summary, ''), coalesce(description, ''), coalesce(availability, '')], lambda x: x <> ''), chr(10))) n_text, sha256(array_to_string(list_filter([coalesce(title, ''), coalesce(summary, ''), coalesce(description, ''), coalesce(availability, '')], lambda x: x <> ''), chr(10))) digest from api_objects")
def record_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.filter(F.array(*[t.text_or_empty(c) for c in ("title", "summary", "description", "availability")]), lambda x: x != ""), "\n")
    return table(spark, d, "api_objects").select("id", F.length(body).alias("n_text"), F.sha2(body, 256).alias("digest"))


@q("select id, cast(('0x' || sha256(coalesce(version, '') || '|' || coalesce(language, '') || '|' || coalesce(path, ''))[1:14]) as bigint) point_id from api_topics")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").select("id", t.point_id(F.col("version"), F.col("language"), F.col("path")).alias("point_id"))


@q("select id, trim(string_split(trim(coalesce(title, '')), ' (')[1]) as base from api_topics")
def title_bases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_topics").select("id", t.title_base("title").alias("base"))
