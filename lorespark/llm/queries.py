"""Queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.paths import page_key
from lorespark.functions.versions import version_key
from lorespark.llm.lookalikes import canonical_names, lookalike_pairs
from lorespark.llm.packing import containers, pack
from lorespark.llm.repeats import MIN_UNIT, remove_repeats, repeated_units
from lorespark.llm.spans import SharedSpans
from lorespark.llm.splitting import split_oversized
from lorespark.llm.survivors import survivors
from lorespark.llm.tokenizer import count_tokens, encode_corpus
from lorespark.plans.tables import table
from lorespark.util.scratch import Scratch


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    a = split_oversized(table(spark, d, "skd_composition_result"), "skd_composition_result", "item_id", ["description", "code_snippet"])
    return a.unionByName(split_oversized(table(spark, d, "api_topics"), "api_topics", "id", ["text"]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items of which the operator made more than one piece."""
    return p1_pieces(spark, d).where("pieces > 1 and piece = 0").select("tab", "item_id", "field")


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    api = table(spark, d, "api_objects").select(F.col("id").cast("string").alias("key"), F.col("full_name").alias("name"))
    objects = table(spark, d, "objects").select(F.col("config_name").alias("scope"), "object_type", F.col("id").alias("key"), "name").distinct()
    return api, objects


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its consistent form."""
    api, objects = _names(spark, d)
    return canonical_names(api.select("name").unionByName(objects.select("name")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    api, objects = _names(spark, d)
    objects = scratch.save(objects)
    forms = scratch.save(canonical_names(api.select("name").unionByName(objects.select("name")), scratch))
    a = lookalike_pairs(api, forms, [], scratch=scratch).select(F.lit("api_objects").alias("tab"), F.lit("").alias("scope"), "key_a", "key_b")
    b = lookalike_pairs(objects, forms, ["scope", "object_type"], scratch=scratch).select(F.lit("objects").alias("tab"), "scope", "key_a", "key_b")
    return a.unionByName(b.distinct())


#: Trust in a record without a version, of 1 for one with a version.
UNVERSIONED_TRUST = 0.5


def _trust() -> Column:
    return F.when(F.length(F.trim("version")) > 0, 1.0).otherwise(UNVERSIONED_TRUST)


_TOPIC_FIELDS = ["path", "title", "text", "version", "language", "entity_type", "breadcrumb", "toc_id", "hbk_label", "loaded_at"]
_MEMBER_FIELDS = ["owner_name", "member_name", "full_name", "kind", "summary", "description", "syntax", "version", "versions", "returns", "language", "params", "loaded_at"]


def _topics(spark: SparkSession, d: str, **how) -> DataFrame:
    standing = [version_key("version"), ["title", "text", "entity_type", "breadcrumb"]]
    return survivors(table(spark, d, "api_topics"), page_key("path"), "id", standing, _TOPIC_FIELDS, trust=_trust(), **how)


def _members(spark: SparkSession, d: str, **how) -> DataFrame:
    highest = F.array_max(F.transform(F.array_append(F.coalesce("versions", F.array().cast("array<string>")), F.col("version")), version_key))
    standing = [highest, ["summary", "description", "syntax", "returns"]]
    name = F.when(F.col("full_name").isNotNull(), F.to_json(F.struct(F.lower(F.regexp_replace("full_name", r"(?U)\s+", "")).alias("n"), F.col("language").alias("l"))))
    return survivors(table(spark, d, "api_members"), name, "id", standing, _MEMBER_FIELDS, trust=_trust(), **how)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of several records with the record that wins the vote, read off the surviving records.

    These are voted for field by field as in p5_topics and p5_members, and kept as the keys of the records that each field
    is taken from: they are written, so that no vote is optimized away.
    """
    scratch = Scratch(spark)
    made = [(t, scratch.save(f(spark, d, sources=True, scratch=scratch))) for t, f in (("api_topics", _topics), ("api_members", _members))]
    parts = [s.where("n > 1").select(F.lit(t).alias("tab"), "group_id", "best_id") for t, s in made]
    return parts[0].unionByName(parts[1])


def p5_topics(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d)


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per language and source."""
    counts = count_tokens(table(spark, d, "documents"), ["lang", "source"])
    return counts.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(count_tokens(table(spark, d, "documents"), ["doc_id", "source"]))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("pieces > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).pairs()


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return SharedSpans(docs, every=True).shared(docs)


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of all documents with their offsets, cut where the earliest holder changes; kept in it, removed elsewhere."""
    found = SharedSpans(table(spark, d, "documents"), every=True).passages()
    return found.select(F.col("doc").alias("doc_id"), "begin", "end", "first_doc", (F.col("doc") == F.col("first_doc")).alias("kept"))


def p9_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common run between the first ones of each group of copies."""
    found = SharedSpans(table(spark, d, "documents"))
    return found.links().withColumnsRenamed({"ra": "doc_a", "rb": "doc_b"})


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every document of at least 200 characters that has copies, with the one that stands for all of them in p9_links."""
    return SharedSpans(table(spark, d, "documents")).members().withColumnsRenamed({"doc": "doc_id", "rep": "first_doc"})


def p9_lines(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines with their offsets: the earliest one is kept, the rest is removed."""
    return repeated_units(table(spark, d, "documents"))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All texts without the paragraphs that stand earlier in the corpus."""
    return remove_repeats(table(spark, d, "documents"), unit="paragraph")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold of each source, checked against what the documents have: pieces, tokens, greatest fill."""
    docs = table(spark, d, "documents")
    scratch = Scratch(spark)
    counted = scratch.save(count_tokens(docs, ["doc_id", "source"]))
    packed = scratch.save(pack(counted, scratch=scratch))
    fill = packed.groupBy("container").agg(F.sum("size").alias("used"))
    most = fill.agg(F.max("used")).scalar()
    held = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("packed"))
    every = counted.join(held, "doc_id", "left").groupBy("source")
    return every.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("pieces").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.sum("packed").alias("packed")).withColumn("fullest", most)


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_names, p5_found, p5_topics, p5_members, p7_ids, p7_counts, p8_found, p8_pack, p8_containers, p8_sources, p9_found, p9_links, p9_copies, p9_shared, p9_passages, p9_lines, p9_cleaned)}

_VK = "(case when trim(coalesce({v}, '')) = '' then cast([] as bigint[]) else list_transform(string_split(trim({v}), '.'), lambda x: coalesce(try_cast(trim(x) as bigint), 0)) end)"
_LONG = "length(trim({c}, ' ' || chr(9) || chr(13) || chr(10) || chr(160))) > 1200"
# letters that look alike, stated for the SQL by itself, and composed letters that do so through their base letter
_FROM = "АВЕЅІЈКМНОРСТХаеорсухѕіјһԁ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ" + "ЁёЇї"
_TO = "ABESIJKMHOPCTXaeopcyxsijhd" + "ABEZHIKMNOPTYXovp" + "ËëÏï"
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _fold(c: str) -> str:
    seen = rf"nfc_normalize(regexp_replace({c}, '[\x{{ad}}\x{{34f}}\p{{Cf}}]', '', 'g'))"
    trimmed = rf"regexp_replace(regexp_replace({seen}, '[\p{{Zs}}]', ' ', 'g'), '^ +| +$', '', 'g')"
    return f"trim(nfc_normalize(translate(translate({trimmed}, '{_WIDE}', '{_NARROW}'), '{_FROM}', '{_TO}')))"


_SPACE = r"\s\x{a0}"
_KEY = rf"""regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url_decode(replace(regexp_replace(trim(path), '(?s)#.*$', ''), '+', '%2B')), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '[\\/]+', '/', 'g')), '^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+', ''), '\.(html|htm|md)$', '')"""
_ON = "(trim(coalesce({c}, ''), ' ' || chr(9) || chr(13) || chr(10) || chr(160)) <> '')::int"

ORACLE: dict[str, str] = {
    "p1_found": " union all ".join(
        f"select '{tab}' tab, {key} item_id, '{c}' field from {tab} where {_LONG.format(c=c)}" for tab, key, c in (("skd_composition_result", "item_id", "description"), ("skd_composition_result", "item_id", "code_snippet"), ("api_topics", "id", "text"))
    ),
    "p3_found": f"""with a as (select cast(id as varchar) k, full_name n, {_fold("full_name")} f from api_objects where full_name is not null),
o as (select distinct config_name s, object_type t, id k, name n, {_fold("name")} f from objects where name is not null)
select distinct 'api_objects' tab, '' as scope, least(x.k, y.k) key_a, greatest(x.k, y.k) key_b from a x join a y on x.f = y.f and x.n < y.n and x.k <> y.k
union all select distinct 'objects', x.s, least(x.k, y.k), greatest(x.k, y.k) from o x join o y on x.s = y.s and x.t = y.t and x.f = y.f and x.n < y.n and x.k <> y.k""",
    "p5_found": f"""with t as (select id, {_KEY} k, {_VK.format(v="version")} v, {_ON.format(c="title")} + {_ON.format(c="text")} + {_ON.format(c="entity_type")} + (len(coalesce(breadcrumb, [])) > 0)::int f, loaded_at from api_topics where path is not null),
m as (select id, lower(regexp_replace(full_name, '[{_SPACE}]+', '', 'g')) k, language l, list_max(list_transform(list_append(coalesce(versions, []), version), lambda w: {_VK.format(v="w")})) v, {" + ".join(_ON.format(c=c) for c in ("summary", "description", "syntax", "returns"))} f, loaded_at from api_members where full_name is not null)
select 'api_topics' tab, min(id) group_id, arg_max(id, (v, f, loaded_at, id)) best_id from t group by k having count(*) > 1
union all select 'api_members', min(id), arg_max(id, (v, f, loaded_at, id)) from m group by k, l having count(*) > 1""",
    "p9_copies": """with t as (select doc_id, text, min(doc_id) over (partition by text) first_doc, count(*) over (partition by text) n from documents where length(text) >= 200)
select doc_id, first_doc from t where n > 1""",
    "p9_lines": f"""with d as (select doc_id, string_split(translate(text, chr(13), chr(10)), chr(10)) l from documents where text <> ''),
u as (select doc_id, unnest(l) line, generate_subscripts(l, 1) i from d),
o as (select doc_id, line, (sum(length(line) + 1) over (partition by doc_id order by i rows unbounded preceding) - length(line) - 1)::int as "begin" from u),
n as (select doc_id, "begin", ("begin" + length(line))::int as "end", trim(regexp_replace(line, '[ \\t\\x{{b}}\\x{{c}}\\x{{a0}}]+', ' ', 'g'), ' ') k from o),
g as (select *, count(*) over (partition by k) c, first_value(doc_id) over w first_doc, first_value("begin") over w first_at from n where length(k) >= {MIN_UNIT} window w as (partition by k order by doc_id, "begin"))
select doc_id, "begin", "end", first_doc, doc_id = first_doc and "begin" = first_at kept from g where c > 1""",
}
