"""From help pages to the five tables of a snapshot: objects, members, examples, links and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import LINK, code_blocks, member_kind, owner_of, strip, summary, text_or_empty, title_base, title_synonym, topic_doc_kind
from lorespark.functions.versions import version_key
from lorespark.operators.merge import content_merge
from lorespark.sources.files import parameters_of, sections_of

MEMBER_KINDS = ["method", "property", "event", "constructor", "function", "field"]
# Breadcrumb entries that name a kind of page, not an owner.
GENERIC = ["объекты", "типы", "методы", "свойства", "конструкторы", "события", "functions", "methods", "properties", "types", "objects", "events", "constructors"]


def object_kind(path: Column | str, title: Column | str) -> Column:
    p = F.lower(F.regexp_replace(text_or_empty(path), r"\\", "/"))
    t = title_base(title)
    has = lambda s: F.contains(p, F.lit(s))
    return (
        F.when(has("/tables/"), "table")
        .when(p.rlike("(^|/)shquery_"), "query_topic")
        .when(p.rlike("(^|/)(shclang_|embedlang|shlang_ru/)"), "language_topic")
        .when(F.startswith(t, F.lit("Глобальный контекст")), "global_context")
        .when(F.startswith(t, F.lit("ОбъектМетаданных:")), "metadata_object")
        .when(F.contains(F.lower(t), F.lit("менеджер")), "manager")
        .when(p.endswith("/global context.html"), "global_context")
        .when(has("/enums/") | F.contains(F.lower(t), F.lit("перечислен")), "enum")
        .when(has("/collections/") | F.contains(F.lower(t), F.lit("коллекц")), "collection")
        .when(has("/objects/"), "type")
        .otherwise("topic")
    )


def parent_name(title: Column, breadcrumb: Column) -> Column:
    """The last entry of the breadcrumb that is neither the title itself nor the name of a kind; '' if there is none."""
    crumbs = F.coalesce(breadcrumb, F.array().cast("array<string>"))
    good = F.filter(crumbs, lambda c: F.coalesce((F.trim(c) != "") & (F.lower(F.trim(c)) != F.lower(title)) & ~F.lower(F.trim(c)).isin(GENERIC), F.lit(False)))
    return F.when(F.size(good) > 0, F.trim(F.element_at(good, -1))).otherwise("")


def value_types(text: Column) -> Column:
    """Type names of `Тип: А, Б.`; [] without the prefix."""
    flat = F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))
    listed = F.regexp_extract(flat, r"(?u)^Тип:\s*(.*?)(?:\s\.\s.*|\.)?$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(listed, r"\s*[,;]\s*"), lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", "")), lambda x: x != ""))


def build_records(topics: DataFrame) -> dict[str, DataFrame]:
    """The five tables of topics (path, title, text, version, language, entity_type, breadcrumb).

    The text is Markdown; its sections are found once per page in Arrow batches, everything else is built in. A page
    gives a member if its kind is one, an object if it lies below objects or has a kind of object, a topic otherwise,
    and an example for every code block and a link for every Markdown link and line of "see also".
    """
    body = topics.withColumn("s", sections_of(text_or_empty("text")))
    section = lambda k: text_or_empty(F.col("s")[k])
    base = title_base(F.coalesce(F.nullif(strip("title"), F.lit("")), section("title")))
    page = body.select(
        "path", base.alias("title"), title_synonym("title").alias("synonym"), F.trim(text_or_empty("version")).alias("version"), text_or_empty("language").alias("language"), "breadcrumb", "text",
        member_kind("path", "title", "entity_type").alias("kind"), object_kind("path", "title").alias("object_kind"), parent_name(base, F.col("breadcrumb")).alias("parent"),
        summary(F.coalesce(F.nullif(section("description"), F.lit("")), section("intro"))).alias("summary"), section("description").alias("description"), section("syntax").alias("syntax"),
        section("params").alias("params_text"), section("returns").alias("returns"), section("availability").alias("availability"), section("see_also").alias("see_also"), section("example").alias("example"),
    )
    is_member = F.col("kind").isin(MEMBER_KINDS)
    full = F.when(F.contains("title", F.lit(".")) | (F.col("parent") == ""), F.col("title")).otherwise(F.concat_ws(".", "parent", "title"))
    members = page.where(is_member).select(
        full.alias("full_name"), F.substring_index("title", ".", -1).alias("member_name"), "kind", "title", "summary", "description", "syntax", "returns", "availability", "version", "language", F.col("path").alias("topic_path"),
        parameters_of("params_text").alias("params"), value_types(F.col("returns")).alias("value_types"), F.array_compact(F.array("synonym")).alias("aliases"),
    ).withColumn("owner_name", owner_of("full_name"))
    is_object = ~is_member & (F.col("object_kind") != "topic")
    objects = page.where(is_object).select(F.col("title").alias("object_name"), F.col("title").alias("full_name"), F.col("object_kind").alias("kind"), "title", "summary", "description", "availability", "version", "language", F.col("path").alias("topic_path"), "breadcrumb", F.array_compact(F.array("synonym")).alias("aliases"))
    blocks = F.filter(code_blocks(F.when(F.col("example") != "", F.col("example")).otherwise(F.col("text"))), lambda b: b != "")
    examples = page.select(full.alias("full_name"), "title", "kind", F.posexplode(blocks).alias("number", "code"), "version", "language", F.col("path").alias("topic_path"))
    href = F.regexp_extract_all(text_or_empty("text"), F.lit(LINK), F.lit(2))
    label = F.regexp_extract_all(text_or_empty("text"), F.lit(LINK), F.lit(1))
    inline = page.select(full.alias("source_full_name"), F.explode(F.arrays_zip(label.alias("target_name"), href.alias("href"))).alias("l"), F.lit("markdown").alias("link_kind"), "version", "language", F.col("path").alias("topic_path")).select("source_full_name", "l.target_name", "l.href", "link_kind", "version", "language", "topic_path")
    lines = F.filter(F.transform(F.split("see_also", "\n"), lambda x: F.regexp_replace(x, r"^[\s-]+|\s+$", "")), lambda x: (x != "") & ~F.lower(x).isin("описание", "description", "см. также", "see also"))
    also = page.select(full.alias("source_full_name"), F.explode(F.array_distinct(lines)).alias("target_name"), F.lit("").alias("href"), F.lit("see_also").alias("link_kind"), "version", "language", F.col("path").alias("topic_path"))
    typed = members.select(F.col("full_name").alias("source_full_name"), F.explode("value_types").alias("target_name"), F.lit("").alias("href"), F.lit("returns_type").alias("link_kind"), "version", "language", "topic_path")
    prose = page.where(~is_member & ~is_object).select("title", topic_doc_kind("path").alias("kind"), "summary", F.substring("text", 1, 50_000).alias("body"), "version", "language", F.col("path").alias("topic_path"), "breadcrumb")
    return {"api_objects": objects, "api_members": members, "api_examples": examples, "api_links": inline.unionByName(also).unionByName(typed), "api_topics": prose}


def merge_members(members: DataFrame) -> DataFrame:
    """Members of equal content under one id with all their versions."""
    fields = ["full_name", "kind", "summary", "description", "syntax", "returns"]
    return content_merge(members, "language", fields, "version", None, "member", version_key("version"), F.col("topic_path"))


def resolve_links(links: DataFrame, objects: DataFrame, members: DataFrame) -> DataFrame:
    """Links with the record their name leads to: `full_name`, `member_name` or null.

    Names are unique after the aggregation; a hot target meets one row.
    """
    names = objects.select(F.lower("full_name").alias("n")).withColumn("target_lookup", F.lit("full_name"))
    names = names.unionByName(members.select(F.lower("full_name").alias("n")).withColumn("target_lookup", F.lit("full_name")))
    names = names.unionByName(members.select(F.lower("member_name").alias("n")).withColumn("target_lookup", F.lit("member_name")))
    one = names.groupBy("n").agg(F.min("target_lookup").alias("target_lookup"))
    return links.join(one, F.lower("target_name") == F.col("n"), "left").drop("n")
