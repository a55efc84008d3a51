"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.canonical import ZERO_GUID, guid
from lorespark.functions.versions import version_key
from lorespark.util.bloom import Bloom
from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join, sketch


def _classify(refs: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """refs (…, k) left-joined to parents (k, …), which is unique by k; `_known` says whether k exists.

    A Bloom filter of the parent keys, sized by their number, proves part of the references to be orphans; only the rest
    is joined.
    """
    parents, n = scratch.save_counting(parents, k=F.count(F.lit(1)))
    bloom = Bloom(parents, F.col("k"), n["k"])
    maybe = F.when(F.col("_maybe"), F.col("k"))
    probed, n = scratch.save_counting(bloom.mark(refs, F.col("k")), k=F.count(maybe), hot=sketch(maybe))
    orphans = probed.where("not _maybe").drop("_maybe")
    joined = lookup_join(probed.where("_maybe").drop("_maybe"), parents.withColumn("_known", F.lit(True)), "k", total=n["k"], hot=n["hot"])
    joined = joined.withColumn("_known", F.coalesce("_known", F.lit(False)))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in parents.schema if f.name != "k"}
    return joined.unionByName(orphans.select("*", *empty.values(), F.lit(False).alias("_known")))


def dangling_relations(relations: DataFrame, objects: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(tab, row_id, field, kind, seen_at) of the ends of relations that have no record in the snapshot they name.

    kind is `deleted` if the configuration has the id in a lower version only or also, else `later` if in a higher
    one, else `missing`. Null, empty and zero ids are no references. Ids, configurations and versions compare as
    delivered; a null configuration or version is compared as a value of its own. Parents are reduced to one row per
    (configuration, id) with the set of versions that hold it, bounded by the number of snapshots.
    """
    scratch = scratch or Scratch(relations.sparkSession)
    key = F.to_json(F.struct(F.col("config_name").alias("c"), F.col("id").alias("i")))
    held = objects.where("id is not null").select(key.alias("k"), "config_version").distinct()
    parents = held.groupBy("k").agg(F.collect_set(F.coalesce("config_version", F.lit("\u0000"))).alias("held"), F.min(version_key("config_version")).alias("low"), F.max(version_key("config_version")).alias("high"))
    ends = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("id")) for f in ("from_id", "to_id")]))
    refs = relations.select(F.col("rel_id").alias("row_id"), "config_name", "config_version", "seen_at", ends.alias("e")).select("*", "e.*").drop("e")
    refs = refs.where(F.col("id").isNotNull() & ~F.trim("id").isin("", "0", ZERO_GUID))
    refs = refs.select("row_id", "field", F.coalesce("config_version", F.lit("\u0000")).alias("v"), version_key("config_version").alias("vk"), "seen_at", key.alias("k"))
    met = _classify(refs, parents, scratch)
    kind = F.when(F.array_contains("held", F.col("v")), None).when(F.col("low") < F.col("vk"), "deleted").when(F.col("high") > F.col("vk"), "later").otherwise("missing")
    return met.select(F.lit("config_relations").alias("tab"), "row_id", "field", kind.alias("kind"), "seen_at").where("kind is not null")


def dangling_owners(properties: DataFrame, catalog: DataFrame, configs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(tab, row_id, field, kind, seen_at) of the owners that were never delivered, are deleted or came only later.

    GUIDs compare without case, braces and surrounding white space; null, empty and zero owners are no references. Of
    an object delivered more than once the latest deletion mark counts; a null mark is false. A row without loaded_at
    is never `later`.
    """
    scratch = scratch or Scratch(properties.sparkSession)
    no_mark = F.lit(None).cast("boolean")
    never = F.lit(None).cast("timestamp")
    rows = (
        catalog.select(guid("ref").alias("k"), "loaded_at", F.coalesce("deletion_mark", F.lit(False)).alias("mark"), F.lit(False).alias("config"))
        .unionByName(properties.select(guid("ref").alias("k"), "loaded_at", no_mark.alias("mark"), F.lit(False).alias("config")))
        .unionByName(configs.select(guid("config_ref").alias("k"), never.alias("loaded_at"), no_mark.alias("mark"), F.lit(True).alias("config")))
    ).where("k is not null")
    marked = F.when(F.col("mark").isNotNull(), F.struct(F.coalesce("loaded_at", F.to_timestamp(F.lit("0001-01-01"))), "mark"))
    parents = rows.groupBy("k").agg(F.min("loaded_at").alias("first"), F.max(marked).alias("m"), F.bool_or("config").alias("config"))
    parents = parents.select("k", "first", F.coalesce(F.col("m.mark"), F.lit(False)).alias("mark"), "config")
    refs = properties.select("row_id", F.col("loaded_at").alias("seen_at"), guid("owner").alias("k")).where("k is not null")
    met = _classify(refs, parents, scratch)
    kind = F.when(~F.col("_known"), "missing").when(F.col("config"), None).when(F.col("mark"), "deleted").when(F.col("first") > F.col("seen_at"), "later")
    return met.select(F.lit("catalog_properties").alias("tab"), "row_id", F.lit("owner").alias("field"), kind.alias("kind"), "seen_at").where("kind is not null")


def orphan_report(found: DataFrame) -> DataFrame:
    """(tab, month, field, kind, n): dangling references per table and month; a null time has a null month."""
    return found.groupBy("tab", F.date_format("seen_at", "yyyy-MM").alias("month"), "field", "kind").agg(F.count("*").alias("n"))
