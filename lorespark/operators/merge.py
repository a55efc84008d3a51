"""Content-hash merge, full-outer and anti joins between deliveries of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import normal_lines, point_id
from lorespark.functions.versions import version_key


def content_hash(rows: DataFrame, fields: list[str]) -> Column:
    """SHA-256 over the canonical JSON of the given fields in the order of their names, text normalised line by line."""
    kinds = dict(rows.dtypes)
    cells = []
    for f in sorted(fields):
        value = F.col(f)
        if kinds[f] == "string":
            value = normal_lines(value)
        elif kinds[f] == "array<string>":
            value = F.transform(F.coalesce(value, F.array().cast("array<string>")), normal_lines)
        cells.append(value.alias(f))
    return F.sha2(F.to_json(F.struct(*cells)), 256)


def content_merge(rows: DataFrame, language: str, fields: list[str], version: str, versions: str | None, suffix: str, *order: Column) -> DataFrame:
    """(id, language, content_hash, version, versions, n, last) for each language and content.

    The last row in the given order gives `last` (a struct of the fields); versions are the union of all, newest
    first. Equal contents are combined before the shuffle; a null language is ''.
    """
    lang = F.coalesce(F.col(language), F.lit(""))
    own = F.when(F.size(F.col(versions)) > 0, F.col(versions)).otherwise(F.array(F.col(version))) if versions else F.array(F.col(version))
    each = rows.select(lang.alias("language"), content_hash(rows, fields).alias("content_hash"), own.alias("v"), F.struct(*fields).alias("rec"), F.struct(*order).alias("ord"))
    last = each.groupBy("language", "content_hash").agg(F.max_by("rec", "ord").alias("last"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("v"))).alias("v"))
    clean = F.array_distinct(F.filter(F.transform("v", lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    keyed = F.transform(clean, lambda x: F.struct(version_key(x).alias("k"), x.alias("v")))
    newest = F.transform(F.sort_array(keyed, asc=False), lambda x: x["v"])
    out = last.withColumn("versions", newest)
    return out.select(point_id(F.lit(suffix), F.col("language"), F.col("content_hash")).alias("id"), "language", "content_hash", F.get("versions", 0).alias("version"), "versions", "n", "last")


def key_changes(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) between two states of a keyed table: added, removed or changed; a null key is no key."""
    a, b = before.select(F.col(key).alias("ka"), F.col(value).alias("va")).where("ka is not null"), now.select(F.col(key).alias("kb"), F.col(value).alias("vb")).where("kb is not null")
    met = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(~F.col("va").eqNullSafe(F.col("vb")), "changed")
    return met.select(F.coalesce("kb", "ka").alias(key), change.alias("change")).where("change is not null")


def to_load(tasks: DataFrame, cache: DataFrame, key: str, digest: str) -> DataFrame:
    """Tasks that the cache doesn't hold as done with the same digest."""
    done = cache.where("indexed").select(key, digest)
    return tasks.join(done, [key, digest], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in or replaced by key (new must be unique by key)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def signature(files: DataFrame, path: str, size: str) -> DataFrame:
    """(digest) one SHA-256 over all (path, size), whatever their order.

    Lines are digested in 4,096 buckets by the digest of the line, each sorted by itself, and the digests of the buckets
    once more; so no task holds the whole listing.
    """
    line = F.concat_ws(":", F.col(path), F.col(size).cast("string"))
    lines = files.select(line.alias("line"), F.substring(F.sha2(line, 256), 1, 3).alias("bucket"))
    buckets = lines.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    # one row for each bucket
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))
