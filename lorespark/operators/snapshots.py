"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.functions.canonical import json_hash
from lorespark.functions.versions import version_key
from lorespark.util.scratch import Scratch

#: The list of snapshots (one row each, not one per record) is broadcast up to this length.
MAX_BROADCAST_SNAPSHOTS = 100_000


def snapshot_changes(
    rows: DataFrame, config: str = "config_name", version: str = "config_version", key: str = "id", delivered: str = "delivered_at", content: Column | None = None
) -> DataFrame:
    """(config_name, config_version, id, change) for every snapshot after the first of its configuration.

    `content` is a column that is equal for equal records (default: the hash of `attributes` as a JSON value). Of a key
    that one snapshot holds more than once the latest delivery counts, on a tie the greater hash. Rows without a key
    are left out; a null configuration or version is a value like any other, a null version the lowest. Consecutive
    snapshots meet in a full outer join on (configuration, position, key) of 8-byte hashes; the payload itself is
    never shuffled. An empty table gives no rows; further columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    content = json_hash("attributes") if content is None else content
    listed = rows.where(F.col(key).isNotNull()).select(F.col(config).alias("c"), F.col(version).alias("v")).distinct()
    order = W.partitionBy("c").orderBy(version_key("v"), "v")
    snaps = scratch.save(listed.select("c", "v", F.row_number().over(order).alias("ord"), F.count("*").over(W.partitionBy("c")).alias("last")))
    few = snaps.count() <= MAX_BROADCAST_SNAPSHOTS
    snaps = F.broadcast(snaps) if few else snaps

    cut = rows.where(F.col(key).isNotNull()).select(F.col(config).alias("c0"), F.col(version).alias("v0"), F.col(key).alias("id"), content.alias("h"), F.col(delivered).alias("at"))
    cut = cut.join(snaps, F.col("c0").eqNullSafe(F.col("c")) & F.col("v0").eqNullSafe(F.col("v")))
    latest = cut.groupBy("c", "ord", "last", "id").agg(F.max_by("h", F.struct("at", "h")).alias("h"))
    latest = scratch.save(latest)

    now = latest.where("ord > 1").select(F.col("c").alias("cn"), F.col("ord").alias("on"), F.col("id").alias("idn"), F.col("h").alias("hn"))
    before = latest.where("ord < last").select(F.col("c").alias("cb"), (F.col("ord") + 1).alias("ob"), F.col("id").alias("idb"), F.col("h").alias("hb"))
    met = now.join(before, F.col("cn").eqNullSafe(F.col("cb")) & (F.col("on") == F.col("ob")) & (F.col("idn") == F.col("idb")), "full_outer")
    change = F.when(F.col("idb").isNull(), "added").when(F.col("idn").isNull(), "removed").when(F.col("hn") != F.col("hb"), "changed")
    met = met.select(
        F.when(F.col("idn").isNotNull(), F.col("cn")).otherwise(F.col("cb")).alias("config_name"),
        F.coalesce("on", "ob").alias("_ord"),
        F.coalesce("idn", "idb").alias("id"),
        change.alias("change"),
    ).where("change is not null")
    back = met.join(snaps.select("c", "v", "ord"), F.col("config_name").eqNullSafe(F.col("c")) & (F.col("_ord") == F.col("ord")))
    return back.select("config_name", F.col("v").alias("config_version"), "id", "change")
