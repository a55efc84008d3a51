"""Lookups with fallbacks, filters that never empty a list, and logs kept short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fallback_lookup(items: DataFrame, key: str, candidates: list[Column], table: DataFrame, name: str) -> DataFrame:
    """items ⟕ table by the first candidate key that the table holds (table unique by `name`).

    All candidates are tried in one join; what is left without a match keeps nulls.
    """
    tries = F.posexplode(F.array_distinct(F.array(*candidates))).alias("_rank", name)
    met = items.select(key, tries).join(table, name)
    best = met.groupBy(key).agg(F.min_by(F.struct(*table.columns), "_rank").alias("_hit"))
    return items.join(best, key, "left").select(*items.columns, "_hit.*")


def unless_empty(rows: DataFrame, noise: Column) -> DataFrame:
    """Rows that are no noise; all of them if nothing else is left (a hit list, cut before)."""
    marked = rows.withColumn("_noise", F.coalesce(noise, F.lit(False)))
    only = F.min(F.col("_noise").cast("int")).over(W.partitionBy())
    return marked.withColumn("_only", only).where((F.col("_only") == 1) | ~F.col("_noise")).drop("_noise", "_only")


def newest(rows: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """The latest n entries of a log, newest first."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def domain_share(rows: DataFrame, domain: str, score: str, tie: str, limit: int, domains: int) -> DataFrame:
    """The best max(2, limit / domains) rows of each domain."""
    share = max(2, -(-limit // max(1, domains)))
    rank = F.row_number().over(W.partitionBy(domain).orderBy(F.desc(score), tie))
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= share).drop("_rn")


def unchanged(source_digest: str, last_digest: str | None, target: DataFrame) -> bool:
    """Whether a build may be skipped: the same source as last time and a target that isn't empty."""
    return source_digest == last_digest and not target.isEmpty()
