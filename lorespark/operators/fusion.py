"""Reciprocal-rank fusion and keeping the best row of each path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.util.scratch import Scratch

RRF_K = 60


def ranked(leg: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, rank) of a ranked list that is already cut to its first rows (a leg is small by its limit)."""
    return leg.select(key, F.row_number().over(W.orderBy(*order)).alias("rank"))


def rrf(legs: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf): the sum of 1 / (k + rank) over all legs of (key, rank); a key twice in one leg scores twice."""
    every = reduce(DataFrame.unionByName, legs)
    return every.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("rrf"))


def best_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows with a blank key are left out."""
    kept = rows.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    return kept.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def quotas(rows: DataFrame, domain: str, position: str, title: str, limits: dict[str, int], total: int) -> DataFrame:
    """Rows in display order: the first of each domain up to its limit, then others not yet shown, `total` in all.

    The input is a hit list, cut to its first rows before; the same (title, domain) is filled in only once.
    """
    order = list(limits)
    at = F.row_number().over(W.partitionBy(domain).orderBy(position))
    quota = F.lit(0)
    group = F.lit(len(order))
    for i, d in enumerate(order):
        quota = F.when(F.col(domain) == d, F.lit(limits[d])).otherwise(quota)
        group = F.when(F.col(domain) == d, F.lit(i)).otherwise(group)
    marked = rows.withColumn("_in", at <= quota).withColumn("_group", F.when(F.col("_in"), group).otherwise(len(order)))
    again = W.partitionBy(title, domain).orderBy("_group", position)
    marked = marked.withColumn("_first", F.row_number().over(again)).where(F.col("_in") | (F.col("_first") == 1))
    shown = marked.withColumn("place", F.row_number().over(W.orderBy("_group", position))).where(F.col("place") <= total)
    return shown.drop("_in", "_group", "_first")


def quota_candidates(rows: DataFrame, domain: str, position: str, title: str, limits: dict[str, int], total: int) -> DataFrame:
    """The rows of a hit list of any length that quotas() can show; position is unique.

    These are the first of each domain up to its limit, and of the first rows of each (title, domain) so many as can
    be filled in, counting those that the limits have shown already.
    """
    once = rows.groupBy(title, domain).agg(F.min_by(F.struct(*rows.columns), position).alias("x")).select("x.*")
    out = once.orderBy(position).limit(total + sum(limits.values()))
    for d, n in limits.items():
        out = out.unionByName(rows.where(F.col(domain) == d).orderBy(position).limit(n))
    return out.dropDuplicates([position])


def places(rows: DataFrame, order: list, scratch: Scratch | None = None) -> DataFrame:
    """rows with `place` from 1 in the given total order: sorted by ranges, each part counted on from those before it."""
    scratch = scratch or Scratch(rows.sparkSession)
    done = scratch.save(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    done = done.withColumn("_part", F.shiftright("_m", 33))
    counts = done.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    # one row for each part of the sort
    met = done.join(F.broadcast(before), "_part")
    return met.withColumn("place", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_part", "_before")
