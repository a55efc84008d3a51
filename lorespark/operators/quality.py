"""Coverage, hit rates, percentiles and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def present(value: Column, kind: str) -> Column:
    """Lists count if not empty, other values if not blank."""
    test = F.size(value) > 0 if kind.startswith("array") else F.trim(value.cast("string")) != ""
    return F.coalesce(test, F.lit(False))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """0 for an empty whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, pct): the share of rows in which the field holds something. One pass over the table."""
    kinds = dict(rows.dtypes)
    one = rows.agg(*[percent(F.count_if(present(F.col(f), kinds[f])), F.count(F.lit(1))).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("pct")) for f in fields])).alias("x")).select("x.*")


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median_ms, p95_ms, max_ms): median of the middle two, 95th percentile by nearest rank.

    Values are counted per distinct value first, so a group with most of the rows is combined before it is sorted.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(group).orderBy(value))
    total = F.sum("c").over(W.partitionBy(group))
    seen = counts.select(group, value, "c", upto.alias("upto"), total.alias("n"))
    rank = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    agg = seen.groupBy(group, "n").agg(rank(low).alias("lo"), rank(high).alias("hi"), rank(F.ceil(F.col("n") * 0.95)).alias("p95"), F.max(value).alias("most"))
    return agg.select(group, "n", F.round((F.col("lo") + F.col("hi")) / 2, 1).alias("median_ms"), F.round("p95", 1).alias("p95_ms"), F.round("most", 1).alias("max_ms"))


def hit_cards(rows: DataFrame, groups: list[str], expected: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One card for each value of each grouping and one for all rows: n and the hit rate of each metric.

    expected gives for each metric (row counts, row is a hit); GROUPING SETS over one pass.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, (counts, ok) in expected.items():
        aggs.append(percent(F.count_if(counts & ok), F.count_if(counts)).alias(name))
    sets = [[F.col(g)] for g in groups] + [[]]
    return rows.groupingSets(sets, *[F.col(g) for g in groups]).agg(*aggs)
