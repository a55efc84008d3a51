"""Event logs: request counts, sliding limits, last-N with an age limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tool_metrics(events: DataFrame, tool: str, value: str, is_error: str) -> DataFrame:
    """(tool, total, max_value, errors, last_error_at), most used first."""
    one = events.groupBy(tool).agg(F.count("*").alias("total"), F.round(F.max(value), 3).alias("max_value"), F.count_if(F.expr(is_error)).alias("errors"), F.max(F.when(F.expr(is_error), F.col("ts"))).alias("last_error_at"))
    return one.orderBy(F.desc("total"), tool)


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with `recent`: how many of the same key lie in the trailing window, the row itself counted."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w))


def last_n(events: DataFrame, key: str, ts: str, tie: str, n: int, days: int) -> DataFrame:
    """The newest n rows of each key that are no older than `days` before the newest row of all."""
    newest = events.agg(F.max(ts)).scalar()
    fresh = events.where(F.col(ts).cast("timestamp") > newest.cast("timestamp") - F.make_dt_interval(F.lit(days)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return fresh.withColumn("rn", rank).where(F.col("rn") <= n)
