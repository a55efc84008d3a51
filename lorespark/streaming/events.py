"""Incremental and streaming forms of the event operators: new files, trailing counts, a rate limit with memory, sinks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.merge import upsert


def file_stream(spark: SparkSession, path: str, schema: str, form: str = "json", per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder; the checkpoint of the query remembers which were read."""
    reader = spark.readStream.format(form).schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def run_new(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what is new since the last call and return; a failed batch is repeated by the next call."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def trailing_hour(events: DataFrame, ts: str = "ts", key: str = "event_type", length: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(window, key, n) in sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), key).agg(F.count("*").alias("n"))


def tumbling(events: DataFrame, length: str = "1 day", ts: str = "ts", key: str = "event_type", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", ts: str = "ts", key: str = "user_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"))


def admit(times: list[float], kept: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which calls pass a limit of `limit` calls in the trailing seconds; calls that are refused are not counted."""
    out, held = [], deque(kept)
    for t in times:
        while held and t - held[0] >= seconds:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, list(held)


def admitted(events: DataFrame, key: str, ts: str, tie: str, limit: int = 6000, seconds: float = 60.0) -> DataFrame:
    """(key, tie, admitted) of all calls of a table by the rule of admit(); a null key is a key.

    Whether a call passes rests on all earlier ones of its key, so the calls of a key go through one task in the order of
    (ts, tie), streaming: what is held are the admitted calls of the last seconds. A null time never passes.
    """
    kinds = dict(events.dtypes)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = object(), []
        for b in batches:
            flags = np.zeros(len(b), bool)
            cuts = np.flatnonzero(np.r_[True, b["k"].to_numpy()[1:] != b["k"].to_numpy()[:-1], True]) if len(b) else [0]
            for x, y in zip(cuts, cuts[1:]):
                if b["k"].iloc[x] != at:
                    at, kept = b["k"].iloc[x], []
                times = b["t"].iloc[x:y]
                real = times.notna().to_numpy()
                passed, kept = admit(times[real].tolist(), kept, limit, seconds)
                flags[x:y][real] = passed
            yield pd.DataFrame({key: b[key], tie: b[tie], "admitted": flags})

    k = F.to_json(F.struct(F.col(key).alias("k"))).alias("k")
    rows = events.select(k, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("t"), key, tie).withColumn("t", F.col("t") / 1e6)
    return rows.repartition("k").sortWithinPartitions("k", "t", tie).mapInPandas(step, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, admitted boolean")


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 6000, seconds: float = 60.0) -> DataFrame:
    """(key, ts, admitted) of a stream: the state of each key is the list of its admitted calls in the window.

    The state never holds more than `limit` times. Rows of one batch are taken in the order of their times.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(ts)
        kept = list(state.get[0]) if state.exists else []
        passed, kept = admit([t.timestamp() for t in rows[ts]], kept, limit, seconds)
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts].to_numpy(), "admitted": passed})

    schema = f"{key} {kind}, {ts} timestamp, admitted boolean"
    return events.select(key, F.col(ts).cast("timestamp").alias(ts)).groupBy(key).applyInPandasWithState(step, schema, "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: str, *order: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that puts the rows of a batch into a table by key; of several rows of a key the last by `order` counts.

    Each batch writes a new state beside the old ones, named by its number, so a repeated batch gives the same table. It
    starts from the greatest whole state before it; if there is none although batches went before, it fails instead of
    losing them. The latest `keep` states stay. upsert_table() reads the last one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        every = F.struct(*(order or batch.columns))
        one = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), every).alias("x")).select("x.*")
        states = _states(spark, path)
        before = [n for n in states if n < number]
        if number and not before:
            raise RuntimeError(f"no state of the table before batch {number} in {path}")
        out = upsert(spark.read.parquet(f"{path}/v{max(before)}"), one, key) if before else one
        out.write.mode("overwrite").parquet(f"{path}/v{number}")
        for n in sorted({*states, number})[:-keep]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return write


def _states(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole states of an upsert_sink()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def upsert_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{_states(spark, path)[-1]}")


def fan_out(sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that writes several forms of one batch; each batch has a folder of its own, so it may be repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, form in sinks.items():
            form(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return write


def retry_pending(pending: DataFrame, work: Callable[[DataFrame], DataFrame], attempts: str = "attempts", most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, still pending, given up): `work` adds a column ok to the rows it was given.

    A row that fails has its attempts counted and comes back until it has failed `most` times. The result of work is
    read three times, so it should be a table.
    """
    counted = pending if attempts in pending.columns else pending.withColumn(attempts, F.lit(0))
    done = work(counted)
    failed = done.where("not coalesce(ok, false)").drop("ok").withColumn(attempts, F.coalesce(attempts, F.lit(0)) + 1)
    return done.where("ok").drop("ok", attempts), failed.where(F.col(attempts) < most), failed.where(F.col(attempts) >= most)


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()
