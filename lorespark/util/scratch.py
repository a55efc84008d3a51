"""Intermediate tables in the folder all executors share.

Lineage is cut by writing parquet under `spark.checkpoint.dir`; the files survive the loss of an executor and are
smaller than an RDD checkpoint. Where the session names no such folder (local tests), a temporary one is made and
set. Tables that a later one replaces are dropped at once, the rest when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lorespark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Names, writes and drops the intermediate tables of one query."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/lorespark-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write df and return it as read back; `path_of` gives the place."""
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_counting(self, df: DataFrame, then: Callable[[DataFrame], DataFrame] | None = None, *partition_by: str, **counts: Column) -> tuple[DataFrame, dict]:
        """save() of df, or of then(df), that also counts over df on the way, without another pass over the rows.

        Counts come back as int (0 for null), aggregates that give an array as a list.
        """
        seen = Observation()
        counted = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        out = self.save(then(counted) if then else counted, *partition_by)
        try:
            out_counts = seen.get
        except Py4JJavaError:  # nothing was observed: the optimizer found df to be empty
            out_counts = df.agg(*[c.alias(k) for k, c in counts.items()]).first().asDict()
        return out, {k: v if isinstance(v := out_counts.get(k), list) else int(v or 0) for k in counts}

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables given by save() that nothing reads any more."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                self._delete(path)

    def clear(self) -> None:
        self._delete(self.base)
