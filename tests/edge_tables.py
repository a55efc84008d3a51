"""Small copies of the input tables: empty ones, and ones with rows of nulls, repeated rows and extra columns."""

import os

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def make(spark, root, kind):
    out = f"{root}/{kind}"
    for f in os.listdir(SF):
        df = spark.read.parquet(f"{SF}/{f}").limit(0 if kind == "empty" else 20)
        if kind == "nulls":
            none = df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
            df = df.unionByName(none).unionByName(none).unionByName(df.limit(3))
            for clash in ("id", "key", "doc", "text", "n", "k", "c", "h", "node", "rank", "name", "path", "_n"):
                if clash not in df.columns:
                    df = df.withColumn(clash, F.lit("clash"))
        df.coalesce(1).write.mode("overwrite").parquet(f"{out}/{f}")
    return out
