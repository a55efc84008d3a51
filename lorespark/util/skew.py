"""Joins whose key may hold a large share of the rows.

Hot keys are found by a sketch of frequent items: every row is counted in its task, one small sketch per task moves and
no key is shuffled. A hot key is split in proportion to its rows, so that no part is larger than the share of one task.
Keys below the resolution of the sketch are at most a few times that share; adaptive skew joins even them out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most hot keys that are told apart, and the counters of a sketch (16 bytes each).
HOT_KEYS, COUNTERS = 256, 4096
#: Rows of one key that one task may always take, and pairs of one key that one task makes.
LEAST_SPLIT, PAIRS = 20_000, 4_000_000
#: xxhash64 of a null.
_NULL = 42


def sketch(key: Column | str) -> Column:
    """Aggregate with the most frequent keys as (hash, rows); nulls count as a key of their own."""
    return F.call_function("approx_top_k", F.xxhash64(key), F.lit(HOT_KEYS), F.lit(COUNTERS))


def hot_keys(rows: DataFrame, key: str) -> tuple[list, int]:
    """((hash, rows) of the most frequent keys, number of all rows); one job over this column."""
    row = rows.agg(sketch(key).alias("hot"), F.count(F.lit(1)).alias("n")).first()
    return list(row["hot"] or []), int(row["n"])


def _tasks(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_of(key: Column | str, parts: dict[int, int]) -> Column:
    """Number of parts of a row's key, 1 for most."""
    out = F.lit(1)
    for h, n in parts.items():
        out = F.when(F.xxhash64(key) == F.lit(h), F.lit(n)).otherwise(out)
    return out


def part_in(df: DataFrame, key: str, parts: Column) -> Column:
    """The part of its key that a row falls into, by its other columns."""
    plain = [c for c, t in df.dtypes if c != key and not t.startswith("map")]
    return F.pmod(F.xxhash64(*plain) if plain else F.monotonically_increasing_id(), parts).cast("int")


def every_part(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", total: int | None = None, hot: list | None = None, least: int = LEAST_SPLIT) -> DataFrame:
    """left ⋈ right on `key` (same name on both sides), right unique by key; how is left or inner.

    A key with more rows than a task's share is split into parts of that size, and the right rows of just these keys are
    repeated for each part, at most as many times in all as there are tasks. A null key matches nothing; nulls are
    spread like a hot key. total is the number of rows of the left side and hot its sketch(), where they are known from
    writing it; otherwise one job reads the key column, so the left side should be a table, not another join.
    """
    if hot is None and (total is None or total > least):
        hot, total = hot_keys(left, key)
    share = max((total or 0) // _tasks(left.sparkSession), least)
    parts = {x["item"]: math.ceil(x["count"] / share) for x in hot or [] if x["item"] is not None and x["count"] > share}
    if how == "inner":
        parts.pop(_NULL, None)
    if not parts:
        return left.join(right, key, how)
    n = parts_of(key, parts)
    spread = left.withColumn("_part", part_in(left, key, n))
    return spread.join(right.withColumn("_part", every_part(n)), [key, "_part"], how).drop("_part")


def pair_join(left: DataFrame, right: DataFrame, key: str, least: int = LEAST_SPLIT, pairs: int = PAIRS) -> DataFrame:
    """left ⋈ right on `key`, inner, many to many: all pairs of rows of one key.

    A hot key becomes a grid: its left rows are split into a parts, its right rows into b, and each of the a × b cells is
    made by one task, so that no task takes more than its share of rows or more than `pairs` pairs of one key.
    """
    sides, shares = [], []
    for side in (left, right):
        hot, total = hot_keys(side, key)
        sides.append(({x["item"]: x["count"] for x in hot if x["item"] is not None}, max(1, total // COUNTERS)))
        shares.append(max(total // _tasks(side.sparkSession), least))
    (l, floor_l), (r, floor_r) = sides
    rows_l, rows_r = {}, {}
    for h in l.keys() | r.keys():
        nl, nr = l.get(h, floor_l), r.get(h, floor_r)
        a, b = math.ceil(nl / shares[0]), math.ceil(nr / shares[1])
        grow = math.sqrt(max(1.0, nl * nr / pairs / (a * b)))
        a, b = min(nl, math.ceil(a * grow)), min(nr, math.ceil(b * grow))
        if a * b > 1 and h != _NULL:
            rows_l[h], rows_r[h] = a, b
    if not rows_l:
        return left.join(right, key)
    a, b = parts_of(key, rows_l), parts_of(key, rows_r)
    spread = left.withColumn("_a", part_in(left, key, a)).withColumn("_b", every_part(b))
    copies = right.withColumn("_b", part_in(right, key, b)).withColumn("_a", every_part(a))
    return spread.join(copies, [key, "_a", "_b"]).drop("_a", "_b")
