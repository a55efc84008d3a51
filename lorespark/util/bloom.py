"""Bloom filters over any number of keys: one filter of bounded size for each range of the keys' hashes.

The number of ranges follows the number of keys, so the share of false positives stays the same at every size. The
filters are a table (range, words); probing is a join on the range and a few bit tests, all built-in expressions. Up to
BROADCAST_RANGES filters (1 MiB each) are broadcast; more of them meet the rows in a shuffle join by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.util.skew import lookup_join

BITS_PER_KEY = 10
#: Bits of the filter of one range (1 MiB), and the most filters that are broadcast.
RANGE_BITS, BROADCAST_RANGES = 1 << 23, 32


class Bloom:
    """Filter over the values of `key` in `keys` (nulls are left out); n_keys, their number, may be an estimate.

    The filter is made within the plan that probes it, so it should be probed once.
    """

    def __init__(self, keys: DataFrame, key: Column, n_keys: int, range_bits: int = RANGE_BITS, broadcast_ranges: int = BROADCAST_RANGES):
        self.ranges, self.bits = max(1, -(-n_keys * BITS_PER_KEY // range_bits)), range_bits
        while self.ranges == 1 and self.bits > 1 << 12 and self.bits // 2 >= n_keys * BITS_PER_KEY:
            self.bits //= 2
        self.broadcast = self.ranges <= broadcast_ranges
        at = keys.select(key.alias("_k")).where("_k is not null")
        at = at.select(self._range(F.col("_k")).alias("_r"), F.explode(F.array(*self._positions(F.col("_k")))).alias("_p"))
        words = at.select("_r", F.shiftrightunsigned("_p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("b"))
        n = self.bits // 64
        ids = keys.sparkSession.range(self.ranges * n)
        none = ids.select(F.floor(F.col("id") / n).cast("int").alias("_r"), (F.col("id") % n).cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
        one = none.unionByName(words).groupBy("_r", "w").agg(F.bit_or("b").alias("b"))
        # n words for each range, by construction
        self.filters = one.groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("_words"))

    def _range(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("range")), F.lit(self.ranges)).cast("int")

    def _positions(self, key: Column) -> list[Column]:
        """Four positions from the halves of two 64-bit hashes."""
        pair = F.xxhash64(key), F.xxhash64(key, F.lit("second"))
        return [x.bitwiseAND(F.lit(self.bits - 1)) for h in pair for x in (h, F.shiftrightunsigned(h, 32))]

    def mark(self, rows: DataFrame, key: Column, name: str = "_maybe") -> DataFrame:
        """rows with `name`: false only if the key certainly is none of the filter's; null for a null key."""
        hit = F.lit(True)
        for p in self._positions(key):
            bit = F.call_function("shiftrightunsigned", F.get("_words", F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int"))
            hit = hit & (bit.bitwiseAND(F.lit(1)) == 1)
        ranged = rows.withColumn("_r", self._range(key))
        met = ranged.join(F.broadcast(self.filters), "_r", "left") if self.broadcast else lookup_join(ranged, self.filters, "_r")
        return met.withColumn(name, F.when(key.isNotNull(), hit)).select(*rows.columns, name)

    def filter(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows whose key may be one of the filter's."""
        return self.mark(rows, key).where("_maybe").drop("_maybe")
