"""Filling fixed-capacity containers with items: packing controlled by the mixture of sources.

Items are spread over shards of bounded size, whatever their source, so that a source with a third of all rows is as
spread as any other. In each shard a deficit round-robin over the sources' queues fills one window (container) after
the other: a source earns its share of every window's tokens and pays for what is taken, and the source with the
greatest deficit gives its largest item that still fits. Deficits go on from window to window. What a shard starts with
is the debt that all earlier shards leave behind: the source's share of all tokens packed there less its own tokens
there, whether these shards held any of it or not; it is known beforehand from the totals per shard and source.

Each shard may leave one window partly empty, so SHARD_ITEMS sets how much room is lost: for 100,000 documents of 86
million tokens 0.07 % with shards of 100,000 items, 0.22 % with shards of 10,000.
"""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.util.scratch import Scratch

CAPACITY = 4096
#: Items (without their text) that one task packs; only the last window of a shard may stay partly empty.
SHARD_ITEMS = 100_000


def pack_shard(items: list[tuple], capacity: int, share: dict, deficit: dict) -> list[list[tuple]]:
    """Windows of (…, size, source) items, none larger than capacity; deficit is updated."""
    queues: dict = {}
    for it in items:
        queues.setdefault(it[-1], []).append(it)
    for q in queues.values():
        q.sort(key=lambda it: (it[-2], it[0]))
    sizes = {s: [it[-2] for it in q] for s, q in queues.items()}
    windows = []
    while queues:
        room, window = capacity, []
        for s in queues:
            deficit[s] = deficit.get(s, 0.0) + capacity * share.get(s, 0.0)
        ready = [(-deficit[s], s) for s in queues]
        heapq.heapify(ready)
        while ready and (room > 0 or not window):
            s = ready[0][1]
            q, z = queues[s], sizes[s]
            i = bisect.bisect_right(z, room) - 1
            if i < 0:  # none of its items fits into what is left of this window
                heapq.heappop(ready)
                continue
            it = q.pop(i)
            z.pop(i)
            window.append(it)
            room -= it[-2]
            deficit[s] -= it[-2]
            if q:
                heapq.heapreplace(ready, (-deficit[s], s))
            else:
                heapq.heappop(ready)
                del queues[s], sizes[s]
        windows.append(window)
    return windows


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", source: str = "source", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, mixture: dict[str | None, float] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(key, container, piece, pieces, start, size) of items (key, size, source).

    container is a string `shard-window`; an item is one piece unless it is larger than the capacity, then it is cut
    every `capacity` tokens and its last, smaller piece is packed like any other item. Items of size 0 or null size
    take part with size 0; a null source is a source of its own; a repeated key is packed each time it occurs. An
    empty table gives no rows. Only key, size and source are shuffled, never a text.

    mixture gives the target proportions of tokens by source (any positive weights; a source it does not name only fills
    what the others leave); without it every window aims at the proportions of the whole table. As every item is packed,
    a source that the mixture asks more of than there is runs out, and the rest goes on without it.
    """
    scratch = scratch or Scratch(items.sparkSession)
    cut = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("s"))
    pieces = F.greatest(F.ceil(F.col("n") / F.lit(capacity)), F.lit(1)).cast("int")
    cut = cut.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("size", F.when(F.col("piece") + 1 < F.col("pieces"), F.lit(capacity)).otherwise(F.col("n") - F.lit(capacity).cast("long") * (F.col("pieces") - 1)).cast("long"))
    cut = scratch.save(cut)
    total = cut.count()
    shards = max(1, -(-total // shard_items))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int"))
    # totals per shard and source; the deficits a shard starts with
    sums = scratch.save(cut.groupBy("shard", "s").agg(F.sum("size").alias("t")))
    whole = sums.groupBy("s").agg(F.sum("t").alias("all_s"))
    if mixture is None:
        share = F.col("all_s") / F.greatest(sums.agg(F.sum("t")).scalar(), F.lit(1))
    else:
        share = F.lit(0.0)
        for name, weight in mixture.items():
            share = F.when(F.col("s") == ("\u0000" if name is None else name), F.lit(weight / sum(mixture.values()))).otherwise(share)
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # one row for each shard
    packed = sums.groupBy("shard").agg(F.sum("t").alias("t")).select("shard", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("packed"))
    own = F.coalesce(F.sum("t").over(W.partitionBy("s").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grid = sums.withColumn("own", own).join(whole.select("s", share.alias("share")), "s").join(packed, "shard")
    grid = grid.select("shard", "s", "share", (F.col("share") * F.col("packed") - F.col("own")).alias("carried"))
    full = cut.join(grid, ["shard", "s"]).select("shard", "key", "piece", "pieces", "size", "s", "share", "carried")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        first = pdf.drop_duplicates("s")
        share, deficit = dict(zip(first["s"], first["share"])), dict(zip(first["s"], first["carried"]))
        rows = []
        items = list(zip(pdf["key"], pdf["piece"], pdf["pieces"], pdf["size"], pdf["s"]))
        for w, window in enumerate(pack_shard(items, capacity, share, deficit)):
            rows += [(k, f"{shard}-{w}", p, n, p * capacity, z) for k, p, n, z, _ in window]
        return pd.DataFrame(rows, columns=["key", "container", "piece", "pieces", "start", "size"])

    kind = dict(items.dtypes)[key]
    out = full.groupBy("shard").applyInPandas(fill, f"key {kind}, container string, piece int, pieces int, start bigint, size bigint")
    return out.withColumnRenamed("key", key)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_items, used, free) of the result of pack()."""
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("size").alias("used"), (F.lit(capacity) - F.sum("size")).alias("free"))
