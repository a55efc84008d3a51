"""Long exact spans shared between records.

Units of text are hashed, their digests grouped over the whole corpus and the offsets of every unit kept. Whole lines
would miss a span that begins and ends inside lines, so the units are spans of SEED characters at places that the text
itself selects: in every run of MIN_CHARS characters the unit with the least hash. Two texts that share such a run
select the same unit in it. A shared digest is then verified on the characters around it (never more than the run can
reach), so the result is exact.

Identical texts are one text until the very end, and identical surroundings of one unit are one class; comparisons run
between classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.llm.tokenizer import _blocks
from lorespark.util.bloom import Bloom
from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join, pair_join

MIN_CHARS = 200
SEED = 100
#: Characters of text that are hashed at a time in one task.
BLOCK_CHARS = 4_000_000
#: Up to so many different surroundings of one unit are compared directly, more of them through the hashes of their windows.
DIRECT_CLASSES = 64


def _sliding(op, values: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """op over each window of `width` values beginning (back: ending) at every place; the ends see shorter windows."""
    out, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        if len(out) <= step:
            break
        if back:
            out[step:] = op(out[step:], out[:-step].copy())
        else:
            out[:-step] = op(out[:-step], out[step:])
        span += step
    return out


def select_units(texts: list[str], min_chars: int = MIN_CHARS, seed: int = SEED, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, offset) of the selected units of all texts.

    Of equal units that overlap by half or more (a repeated pattern) only the first two and the last two of the row are
    kept, the row taken over its whole length: whatever run two texts share there shows in one of these alignments.
    every = True keeps them all, which the offsets of all shared characters need.
    """
    none = np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    if n < min_chars:
        return none, none, none
    width = min_chars - seed + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        base = 0x9E3779B97F4A7C15
        power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * power, out=sums[1:])
        m = n - seed + 1
        h = (sums[seed:] - sums[:-seed]) * inverse[:m]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    whole = text_of[:m] == text_of[seed - 1 :]
    h[~whole] = np.iinfo(np.uint64).max
    least = _sliding(np.minimum, h, width)
    inside = np.zeros(m, bool)
    inside[: n - min_chars + 1] = text_of[: n - min_chars + 1] == text_of[min_chars - 1 :]
    least[~inside] = 0
    chosen = np.flatnonzero((_sliding(np.maximum, least, width, back=True) == h) & whole)
    if not len(chosen):
        return none, none, none
    order = np.lexsort((chosen, h[chosen], text_of[chosen]))
    at = chosen[order]
    same = (h[at][1:] == h[at][:-1]) & (text_of[at][1:] == text_of[at][:-1])
    linked = np.r_[False, same & (np.diff(at) * 2 <= seed)]
    if linked.any() and not every:
        heads = np.flatnonzero(~linked)
        lasts = np.r_[heads[1:], len(at)] - 1
        rows = heads != lasts
        keep = [at[heads[~rows]]]
        for a, b in zip(heads[rows], lasts[rows]):
            first, last, step = int(at[a]), int(at[b]), int(np.diff(at[a : b + 1]).min())
            while first - step >= 0 and h[first - step] == h[first] and text_of[first - step] == text_of[first]:
                first -= step
            while last + step < m and h[last + step] == h[last] and text_of[last + step] == text_of[last]:
                last += step
            keep.append(np.unique([first, min(first + step, last), max(last - step, first), last]))
        at = np.concatenate(keep)
    return h[at].view(np.int64), text_of[at], at - (ends - sizes)[text_of[at]]


def _units(docs: DataFrame, min_chars: int, seed: int, every: bool) -> DataFrame:
    """(h, doc, g, at) of all selected units; g is a hash of the whole text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for held in _blocks(batches, "text", BLOCK_CHARS):
            t = pa.Table.from_batches(held)
            texts, doc, g = [x or "" for x in t["text"].to_pylist()], t["doc"].to_numpy(), t["g"].to_numpy()
            starts = [0]
            if len(texts) == 1 and len(texts[0]) > BLOCK_CHARS:  # every run lies whole in one of the parts
                starts = list(range(0, len(texts[0]), BLOCK_CHARS))
            for start in starts:
                part = texts if len(starts) == 1 else [texts[0][start : start + BLOCK_CHARS + min_chars - 1]]
                h, i, at = select_units(part, min_chars, seed, every)
                yield from pa.table({"h": h, "doc": doc[i], "g": g[i], "at": (at + start).astype(np.int32)}).to_batches()

    return docs.select("doc", F.xxhash64("text").alias("g"), "text").mapInArrow(find, "h long, doc long, g long, at int")


def _surroundings(rows: DataFrame, min_chars: int, seed: int) -> DataFrame:
    """(doc, text, places array<struct<h,at>>) → (h, doc, start, off, ctx): the characters a run over the unit can reach."""
    reach = min_chars - seed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, places in zip(b["doc"].to_pylist(), b["text"].to_pylist(), b["places"].to_pylist()):
                for p in places:
                    start = max(0, p["at"] - reach)
                    for column, value in zip(out, (p["h"], doc, start, p["at"] - start, text[start : p["at"] + seed + reach])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["h", "doc", "start", "off", "ctx"])

    return rows.select("doc", "text", "places").mapInArrow(cut, "h long, doc long, start int, off int, ctx string")


def common_run(a: str, off_a: int, b: str, off_b: int, seed: int) -> tuple[int, int] | None:
    """How far left of and right of the unit's begin the two surroundings agree; None if the units differ."""
    if a[off_a : off_a + seed] != b[off_b : off_b + seed]:
        return None
    left = 0
    while left < min(off_a, off_b) and a[off_a - left - 1] == b[off_b - left - 1]:
        left += 1
    right, most = seed, min(len(a) - off_a, len(b) - off_b)
    while right < most and a[off_a + right] == b[off_b + right]:
        right += 1
    return left, right


def _direct(grouped: DataFrame, min_chars: int, seed: int) -> DataFrame:
    """(h, classes array) → edges between the classes of one unit, each class also with itself if it has two texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for h, classes in zip(b["h"].to_pylist(), b["classes"].to_pylist()):
                for i, x in enumerate(classes):
                    for y in classes[i:]:
                        if x is y and x["n"] < 2:
                            continue
                        run = common_run(x["ctx"], x["off"], y["ctx"], y["off"], seed)
                        if run and sum(run) >= min_chars:
                            for column, value in zip(out, (h, x["c"], y["c"], *run)):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.int32(),) * 2)], names=["h", "ca", "cb", "left", "right"])

    return grouped.mapInArrow(compare, "h long, ca long, cb long, left int, right int")


def _windows(classes: DataFrame, min_chars: int, seed: int) -> DataFrame:
    """(h, c, n, off, ctx) → (h, c, n, i, w): digests of all runs of min_chars characters over the unit, begun at i from it."""
    reach = min_chars - seed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for h, c, n, off, ctx in zip(*(b[k].to_pylist() for k in ("h", "c", "n", "off", "ctx"))):
                for s in range(max(0, off - reach), min(off, len(ctx) - min_chars) + 1):
                    digest = hashlib.blake2b(ctx[s : s + min_chars].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for column, value in zip(out, (h, c, n, s - off, digest)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["h", "c", "n", "i", "w"])

    return classes.select("h", "c", "n", "off", "ctx").mapInArrow(cut, "h long, c long, n long, i int, w binary")


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, begin, end, first) sorted by doc and begin → (doc, begin, end, first_doc): disjoint, the least first of all over a place."""
    import heapq

    names, kinds = ["doc", "begin", "end", "first_doc"], (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    out: list[list] = []  # the last stretch may still grow
    heap: list[tuple[int, int]] = []
    doc, at = None, 0

    def advance(to: float) -> None:
        nonlocal at
        while heap and at < to:
            first, end = heap[0]
            if end <= at:
                heapq.heappop(heap)
                continue
            stop = min(end, to)
            if out and out[-1][0] == doc and out[-1][2] == at and out[-1][3] == first:
                out[-1][2] = stop
            else:
                out.append([doc, at, stop, first])
            at = stop

    def flush(n: int) -> pa.RecordBatch:
        done = out[:n]
        del out[:n]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(kinds)], names=names)

    for b in batches:
        for d, begin, end, first in zip(*(b[k].to_pylist() for k in ("doc", "begin", "end", "first"))):
            if d != doc:
                advance(float("inf"))
                doc, at = d, begin
            advance(begin)
            at = begin
            heapq.heappush(heap, (first, end))
        if len(out) > 1:
            yield flush(len(out) - 1)
    advance(float("inf"))
    if out:
        yield flush(len(out))


class SharedSpans:
    """Shared spans of documents (key, text); see the module's text.

    Rows with a null key, a null text or fewer than min_chars characters share nothing; an empty table gives no rows.
    Characters are code points and compare as they are. Further columns are ignored.
    """

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, seed: int = SEED, direct: int = DIRECT_CLASSES, every: bool = False, scratch: Scratch | None = None):
        self.min, self.seed, self.key, self.every = min_chars, seed, key, every
        self.scratch = scratch or Scratch(documents.sparkSession)
        save = self.scratch.save
        docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
        # identical texts: the one with the least key stands for all
        digests = save(docs.select("doc", F.unhex(F.md5("text")).alias("d"), F.length("text").alias("size")))
        groups = digests.groupBy("d").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1").select("d", "rep")
        self.copies = save(lookup_join(digests, groups, "d", "inner").select("doc", "rep", "size"))
        # digests of units that occur in different texts
        units = _units(docs, min_chars, seed, every)
        shared = units.groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("h")
        shared, n = self.scratch.save_counting(shared, k=F.count(F.lit(1)))
        places = save(Bloom(shared, F.col("h"), n["k"]).filter(units, F.col("h")).select("h", "doc", "at"))
        others = self.copies.where("doc <> rep").select("doc")
        places = lookup_join(places, shared, "h", "inner").join(others, "doc", "left_anti")
        # as many places as a text has units
        places, n = self.scratch.save_counting(places.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("places")), k=F.count(F.lit(1)))
        with_text = Bloom(places, F.col("doc"), n["k"]).filter(docs, F.col("doc")).join(places, "doc")
        rows = _surroundings(with_text, min_chars, seed).withColumn("c", F.xxhash64("h", "off", "ctx"))
        rows = save(rows)
        self.rows = rows.select("h", "c", "doc", "start", "off")
        classes = rows.groupBy("h", "c", "off", "ctx").agg(F.countDistinct("doc").alias("n"), F.min(F.struct("doc", "start")).alias("first"))
        classes = save(classes)
        counts = classes.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("docs")).where("docs > 1").select("h", "k")
        counted = lookup_join(classes, counts, "h", "inner")
        few = counted.where(F.col("k") <= direct).groupBy("h").agg(F.collect_list(F.struct("c", "off", "ctx", "n")).alias("classes"))
        self.classes = classes
        self.edges = save(_direct(few, min_chars, seed))
        self.wide = save(_windows(counted.where(F.col("k") > direct), min_chars, seed))

    def _holders(self, rows: DataFrame, *group: str) -> DataFrame:
        """(group…, set) of rows (group…, doc): a digest of the set of documents of each group.

        Sets are told apart by their size, their least and greatest key and two independent 64-bit sums over the keys.
        """
        mixed = [F.bit_xor(F.xxhash64("doc", F.lit(x))) for x in ("one", "two")]
        return rows.groupBy(*group).agg(F.struct(mixed[0].alias("x"), mixed[1].alias("y"), F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).alias("set"))

    def members(self) -> DataFrame:
        """(doc, rep): every document that has copies, with the one of least key that stands for all of them."""
        return self.copies.select("doc", "rep")

    def links(self) -> DataFrame:
        """(ra, rb): pairs of representatives with a common run, smaller key first, each once; with members() all pairs."""
        save, key = self.scratch.save, lambda c: F.struct(F.col("h"), F.col(c).alias("c"))
        members = save(self.rows.select(key("c").alias("k"), "doc").distinct())
        # neighbouring units of one passage have the same holders: one pair of classes stands for all of these
        holders = save(self._holders(members, "k"))
        pairs = self.edges.select(key("ca").alias("ka"), key("cb").alias("kb"))
        pairs = save(lookup_join(pairs, holders.select(F.col("k").alias("ka"), F.col("set").alias("sa")), "ka", "inner"))
        pairs = lookup_join(pairs, holders.select(F.col("k").alias("kb"), F.col("set").alias("sb")), "kb", "inner")
        pairs = save(pairs.groupBy("sa", "sb").agg(F.min(F.struct("ka", "kb")).alias("p")).select("p.*"))
        left = save(pair_join(members.select(F.col("k").alias("ka"), F.col("doc").alias("da")), pairs, "ka").select("kb", "da"))
        both = pair_join(left, members.select(F.col("k").alias("kb"), F.col("doc").alias("db")), "kb")
        # and so have neighbouring windows: one window stands for all with the same holders
        window = save(self.wide.select(key("c").alias("k"), F.struct("h", "i", "w").alias("g")))
        inside = save(pair_join(window, members, "k").select("g", "doc").distinct())
        groups = self._holders(inside, "g").where("set.n > 1").groupBy("set").agg(F.min("g").alias("g")).select("g")
        inside = save(lookup_join(inside, groups, "g", "inner"))
        wide = pair_join(inside.select("g", F.col("doc").alias("da")), inside.select("g", F.col("doc").alias("db")), "g")
        both = both.select("da", "db").unionByName(wide.select("da", "db"))
        return both.where("da <> db").select(F.least("da", "db").alias("ra"), F.greatest("da", "db").alias("rb")).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b): every pair of different documents with a common run, smaller key first, once.

        Made from links() and members(); a group of copies is split on both sides by its size.
        """
        save, links, copies = self.scratch.save, self.scratch.save(self.links()), self.members()
        single = links.select(F.explode(F.array("ra", "rb")).alias("rep")).distinct().join(copies.select("rep").distinct(), "rep", "left_anti")
        every = save(single.select("rep", F.col("rep").alias("doc")).unionByName(copies.select("rep", "doc")))
        left = save(pair_join(links, every.select(F.col("rep").alias("ra"), F.col("doc").alias("x")), "ra").select("rb", "x"))
        wider = pair_join(left, every.select(F.col("rep").alias("rb"), F.col("doc").alias("y")), "rb").select("x", "y")
        twins = pair_join(copies.select("rep", F.col("doc").alias("x")), copies.select("rep", F.col("doc").alias("y")), "rep").where("x < y").select("x", "y")
        return wider.unionByName(twins).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def _stretches(self) -> DataFrame:
        """(doc, begin, end, first_doc): the passages of texts without copies and of the first of each group of copies."""
        if not self.every:
            raise ValueError("passages need every=True")
        e, save, key = self.edges, self.scratch.save, lambda c: F.struct(F.col("h"), F.col(c).alias("c"))
        first = save(self.classes.select(key("c").alias("k"), F.col("first.doc").alias("first")))
        sides = e.select(key("ca").alias("to"), key("cb").alias("k"), "left", "right").unionByName(e.select(key("cb").alias("to"), key("ca").alias("k"), "left", "right"))
        sides = lookup_join(save(sides), first, "k", "inner").select(F.col("to").alias("k"), "left", "right", "first")
        wide = save(lookup_join(self.wide.select(key("c").alias("k"), F.struct("h", "i", "w").alias("g"), "n"), first, "k", "inner"))
        least = wide.groupBy("g").agg(F.sum("n").alias("docs"), F.min("first").alias("least")).where("docs > 1").select("g", "least")
        wide = lookup_join(wide, least, "g", "inner").select("k", (-F.col("g.i")).alias("left"), (F.col("g.i") + self.min).alias("right"), F.col("least").alias("first"))
        reach = sides.unionByName(wide).groupBy("k", "left", "right").agg(F.min("first").alias("first"))
        # what reaches no further than an earlier holder says nothing new
        earlier = W.partitionBy("k").orderBy("first", F.desc("left"), F.desc("right")).rowsBetween(W.unboundedPreceding, -1)
        reach = reach.withColumn("far_l", F.max("left").over(earlier)).withColumn("far_r", F.max("right").over(earlier))
        reach = reach.where("far_l is null or left > far_l or right > far_r").drop("far_l", "far_r")
        parts = pair_join(self.rows.select(key("c").alias("k"), "doc", "start", "off"), save(reach), "k")
        parts = parts.select("doc", (F.col("start") + F.col("off") - F.col("left")).alias("begin"), (F.col("start") + F.col("off") + F.col("right")).alias("end"), F.least("first", "doc").alias("first"))
        # a copy shares all of its text
        parts = parts.unionByName(self.copies.where("doc = rep").select("doc", F.lit(0).alias("begin"), F.col("size").alias("end"), F.col("doc").alias("first")))
        return parts.repartition("doc").sortWithinPartitions("doc", "begin").mapInArrow(_by_first, "doc long, begin int, end int, first_doc long")

    def passages(self) -> DataFrame:
        """(doc, begin, end, first_doc): what of every document stands elsewhere too, cut where first_doc changes.

        first_doc is the least key that holds a run of min_chars characters over the place. Where it is the document
        itself the stretch is kept, elsewhere it is removed; begin and end are the original offsets. What is removed is
        always kept in an earlier document. A stretch may be shorter than min_chars, the runs it is cut from are not.
        The other copies of a text get the rows of the first; of a group with a third of all documents they are salted.
        Needs every = True.
        """
        found = self.scratch.save(self._stretches())
        copies = self.copies.where("doc <> rep").select("doc", "rep")
        again = pair_join(copies, found.withColumnRenamed("doc", "rep"), "rep").drop("rep")
        return found.unionByName(again)

    def shared(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """(key, n_chars, shared_chars) of every document; 0 for texts that share nothing, null for a null text."""
        found, copies = self._stretches(), self.copies
        sums = found.groupBy("doc").agg(F.sum(F.col("end") - F.col("begin")).alias("s"))
        every = documents.select(F.col(self.key).cast("long").alias("doc"), F.length(text).alias("n_chars"))
        out = every.join(sums, "doc", "left").join(copies.select("doc", F.lit(True).alias("copy")).distinct(), "doc", "left")
        shared = F.when(F.col("n_chars").isNull(), None).when(F.col("copy"), F.col("n_chars")).otherwise(F.coalesce("s", F.lit(0))).cast("long")
        return out.select(F.col("doc").alias(self.key), "n_chars", shared.alias("shared_chars"))
