"""Lines or paragraphs that are repeated across a corpus: the earliest one is kept, the rest is removed.

Units are normalised and digested; digests are grouped over the whole corpus; of each group the earliest ranked unit
keeps its text, and every unit comes with its offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join, sketch

#: Characters of a normalised unit from which on a repetition counts; shorter ones (brackets, table rules) stay.
MIN_UNIT = 40
#: What a unit is: a line, or a run of lines without a blank one between.
UNITS = {"line": re.compile(r"[^\r\n]+"), "paragraph": re.compile(r"[^\s](?:(?!\r?\n[^\S\n]*\r?\n|\r[^\S\r\n]*\r).)*", re.S)}
_BLANKS = re.compile(r"[ \t\x0b\x0c\xa0]+")


def normal_unit(text: str) -> str:
    """Blanks put together and taken off the ends; line ends inside of a paragraph count as blanks."""
    return _BLANKS.sub(" ", text.replace("\r", " ").replace("\n", " ")).strip(" ")


def _units(docs: DataFrame, unit: str, least: int) -> DataFrame:
    """(doc, begin, end, digest binary) of the units of at least so many normalised characters."""
    pattern = UNITS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(b["doc"].to_pylist(), b["text"].to_pylist()):
                for m in pattern.finditer(text or ""):
                    if m.end() - m.start() < least:
                        continue
                    normal = normal_unit(m[0])
                    if len(normal) >= least:
                        for column, value in zip(out, (doc, m.start(), m.end(), hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest())):
                            column.append(value)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc", "begin", "end", "digest"])
                    out = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc", "begin", "end", "digest"])

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return docs.select("doc", "text").mapInArrow(cut, "doc long, begin int, end int, digest binary")


def repeated_units(documents: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", least: int = MIN_UNIT, scratch: Scratch | None = None) -> DataFrame:
    """(key, begin, end, first_doc, kept) of every unit that occurs more than once, within one text too.

    Occurrences are ranked by key, then by offset; only the first of all is kept. Rows with a null key or a null or empty
    text have no units; rows with the same key count as one document and equal units of them at one place as one unit. A
    unit that stands in a third of all documents is summed up before it moves and salted when it is looked up.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text <> ''")
    units, n = scratch.save_counting(_units(docs, unit, least), k=F.count(F.lit(1)), hot=sketch("digest"))
    first = units.groupBy("digest").agg(F.min(F.struct("doc", "begin")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    met = lookup_join(units, first, "digest", "inner", total=n["k"], hot=n["hot"])
    kept = (F.col("doc") == F.col("first.doc")) & (F.col("begin") == F.col("first.begin"))
    return met.select(F.col("doc").alias(key), "begin", "end", F.col("first.doc").alias("first_doc"), kept.alias("kept")).distinct()


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", least: int = MIN_UNIT, scratch: Scratch | None = None) -> DataFrame:
    """(key, removed, text) of every row: the text without the units that repeated_units() does not keep, and their number.

    The line ends around a removed unit stay. A null text stays null, a row with a null key or without repetitions as it is.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    gone = repeated_units(documents, key, text, unit, least, scratch).where("not kept").select(F.col(key).alias("_doc"), "begin", "end")
    # as many as a text has units
    spans = scratch.save(gone.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")))
    met = documents.select(key, F.col(text).alias("text")).join(spans, F.col(key).cast("long") == F.col("_doc"), "left").drop("_doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                at, parts = 0, []
                for s in spans or []:
                    parts.append(t[at : s["begin"]])
                    at = s["end"]
                texts.append(None if t is None else "".join([*parts, t[at:]]))
                counts.append(len(spans or []))
            yield pa.RecordBatch.from_arrays([b[key], pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=[key, "removed", "text"])

    return met.mapInArrow(cut, f"`{key}` {dict(documents.dtypes)[key]}, removed int, text string")
