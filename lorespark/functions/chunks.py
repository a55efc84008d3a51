"""Overlapping chunks of fixed size and their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import let, strip, text_or_empty

MAX_CHUNK, OVERLAP = 1400, 250
#: Allowed sizes; values outside are set to the nearest end.
CHUNK_RANGE, OVERLAP_RANGE = (400, 1900), (0, 800)


def clamp(value: int, ends: tuple[int, int]) -> int:
    return max(ends[0], min(ends[1], value))


def chunks(text: Column | str, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> Column:
    """Array of chunks; [] for blank text, one chunk if it fits. The overlap is at most half a chunk."""
    stride = size - min(max(0, overlap), size // 2)

    def cut(body: Column) -> Column:
        n = F.when(F.length(body) == 0, 0).when(F.length(body) <= size, 1).otherwise(1 + F.ceil((F.length(body) - size) / stride)).cast("int")
        every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(body, i * stride + 1, F.lit(size)))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(every)

    return let(strip(text), cut)


def chunk_rows(rows: DataFrame, text: str, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk with its place; rows without text give none."""
    made = rows.withColumn("_c", chunks(text, size, overlap)).withColumn("chunk_total", F.size("_c"))
    return made.select(*[c for c in rows.columns if c != text], "chunk_total", F.posexplode("_c").alias("chunk_index", "chunk"))


def document_key(domain: str, body: Column, source_ref: Column, title: Column, url: Column | None = None) -> Column:
    inner = F.substring(F.sha2(F.substring(body, 1, 4000), 256), 1, 24)
    parts = F.concat_ws("|", F.lit(domain), F.lit("") if url is None else text_or_empty(url), text_or_empty(source_ref), text_or_empty(title), inner)
    return F.substring(F.sha2(parts, 256), 1, 16)


def chunk_points(rows: DataFrame, domain: str, text: str) -> DataFrame:
    """Chunks of long items with a common parent key, numbered titles and stable point ids; items of one chunk are left out."""
    body = strip(text)
    base = F.coalesce(F.nullif(F.trim(F.col("title")), F.lit("")), F.lit("document"))
    keyed = rows.withColumn("parent_key", document_key(domain, body, F.col("source_ref"), F.col("title"))).withColumn("title", base)
    made = chunk_rows(keyed, text).where("chunk_total > 1")
    number = F.concat_ws("/", (F.col("chunk_index") + 1).cast("string"), F.col("chunk_total").cast("string"))
    prefix = domain[:8]
    point = F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), "parent_key", F.col("chunk_index").cast("string"), F.col("chunk_total").cast("string")), 256), 1, 16)
    return made.withColumn("title", F.concat("title", F.lit(" · "), number)).withColumn("point_id", F.concat(F.lit(prefix + "_"), point))
