"""Splitting oversized items at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120
BLANKS = " \t\r\n\xa0"
#: Strength of a boundary, the weakest is merged first.
HARD, WORD, SENTENCE, STATEMENT, LINE, PARAGRAPH = range(6)
KINDS = ("hard", "word", "sentence", "statement", "line", "paragraph")
_NATURAL = re.compile(
    r"(?P<paragraph>(?:\r\n|\r|\n)[ \t\xa0]*(?:(?:\r\n|\r|\n)[ \t\xa0]*)+)"
    r"|(?P<line>\r\n|\r|\n)"
    r"|(?P<statement>;[ \t\xa0]*(?=[^\r\n])|\b(?:КонецПроцедуры|КонецФункции|КонецЕсли|КонецЦикла|EndProcedure|EndFunction|EndIf|EndDo)\b[ \t]*(?=[^\r\n;]))"
    r"|(?P<sentence>[.!?…]+[\"'»”)\]]*[ \t\xa0]+)"
)
_WORD = re.compile(r"\s+")


def _boundaries(text: str, start: int, end: int, most: int) -> tuple[list[int], list[int]]:
    """Cut places (the end is the last) and their strengths; segments above `most` are cut at words, then anywhere."""
    cuts, strengths = [], []

    def put(at: int, strength: int) -> None:
        last = cuts[-1] if cuts else start
        if at <= last:
            return
        if at - last > most and strength > WORD:
            for m in _WORD.finditer(text, last, at):
                if last < m.end() < at:
                    put(m.end(), WORD)
            put(at, -strength)
            return
        strength = abs(strength)
        while at - last > most:
            cut = last + most
            # a mark or the second half of CR LF stays with what it belongs to
            while cut > last + 1 and (cut < len(text) and unicodedata.category(text[cut])[0] == "M" or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            cuts.append(cut)
            strengths.append(HARD)
            last = cut
        cuts.append(at)
        strengths.append(strength)

    for m in _NATURAL.finditer(text, start, end):
        if m.end() < end:
            put(m.end(), next(k for k in (PARAGRAPH, LINE, STATEMENT, SENTENCE) if m.group(KINDS[k])))
    put(end, PARAGRAPH)
    return cuts, strengths


def split_item(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, core start, kind of the cut at the end) of the pieces of one item.

    The cores, put together, are the item without the blanks at both ends. Each piece but the first begins `overlap`
    characters before its core (or where the item begins). Atomic segments between all boundaries are merged pairwise
    out of a heap, the weakest boundary first, of equals the smaller pair, as long as the core and its overlap fit.
    """
    n = len(text)
    start = n - len(text.lstrip(BLANKS))
    end = start + len(text.strip(BLANKS))
    if end - start <= limit:
        return [(start, end, start, "end")]
    room = limit - overlap
    cuts, strengths = _boundaries(text, start, end, room)
    k = len(cuts)
    begin = [start, *cuts[:-1]]
    finish = cuts[:]
    right = list(range(1, k)) + [-1]
    left = [-1, *range(k - 1)]
    live = [True] * k
    heap = [(strengths[i], finish[i + 1] - begin[i], begin[i], i, i + 1) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, _, i, j = heapq.heappop(heap)
        if not (live[i] and live[j] and right[i] == j and finish[j] - begin[i] == size):
            continue
        if size > (limit if left[i] < 0 else room):
            continue
        finish[i], right[i] = finish[j], right[j]
        strengths[i] = strengths[j]
        live[j] = False
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (strengths[i], finish[right[i]] - begin[i], begin[i], i, right[i]))
        if left[i] >= 0:
            p = left[i]
            heapq.heappush(heap, (strengths[p], finish[i] - begin[p], begin[p], p, i))
    out = []
    for i in range(k):
        if live[i]:
            out.append((max(start, begin[i] - overlap), finish[i], begin[i], KINDS[strengths[i]] if finish[i] < end else "end"))
    return out


def is_oversized(text: Column, limit: int = LIMIT) -> Column:
    return F.length(F.btrim(text, F.lit(BLANKS))) > limit


def split_oversized(items: DataFrame, tab: str, key: str, fields: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tab, item_id, field, piece, pieces, start, end, core, cut, text) of every item: a field of a row of `items`.

    Items of at most `limit` characters without the blanks at both ends are one piece and never leave the JVM; the
    others are cut by split_item(). start, end and core are offsets in the field as delivered; text is what stands
    between start and end. Null fields are no items, empty and blank ones a piece of length 0. A repeated key is split
    each time it occurs; further columns are ignored.
    """
    long = items.select(F.col(key).alias("item_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("e"))
    long = long.select(F.lit(tab).alias("tab"), "item_id", "e.field", "e.text").where(F.col("text").isNotNull())
    head = F.length("text") - F.length(F.ltrim("text", F.lit(BLANKS)))
    body = F.btrim("text", F.lit(BLANKS))
    small = long.where(~is_oversized(F.col("text"), limit)).select(
        "tab", "item_id", "field", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), head.alias("start"), (head + F.length(body)).alias("end"), head.alias("core"), F.lit("end").alias("cut"), body.alias("text")
    )
    kind = dict(items.dtypes)[key]
    schema = f"tab string, item_id {kind}, field string, piece int, pieces int, start int, end int, core int, cut string, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], ([], [], [], [], [], [], [])
            for i, text in enumerate(b["text"].to_pylist()):
                pieces = split_item(text, limit, overlap)
                for p, (s, e, core, how) in enumerate(pieces):
                    at.append(i)
                    for column, value in zip(rows, (p, len(pieces), s, e, core, how, text[s:e])):
                        column.append(value)
            took = b.take(pa.array(at, pa.int64()))
            kinds = (pa.int32(),) * 5 + (pa.string(),) * 2
            made = [pa.array(c, t) for c, t in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([took["tab"], took["item_id"], took["field"], *made], names=["tab", "item_id", "field", "piece", "pieces", "start", "end", "core", "cut", "text"])

    large = long.where(is_oversized(F.col("text"), limit)).mapInArrow(cut, schema)
    return small.unionByName(large)
