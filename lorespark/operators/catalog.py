"""Lookups in a catalogue of named things: exact, by prefix, by substring, and cascades of these."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespark.functions.text import any_of, match_rank, text_or_empty

# Object types and the words of a query that hint at them, in the order they are tried.
TYPE_HINTS = {
    "Constant": ["констант", "constant", "constants"],
    "Document": ["документ", "document"],
    "Catalog": ["справочник", "catalog"],
    "InformationRegister": ["регистр сведений", "informationregister"],
    "AccumulationRegister": ["регистр накопления", "accumulationregister"],
    "Report": ["отчет", "отчёт", "report"],
    "DataProcessor": ["обработка", "dataprocessor"],
    "Enum": ["перечисление", "enumeration", "enum"],
}


def guess_type(query: str) -> str | None:
    q = (query or "").strip().lower()
    return next((t for t, hints in TYPE_HINTS.items() if any(h in q for h in hints)), None)


def query_variants(query: str) -> list[str]:
    """The lower-case query, without its blanks, and its parts between slashes."""
    q = (query or "").strip().lower()
    out = [q, q.replace(" ", ""), *([p for p in q.split("/") if p] if "/" in q else [])]
    return [v for v in dict.fromkeys(out) if v]


def match_priority(columns: list[Column], variants: list[str]) -> Column:
    """0 if a column equals a variant, 1 prefix, 2 contained, 3 none."""
    low = [F.lower(text_or_empty(c)) for c in columns]
    return reduce(F.least, [match_rank(v, low) for v in variants]) if len(variants) > 1 else match_rank(variants[0], low)


def exact_lookup(rows: DataFrame, fields: list[str], values: list[str], key: list[str], limit: int) -> DataFrame:
    """Rows one of whose fields equals one of the values; earlier fields and values first; one row per key."""
    hit = F.array_min(F.filter(F.array(*[F.when(F.col(f) == v, F.lit(i * len(values) + j)) for i, f in enumerate(fields) for j, v in enumerate(values)]), lambda x: x.isNotNull()))
    found = rows.where(any_of([F.coalesce(F.col(f).isin(values), F.lit(False)) for f in fields])).withColumn("priority", hit)
    first = W.partitionBy(*key).orderBy("priority", *[F.col(c) for c in rows.columns if c not in key])
    one = found.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return one.orderBy("priority", *key).limit(limit)


def substring_lookup(rows: DataFrame, fields: list[str], query: str, order: list[str], limit: int) -> DataFrame:
    """Rows by match priority (exact, prefix, contained), then by `order`; all rows are looked at."""
    ranked = rows.withColumn("priority", match_priority([F.col(f) for f in fields], query_variants(query)))
    return ranked.where("priority <= 2").orderBy("priority", *order).limit(limit)


def cascade(legs: list[DataFrame]) -> DataFrame:
    """The rows of the first leg that has any, marked with its number; one plan, no look at results on the driver.

    Legs are hit lists that their limits keep small.
    """
    marked = [leg.withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)]
    every = reduce(DataFrame.unionByName, marked)
    return every.withColumn("_min", F.min("leg").over(W.partitionBy())).where("leg = _min").drop("_min")


def first_wins(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Keyed distinct that keeps the first row in the given order."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
