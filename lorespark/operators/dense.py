"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.vectors import cosine


def knn(rows: DataFrame, key: str, vector: str, query: list[float], limit: int = 10, keep: list[str] | None = None) -> DataFrame:
    """(key, keep…, score) of the `limit` most similar rows; filters are put on `rows` before. Null vectors are left out.

    The scan stays where the rows lie, only `limit` rows per task move.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(cosine(F.col(vector).cast("array<double>"), q), 6)
    return rows.where(F.col(vector).isNotNull()).select(key, *(keep or []), score.alias("score")).orderBy(F.desc("score"), key).limit(limit)
