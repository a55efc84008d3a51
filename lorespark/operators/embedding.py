"""Embedding of texts by a pluggable backend: each distinct text once, kept in a table by its hash."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.vectors import token_hash_vector

Backend = Callable[[list[str]], list[list[float]]]


def resilient(texts: list[str], backend: Backend, dimension: int, attempts: int = 3, wait: float = 0.5) -> list[list[float]]:
    """Vectors of a batch: a failing batch is tried again, then halved; a single text that fails gets the hashed vector."""
    for n in range(attempts):
        try:
            out = backend(texts)
            if len(out) == len(texts):
                return [list(map(float, v)) for v in out]
        except Exception:  # noqa: BLE001 - whatever the backend raises counts as a failed attempt
            if n + 1 < attempts:
                time.sleep(wait * 2**n)
    if len(texts) == 1:
        return [token_hash_vector(texts[0], dimension)]
    half = len(texts) // 2
    return resilient(texts[:half], backend, dimension, attempts, wait) + resilient(texts[half:], backend, dimension, attempts, wait)


def embed(rows: DataFrame, text: str, backend: Backend | None = None, dimension: int = 64, batch: int = 32, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with `vector`, new cache entries (text_hash, vector)); null texts have a null vector.

    Only texts that the cache doesn't hold are embedded, each once, in batches of `batch`.
    """
    backend = backend or (lambda texts: [token_hash_vector(t, dimension) for t in texts])
    keyed = rows.withColumn("text_hash", F.sha2(F.col(text), 256))
    todo = keyed.where(F.col(text).isNotNull()).groupBy("text_hash").agg(F.any_value(text).alias("_text"))
    if cache is not None:
        todo = todo.join(cache.select("text_hash"), "text_hash", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, out = list(part["_text"]), []
            for i in range(0, len(texts), batch):
                out += resilient(texts[i : i + batch], backend, dimension)
            yield pd.DataFrame({"text_hash": part["text_hash"], "vector": out})

    new = todo.mapInPandas(run, "text_hash string, vector array<double>")
    known = new if cache is None else cache.select("text_hash", "vector").unionByName(new)
    return keyed.join(known, "text_hash", "left").drop("text_hash"), new
