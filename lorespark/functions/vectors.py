"""Vectors as arrays of doubles."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def placeholder(text: Column, dimension: int = 64) -> Column:
    """(byte i of the SHA-256, repeated) scaled to [-1, 1)."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)


def token_hash_vector(text: str | None, dimension: int) -> list[float]:
    clean = unicodedata.normalize("NFC", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text or ""))
    found = re.findall(r"\w+|[^\w\s]", clean.lower())
    out = [0.0] * dimension
    for i, t in enumerate(found):
        out[i % dimension] += (int.from_bytes(hashlib.sha256(t.encode("utf-8", "replace")).digest()[:4], "big") % 256 - 128) / 128
    return [x / max(len(found), 1) for x in out]


def deterministic(text: Column, dimension: int = 64) -> Column:
    """Vector of hashed tokens; zeros for a text without any (Arrow batches: Spark has no normal forms)."""

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: token_hash_vector(t, dimension))

    return embed(text)
