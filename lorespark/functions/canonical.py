"""Canonical forms that make equal values equal as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_GUID = "00000000-0000-0000-0000-000000000000"


def json_canonical(value: Column | str) -> Column:
    """JSON text with sorted keys, no blanks and one way of escaping; null and JSON null become {}.

    Text that is no JSON, or that repeats a key, is kept as it is behind a mark, so that it equals only itself.
    """
    value = F.col(value) if isinstance(value, str) else value
    parsed = F.to_json(F.try_parse_json(value))
    out = F.coalesce(parsed, F.concat(F.lit("\u0000"), value), F.lit("{}"))
    return F.when(out == "null", F.lit("{}")).otherwise(out)


def json_hash(value: Column | str) -> Column:
    """64-bit hash of the canonical form; only hashes of one key are ever compared with each other."""
    return F.xxhash64(json_canonical(value))


def guid(value: Column | str) -> Column:
    """Lower case without surrounding braces and white space; null for null, empty and the zero GUID."""
    value = F.col(value) if isinstance(value, str) else value
    clean = F.lower(F.regexp_replace(value, r"(?U)^[\s{]+|[\s}]+$", ""))
    return F.when((clean != "") & (clean != ZERO_GUID), clean)
