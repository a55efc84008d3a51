"""Dotted version strings as comparable arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that count as white space at the ends of a value.
BLANKS = " \t\r\n\xa0"


def strip(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.btrim(value, F.lit(BLANKS))


def version_key(value: Column | str) -> Column:
    """Segments as numbers, a segment that is no number as 0, a missing version as [] (the lowest).

    Arrays compare element by element, a longer one above its own prefix.
    """
    clean = F.coalesce(strip(value), F.lit(""))
    parts = F.transform(F.split(clean, "[.]"), lambda x: F.coalesce(F.when(F.trim(x).rlike("^[0-9]{1,18}$"), F.trim(x).cast("long")), F.lit(0)))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(parts)


def version_matches(version: Column, versions: Column, wanted: str) -> Column:
    """Membership in the list of versions or equality with the single one."""
    return F.coalesce(F.array_contains(versions, wanted), F.lit(False)) | F.coalesce(version == wanted, F.lit(False))
