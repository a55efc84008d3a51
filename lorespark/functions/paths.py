"""Paths of help pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"(?U)^\s+|\s+$"


def without_version_prefix(path: Column | str, version: Column | None = None) -> Column:
    """The path without a leading `8.x.y.z/` folder, or without the folder of the given version."""
    path = F.col(path) if isinstance(path, str) else path
    plain = F.regexp_replace(path, r"^8\.[0-9]+\.[0-9]+(\.[0-9]+)?/", "")
    if version is None:
        return plain
    own = F.concat(version, F.lit("/"))
    return F.when((F.length(version) > 0) & F.startswith(path, own), F.substr(path, F.length(own) + 1)).otherwise(plain)


def page_key(path: Column | str) -> Column:
    """Equal for all ways to write the path of one help page; null for null.

    Without letter case, direction and number of slashes, leading dots, slashes and version folders, a final
    .html/.htm/.md, a fragment, percent escapes (left as they are if malformed) and blanks at the ends.
    """
    path = F.col(path) if isinstance(path, str) else path
    plain = F.regexp_replace(F.regexp_replace(path, _ENDS, ""), r"(?s)#.*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    clean = F.regexp_replace(F.regexp_replace(decoded, _ENDS, ""), r"[\\/]+", "/")
    clean = F.regexp_replace(F.lower(clean), r"^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+", "")
    return F.regexp_replace(clean, r"\.(html|htm|md)$", "")
