"""What a query looks like: exact names, natural language, significant words; and guards for paths and addresses."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import strip, text_or_empty
from lorespark.operators.catalog import TYPE_HINTS, query_variants

# Words that carry no meaning in a question about the catalogue.
STOPWORDS = frozenset({"метаданные", "metadata", "объект", "object", "найти", "нужен", "нужна", "нужно", "where", "find", "the", "and", "for"}) | {p for k, v in TYPE_HINTS.items() for w in (k, *v) for p in w.lower().split() if len(p) >= 3}
QUESTION_WORDS = ("как", "что", "где", "зачем", "почему", "какой", "чем", "how", "what", "why", "where")
#: Below this score of the best dense hit a keyword search is suggested.
LOW_SCORE = 0.48


def is_exact_name(query: str) -> bool:
    """`Type.Member`: two identifiers with a dot between."""
    return bool(re.fullmatch(r"[^\W\d]\w*\.\w+", (query or "").strip()))


def is_natural_language(query: str) -> bool:
    words = (query or "").strip().lower().split()
    return len(words) >= 3 or bool(words) and words[0] in QUESTION_WORDS or (query or "").strip().endswith("?")


def significant_words(query: str) -> list[str]:
    """Words of four letters or more of a phrase that are no stop words, each once."""
    q = (query or "").strip().lower()
    if " " not in q:
        return []
    return [w for w in dict.fromkeys(re.findall(r"\w+", q)) if len(w) >= 4 and w not in STOPWORDS]


def search_variants(query: str) -> list[str]:
    return list(dict.fromkeys([*query_variants(query), *significant_words(query)]))


def is_safe_url(url: str, hosts: tuple[str, ...] = ()) -> bool:
    """http(s) with a host, without credentials, and one of the hosts if any are given."""
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.hostname) and "@" not in parts.netloc and (not hosts or parts.hostname in hosts)


def inside_base(path: str, base: str) -> bool:
    full, root = posixpath.normpath(posixpath.join(base, path)), posixpath.normpath(base)
    return full == root or full.startswith(root.rstrip("/") + "/")


def low_score_hint(keyword_hits: Column, top_score: Column, any_result: Column) -> Column:
    return ~F.coalesce(keyword_hits, F.lit(False)) & (F.coalesce(top_score, F.lit(0.0)) < LOW_SCORE) & any_result


def without_title_lines(text: Column | str, title: Column | str, breadcrumb: Column) -> Column:
    """The lines of a text but for those that only repeat the title or an entry of the breadcrumb."""
    base = lambda x: F.lower(F.trim(F.substring_index(strip(x), " (", 1)))
    noise = F.concat(F.array(base(title)), F.transform(F.coalesce(breadcrumb, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))))
    lines = F.filter(F.transform(F.split(F.regexp_replace(text_or_empty(text), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.filter(lines, lambda x: ~F.array_contains(noise, F.lower(F.trim(F.substring_index(x, " (", 1))))), "\n")


def first_fact(*values: Column | str, most: int = 1600) -> Column:
    """The first three distinct values that aren't blank, a blank line between, cut to `most` characters."""
    good = F.filter(F.array(*[strip(v) for v in values]), lambda x: x != "")
    return F.substring(F.array_join(F.slice(F.array_distinct(good), 1, 3), "\n\n"), 1, most)


def question_order(question: str, name: Column, title: Column, body: Column, version_desc: Column, path: Column) -> list[Column]:
    """Sort keys of hits for a question: best match of a word in the name, its length, matches in title and body, newest, path."""
    words = sorted(dict.fromkeys(w.lower() for w in re.findall(r"[\w.]+", question or "") if len(w) >= 3), key=lambda w: (-("." in w), -len(w)))
    low_name, low_title, low_body = (F.lower(text_or_empty(c)) for c in (name, title, body))
    rank = lambda c: F.least(*[F.when(c == w, i * 3).when(F.startswith(c, F.lit(w)), i * 3 + 1).when(F.contains(c, F.lit(w)), i * 3 + 2).otherwise(999) for i, w in enumerate(words)], F.lit(999))
    hits = sum((F.when(F.contains(low_body, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return [rank(low_name), rank(low_title), -hits, F.length(low_name), version_desc, path]
