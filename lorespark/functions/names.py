"""Ids, labels, displays and summaries of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import strip, text_or_empty

# Primitive types of the catalogue and how they are shown.
TYPE_NAMES = {"xs:string": "Строка", "xs:decimal": "Число", "xs:boolean": "Булево", "xs:dateTime": "Дата", "v8:UUID": "УникальныйИдентификатор"}
# Object types and the accessor their objects are reached by.
MANAGERS = {"Catalog": "Справочники", "Document": "Документы", "Enum": "Перечисления", "Report": "Отчеты", "DataProcessor": "Обработки", "Constant": "Константы", "InformationRegister": "РегистрыСведений", "AccumulationRegister": "РегистрыНакопления"}


def object_id(kind: Column | str, name: Column | str) -> Column:
    return F.concat(strip(kind), F.lit("."), strip(name))


def accessor(kind: Column, name: Column) -> Column:
    """`Справочники.Имя`; null for a type without a manager."""
    pairs = F.create_map(*[F.lit(x) for p in MANAGERS.items() for x in p])
    return F.concat(F.try_element_at(pairs, kind), F.lit("."), name)


def type_display(kind: Column, length: Column | None = None, precision: Column | None = None) -> Column:
    """Readable type with its length or digits: `Строка(50)`, `Число(15,2)`."""
    pairs = F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p])
    name = F.coalesce(F.try_element_at(pairs, kind), kind)
    out = name
    if length is not None:
        out = F.when((name == "Строка") & (length > 0), F.concat(name, F.lit("("), length.cast("string"), F.lit(")"))).otherwise(out)
    if precision is not None and length is not None:
        out = F.when((name == "Число") & (length > 0), F.concat(name, F.lit("("), length.cast("string"), F.lit(","), F.coalesce(precision, F.lit(0)).cast("string"), F.lit(")"))).otherwise(out)
    return out


def union_ignore_case(a: Column, b: Column) -> Column:
    """a and then what b adds, letter case ignored, blank values left out of b."""
    extra = F.filter(F.transform(b, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    low = F.transform(a, lambda x: F.lower(F.trim(x)))
    low_extra = F.transform(extra, lambda x: F.lower(x))
    first = F.transform(F.array_except(F.array_distinct(low_extra), low), lambda k: F.element_at(extra, F.array_position(low_extra, k).cast("int")))
    return F.concat(a, first)


def language_of_file(name: Column | str) -> Column:
    """`xx` of `book_xx.hbk`; '' if there is none."""
    return F.regexp_extract(F.lower(text_or_empty(name)), r"_([a-z]{2})\.hbk$", 1)


def book_label(stem: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(stem)), r"_[a-z]{2}$", "")


def cache_key(path: Column, version: Column, language: Column) -> Column:
    return F.concat_ws("|", version, language, F.substring(F.sha2(path, 256), 1, 16))


def memory_summary(title: Column, query: Column, tags: Column, description: Column, code: Column) -> Column:
    """`title | query | tags` if any of them is there, else `description | first 300 characters of code`."""
    some = (text_or_empty(title) != "") | (text_or_empty(query) != "") | (text_or_empty(tags) != "")
    a = F.concat_ws(" | ", text_or_empty(title), text_or_empty(query), text_or_empty(tags))
    return F.when(some, a).otherwise(F.concat_ws(" | ", text_or_empty(description), F.substring(text_or_empty(code), 1, 300)))


def duration(seconds: Column) -> Column:
    """`45s`, `3m 05s`, `2h 03m`."""
    s = F.floor(seconds).cast("int")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", (s / 60).cast("int"), s % 60)).otherwise(F.format_string("%dh %02dm", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int")))


def rewrite_links(text: Column, links: Column) -> Column:
    """`](href)` replaced by `](resolved)` for links (array of href, resolved) that were resolved."""
    good = F.filter(links, lambda x: F.coalesce(x["resolved"] != "", F.lit(False)))
    return F.aggregate(good, text, lambda s, x: F.replace(s, F.concat(F.lit("]("), x["href"], F.lit(")")), F.concat(F.lit("]("), x["resolved"], F.lit(")"))))
