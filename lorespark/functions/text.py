"""Text columns: tokens, keywords, names, summaries, classifiers. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token, keyword, camel-case, qualified-name and fence patterns.
TOKEN = "[а-яёА-ЯЁa-zA-Z0-9]+"
KEYWORD = "[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]{2,}"
CAMEL = "[А-ЯЁ][а-яё]+|[A-Z][a-z]+"
QUALIFIED = r"[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*\.[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*"
FENCE = r"(?s)```\w*\s*\n(.*?)```"
LINK = r"\[([^\]\[]*)\]\(([^)\s]+)\)"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""

# Words that mark a path segment or breadcrumb as an entity type, in the order they are tried.
ENTITY_WORDS = {
    "method": ["методы", "methods"],
    "property": ["свойства", "properties"],
    "type": ["типы", "types"],
    "function": ["функции", "functions"],
    "constructor": ["конструктор", "constructor"],
    "event": ["события", "events"],
}
# Words by which an error message is put into a category, in the order they are tried.
ERROR_WORDS = {
    "unpack": ["unpack", "7z", "unzip", "all unpack methods failed", "no such file"],
    "embed": ["embed", "api", "429", "timeout", "connection", "placeholder"],
    "index": ["qdrant", "upsert", "collection", "vector"],
    "build": ["build", "html", "markdown", "parse"],
}
# Constructs of the script language and titles of instructions.
SCRIPT_WORDS = [
    "Процедура", "Функция", "КонецПроцедуры", "КонецФункции", "Запрос", "Выполнить", "Новый ", "Возврат", "Для ",
    "Цикл", "КонецЦикла", "Если ", "Тогда", "КонецЕсли", "Пока ", "Попытка", "Исключение",
]
INSTRUCTION_TITLE = r"(?iu)^(как\s+|инструкция|руководство|настройка|восстановление|установка|методика|решение\s+проблемы|ошибка|troubleshooting)"
# Owners whose members belong to no type.
GLOBAL_OWNERS = ["глобальный контекст", "встроенные функции языка"]


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body (and lambdas in it) name it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(""))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(value: Column, words: list[str]) -> Column:
    return any_of([F.contains(value, F.lit(w)) for w in words])


def strip(value: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(value), r"^\s+|\s+$", "")


def squeeze(value: Column | str) -> Column:
    """White space put together to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(value), r"\s+", " "))


def tokens(value: Column | str) -> Column:
    """Lower-case tokens of two characters or more; [] for null."""
    found = F.regexp_extract_all(F.lower(text_or_empty(value)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def keywords(value: Column | str, most: int = 50) -> Column:
    """Identifiers of three characters or more, first spelling of each, letter case ignored."""
    found = F.regexp_extract_all(text_or_empty(value), F.lit(KEYWORD), F.lit(0))
    return let(found, lambda f: _first_spellings(f, most))


def _first_spellings(words: Column, most: int) -> Column:
    """The words that differ in more than letter case, each as it is first written."""
    pick = lambda low: F.transform(F.slice(F.array_distinct(low), 1, most), lambda t: F.element_at(words, F.array_position(low, t).cast("int")))
    return let(F.transform(words, lambda x: F.lower(x)), pick)


def keyword_tokens(value: Column | str, most: int = 8) -> Column:
    """Qualified names of five characters or more first, then identifiers of three or more."""
    q = text_or_empty(value)
    whole = F.array_distinct(F.filter(F.regexp_extract_all(q, F.lit(QUALIFIED), F.lit(0)), lambda t: F.length(t) >= 5))
    words = F.filter(F.regexp_extract_all(q, F.lit("[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*"), F.lit(0)), lambda t: F.length(t) >= 3)
    first = let(words, lambda w: _first_spellings(w, most))
    return F.slice(F.concat(whole, first), 1, most)


def camel_words(*names: Column | str) -> Column:
    """Words of compound names, a blank between; '' if no name is compound."""
    segments = F.filter(F.flatten(F.array(*[F.split(text_or_empty(n), r"[.\s]+") for n in names])), lambda s: s != "")
    words = F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(CAMEL), F.lit(0)))
    return F.array_join(F.flatten(F.filter(words, lambda w: F.size(w) > 1)), " ")


def summary(value: Column | str, most: int = 500) -> Column:
    flat = squeeze(value)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def normal_lines(value: Column | str) -> Column:
    """Line ends unified, blanks at the ends of lines and of the text removed."""
    lines = F.split(F.regexp_replace(text_or_empty(value), r"\r\n|\r", "\n"), "\n")
    return strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"))


def title_base(title: Column | str) -> Column:
    return F.trim(F.substring_index(strip(title), " (", 1))


def title_synonym(title: Column | str) -> Column:
    """The name in brackets behind a title; null if there is none or it is the same."""
    t = strip(title)
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, r"(?s) \((.*)$", 1)), r"\)+$", ""))
    return F.when((rest != "") & (F.lower(rest) != F.lower(title_base(title))), rest)


def owner_of(full_name: Column | str) -> Column:
    v = strip(full_name)
    return F.when(F.contains(v, F.lit(".")), F.trim(F.regexp_extract(v, r"(?s)^(.*)\.[^.]*$", 1))).otherwise("")


def member_of(full_name: Column | str) -> Column:
    return F.trim(F.substring_index(strip(full_name), ".", -1))


def code_blocks(value: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text_or_empty(value), F.lit(FENCE), F.lit(1)), strip)


def html_title(html: Column | str) -> Column:
    head = F.substring(text_or_empty(html), 1, 2000)
    h1 = F.regexp_extract(head, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.regexp_extract(head, r"(?i)<title>(.*?)</title>", 1)
    return F.when(head.rlike(r"(?is)<h1[^>]*>.*?</h1>"), strip(F.regexp_replace(h1, "<[^>]+>", ""))).when(head.rlike(r"(?i)<title>.*?</title>"), strip(title)).otherwise("Untitled")


def html_links(html: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(html), F.lit(HREF), F.lit(1))


def without_controls(value: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(value), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def looks_garbled(value: Column | str) -> Column:
    """UTF-8 read as a one-byte encoding: too many lead letters, or box characters among Cyrillic ones."""
    t = text_or_empty(value)
    count = lambda cls: F.length(F.regexp_replace(t, f"[^{cls}]", ""))
    cyr, bad, box = count("\\u0400-\\u04ff"), count("\\u0420\\u0421"), count("\\u2500-\\u257f")
    return F.when((F.length(t) < 20) | (cyr < 10), False).otherwise((bad / cyr > 0.25) | (box > 5))


def entity_type(section: Column | str, breadcrumb: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(text_or_empty(section), r"\\", "/"), "/"), lambda s: s != "")
    crumbs = F.filter(F.coalesce(breadcrumb, F.array().cast("array<string>")), lambda s: F.coalesce(s != "", F.lit(False)))
    every = F.transform(F.concat(parts, crumbs), lambda s: F.lower(F.trim(s)))
    tail = F.slice(every, F.greatest(F.size(every) - 2, F.lit(1)), 3)
    out = F
    for name, words in ENTITY_WORDS.items():
        test = F.arrays_overlap(tail, F.array(*map(F.lit, words)))
        out = out.when(test, name)
    return out.otherwise("topic")


def error_category(message: Column | str) -> Column:
    low, out = F.lower(text_or_empty(message)), F
    for name, words in ERROR_WORDS.items():
        out = out.when(contains_any(low, words), name)
    return out.otherwise("other")


def snippet_or_reference(title: Column | str, description: Column | str, code: Column | str) -> Column:
    t, d, c = strip(title), strip(description), strip(code)
    n_code, n_desc, script = F.length(c), F.length(d), contains_any(c, SCRIPT_WORDS)
    return (
        F.when(n_code < 80, "reference")
        .when(t.rlike(INSTRUCTION_TITLE) & ~(script & (n_code > n_desc)), "reference")
        .when(script & (n_code > n_desc * 1.2), "snippet")
        .when(script & (n_code / (n_code + n_desc) > 0.45), "snippet")
        .otherwise("reference")
    )


def member_kind(path: Column | str, title: Column | str, entity: Column | str) -> Column:
    e, p, t = F.lower(strip(entity)), F.lower(F.regexp_replace(text_or_empty(path), r"\\", "/")), strip(title)
    has = lambda s: F.contains(p, F.lit(s))
    return (
        F.when(e.isin("method", "property", "event", "constructor", "function", "field"), e)
        .when(has("/methods/"), F.when(has("/script functions/") | F.startswith(t, F.lit("Встроенные функции языка.")), "function").otherwise("method"))
        .when(has("/tables/") & has("/fields/"), "field")
        .when(has("/properties/"), "property")
        .when(has("/events/"), "event")
        .when(has("/ctors/") | F.contains(t, F.lit(".По умолчанию")), "constructor")
        .otherwise("topic")
    )


def topic_doc_kind(path: Column | str) -> Column:
    stem = F.lower(F.substring_index(F.regexp_replace(text_or_empty(path), r"\\", "/"), "/", -1))
    return F.when(F.startswith(stem, F.lit("form_")), "form_help").when(stem.rlike("^zif[0-9]*_"), "cli_help").otherwise("article")


def help_only_bucket(path: Column | str) -> Column:
    p = F.lower(F.regexp_replace(text_or_empty(path), r"\\", "/"))
    has = lambda *s: any_of([F.contains(p, F.lit(x)) for x in s])
    return (
        F.when(has("/shclang_", "/embedlang", "/shlang_ru/"), "language")
        .when(has("/tables/"), "tables")
        .when(has("/forms/"), "forms")
        .when(has("/objects/") & ~has("/methods/", "/properties/", "/events/", "/ctors/"), "object_overview")
        .when(has("/query/", "queries", "/shquery_ru/"), "query")
        .when(has("/lang/"), "language")
        .otherwise("other_topic")
    )


def is_stub_path(path: Column | str) -> Column:
    p = F.lower(text_or_empty(path))
    return contains_any(p, ["/methods/", "/properties/", "/constructors/"])


def match_rank(query: str | Column, values: list[Column]) -> Column:
    """0 equal, 1 prefix, 2 contained, 3 none, over several lower-case columns."""
    q = F.lit(query) if isinstance(query, str) else query
    return F.when(any_of([v == q for v in values]), 0).when(any_of([F.startswith(v, q) for v in values]), 1).when(any_of([F.contains(v, q) for v in values]), 2).otherwise(3)


def title_rank(query: str | Column, title: Column, stem: Column | None = None) -> Column:
    """0 exact or followed by a bracket, dash or colon; 1 first word; 2 begin of a word or contained; 3 none."""
    q = F.lit(query) if isinstance(query, str) else query
    both = [title] + ([stem] if stem is not None else [])
    there = [(c, F.length(c) > 0) for c in both]
    starts = lambda *tails: any_of([n & F.startswith(c, F.concat(q, F.lit(t))) for c, n in there for t in tails])
    out = F.when(any_of([n & (c == q) for c, n in there]), 0).when(starts(" (", " [", " —", ":"), 0).when(starts(" ", "("), 1)
    for c, n in there:
        tail = F.substr(c, F.length(q) + 1, F.lit(1))
        out = out.when(n & F.startswith(c, q), F.when((tail != "") & tail.rlike(r"^[\p{L}\p{N}_]"), 2).otherwise(1))
    return out.when(any_of([n & F.contains(c, q) for c, n in there]), 2).otherwise(3)


def is_member_title(query: str | Column, title: Column) -> Column:
    q = F.lit(query) if isinstance(query, str) else query
    at = F.locate(query, title) if isinstance(query, str) else F.instr(title, q)
    return F.when(at > 1, F.substr(title, at - 1, F.lit(1)) == ".").otherwise(False)


def member_order(query: str, title: Column) -> Column:
    """Members first for a dotted query, else members last."""
    member = is_member_title(query, title)
    return (~member if "." in query else member).cast("int")


def point_id(*parts: Column) -> Column:
    """56-bit id: the first 14 hex digits of the SHA-256 of the parts with | between."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 14), 16, 10).cast("long")
