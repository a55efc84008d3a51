"""Names as people write them: chains of accessors, plural roots, owner aliases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accessors of the script language and the object type they lead to.
ROOTS = {
    "Справочники": "Catalog", "Документы": "Document", "Перечисления": "Enum", "Отчеты": "Report", "Обработки": "DataProcessor", "Константы": "Constant", "РегистрыСведений": "InformationRegister", "РегистрыНакопления": "AccumulationRegister",
    "Catalogs": "Catalog", "Documents": "Document", "Enums": "Enum", "Reports": "Report", "DataProcessors": "DataProcessor", "Constants": "Constant", "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister",
}
PREFIXES = ("глобальный контекст.", "global context.", "метаданные.", "metadata.")


def split_chain(name: str) -> list[str]:
    """Segments of a dotted name without blanks and leading roots."""
    text = re.sub(r"\s*\.\s*", ".", (name or "").strip())
    while any(text.lower().startswith(p) for p in PREFIXES):
        text = text.split(".", 1)[1]
    return [s for s in text.split(".") if s]


def candidates(name: str) -> list[tuple[str, str]]:
    """(candidate, how it came about), best first, each once: the chain itself, its object id, its last two and last segment."""
    parts = split_chain(name)
    out: list[tuple[str, str]] = []
    if parts:
        out.append((".".join(parts), "exact"))
        if parts[0] in ROOTS and len(parts) > 1:
            out.append((f"{ROOTS[parts[0]]}.{parts[1]}", "object_id"))
        if len(parts) > 2:
            out.append((".".join(parts[-2:]), "tail"))
        out.append((parts[-1], "member"))
    seen: set[str] = set()
    return [c for c in out if not (c[0].lower() in seen or seen.add(c[0].lower()))]


def owner_alias_members(members: DataFrame, owner: str, member: str, limit: int = 5) -> DataFrame:
    """Members `member` of the types that a property `owner` returns: property → value types → members of these types."""
    props = members.where((F.lower("member_name") == owner.lower()) & (F.col("kind") == "property"))
    types = props.select(F.explode(F.split(F.coalesce("returns", F.lit("")), r"\s*[,;]\s*")).alias("t")).select(F.lower(F.regexp_replace("t", r"^(?u)Тип:\s*|[. ]+$", "")).alias("t")).where("t <> ''").distinct()
    found = members.where(F.lower("member_name") == member.lower()).withColumn("t", F.lower("owner_name"))
    return found.join(types, "t", "left_semi").drop("t").orderBy("full_name", "id").limit(limit)
