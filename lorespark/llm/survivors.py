"""One surviving record for each group of records of the same thing, filled field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.fusion import places
from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join

#: Days after which a value's vote has lost half of its weight.
HALF_LIFE_DAYS = 365.0
#: Distinct values of a standing (versions, say) that are broadcast with their places; more are joined.
MAX_BROADCAST_PLACES = 100_000
#: Number of the field of records among the fields.
_ID = -1


def is_filled(value: Column, kind: str) -> Column:
    """Not null, not empty and not only white space."""
    if kind.startswith("array"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value.cast("string").rlike(r"(?U)\S"), F.lit(False))


def _placed(rows: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """rows with the place of each value of `column` among its distinct values instead of the value."""
    ranked = places(rows.select(column).distinct(), [column], scratch)
    ranked, n = scratch.save_counting(ranked, k=F.count(F.lit(1)))
    met = rows.join(F.broadcast(ranked), column, "left") if n["k"] <= MAX_BROADCAST_PLACES else lookup_join(rows, ranked, column)
    return met.withColumn(column, F.coalesce(F.col("place"), F.lit(0)).cast("double")).drop("place")


def survivors(
    records: DataFrame,
    group: Column,
    key: str,
    standing: list[Column | list[str]],
    fields: list[str],
    loaded: str = "loaded_at",
    trust: Column | None = None,
    half_life: float = HALF_LIFE_DAYS,
    scratch: Scratch | None = None,
    sources: bool = False,
) -> DataFrame:
    """(group_id, best_id, n, fields…) with one row for each group of `records`.

    The fields of every record are unpivoted to long rows (group, field, value), and each filled value votes for its
    normalised form (blanks put together, case ignored). Votes are vectors of weights, summed by component for each form
    and compared component by component. The vote for a value is source trust × 2^(-age / half_life), age counted from
    the newest record of the table. The record itself is one more field, its key being the value, and several long rows
    of each record vote for it: one for each standing (a numeric column as it is, any other by its place among the
    distinct values), one for each filled field of a standing that is a list of fields, and one for its recency
    (microseconds since the oldest record, undated ones lowest), each in its own component. The form with the most votes
    wins its field, on a tie the one of the better record, then of the greater key; it is given as its best record
    writes it. best_id is the winner of the field of records. The winners are pivoted back to one row. With `sources`
    each field gives the key of the record that its winner is taken from, and no value is shuffled.

    Long rows are summed up before they meet, so a group with a third of all rows is no burden to one task. group_id is
    the least key of the group, n its number of rows. A key that is delivered more than once stands with the mean of its
    rows. Arrays come back as JSON text. Rows with a null group or key are left out; a field that no record fills is
    null; an empty table gives no rows. Only the fields asked for are unpivoted.
    """
    scratch = scratch or Scratch(records.sparkSession)
    counted = {(i, f): f"b{i}_{j}" for i, c in enumerate(standing) if isinstance(c, list) for j, f in enumerate(c)}
    standing = [filled_count(records, c) if isinstance(c, list) else c for c in standing]
    kinds = dict(records.dtypes)
    micros = F.unix_micros(F.col(loaded).cast("timestamp"))
    newest, oldest = (F.unix_micros(records.agg(f(loaded)).scalar().cast("timestamp")) for f in (F.max, F.min))
    age = F.greatest((newest - micros) / F.lit(86_400e6), F.lit(0.0))
    weight = (F.lit(1.0) if trust is None else trust) * F.coalesce(F.pow(F.lit(2.0), -age / F.lit(half_life)), F.lit(0.0))
    as_text = {f: F.to_json(F.col(f)) if kinds[f].startswith(("array", "struct", "map")) else F.col(f).cast("string") for f in fields}
    values = [F.when(is_filled(F.col(f), kinds[f]), as_text[f]).alias(f"v{i}") for i, f in enumerate(fields)]
    stand = [f"s{i}" for i in range(len(standing))]
    rows = records.where(F.col(key).isNotNull() & group.isNotNull())
    rows = rows.select(group.alias("g"), F.col(key).alias("k"), *[c.alias(n) for c, n in zip(standing, stand)], F.coalesce(micros - oldest, F.lit(-1)).cast("double").alias("recency"), weight.alias("w"), *[is_filled(F.col(f), kinds[f]).alias(n) for (_, f), n in counted.items()], *values)
    for name in stand:
        rows = rows.withColumn(name, F.col(name).cast("double")) if dict(rows.dtypes)[name] in ("int", "bigint", "double") else _placed(rows, name, scratch)

    criteria = [F.col(c) for c in (*stand, "recency")]

    def cell(f: int, v: Column, form: Column, w: Column, at: int = 0, n: int = 1) -> Column:
        weights = [w if i == at else F.lit(0.0) for i in range(len(criteria))]
        kept = [] if sources else [v.alias("v")]
        return F.struct(F.lit(f).alias("f"), F.when(v.isNotNull(), F.xxhash64(form)).alias("form"), F.array(*weights).alias("w"), F.lit(n).alias("one"), *kept)

    def normal(v: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), "^ | $", ""))

    this, listed = F.col("k").cast("string"), {i for i, _ in counted}
    cells = [cell(_ID, this, this, F.col(c), i, 0) for i, c in enumerate(stand) if i not in listed]
    cells += [cell(_ID, F.when(F.col(n), this), this, F.lit(1.0), i, 0) for (i, _), n in counted.items()]
    cells += [cell(_ID, this, this, F.col("recency"), len(stand))]
    cells += [cell(i, F.col(f"v{i}"), normal(F.col(f"v{i}")), F.col("w")) for i in range(len(fields))]
    rank = F.struct(*criteria, F.col("k"))
    long = rows.select("g", "k", rank.alias("rank"), F.explode(F.array(*cells)).alias("c")).select("g", "k", "rank", "c.*").where("form is not null")
    own = F.col("f") == _ID
    sums = [F.sum(F.get("w", i)) for i in range(len(criteria))]
    total = F.array(*[F.when(own, s / F.sum("one")).otherwise(F.round(s, 9)) for s in sums])
    # a form and its best record in one struct
    top = F.max("rank" if sources else F.struct("rank", "v"))
    votes = long.groupBy("g", "f", "form").agg(total.alias("votes"), top.alias("top"), F.sum("one").alias("n"))

    taken, record = (F.col("top.k"),) * 2 if sources else (F.col("top.v"), F.col("top.rank.k"))
    best = F.max_by(record, F.when(own, F.struct("votes", record.alias("k"))))
    picked = [F.max_by(taken, F.when(F.col("f") == i, F.struct("votes", "top"))).alias(f) for i, f in enumerate(fields)]
    return votes.groupBy("g").agg(F.min(F.when(own, record)).alias("group_id"), best.alias("best_id"), F.sum(F.when(own, F.col("n"))).alias("n"), *picked).drop("g")


def filled_count(records: DataFrame, fields: list[str]) -> Column:
    kinds = dict(records.dtypes)
    return sum((is_filled(F.col(f), kinds[f]).cast("int") for f in fields), F.lit(0))
