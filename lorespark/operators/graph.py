"""Walks over edges: breadth-first reach, sections of a contents tree, differences of texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.hierarchy import resolve_hierarchy
from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join, sketch


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(node, depth) of all nodes that edges (a, b) lead to from seeds (node), each at its least depth.

    One round per depth: the frontier meets the edges, what was seen before is left out; a node that a third of all
    edges leave is salted. Stops when nothing new comes up, so cycles do no harm, or after `most` rounds if it
    is given.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.save(edges.select("a", "b").where("a is not null and b is not null").distinct())
    front, n = scratch.save_counting(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), k=F.count(F.lit(1)))
    seen = front
    depth = 0
    while n["k"] and (most is None or depth < most):
        depth += 1
        heads = front.select(F.col("node").alias("a"), F.lit(True).alias("_in"))
        step = lookup_join(edges, heads, "a", "inner").select(F.col("b").alias("node")).distinct()
        new = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        front, n = scratch.save_counting(new, k=F.count(F.lit(1)))
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # the plan of a long walk stays small
            seen = scratch.save(seen)
    return seen


def chain(following: DataFrame, seeds: DataFrame, most: int, scratch: Scratch | None = None) -> DataFrame:
    """(seed, node, step) of the walk from each seed along following (a, b), unique by a, `most` nodes at most, none twice.

    All walks take one step in one round; a node that many of them meet is salted.
    """
    scratch = scratch or Scratch(following.sparkSession)
    following = scratch.save(following.select(F.col("a").alias("node"), "b").where("node is not null and b is not null"))
    front, n = scratch.save_counting(seeds.where("seed is not null").select("seed", F.col("seed").alias("node"), F.lit(0).alias("step"), F.array("seed").alias("seen")), k=F.count(F.lit(1)), hot=sketch("node"))
    out = front
    for step in range(1, most):
        if not n["k"]:
            break
        on = lookup_join(front, following, "node", "inner", total=n["k"], hot=n["hot"]).where(~F.array_contains("seen", F.col("b")))
        front, n = scratch.save_counting(on.select("seed", F.col("b").alias("node"), F.lit(step).alias("step"), F.array_append("seen", F.col("b")).alias("seen")), k=F.count(F.lit(1)), hot=sketch("node"))
        out = out.unionByName(front)
    return out.select("seed", "node", "step")


def page_sections(chunks: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(key, section_path, breadcrumb, entity_type) of contents (id, parent_id, title_ru, title_en, html_path).

    Each page is found by its path, its path without the extension and its file name without it; of several entries
    with one key the least id counts. Entries on cycles and without a page have no section.
    """
    label = F.coalesce(F.nullif(F.trim("title_ru"), F.lit("")), F.nullif(F.trim("title_en"), F.lit("")))
    tree = resolve_hierarchy(chunks.select(F.col("id").alias("node"), F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent"), label.alias("label")), scratch)
    above = F.array_compact(F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda x: x["label"]))
    pages = chunks.where("trim(html_path) <> ''").select("id", F.trim("html_path").alias("page"))
    rows = pages.join(tree.where("not cyclic").select(F.col("node").alias("id"), above.alias("breadcrumb")), "id")
    last = F.lower(F.coalesce(F.element_at(F.array_append("breadcrumb", F.lit("")), F.greatest(F.size("breadcrumb"), F.lit(1))), F.lit("")))
    has = lambda *w: F.greatest(*[F.contains(last, F.lit(x)) for x in w])
    kind = F.when(has("метод", "method"), "method").when(has("свойств", "propert"), "property").when(has("тип", "type"), "type").otherwise("topic")
    bare = F.regexp_replace("page", r"\.[^./]*$", "")
    keys = F.array_distinct(F.array(F.col("page"), bare, F.substring_index(bare, "/", -1)))
    flat = rows.select("id", F.explode(keys).alias("key"), F.array_join("breadcrumb", "/").alias("section_path"), "breadcrumb", kind.alias("entity_type"))
    return flat.groupBy("key").agg(F.min_by(F.struct("section_path", "breadcrumb", "entity_type"), "id").alias("x")).select("key", "x.*")


def text_diff(pairs: DataFrame, left: str, right: str, most_lines: int | None = None) -> DataFrame:
    """pairs with `diff`: the unified difference of two texts, '' if they are equal; nulls count as ''. Whole, unless most_lines is given."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        made = (difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "left", "right", lineterm="", n=2) for x, y in zip(a, b))
        return pd.Series(["\n".join(list(lines)[:most_lines]) for lines in made])

    return pairs.withColumn("diff", diff(F.col(left), F.col(right)))
