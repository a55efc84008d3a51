"""Parent-child links resolved to roots, depths, paths and descendants by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.util.bloom import Bloom
from lorespark.util.scratch import Scratch
from lorespark.util.skew import lookup_join, sketch


class Hierarchy:
    """The trees of nodes (node, parent, label), one row per node after repeated ones are reduced to the last.

    Each lookup replaces every open pointer by the pointer of the node it points to; a round makes HOPS of them, so the
    distance covered doubles twice, and a chain of length n takes about log4 n rounds. If a round closes no chain, none
    of the open ones can ever close: a chain longer than the distance covered has an ancestor at every smaller distance,
    which would have closed. What is left open runs into a cycle. Pointers only ever name nodes that have children, so
    the rounds run over these (by a Bloom filter of the parents, whose false positives do no harm) and carry nothing but
    pointers and distances. Path segments are put together afterwards, in rounds of the same kind over the nodes whose
    paths are wanted and end; no node on or below a cycle ever carries one.

    Rows with a null node are left out; of repeated nodes the row that is last in the columns `order` is kept (default:
    parent, label). A parent that is no node ends the chain: the child is a root with dangling = true. Hot parents are
    salted.
    """

    HOPS = 3

    def __init__(self, nodes: DataFrame, scratch: Scratch | None = None, order: list[str] | None = None):
        self.scratch = scratch or Scratch(nodes.sparkSession)
        last = F.max_by(F.struct("parent", "label"), F.struct(*(order or ["parent", "label"])))
        start = nodes.where("node is not null").groupBy("node").agg(last.alias("x")).select("node", "x.*")
        self.start, n = self.scratch.save_counting(start, below=F.count("parent"), parents=F.approx_count_distinct("parent"), hot=sketch("parent"))
        self.below, self.hot = n["below"], n["hot"]
        named = Bloom(self.start.where("parent is not null"), F.col("parent"), n["parents"])
        self.inner, n = self.scratch.save_counting(named.filter(self.start, F.col("node")), left=F.count("parent"), hot=sketch("parent"))
        self._double(n)

    def _double(self, n: dict) -> None:
        """Rounds over (node, ptr, low, dist, dangling, closed); low is the node whose parent the pointer is."""
        state = self.inner.selectExpr("node", "coalesce(parent, node) as ptr", "node as low", "int(parent is not null) as dist", "false as dangling", "parent is null as closed")
        while left := n["left"]:
            jump = state.selectExpr("node as at", *[f"{c} as _{c}" for c in state.columns[1:]])
            step, hot = state.where("not closed"), n["hot"]
            for _ in range(self.HOPS):
                # a pointer to no node: the chain ends below it
                then = "case when at is null then {0} when _ptr is null then {2} else {1} end as {0}".format
                met = lookup_join(step.selectExpr("*", "if(closed, null, ptr) as at"), jump, "at", total=left, hot=hot)
                step = met.selectExpr("node", then("ptr", "_ptr", "low"), then("low", "_low", "low"), then("dist", "dist + _dist", "dist - 1"), then("dangling", "_dangling", "true"), then("closed", "_closed", "true"))
            open_ = ~F.col("closed")
            step, n = self.scratch.save_counting(step.unionByName(state.where("closed")), left=F.count_if(open_), hot=sketch(F.when(open_, F.col("ptr"))))
            if n["left"] == left:
                self.scratch.drop(step)
                break
            self.scratch.drop(state)
            state = step
        self.closed = state.where("closed").select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), "dangling")
        self.open, self.n_open = state.where("not closed").select("node"), n["left"]

    def circular(self) -> DataFrame:
        """(node) of all nodes on or below a cycle: those whose parent is left open."""
        if not self.n_open:
            return self.start.select("node").limit(0)
        above = self.open.select(F.col("node").alias("parent"))
        maybe = Bloom(above, F.col("parent"), self.n_open).filter(self.start.select("node", "parent"), F.col("parent"))
        return lookup_join(self.scratch.save(maybe), above, "parent", "inner").select("node")

    def _paths(self, want: Column) -> DataFrame:
        """(node, root, depth, dangling, path) of the nodes with children that are wanted and not cyclic."""
        own = F.array(F.struct(F.col("node").alias("id"), "label"))
        count = {"left": F.count("ptr"), "hot": sketch("ptr")}
        first = self.inner.where(want).join(self.closed, "node")
        first = first.select("node", F.when(F.col("depth") > 0, F.col("parent")).alias("ptr"), "root", "depth", "dangling", own.alias("path"))
        state, n = self.scratch.save_counting(first, **count)
        while n["left"]:
            jump = state.selectExpr("node as ptr", "ptr as _ptr", "path as _path")
            step, hot = state.where("ptr is not null"), [x for x in n["hot"] if x["item"] is not None]
            for _ in range(self.HOPS):
                met = lookup_join(step, jump, "ptr", total=n["left"], hot=hot)
                step = met.selectExpr("node", "_ptr as ptr", "root", "depth", "dangling", "concat(coalesce(_path, slice(path, 1, 0)), path) as path")
            before = state
            state, n = self.scratch.save_counting(step.unionByName(before.where("ptr is null")), **count)
            self.scratch.drop(before)
        return state.drop("ptr")

    def resolve(self, paths: bool = True, want: Column | None = None) -> DataFrame:
        """(node, parent, root, depth, [path,] cyclic, dangling) of every node, or of those wanted: whole trees.

        path is an array of (id, label) from the root to the node; for nodes on or below a cycle root, depth and path are
        null. Every node is put under its parent by one join.
        """
        want = F.lit(True) if want is None else want
        own = F.array(F.struct(F.col("node").alias("id"), "label"))
        kinds = dict(self.start.dtypes)
        path = f"array<struct<id:{kinds['node']},label:{kinds['label']}>>"
        known = self._paths(want) if paths else self.closed.withColumn("path", F.lit(None).cast(path))
        ends = known.select(F.col("node").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.lit(False).alias("_cyclic"), F.col("dangling").alias("_dangling"))
        none = self.open.select(F.col("node").alias("parent"), F.lit(None).cast(kinds["node"]).alias("_root"), F.lit(None).cast("int").alias("_depth"), F.lit(None).cast(path).alias("_path"), F.lit(True).alias("_cyclic"), F.lit(False).alias("_dangling"))
        start = self.start.where(want)
        roots = start.where("parent is null").select("node", "parent", F.col("node").alias("root"), F.lit(0).alias("depth"), own.alias("path"), F.lit(False).alias("cyclic"), F.lit(False).alias("dangling"))
        alone = F.col("_cyclic").isNull()
        below = lookup_join(start.where("parent is not null"), ends.unionByName(none), "parent", total=self.below, hot=self.hot).select(
            "node",
            "parent",
            F.when(alone, F.col("node")).otherwise(F.col("_root")).alias("root"),
            F.when(alone, 0).otherwise(F.col("_depth") + 1).alias("depth"),
            F.when(alone, own).otherwise(F.concat("_path", own)).alias("path"),
            F.coalesce("_cyclic", F.lit(False)).alias("cyclic"),
            F.coalesce("_dangling", F.lit(True)).alias("dangling"),
        )
        out = roots.unionByName(below)
        return out if paths else out.drop("path")


def resolve_hierarchy(nodes: DataFrame, scratch: Scratch | None = None, order: list[str] | None = None) -> DataFrame:
    """(node, parent, root, depth, path, cyclic, dangling) of nodes (node, parent, label); see Hierarchy.

    An empty table gives no rows.
    """
    return Hierarchy(nodes, scratch, order).resolve()


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every node with a path and each of its ancestors: no further join.

    What hangs on a cycle has no path; see circular_descendants().
    """
    flat = resolved.where("not cyclic").select("node", "depth", F.posexplode("path").alias("at", "step"))
    return flat.where("at < depth").select(F.col("step.id").alias("ancestor"), "node", (F.col("depth") - F.col("at")).alias("distance"))


def circular_descendants(resolved: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(ancestor, node, distance) for every node on or below a cycle and each of its ancestors, at the least distance.

    Pointer doubling again: `up` holds the ancestors from the parent on, as many as were covered. Once one comes up for
    the second time (or is the node itself) the chain only repeats itself, so it is cut there; no node is its own
    ancestor. A chain that meets one that is cut takes over its ancestors and is cut too.
    """
    scratch = scratch or Scratch(resolved.sparkSession)
    ended = lambda up: F.size(F.array_distinct(F.concat(F.array("node"), up))) <= F.size(up)
    cut = lambda up: F.array_except(up, F.array("node"))  # noqa: E731 - distinct, the first of equal ones kept
    up = F.array("parent")
    first = resolved.where("cyclic").select("node", F.col("parent").alias("ptr"), cut(up).alias("up"), ended(up).alias("closed"))
    state, n = scratch.save_counting(first, left=F.count_if(~F.col("closed")))
    closed, active, left = [state.where("closed")], state.where("not closed"), n["left"]
    while left:
        every = active
        for part in closed:
            every = every.unionByName(part)
        jump = every.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("up").alias("_up"), F.col("closed").alias("_closed"))
        up = F.concat("up", "_up")
        step = lookup_join(active, jump, "ptr", "inner", total=left).select("node", F.col("_ptr").alias("ptr"), cut(up).alias("up"), (F.col("_closed") | ended(up)).alias("closed"))
        step, n = scratch.save_counting(step, left=F.count_if(~F.col("closed")))
        left = n["left"]
        closed.append(step.where("closed"))
        active = step.where("not closed")
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return whole.select("node", F.posexplode("up").alias("at", "ancestor")).select("ancestor", "node", (F.col("at") + 1).alias("distance"))
