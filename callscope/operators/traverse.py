"""Bounded traversal of call edges, set-oriented: every round joins the whole frontier with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.durable import cut


def arcs(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (a, b) steps: along calls, against them, or both ways."""
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def reach(edges: DataFrame, sources: DataFrame, most: int, direction: str = "out") -> DataFrame:
    """``src, node, depth``: the least number of steps (at most ``most``) from each source (column ``src``)."""
    step = cut(arcs(edges, direction))
    seen = frontier = cut(sources.select("src", F.col("src").alias("node"), F.lit(0).alias("depth")))
    for depth in range(1, most + 1):
        new = frontier.join(step, F.col("node") == F.col("a")).select("src", F.col("b").alias("node")).distinct().join(seen, ["src", "node"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _between(step: DataFrame, pairs: DataFrame, most: int, nodes: bool, top: int | None) -> DataFrame:
    """``src, dst, length, path`` between asked ends; a step, or a node where ``nodes``, isn't repeated.

    A round first closes the walks whose next step leads to their end, then lengthens them for the pairs that aren't
    served yet. Walks that stand further from their end than the steps left go as soon as two or fewer are left, so the last,
    largest rounds stay small.
    """
    near = [None, cut(pairs.select("dst").distinct().join(step, F.col("dst") == F.col("b")).select("dst", F.col("a").alias("tail")).distinct())]
    near.append(cut(near[1].unionByName(near[1].join(step, F.col("tail") == F.col("b")).select("dst", F.col("a").alias("tail"))).distinct()))
    tail = F.element_at("path", -1)
    pair = F.struct("a", "b")
    free = ~F.array_contains("path", F.col("b")) if nodes else ~F.array_contains("used", pair)
    walks = pairs.distinct().select("src", "dst", F.array("src").alias("path"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("used"))
    found = None
    for n in range(1, most + 1):
        ends = walks.withColumn("tail", tail).join(step, (F.col("tail") == F.col("a")) & (F.col("dst") == F.col("b"))).where(free).select("src", "dst", F.concat("path", F.array("b")).alias("path"))
        found = cut(ends if found is None else found.unionByName(ends))
        if n == most:
            break
        if top is not None:  # later walks are longer, so a pair with enough is served
            walks = walks.join(found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).select("src", "dst"), ["src", "dst"], "left_anti")
        longer = walks.withColumn("tail", tail).join(step, F.col("tail") == F.col("a")).where(free)
        if nodes:
            longer = longer.where("b != dst")
        longer = longer.select("src", "dst", F.concat("path", F.array("b")).alias("path"), F.concat("used", F.array(pair)).alias("used"))
        if most - n <= 2:
            longer = longer.withColumn("tail", tail).join(near[most - n], ["dst", "tail"], "left_semi").drop("tail")
        walks = cut(longer)
        if walks.isEmpty():
            break
    out = found.select("src", "dst", (F.size("path") - 1).alias("length"), "path")
    if top is None:
        return out
    w = Window.partitionBy("src", "dst").orderBy("length", "path")
    return out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).drop("nth")


def best_walks(edges: DataFrame, pairs: DataFrame, most: int, top: int) -> DataFrame:
    """The ``top`` shortest walks of at most ``most`` steps between asked ends (``src, dst``) that repeat no step; of equal length the least as lists."""
    return _between(cut(arcs(edges)), cut(pairs), most, False, top)


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """All paths of at most ``most`` steps between asked ends (``src, dst``) that repeat no node."""
    return _between(cut(arcs(edges)), cut(pairs), most, True, None)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``id, component`` (least id reachable, either way), by contraction.

    The calls are read once. A round lets each node join that of itself and its neighbours which comes first in an order by hash, follows
    the choices one step on, and leads the edges over to what is found; so the edges shrink from round to round. Each round's labels lead to nodes
    of the next, and are put together from the last to the first, one join at a time.
    """
    step = cut(edges.where("from_id IS NOT NULL AND to_id IS NOT NULL").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct())
    rounds: list[DataFrame] = []
    left = step.where("a != b")
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        chosen = cut(first.select(F.col("a").alias("id"), F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("label")))
        if chosen.isEmpty():
            break
        if len(rounds) == most:
            raise RuntimeError("components did not settle")
        label = cut(chosen.join(chosen.select(F.col("id").alias("label"), F.col("label").alias("further")), "label").select("id", F.col("further").alias("label")))
        rounds.append(label)
        la, lb = (label.select(F.col("id").alias(n), F.col("label").alias("l" + n)) for n in "ab")
        left = cut(left.join(la, "a").join(lb, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    nodes = step.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if not rounds:
        return nodes.select("id", F.col("id").alias("component"))
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("id").alias("label"), F.col("label").alias("root"))
        out = cut(rounds.pop().join(later, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
    alone = nodes.join(out, "id", "left_anti").select("id", F.col("id").alias("component"))
    return out.join(out.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component").unionByName(alone)


def affected(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """The changed methods (``src``) and all within ``depth`` steps of them, either way."""
    return reach(edges, changed, depth, "both").select(F.col("node").alias("id")).distinct()
