"""Call trees: breadth-first from root methods, with the order of arrival that a queue would give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import rules as r
from callscope.functions.durable import cut
from callscope.plans.graph import CodeGraph
from callscope.plans.rule_queries import ROOT

MOST_DEPTH = 10


def admissible(graph: CodeGraph) -> DataFrame:
    """Methods that may stand in a tree below its root."""
    return graph.sql("""SELECT m.id FROM {methods} m JOIN {classes} c ON m.class_id = c.id WHERE m.is_public AND NOT m.is_ctor
        AND NOT contains(lower(c.name), 'util') AND NOT contains(lower(c.name), 'helper')
        AND NOT (contains(lower(c.package), 'util') OR (contains(lower(c.package), 'common') AND c.layer = 'UTIL'))""")


def root_methods(graph: CodeGraph) -> DataFrame:
    """Roots in the order of their classes and then their methods."""
    return graph.sql(f"SELECT m.id AS root, m.class_id FROM {{methods}} m JOIN {{classes}} c ON m.class_id = c.id WHERE {ROOT}")


@dataclass(frozen=True)
class Trees:
    """trees: root, tree_number. nodes: root, node, parent, depth, pos, path."""

    trees: DataFrame
    nodes: DataFrame


def steps(graph: CodeGraph) -> DataFrame:
    """``from_id, to_id, edge_ord``: the first of parallel calls to methods that may stand in a tree."""
    allowed = admissible(graph).select(F.col("id").alias("to_id"))
    return graph.edges.join(allowed, "to_id").groupBy("from_id", "to_id").agg(F.min("edge_ord").alias("edge_ord"))


def earliest(step: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``node, first``: the first source (``root``, its order ``first``) that reaches each node in at most ``most`` steps.

    A round sends on only what became earlier, so it is at most one pass over the edges, however many sources there are.
    """
    label = frontier = cut(sources.select(F.col("root").alias("node"), "first"))
    for _ in range(most):
        new = frontier.join(step, F.col("node") == F.col("from_id")).groupBy(F.col("to_id").alias("node")).agg(F.min("first").alias("new"))
        frontier = cut(new.join(label, "node", "left").where("first IS NULL OR new < first").select("node", F.col("new").alias("first")))
        if frontier.isEmpty():
            break
        label = cut(label.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))
    return label


def kept_roots(step: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``root, first``: the roots in order, without those that the tree of an earlier one holds.

    In a round each open root learns the first root, kept or open, that reaches it: if that is itself it is kept, if that is
    a kept one it goes, else it waits for it. The first open root is always decided.
    """
    open_ = cut(roots.select("root", F.struct("class_id", "root").alias("first")))
    kept = open_.limit(0)
    while not open_.isEmpty():
        told = earliest(step, kept.unionByName(open_), most).select(F.col("node").alias("root"), F.col("first").alias("by"))
        met = cut(open_.join(told, "root"))
        kept = cut(kept.unionByName(met.where("by = first").select("root", "first")))
        open_ = cut(met.where("by != first").join(kept.select(F.col("first").alias("by")), "by", "left_anti").select("root", "first"))
    return kept


def visit(graph: CodeGraph, roots: DataFrame, most: int = MOST_DEPTH, step: DataFrame | None = None) -> DataFrame:
    """``root, node, parent, depth, pos, path``: nodes in order of arrival, for all roots at once.

    A queue polls parents in their order and adds their calls in theirs, and the first arrival wins, so a round is
    the frontier joined with the edges, and of each child the least (parent's place, edge).
    """
    step = cut(steps(graph)) if step is None else step
    start = roots.select("root", F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.array("root").alias("path"))
    frontier = seen = cut(start)
    for depth in range(1, most + 1):
        new = frontier.select("root", F.col("node").alias("from_id"), "pos", "path").join(step, "from_id").where(~F.array_contains("path", F.col("to_id")))
        first = new.join(seen.select("root", F.col("node").alias("to_id")), ["root", "to_id"], "left_anti").groupBy("root", "to_id").agg(F.min(F.struct("pos", "edge_ord", "from_id", "path")).alias("f"))
        place = F.row_number().over(Window.partitionBy("root").orderBy("f.pos", "f.edge_ord")) - 1  # one level of one tree
        frontier = cut(first.select("root", F.col("to_id").alias("node"), F.col("f.from_id").alias("parent"), F.lit(depth).alias("depth"), place.alias("pos"), F.concat("f.path", F.array("to_id")).alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def numbered(kept: DataFrame) -> DataFrame:
    """``root, tree_number``: a running number in the order of the roots, from a sort over all partitions."""
    at = F.monotonically_increasing_id()
    placed = cut(kept.orderBy("first").select("root", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return placed.join(before, "part").select("root", F.format_string("T%03d", F.col("base") + F.col("at") + 1).alias("tree_number"))


def build(graph: CodeGraph, roots: DataFrame | None = None, most: int = MOST_DEPTH) -> Trees:
    """The trees of all roots but those that an earlier tree holds."""
    step = cut(steps(graph))
    kept = kept_roots(step, root_methods(graph) if roots is None else roots, most)
    return Trees(numbered(kept), cut(visit(graph, kept, most, step)))


def sizes(graph: CodeGraph, trees: Trees, most: int = MOST_DEPTH) -> DataFrame:
    """``root, tree_number, node_count, depth, cross_nodes``: cross nodes are arrivals at what the tree already holds."""
    allowed = admissible(graph).select(F.col("id").alias("to_id"))
    polled = trees.nodes.where(F.col("depth") < most).join(graph.edges.join(allowed, "to_id"), F.col("node") == F.col("from_id")).where(~F.array_contains("path", F.col("to_id"))).groupBy("root").agg(F.count(F.lit(1)).alias("polled"))
    out = trees.nodes.groupBy("root").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("depth")).join(trees.trees, "root").join(polled, "root", "left")
    return out.select("root", "tree_number", "node_count", "depth", (F.coalesce("polled", F.lit(0)) - (F.col("node_count") - 1)).alias("cross_nodes"))


def crossed(graph: CodeGraph, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n`` of methods and of classes: the trees that hold a method, and those that hold one of a class."""
    classes = nodes.join(graph.methods.select(F.col("id").alias("node"), "class_id"), "node")
    return nodes.groupBy(F.col("node").alias("id")).agg(F.countDistinct("root").alias("n")), classes.groupBy(F.col("class_id").alias("id")).agg(F.countDistinct("root").alias("n"))


def core_paths(graph: CodeGraph, nodes: DataFrame) -> DataFrame:
    """``root, node, length, layer_cross, weight``: the path from the root to each other node."""
    each = nodes.where("depth > 0").select("root", "node", "depth", F.posexplode("path").alias("at", "id"))
    about = graph.methods.select("id", "class_id").join(graph.classes.select(F.col("id").alias("class_id"), "layer", "domain"), "class_id")
    weight = F.expr(f"{r.lookup('layer', r.PATH_LAYER_WEIGHTS, 1.0)} + 0.1 * {r.lookup('domain', r.DOMAIN_PRIORITY, 1)}").cast("double")
    return each.join(about, "id").groupBy("root", "node").agg((F.count(F.lit(1)) - 1).alias("length"), (F.countDistinct("layer") - 1).alias("layer_cross"), F.round(F.sum(weight), 6).alias("weight"))


def cross_counts(nodes: DataFrame) -> DataFrame:
    """``id, n_trees, trees``: the distinct trees that hold each method."""
    return nodes.groupBy(F.col("node").alias("id")).agg(F.countDistinct("root").alias("n_trees"), F.array_join(F.array_sort(F.collect_set(F.col("root").cast("string"))), ",").alias("trees"))


def roles(nodes: DataFrame) -> DataFrame:
    """``root, id, role``: ROOT, PARENT (has children), DIRECT_CHILD or DESCENDANT; the first that holds."""
    parents = nodes.where("parent is not null").select("root", F.col("parent").alias("node")).distinct().withColumn("has", F.lit(True))
    role: Column = F.when(F.col("depth") == 0, "ROOT").when(F.col("has"), "PARENT").when(F.col("depth") == 1, "DIRECT_CHILD").otherwise("DESCENDANT")
    return nodes.join(parents, ["root", "node"], "left").select("root", F.col("node").alias("id"), role.alias("role"))
