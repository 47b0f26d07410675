"""Traversal and tree queries over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import traverse, trees
from callscope.functions.durable import cut
from callscope.plans.bridge import CALL_TYPES, DOMAINS, GRAPH_CTES, LAYERS
from callscope.plans.graph import CodeGraph
from callscope.plans.graph_queries import ask
from callscope.plans.rule_queries import ROOT, WEIGHTS
from callscope.plans.texts import Spark, for_checking

#: Path questions ask of the methods whose id is divisible by this; all edges answer.
ASKED = 20


def some(graph: CodeGraph) -> DataFrame:
    """Sources of path questions."""
    return graph.methods.where(F.col("id") % ASKED == 0).select(F.col("id").alias("src"))


def asked_pairs(graph: CodeGraph) -> DataFrame:
    """``src, dst`` of path questions: each source and the method half the ids away."""
    n = graph.methods.agg(F.count(F.lit(1)).alias("n"))
    return some(graph).crossJoin(F.broadcast(n)).select("src", ((F.col("src") + F.floor(F.col("n") / 2)) % F.col("n")).alias("dst"))  # one row


def joined(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.col("length").cast("bigint").alias("length"), F.array_join("path", ">").alias("path"))


def held(graph: CodeGraph) -> CodeGraph:
    """The graph with its methods and calls written once: trees ask for them in many steps, and rules on names read each name dozens of times."""
    return CodeGraph(graph.classes, cut(graph.methods.repartition("id")), cut(graph.edges))


def nodes(graph: CodeGraph) -> DataFrame:
    return trees.build(graph).nodes


def call_trees(graph: CodeGraph) -> DataFrame:
    return trees.sizes(graph, trees.build(graph))


def weighed(graph: CodeGraph, name: str) -> DataFrame:
    """A score that counts the built trees of methods and classes."""
    built = nodes(graph)
    methods, classes = trees.crossed(graph, built)
    return graph.sql(WEIGHTS[name](Spark()), crossed=methods, class_crossed=classes, tree_roots=built.where("depth = 0").select("root"))


def tree_overview(graph: CodeGraph) -> DataFrame:
    about = graph.methods.select(F.col("id").alias("root"), "class_id").join(graph.classes.select(F.col("id").alias("class_id"), "domain"), "class_id")
    n = nodes(graph).groupBy("root").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").cast("long").alias("max_depth"), F.round(F.avg(F.when(F.col("depth") > 0, F.col("depth").cast("double"))), 6).alias("avg_depth"))
    return n.join(about, "root").select("root", "domain", "node_count", "max_depth", "avg_depth")


def graph_statistics(graph: CodeGraph) -> DataFrame:
    """``kind, k, value``: all totals, averages, and distributions in which what doesn't occur counts 0."""
    built = cut(nodes(graph))
    one = lambda df, k, value: df.agg(value.cast("double").alias("value")).select(F.lit("total").alias("kind"), F.lit(k).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))
    n = F.count(F.lit(1))
    below = built.where("depth > 0")
    crossing = built.groupBy("node").agg(F.count_distinct("root").alias("n")).where("n > 1")
    depths = built.groupBy("root").agg(F.max("depth").alias("depth"))
    per_class = graph.classes.agg(n.alias("c")).crossJoin(graph.methods.agg(n.alias("m")))  # one row each
    parts = [
        one(graph.classes, "classes", n),
        one(graph.methods, "methods", n),
        one(graph.edges, "edges", n),
        one(depths, "trees", n),
        one(below, "tree relations", n),
        one(below, "core paths", n),
        one(ask(graph, "j6_method_implementations"), "interface mappings", n),
        one(crossing, "cross nodes", n),
        one(depths, "average tree depth", F.round(F.avg("depth"), 6)),
        one(per_class, "average methods of a class", F.round(F.max(F.try_divide("m", "c")), 6)),
    ]
    for kind, names, rows in (("layer", LAYERS, graph.classes.select(F.col("layer").alias("k"))), ("call type", CALL_TYPES, graph.edges.select(F.col("call_type").alias("k"))), ("domain", DOMAINS, graph.classes.select(F.col("domain").alias("k")))):
        every = graph.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("k"))
        counted = rows.groupBy("k").agg(n.alias("n"))
        parts.append(every.join(counted, "k", "left").select(F.lit(kind).alias("kind"), "k", F.coalesce("n", F.lit(0)).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TREE: dict[str, Callable[[CodeGraph], DataFrame]] = {
    "g1_call_trees": call_trees,
    "g2_tree_depths": lambda g: nodes(g).select("root", "node", F.col("depth").cast("bigint").alias("depth")),
    "g4_core_paths": lambda g: trees.core_paths(g, nodes(g)),
    "g5_tree_sizes": lambda g: nodes(g).groupBy("root").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").cast("bigint").alias("depth"), (F.count(F.lit(1)) - 1).alias("n_paths")),
    "g6_shortest_paths": lambda g: joined(traverse.best_walks(g.edges, asked_pairs(g), 5, 1)),
    "g7_all_paths": lambda g: joined(traverse.best_walks(g.edges, asked_pairs(g), 5, 10)),
    "g12_connected": lambda g: traverse.reach(g.edges, some(g), 2, "both").select("src", "node", F.col("depth").cast("bigint").alias("depth")),
    "g13_simple_paths": lambda g: joined(traverse.simple_paths(g.edges, asked_pairs(g), 4)),
    "g20_node_roles": lambda g: trees.roles(nodes(g)),
    "g21_tree_children": lambda g: nodes(g).where("parent is not null").groupBy("root", "parent").agg(F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ",").alias("children")),
    "g23_affected": lambda g: traverse.affected(g.edges, some(g)),
    "a4_cross_counts": lambda g: trees.cross_counts(nodes(g)),
    "a5_class_cross_counts": lambda g: nodes(g).join(g.methods.select(F.col("id").alias("node"), "class_id"), "node").groupBy("class_id").agg(F.countDistinct("root").alias("n_trees")),
    "a15_tree_structure": lambda g: nodes(g).groupBy("root", F.col("depth").cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("n")),
    "a16_tree_overview": tree_overview,
    "a17_path_summary": lambda g: nodes(g).where("depth > 0").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("depth") + 1.0), 6).alias("avg_length"), F.max("depth").cast("bigint").alias("max_depth")),
    "a26_components": lambda g: traverse.components(g.edges),
    "j16_unvisited": lambda g: g.methods.select("id").join(traverse.reach(g.edges, some(g), 3).select(F.col("node").alias("id")), "id", "left_anti"),
    "a1_graph_statistics": graph_statistics,
    "t7_tree_order": lambda g: tree_overview(g).orderBy(F.desc("domain"), F.desc("node_count"), "root"),
}

_ALLOWED = """allowed AS (SELECT m.id FROM methods m JOIN classes c ON m.class_id = c.id WHERE m.is_public AND NOT m.is_ctor AND NOT contains(lower(c.name), 'util') AND NOT contains(lower(c.name), 'helper')
  AND NOT (contains(lower(c.package), 'util') OR (contains(lower(c.package), 'common') AND c.layer = 'UTIL')))"""


def _levels() -> str:
    """The roots that no earlier tree holds, and their trees, one common table for each level."""
    out = [
        _ALLOWED,
        "step AS MATERIALIZED (SELECT from_id, to_id, min(edge_ord) AS edge_ord FROM edges JOIN allowed a ON a.id = to_id GROUP BY from_id, to_id)",
        f"roots AS MATERIALIZED (SELECT m.id AS root, row_number() OVER (ORDER BY m.class_id, m.id) AS rn FROM methods m JOIN classes c ON m.class_id = c.id WHERE {ROOT})",
        "near0 AS (SELECT root, root AS node FROM roots)",
    ]
    for k in range(1, 11):
        old = " UNION ALL ".join(f"SELECT root, node FROM near{i}" for i in range(k))
        out.append(f"near{k} AS MATERIALIZED (SELECT DISTINCT n.root, s.to_id AS node FROM near{k - 1} n JOIN step s ON s.from_id = n.node ANTI JOIN ({old}) o ON o.root = n.root AND o.node = s.to_id)")
    reached = " UNION ALL ".join(f"SELECT root, node FROM near{i}" for i in range(1, 11))
    out += [
        f"earlier AS (SELECT b.rn, list(a.root) AS before FROM ({reached}) n JOIN roots a ON a.root = n.root JOIN roots b ON b.root = n.node WHERE a.rn < b.rn GROUP BY b.rn)",
        "queue AS MATERIALIZED (SELECT r.root, r.rn, coalesce(e.before, CAST([] AS BIGINT[])) AS before FROM roots r LEFT JOIN earlier e ON e.rn = r.rn)",
        "chosen AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT q.rn, CASE WHEN list_has_any(c.kept, q.before) THEN c.kept ELSE list_append(c.kept, q.root) END FROM chosen c JOIN queue q ON q.rn = c.rn + 1)",
        "kept AS MATERIALIZED (SELECT unnest(kept) AS root FROM (SELECT kept FROM chosen ORDER BY rn DESC LIMIT 1))",
        "lev0 AS (SELECT root, root AS node, CAST(NULL AS BIGINT) AS parent, 0 AS depth, CAST(0 AS BIGINT) AS pos, [root] AS path FROM kept)",
    ]
    for k in range(1, 11):
        old = " UNION ALL ".join(f"SELECT root, node FROM lev{i}" for i in range(k))
        out.append(
            f"lev{k} AS MATERIALIZED (SELECT root, to_id AS node, from_id AS parent, {k} AS depth, row_number() OVER (PARTITION BY root ORDER BY up, edge_ord) - 1 AS pos, list_append(path, to_id) AS path FROM ("
            f"SELECT v.root, s.to_id, s.from_id, s.edge_ord, v.pos AS up, v.path, row_number() OVER (PARTITION BY v.root, s.to_id ORDER BY v.pos, s.edge_ord) AS nth FROM lev{k - 1} v JOIN step s ON s.from_id = v.node "
            f"ANTI JOIN ({old}) o ON o.root = v.root AND o.node = s.to_id WHERE NOT list_contains(v.path, s.to_id)) x WHERE nth = 1)"
        )
    return ",\n".join([*out, "nodes AS (" + " UNION ALL ".join(f"SELECT root, node, parent, CAST(depth AS BIGINT) AS depth, path FROM lev{i}" for i in range(11)) + ")"])


_NODES = _levels()
_SOME = f"picked AS (SELECT id AS src FROM methods WHERE id % {ASKED} = 0)"
_PAIRS = f"pairs AS (SELECT id AS src, (id + (SELECT count(*) FROM methods) // 2) % (SELECT count(*) FROM methods) AS dst FROM methods WHERE id % {ASKED} = 0)"
_STEPS = "steps AS (SELECT DISTINCT from_id AS a, to_id AS b FROM edges)"
_BOTH = "steps AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges)"
_NEAR = lambda n: f"near AS (SELECT src, src AS node, 0 AS depth FROM picked UNION SELECT n.src, s.b, n.depth + 1 FROM near n JOIN steps s ON s.a = n.node WHERE n.depth < {n})"
_PATHS = "paths AS (SELECT src, dst, src AS tail, [src] AS path FROM pairs UNION ALL SELECT p.src, p.dst, s.b, list_append(p.path, s.b) FROM paths p JOIN steps s ON s.a = p.tail WHERE len(p.path) <= 3 AND s.b <> p.dst AND NOT list_contains(p.path, s.b))"
_OVERVIEW = "over AS (SELECT n.root, c.domain, CAST(count(*) AS BIGINT) AS node_count, max(depth) AS max_depth, round(avg(CASE WHEN depth > 0 THEN CAST(depth AS DOUBLE) END), 6) AS avg_depth FROM nodes n JOIN methods m ON m.id = n.root JOIN classes c ON c.id = m.class_id GROUP BY n.root, c.domain)"
_CROSSED = "crossed AS (SELECT node AS id, count(DISTINCT root) AS n FROM nodes GROUP BY node), class_crossed AS (SELECT m.class_id AS id, count(DISTINCT root) AS n FROM nodes JOIN methods m ON m.id = node GROUP BY m.class_id), tree_roots AS (SELECT root FROM kept)"


_COUNTS = {
    "classes": "SELECT count(*) FROM classes",
    "methods": "SELECT count(*) FROM methods",
    "edges": "SELECT count(*) FROM edges",
    "trees": "SELECT count(*) FROM kept",
    "tree relations": "SELECT count(*) FROM nodes WHERE depth > 0",
    "core paths": "SELECT count(*) FROM nodes WHERE depth > 0",
    "interface mappings": "SELECT count(*) FROM classes c JOIN classes i ON i.id = c.interface_id AND i.is_interface AND NOT c.is_interface JOIN methods im ON im.class_id = i.id AND NOT im.is_static JOIN methods m ON m.class_id = c.id AND m.name = im.name AND m.n_params = im.n_params AND m.is_public AND NOT m.is_static",
    "cross nodes": "SELECT count(*) FROM (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT root) > 1) x",
    "average tree depth": "SELECT round(coalesce(avg(d), 0), 6) FROM (SELECT max(depth) AS d FROM nodes GROUP BY root) x",
    "average methods of a class": "SELECT round((SELECT count(*) FROM methods) / (SELECT count(*) FROM classes), 6)",
}
_BUCKETS = [("layer", LAYERS, "classes", "layer"), ("call type", CALL_TYPES, "edges", "call_type"), ("domain", DOMAINS, "classes", "domain")]
_STATISTICS = " UNION ALL ".join([f"SELECT 'total' AS kind, '{k}' AS k, CAST(({q}) AS DOUBLE) AS value" for k, q in _COUNTS.items()] + [f"SELECT '{kind}', k, CAST((SELECT count(*) FROM {t} WHERE {c} = k) AS DOUBLE) FROM (SELECT unnest({names!r}) AS k) n" for kind, names, t, c in _BUCKETS])


def _sql(*ctes: str) -> str:
    *before, last = ctes
    return "WITH RECURSIVE " + ",\n".join([GRAPH_CTES, *before]) + "\n" + last


def _best(most: int) -> str:
    """The first walks of one to five steps between the ends that repeat no step, by length and then by list; pairs with enough go no further."""
    out = ["f0 AS (SELECT src, dst, src AS tail, [src] AS path, CAST([] AS BIGINT[]) AS used FROM pairs)"]
    code = "s.a * 4294967296 + s.b"
    for n in range(1, 6):
        out.append(f"e{n} AS MATERIALIZED (SELECT f.src, f.dst, list_append(f.path, s.b) AS path FROM f{n - 1} f JOIN steps s ON s.a = f.tail AND s.b = f.dst WHERE NOT list_contains(f.used, {code}))")
        ended = " UNION ALL ".join(f"SELECT src, dst FROM e{k}" for k in range(1, n + 1))
        out.append(f"open{n} AS MATERIALIZED (SELECT p.src, p.dst FROM pairs p ANTI JOIN (SELECT src, dst FROM ({ended}) x GROUP BY src, dst HAVING count(*) >= {most}) d ON d.src = p.src AND d.dst = p.dst)")
        if n < 5:
            out.append(f"f{n} AS MATERIALIZED (SELECT f.src, f.dst, s.b AS tail, list_append(f.path, s.b) AS path, list_append(f.used, {code}) AS used FROM (SELECT f.* FROM f{n - 1} f SEMI JOIN open{n} o ON o.src = f.src AND o.dst = f.dst) f JOIN steps s ON s.a = f.tail WHERE NOT list_contains(f.used, {code}))")
    every = " UNION ALL ".join(f"SELECT * FROM e{n}" for n in range(1, 6))
    return ",\n".join(out) + f"""
SELECT src, dst, CAST(len(path) - 1 AS BIGINT) AS length, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(path), path) AS nth FROM ({every}) w) x WHERE nth <= {most}"""


TREE_SQL = {
    "g2_tree_depths": _sql(_NODES, "SELECT root, node, depth FROM nodes"),
    "g5_tree_sizes": _sql(_NODES, "SELECT root, CAST(count(*) AS BIGINT) AS node_count, max(depth) AS depth, CAST(count(*) - 1 AS BIGINT) AS n_paths FROM nodes GROUP BY root"),
    "g1_call_trees": _sql(
        _NODES,
        "polled AS (SELECT v.root, count(*) AS n FROM nodes v JOIN edges e ON e.from_id = v.node JOIN allowed a ON a.id = e.to_id WHERE v.depth < 10 AND NOT list_contains(v.path, e.to_id) GROUP BY v.root)",
        "SELECT n.root, 'T' || lpad(CAST(k.nr AS VARCHAR), CAST(greatest(3, len(CAST(k.nr AS VARCHAR))) AS INTEGER), '0') AS tree_number, n.node_count, n.depth, coalesce(p.n, 0) - n.node_count + 1 AS cross_nodes FROM (SELECT root, CAST(count(*) AS BIGINT) AS node_count, CAST(max(depth) AS INTEGER) AS depth FROM nodes GROUP BY root) n JOIN (SELECT r.root, row_number() OVER (ORDER BY r.rn) AS nr FROM roots r JOIN kept USING (root)) k ON k.root = n.root LEFT JOIN polled p ON p.root = n.root",
    ),
    "g4_core_paths": _sql(
        _NODES,
        f"each AS (SELECT root, node, unnest(path) AS id FROM nodes WHERE depth > 0)",
        f"SELECT root, node, CAST(count(*) - 1 AS BIGINT) AS length, CAST(count(DISTINCT layer) - 1 AS BIGINT) AS layer_cross, round(sum(CASE layer WHEN 'CONTROLLER' THEN 10.0 WHEN 'SERVICE' THEN 8.0 WHEN 'REPOSITORY' THEN 6.0 WHEN 'COMPONENT' THEN 4.0 WHEN 'UTIL' THEN 2.0 ELSE 1.0 END + 0.1 * CASE domain WHEN 'USER' THEN 10 WHEN 'ORDER' THEN 9 WHEN 'PAYMENT' THEN 8 WHEN 'PRODUCT' THEN 7 WHEN 'AUTH' THEN 6 WHEN 'SYSTEM' THEN 3 WHEN 'COMMON' THEN 2 ELSE 1 END), 6)::DOUBLE AS weight FROM each JOIN methods m ON m.id = each.id JOIN classes c ON c.id = m.class_id GROUP BY root, node",
    ),
    "g20_node_roles": _sql(_NODES, "SELECT n.root, n.node AS id, CASE WHEN n.depth = 0 THEN 'ROOT' WHEN EXISTS (SELECT 1 FROM nodes k WHERE k.root = n.root AND k.parent = n.node) THEN 'PARENT' WHEN n.depth = 1 THEN 'DIRECT_CHILD' ELSE 'DESCENDANT' END AS role FROM nodes n"),
    "g21_tree_children": _sql(_NODES, "SELECT root, parent, array_to_string(list_sort(list(CAST(node AS VARCHAR))), ',') AS children FROM nodes WHERE parent IS NOT NULL GROUP BY root, parent"),
    "g6_shortest_paths": _sql(_PAIRS, _STEPS, ", " + _best(1)),
    "g7_all_paths": _sql(_PAIRS, _STEPS, ", " + _best(10)),
    "g12_connected": _sql(_SOME, _BOTH, _NEAR(2), "SELECT src, node, CAST(min(depth) AS BIGINT) AS depth FROM near GROUP BY src, node"),
    "g13_simple_paths": _sql(_PAIRS, _STEPS, _PATHS, "SELECT src, dst, CAST(len(path) - 1 AS BIGINT) AS length, array_to_string(path, '>') AS path FROM (SELECT p.src, p.dst, list_append(p.path, s.b) AS path FROM paths p JOIN steps s ON s.a = p.tail AND s.b = p.dst) x"),
    "g23_affected": _sql(_SOME, _BOTH, _NEAR(2), "SELECT DISTINCT node AS id FROM near"),
    "a4_cross_counts": _sql(_NODES, "SELECT node AS id, CAST(count(DISTINCT root) AS BIGINT) AS n_trees, array_to_string(list_sort(list(DISTINCT CAST(root AS VARCHAR))), ',') AS trees FROM nodes GROUP BY node"),
    "a5_class_cross_counts": _sql(_NODES, "SELECT m.class_id, CAST(count(DISTINCT root) AS BIGINT) AS n_trees FROM nodes n JOIN methods m ON m.id = n.node GROUP BY m.class_id"),
    "a15_tree_structure": _sql(_NODES, "SELECT root, depth, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY root, depth"),
    "a16_tree_overview": _sql(_NODES, _OVERVIEW, "SELECT * FROM over"),
    "a17_path_summary": _sql(_NODES, "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(depth AS DOUBLE) + 1), 6) AS avg_length, max(depth) AS max_depth FROM nodes WHERE depth > 0"),
    "a26_components": _sql(_BOTH, "reached AS (SELECT DISTINCT a AS id, a AS other FROM steps UNION SELECT r.id, s.b FROM reached r JOIN steps s ON s.a = r.other)", "SELECT id, min(other) AS component FROM reached GROUP BY id"),
    "j16_unvisited": _sql(_SOME, _STEPS, _NEAR(3), "SELECT id FROM methods WHERE id NOT IN (SELECT node FROM near)"),
    "a1_graph_statistics": _sql(_NODES, _STATISTICS),
    "t7_tree_order": _sql(_NODES, _OVERVIEW, "SELECT * FROM over ORDER BY domain DESC, node_count DESC, root"),
}
TREE_SQL |= {n: for_checking(t, f"{GRAPH_CTES},\n{_NODES},\n{_CROSSED}") for n, t in WEIGHTS.items()}
TREE |= {n: (lambda g, n=n: weighed(g, n)) for n in WEIGHTS}
TREE |= {n: (lambda g, f=TREE[n]: f(held(g))) for n, t in TREE_SQL.items() if _NODES in t}
