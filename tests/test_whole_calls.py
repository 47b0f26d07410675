"""Queries over all calls of an order, and hops of classes that share a name or an id."""

import oracle

from callscope.plans import catalog
from callscope.plans.bridge import code_graph
from callscope.plans.graph import CodeGraph
from callscope.plans.graph_queries import ask


def test_every_two_consecutive_parts_of_an_order_call(spark, sf_dir):
    want = oracle.connection(sf_dir).execute("SELECT count(*) FROM (SELECT l_partkey AS b, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem) x WHERE a <> b").fetchone()[0]
    assert catalog.queries()["a1_graph_totals"](spark, sf_dir).where("what = 'edges'").first()["n"] == want
    assert catalog.queries()["p23_confidence"](spark, sf_dir).count() == want
    assert code_graph(spark, sf_dir).edges.count() < want


def test_hops_of_classes_that_share_a_name_or_an_id(spark):
    classes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "C"), (5, None), (6, "D"), (6, "E"), (7, None)], "id long, name string").selectExpr("id", "name", "'X' AS layer", "'Y' AS domain")
    methods = spark.createDataFrame([(c * 10, c, "m") for c in range(1, 8)], "id long, class_id long, name string")
    calls = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (1, 5), (5, 4), (1, 7), (7, 4), (6, 2), (6, 3), (4, 6), (2, 2), (5, 6)]
    edges = spark.createDataFrame([(a * 10, b * 10, "DIRECT", 1, i) for i, (a, b) in enumerate(calls)], "from_id long, to_id long, call_type string, line int, edge_ord long")
    names = {1: ["A"], 2: ["B"], 3: ["B"], 4: ["C"], 5: [None], 6: ["D", "E"], 7: [None]}
    one = {("callee", a, x, y, 1) for a, b in calls for x in names[a] for y in names[b]} | {("caller", b, x, y, 1) for a, b in calls for x in names[a] for y in names[b]}
    two = {(r, c, x, y, 2) for a, b in calls for c2, d in calls if b == c2 for r, c, e, f in (("callee", a, b, d), ("caller", d, a, b)) for x in names[e] for y in names[f]}
    got = [(r["role"], r["center"], r["src"], r["dst"], r["hop"]) for r in ask(CodeGraph(classes, methods, edges), "c16_dependency_graph").collect()]
    assert len(got) == len(set(got)) and set(got) == one | two
