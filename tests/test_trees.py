"""Trees, diffs, writers and streams on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.functions import diff
from callscope.operators import traverse, trees
from callscope.plans import tree_queries
from callscope.plans.graph import CodeGraph
from callscope.sources import readers, writers
from callscope.streaming import events

NAMES = ["UserController", "UserService", "UserServiceImpl", "UserRepository", "OrderController", "OrderService", "DateUtil"]
LAYERS = ["CONTROLLER", "SERVICE", "SERVICE", "REPOSITORY", "CONTROLLER", "SERVICE", "UTIL"]
DOMAINS = ["USER", "USER", "USER", "USER", "ORDER", "ORDER", "COMMON"]
METHODS = {1: (0, "getUser"), 2: (0, "registerUser"), 3: (1, "find"), 4: (2, "find"), 5: (3, "findById"), 6: (4, "createOrder"), 7: (5, "create"), 8: (6, "now"), 9: (5, "audit")}
EDGES = [(1, 3), (2, 3), (4, 5), (6, 7), (7, 3), (7, 8), (7, 5), (7, 9), (9, 5), (9, 7)]


@pytest.fixture(scope="module")
def golden(spark):
    classes = [(i, n, f"com.shop.{n}", "com.shop.app", LAYERS[i], DOMAINS[i], "RestController" if LAYERS[i] == "CONTROLLER" else None, None, 1 if i == 2 else None, i == 1, i == 1, f"src/{n}.java") for i, n in enumerate(NAMES)]
    methods = [(k, c, n, 0, "String", True, k == 8, k == 3, False) for k, (c, n) in METHODS.items()]
    edges = [(a, b, "DIRECT", i, i) for i, (a, b) in enumerate(EDGES)]
    return CodeGraph(
        spark.createDataFrame(classes, "id long, name string, qualified_name string, package string, layer string, domain string, annotation string, super_id long, interface_id long, is_abstract boolean, is_interface boolean, file_path string"),
        spark.createDataFrame(methods, "id long, class_id long, name string, n_params int, return_type string, is_public boolean, is_static boolean, is_abstract boolean, is_ctor boolean"),
        spark.createDataFrame(edges, "from_id long, to_id long, call_type string, line int, edge_ord long"),
    )


def test_golden_trees(golden):
    """The golden graph of FIXTURES 2 in full."""
    t = trees.build(golden)
    got = {r["root"]: (r["tree_number"], r["node_count"], r["depth"], r["cross_nodes"]) for r in trees.sizes(golden, t).collect()}
    assert got == {1: ("T001", 2, 1, 0), 2: ("T002", 2, 1, 0), 6: ("T003", 5, 2, 1)}
    parents = {(r["root"], r["node"]): (r["parent"], r["depth"]) for r in t.nodes.where("depth > 0").collect()}
    assert parents == {(1, 3): (1, 1), (2, 3): (2, 1), (6, 7): (6, 1), (6, 3): (7, 2), (6, 5): (7, 2), (6, 9): (7, 2)}
    paths = {(r["root"], r["node"]): (r["length"], r["weight"], r["layer_cross"]) for r in trees.core_paths(golden, t.nodes).collect()}
    assert paths == {(1, 3): (1, 20.0, 1), (2, 3): (1, 20.0, 1), (6, 7): (1, 19.8, 1), (6, 3): (2, 28.8, 1), (6, 5): (2, 26.8, 2), (6, 9): (2, 28.7, 1)}


def test_golden_weights(golden):
    methods = {r["id"]: (r["cross_count"], r["weight"]) for r in tree_queries.weighed(golden, "r1_method_weight").collect()}
    assert methods == {1: (1, 38.5), 2: (1, 37.5), 3: (3, 33.866025), 4: (0, 17.0), 5: (1, 20.366025), 6: (1, 39.5), 7: (1, 23.224745), 8: (0, 6.5), 9: (1, 20.366025)}
    classes = {r["id"]: r["weight"] for r in tree_queries.weighed(golden, "r2_class_weight").collect()}
    assert classes[1] == 48.60206


def test_walks_between_ends(spark):
    """Brute force over a small dense graph, parallel edges and loops included."""
    r = random.Random(3)
    arcs = [(r.randrange(9), r.randrange(9)) for _ in range(30)]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(arcs)], "from_id long, to_id long, edge_ord long")
    pairs = [(a, b) for a in range(3) for b in range(3, 6)]
    steps = sorted(set(arcs))
    walks = [(a, b, (a,)) for a, b in pairs]
    all_, simple = [], []
    for _ in range(4):
        walks = [(a, b, (*p, y)) for a, b, p in walks for x, y in steps if x == p[-1] and (x, y) not in set(zip(p, p[1:]))]
        all_ += [w for w in walks if w[2][-1] == w[1]]
    simple = [w for w in all_ if len(set(w[2])) == len(w[2])]
    best = []
    for a, b in pairs:
        best += sorted((w for w in all_ if w[:2] == (a, b)), key=lambda w: (len(w[2]), w[2]))[:3]
    asked = spark.createDataFrame(pairs, "src long, dst long")
    got = lambda df: sorted((x["src"], x["dst"], tuple(x["path"])) for x in df.collect())
    assert got(traverse.best_walks(edges, asked, 4, 3)) == sorted(best)
    assert got(traverse.simple_paths(edges, asked, 4)) == sorted(simple)


def test_components_against_union_find(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700), (5, 5)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(links, "from_id long, to_id long")
    assert {x["id"]: x["component"] for x in traverse.components(edges).collect()} == {x: find(x) for x in parent}


def test_a_root_inside_an_earlier_tree_gives_none(spark, golden):
    roots = spark.createDataFrame([(6, 4), (7, 5)], "root long, class_id long")
    assert [r["root"] for r in trees.build(golden, roots).trees.collect()] == [6]


def test_a_skipped_root_hides_none(spark, golden):
    """By order: 0 holds 1 (skipped), 1 holds 2 only beyond the depth of 0's tree, so 2 has a tree."""
    chain = [(0, 1), *((i, i + 1) for i in range(100, 109)), (1, 100), (109, 2)]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(chain)], "from_id long, to_id long, edge_ord long")
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "root long, class_id long")
    assert [r["root"] for r in trees.kept_roots(edges, roots, 10).orderBy("first").collect()] == [0, 2]


def test_depth_is_capped(spark, golden):
    chain = spark.createDataFrame([(i, i + 1, "DIRECT", 1, i) for i in range(20)], "from_id long, to_id long, call_type string, line int, edge_ord long")
    found = traverse.reach(chain, spark.createDataFrame([(0,)], "src long"), 10).collect()
    assert max(r["depth"] for r in found) == 10


def test_empty_graph(spark, golden):
    none = CodeGraph(golden.classes.limit(0), golden.methods.limit(0), golden.edges.limit(0))
    assert trees.build(none).trees.isEmpty()


OLD = ["def area(w, h):", "    s = w * h", "    return s", ""]
NEW = ["def area(w, h):", "    s = w + h", "    s *= 2", "    return s", ""]


def test_line_diff():
    n, lines = diff.changes(OLD, NEW)
    assert n == 3
    assert [k for k, *_ in lines] == ["UNCHANGED", "REMOVED", "ADDED", "ADDED", "UNCHANGED", "UNCHANGED"]
    assert diff.changes(["a", "b"], ["a", "b", "b"])[0] == 2
    assert diff.changes([], ["x"])[1] == [("ADDED", "x", None, 1)]


def test_line_diff_column(spark):
    df = spark.createDataFrame([("\n".join(OLD), "\n".join(NEW)), (None, "x"), ("", "")], "a string, b string")
    rows = df.select(diff.line_diff(F.col("a"), F.col("b")).alias("d")).select("d.lcs", "d.added", "d.removed").collect()
    assert [tuple(r) for r in rows] == [(3, 2, 1), (0, 1, 0), (0, 0, 0)]


def test_java_hash(spark):
    row = spark.createDataFrame([("hello", "")], "a string, b string").select(diff.java_hash(F.col("a")), diff.java_hash(F.col("b"))).first()
    assert tuple(row) == (99162322, 0)


def test_block_body(spark):
    df = spark.createDataFrame([("x void f() { if (a) { b(); } } tail", "void f"), ("none", "void f"), (None, "f")], "t string, s string")
    assert [r[0] for r in df.select(diff.block_body(F.col("t"), F.col("s"))).collect()] == ["void f() { if (a) { b(); } }", None, None]


def test_graph_round_trip_and_script(spark, golden, tmp_path):
    path = f"file://{tmp_path}/graph"
    counts = {r["what"]: r["n"] for r in writers.write_graph(golden, path).collect()}
    assert counts == {"classes": 7, "methods": 9, "edges": 10}
    back = readers.read_graph(spark, path)
    assert sorted(back.edges.collect()) == sorted(golden.edges.collect())
    told = {r["kind"]: (r["n_written"], r["n_rows"]) for r in writers.write_script(golden, f"{path}-script").collect()}
    assert told == {"4-classes": (7, 7), "5-methods": (9, 9), "7-calls": (10, 10)}
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{path}-script/text").collect())
    assert text.count("  {fromId: ") == 10 and text.count("CREATE INDEX ") == 6 and text.count("CREATE CONSTRAINT ") == 2 and text.count("-[:CONTAINS]->") == 1
    assert text.count("UNWIND rows AS r") == sum(1 for r in writers.bodies(golden).collect())
    assert writers.statistics_json(golden).count() == 1


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 500 AS o", "id AS x").repartition(7)
    got = writers.numbered(rows, "o", "x").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1000)) and [(r["o"], r["x"]) for r in got] == sorted((r["o"], r["x"]) for r in got)
    sizes = writers.chunked(rows, F.col("x").cast("string"), "o", 64, "k").orderBy("chunk").collect()
    assert [r["n_rows"] for r in sizes] == [64] * 15 + [40]


def test_quotes_in_scripts(spark):
    got = spark.createDataFrame([("it's \\ so",), (None,)], "x string").select(writers.escaped(F.col("x"))).collect()
    assert [r[0] for r in got] == ["'it\\'s \\\\ so'", "''"]


def test_source_files_and_calls(spark, tmp_path):
    for name in ("app/A.java", "build/B.java", "app/C.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("class A { void f() { repo.save(x); log.info(1); } }")
    calls = readers.call_sites(readers.source_files(spark, str(tmp_path))).select("receiver", "name").collect()
    assert sorted(tuple(c) for c in calls) == [("log", "info"), ("repo", "save")]


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, text string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "path string, text string")
    assert {r["path"]: r["change"] for r in readers.snapshot_changes(old, new).collect()} == {"a": "DELETED", "c": "MODIFIED", "d": "ADDED"}


def test_stream_gives_what_the_batch_gives(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    got = events.run_to_end(events.windowed_counts(stream, "1 day"), "counts_of_events")
    want = events.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_upsert(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string")
    assert sorted(tuple(r) for r in events.upserted(now, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
