"""Risk of places, reach and reviews on graphs small enough to score by hand."""

import pytest

from callscope.plans import weight_queries as w
from callscope.plans.graph import CodeGraph


@pytest.fixture(scope="module")
def graph(spark):
    # class 0 is implemented by 1 to 8 and extended by 9 to 14; class 1 depends on 2 to 8
    classes = spark.createDataFrame([(i, None if i < 9 else 0, 0 if 1 <= i <= 8 else None) for i in range(15)], "id long, super_id long, interface_id long")
    methods = spark.createDataFrame([(i, i) for i in range(15)], "id long, class_id long")
    return CodeGraph(classes, methods, methods)


def calls(spark, pairs, layers):
    rows = [(n, a, b, a, b, layers.get(a, "SERVICE"), layers.get(b, "SERVICE")) for n, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "edge_ord long, from_id long, to_id long, from_class long, to_class long, from_layer string, to_layer string")


def test_place(spark, graph):
    got = {r["id"]: r["arch"] for r in w.architecture(graph, calls(spark, [(1, k) for k in range(2, 9)] * 2 + [(1, 1)], {})).collect()}
    # eight implementations: 3 over; six children: 2 over
    assert got[0] == 5 + 3 * 5 + 2 * 6
    assert got[1] == 10 and got[9] == 5 and len(got) == 15


def test_reach(spark, graph):
    layers = {0: "CONTROLLER", 1: "SERVICE", 2: "REPOSITORY", 3: "UTIL", 4: "CONFIG"}
    pairs = [(k, 9) for k in range(6)] * 3 + [(k, 0) for k in range(1, 15)]
    got = {r["id"]: r["blast"] for r in w.blast(graph, calls(spark, pairs, layers)).collect()}
    # 9: six classes call it; behind them fourteen; of five layers two are too many
    assert got[9] == 20 + 10 + 2 * 8
    # 0: fourteen callers, and the six that call one of them
    assert got[0] == 30 + 5 + 2 * 8 and got[14] == 15


def test_review_and_words(spark):
    rows = [(k, f"src/app/{'AppConfig.java' if k < 3 else f'C{k}.java'}", "DELETED" if k < 4 else "MODIFIED", 30, 11, 0, 0) for k in range(12)]
    files = spark.createDataFrame(rows, "class_id long, path string, change string, added long, deleted long, ops int, critical int")
    # 492 lines: 12, 12 files: 3; four files gone: 15 with the lines; three configurations: 10 at most
    assert w.of_review(files).first()[0] == 15 + 15 + 10
    assert w.of_review(files.limit(0)).first()[0] == 5 + 2


def test_points_of_files(spark):
    paths = [("a/AppConfig.java", 25), ("a/x.yml", 25), ("a/AuthFilter.java", 20), ("a/UserController.java", 12), ("db/1.sql", 15), ("a/DateUtil.java", 18), ("a/OrderService.java", 8), ("a/Thing.java", 3)]
    df = spark.createDataFrame(paths, "path string, want int")
    assert all(r["points"] == r["want"] for r in df.select("want", w.file_points(df["path"]).alias("points")).collect())
