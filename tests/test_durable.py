"""Cuts of iterative plans."""

from pyspark.sql import functions as F

from callscope.functions.durable import cut
from callscope.operators import traverse


def test_the_estimate_of_a_cut_does_not_grow_over_rounds_of_joins(spark):
    x = cut(spark.range(50).select("id", (F.col("id") % 7).alias("n")))
    for _ in range(8):
        x = cut(x.join(x.select("id", F.col("n").alias("m")), "id").select("id", F.when(F.col("m") > 3, F.col("m")).otherwise(F.col("n")).alias("n")))
    assert int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000
    assert sorted(map(tuple, x.collect())) == [(i, i % 7) for i in range(50)]


def test_a_cut_without_rows(spark):
    x = cut(spark.range(0).select("id", F.array("id").alias("path"), F.struct("id").alias("s")))
    assert x.isEmpty() and x.columns == ["id", "path", "s"]


def test_calls_with_an_unknown_end_join_nothing(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (None, None), (3, 4), (9, 9)], "from_id long, to_id long")
    assert {r["id"]: r["component"] for r in traverse.components(edges).collect()} == {3: 3, 4: 3, 9: 9}


def test_paths_and_reach_read_the_calls_once(spark):
    """Rounds and results stand on the written steps, not on the plan of the calls."""
    edges = spark.range(5).selectExpr("id AS from_id", "id + 1 AS to_id")
    pairs = spark.createDataFrame([(0, 3)], "src long, dst long")
    assert [r["path"] for r in traverse.best_walks(edges, pairs, 5, 1).collect()] == [[0, 1, 2, 3]]
    assert "Range" not in traverse.reach(edges, pairs.select("src"), 2)._jdf.queryExecution().optimizedPlan().toString()


def test_trees_work_on_written_methods_and_calls(spark, sf_dir):
    from callscope.plans.bridge import code_graph
    from callscope.plans.tree_queries import held

    g = code_graph(spark, sf_dir)
    h = held(g)
    assert all("Window" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (h.methods, h.edges))
    assert h.edges.exceptAll(g.edges).isEmpty() and h.edges.count() == g.edges.count() and h.methods.exceptAll(g.methods).isEmpty()
