"""Containment joins and method segments against loops."""

import random

import pytest

from callscope.operators.contains import containing
from callscope.plans import file_queries


def pairs_of(spark, needles, hay):
    df = lambda x: spark.createDataFrame([(v,) for v in x], "s string")
    return sorted(map(tuple, containing(df(needles), df(hay)).collect()))


def test_containing_against_a_loop(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    needles = [word(rng.randint(1, 6)) for _ in range(80)] + ["", None, "zzz", "abservice", "é日", "日"]
    hay = [word(rng.randint(0, 20)) for _ in range(120)] + ["x" + "service" * 40, None, "xabservicex", "aé日b", "a"]
    want = sorted({(n, h) for n in needles for h in hay if n and h and n in h})
    assert pairs_of(spark, needles * 2, hay * 2) == want
    assert pairs_of(spark, [], hay) == [] and pairs_of(spark, needles, []) == []


def test_a_common_gram_is_not_joined(spark):
    """All names hold 'Service'; each is looked up by what is rare in it."""
    names = [f"Name{k:04d}Service" for k in range(1500)]
    assert len(pairs_of(spark, names, names)) == 1500


@pytest.mark.parametrize("name", ["j13_tests_of_files", "j13_tests_of_classes", "j19_missing_tests", "w2_method_segments"])
def test_no_nested_loop(spark, sf_dir, name):
    plan = file_queries.FILES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_tests(spark):
    rows = [("src/A/UserService.java", "UserService", False, 4), ("src/A/User.java", "User", False, 0), ("src/A/Cart.java", "Cart", False, 2), ("t/userserviceTest.java", "userserviceTest", True, 2), ("t/UserSpec.kt", "UserSpec", True, 1), ("t/integration/Cart1Test.kt", "Cart1Test", True, 9)]
    f = spark.createDataFrame(rows, "path string, name string, is_test boolean, n_methods long")
    pairs, of_all = file_queries.tests_of_files(f)
    got = {(r["path"][6:], r["test_path"]) for r in pairs.collect()}
    # the stem "user" is in "UserService"; "cart1" holds "Cart"
    assert got == {("UserService.java", "t/userserviceTest.java"), ("User.java", "t/userserviceTest.java"), ("User.java", "t/UserSpec.kt"), ("UserService.java", "t/UserSpec.kt"), ("Cart.java", "t/integration/Cart1Test.kt")}
    assert of_all.isEmpty()
    got = {r["path"][6:]: (r["n_tests"], r["coverage"], r["completeness"]) for r in file_queries.coverage(f).collect()}
    assert got == {"UserService.java": (2, "PARTIAL_COVERAGE", 0.75), "User.java": (2, "PARTIAL_COVERAGE", 1.0), "Cart.java": (1, "BASIC_COVERAGE", 1.0)}
    bare = f.unionByName(spark.createDataFrame([("t/integration/Test.java", "Test", True, 1)], f.schema))
    got = {r["path"][6:]: (r["n_tests"], r["coverage"]) for r in file_queries.coverage(bare).collect()}
    assert got["Cart.java"] == (2, "COMPREHENSIVE_COVERAGE") and got["User.java"] == (3, "COMPREHENSIVE_COVERAGE")


def test_segments_of_a_hunk(spark):
    lines = ["ADDED|x = 1;", "CONTEXT|  public int a(int n) {", "ADDED|    if (n) return 1;", "DELETED|    try { go(); }", "CONTEXT|  }", "ADDED|private void b() {", "CONTEXT|public int field;", "ADDED|while (c) step();"]
    rows = [("p", 1, i, *x.split("|")) for i, x in enumerate(lines)] + [("p", 2, 20, "DELETED", "protected void c(int x) {"), ("p", 2, 21, "DELETED", "for (;;) {}"), ("q", 1, 0, "ADDED", "no start")]
    got = file_queries.segments(spark.createDataFrame(rows, "path string, hunk long, ix long, kind string, content string")).orderBy("path", "hunk", "segment").collect()
    assert [(r["hunk"], r["signature"], r["added"], r["deleted"], r["n_lines"], r["complexity"], r["change"]) for r in got] == [(1, "public int a(int n) {", 1, 1, 3, 2, "MODIFIED"), (1, "private void b() {", 1, 0, 2, 1, "ADDED"), (2, "protected void c(int x) {", 0, 1, 1, 1, "DELETED")]


@pytest.mark.parametrize("name", ["j13_tests_of_files", "j19_missing_tests"])
def test_tables_of_names_stay_out_of_the_driver(spark, sf_dir, name):
    df = file_queries.FILES[name](spark, sf_dir)
    df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
