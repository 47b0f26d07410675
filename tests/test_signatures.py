"""Cascade trees against recursion, and types matched one by one."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.plans.graph import CodeGraph
from callscope.plans.review_queries import normalised
from callscope.plans.signature_queries import cascade_tree, j6_typed_implementations


def plain_tree(steps, roots, depth):
    first = {}
    for caller, callee, label in steps:
        first.setdefault(caller, {}).setdefault(label, []).append(callee)
    kids = {c: sorted(x for x in (min(v) for v in by.values()) if x != c) for c, by in first.items()}
    out = []

    def down(root, way):
        if len(way) <= depth:
            for x in kids.get(way[-1], []):
                if x not in way:
                    out.append((root, ">".join(map(str, way)), ">".join(map(str, [*way, x])), len(way), x))
                    down(root, [*way, x])

    for r in roots:
        down(r, [r])
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_cascades_against_recursion(spark, depth):
    rng = random.Random(depth)
    steps = [(rng.randrange(12), rng.randrange(12), f"L{rng.randrange(6)}") for _ in range(60)]  # cycles, calls of oneself, shared labels
    roots = [0, 3, 99]
    df = spark.createDataFrame(steps, "caller long, callee long, label string")
    got = cascade_tree(df, spark.createDataFrame([(r,) for r in roots], "id long"), depth)
    assert sorted((r["root"], r["parent_id"], r["call_id"], r["level"], r["method"]) for r in got.collect()) == plain_tree(steps, roots, depth)


def test_types_without_packages(spark):
    rows = [(" java.util.Map< java.lang.String ,\tX >",), ("java.util.concurrent.Future",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(normalised(F.col("t"))).collect()]
    assert got == ["Map<String,X>", "concurrent.Future", None]


def test_typed_implementations(spark):
    classes = spark.createDataFrame([(1, "I", True, None), (2, "A", False, 1), (3, "B", False, 1), (4, "C", False, None)], "id long, name string, is_interface boolean, interface_id long")
    # ids choose how types are written; 3 of 7 and 4 of 5 take or return something else
    methods = [(8, 1, "find", 2, True, False), (16, 2, "find", 2, True, False), (21, 3, "find", 2, True, False), (28, 3, "find", 1, True, False), (10, 3, "find", 2, True, False), (29, 2, "find", 2, True, False), (30, 2, "find", 2, False, False), (32, 4, "find", 2, True, False), (36, 2, "seek", 2, True, False), (40, 1, "make", 0, True, True), (41, 2, "make", 0, True, False)]
    m = spark.createDataFrame([(*x, "r", False, False) for x in methods], "id long, class_id long, name string, n_params int, is_public boolean, is_static boolean, return_type string, is_abstract boolean, is_ctor boolean")
    got = {r["impl_method"] for r in j6_typed_implementations(CodeGraph(classes, m, m)).collect()}
    assert got == {16, 21}
