"""Line diffs against the full table of lengths."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.functions import diff
from callscope.plans import text_queries


def plain_common(old, new):
    """By the table of all prefixes."""
    lengths = np.zeros((len(old) + 1, len(new) + 1), int)
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            lengths[i + 1, j + 1] = lengths[i, j] + 1 if x == y else max(lengths[i, j + 1], lengths[i + 1, j])
    i, j, found = len(old), len(new), []
    while i and j:
        if old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            found.append(old[i])
        elif lengths[i - 1, j] > lengths[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


@pytest.mark.parametrize("cells", [diff.FRONT_CELLS, 60])
def test_common_lines_against_the_table(cells):
    rng = random.Random(7)
    for _ in range(1500):
        letters = "ab" if rng.random() < 0.4 else "abcdefgh"
        old = [rng.choice(letters) for _ in range(rng.randint(0, 14))]
        new = [rng.choice(letters) for _ in range(rng.randint(0, 14))] if rng.random() < 0.6 else [x for x in old if rng.random() < 0.8]
        assert diff.common(old, new, cells) == plain_common(old, new), (old, new)


def test_long_fronts_are_thinned():
    rng = random.Random(3)
    old, new = ([str(rng.randint(0, 60)) for _ in range(400)] for _ in range(2))
    assert diff.common(old, new, cells=4000) == plain_common(old, new)


def test_first_places_and_order():
    assert diff.changes(["a", "a"], ["a"]) == (1, [("UNCHANGED", "a", 1, 1), ("REMOVED", "a", 2, None)])
    assert diff.changes(["a"], ["b"])[1] == [("REMOVED", "a", 1, None), ("ADDED", "b", None, 1)]
    assert [k for k, *_ in diff.changes(["x", "k", "y"], ["p", "k"])[1]] == ["REMOVED", "ADDED", "UNCHANGED", "REMOVED"]


# The documented line-diff cases.
CASES = [
    (["public class Test {", "    int a;", "    System.out.println(x);", "}"], ["public class Test {", "    int b;", "    int c;", "    System.out.println(x);", "}"], ["public class Test {", "    System.out.println(x);", "}"]),
    (["a();", "b();"], ["a();", "a();", "b();"], ["a();", "b();"]),
]


@pytest.mark.parametrize(("old", "new", "want"), CASES)
def test_documented_cases(old, new, want):
    n, lines = diff.changes(old, new)
    assert n == len(want) and [x for k, x, *_ in lines if k == "UNCHANGED"] == want


def test_twenty_thousand_lines():
    rng = random.Random(5)
    old = [f"line {rng.randint(0, 5000)}" for _ in range(20_000)]
    new = [f"new {k}" if k % 97 == 0 else x for k, x in enumerate(old) if k % 89]
    began = time.time()
    n, lines = diff.changes(old, new)
    assert time.time() - began < 30
    kept = sum(1 for k in range(20_000) if k % 89 and k % 97)
    assert n == kept and sum(k == "ADDED" for k, *_ in lines) == len(new) - kept


def test_query_over_whole_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in text_queries.d1_line_diff(spark, sf_dir).collect()}
    assert rows.keys() == docs.keys()
    told = {}
    for r in text_queries.d2_line_changes(spark, sf_dir).collect():
        told.setdefault(r["doc_id"], []).append((r["nth"], r["kind"], r["line_no"], r["line"]))
    for i, text in docs.items():
        old, new = (docs.get(i - 1) or "").split("\n") if docs.get(i - 1) else [], text.split("\n") if text else []
        if len(old) * len(new) < 4000:
            held = plain_common(old, new)
            assert (rows[i]["n_common"], rows[i]["added"], rows[i]["removed"]) == (len(held), len(new) - len(held), len(old) - len(held))
        want = [(k, no_old or no_new, x) for k, x, no_old, no_new in diff.changes(old, new)[1] if k != "UNCHANGED"]
        assert [x[1:] for x in sorted(told.get(i, []))] == want


def test_odd_texts(spark):
    df = spark.createDataFrame([(None, None), ("", ""), ("a", None), (None, "a\n"), ("x\n" * 3000, "x\n" * 2999)], "a string, b string")
    got = df.select(diff.line_diff(F.col("a"), F.col("b")).alias("d")).select("d.lcs", "d.added", "d.removed").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 2, 0), (3000, 0, 1)]


def test_diffs_are_sent_on_by_size():
    import pandas as pd

    old, new = pd.Series(["a\nb", None, "x" * 50, "q", ""]), pd.Series(["a", "c", "y", "q", None])
    parts = list(diff.diffs(iter([(old, new), (old[:0], new[:0]), (old, new)]), chars=300))
    whole = list(diff.diffs(iter([(old, new)])))
    assert len(whole) == 1 and len(parts) > 2
    both = pd.concat(parts, ignore_index=True)
    assert both.equals(pd.concat([whole[0]] * 2, ignore_index=True))
