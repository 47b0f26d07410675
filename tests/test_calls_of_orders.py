"""Queries over all calls of an order, against plain loops over the rows of lineitem: each two consecutive parts call, whenever they are shipped."""

from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from callscope.functions.rules import CONFIDENCE
from callscope.plans import catalog
from callscope.plans.bridge import CALL_TYPES, code_graph


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    classes, methods = {r["id"]: r for r in g.classes.collect()}, {r["id"]: r for r in g.methods.collect()}
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect():
        orders[r[0]].append(tuple(r)[1:])
    edges, calls = [], []
    for k, items in orders.items():
        items.sort()
        for rn, (a, b) in enumerate(zip(items, items[1:], strict=False), 2):
            if a[1] != b[1]:
                edges.append(SimpleNamespace(f=a[1], t=b[1], type=CALL_TYPES[(a[1] + b[1]) % 8], line=b[0], ord=k * 1000 + rn))
    for e in edges:
        if e.f in methods and e.t in methods and methods[e.f]["class_id"] in classes and methods[e.t]["class_id"] in classes:
            e.fc, e.tc = classes[methods[e.f]["class_id"]], classes[methods[e.t]["class_id"]]
            calls.append(e)
    assert calls

    def rows(name, *columns):
        return Counter(tuple(r) for r in catalog.queries()[name](spark, sf_dir).select(*columns).collect())

    return SimpleNamespace(classes=classes, methods=methods, edges=edges, calls=calls, rows=rows)


def grouped(pairs):
    """Distinct second values of each first one."""
    found = defaultdict(set)
    for k, v in pairs:
        found[k].add(v)
    return found


def test_p22_call_type(made):
    got = made.rows("p22_call_type", "edge_ord", F.col("kind") == "STATIC")
    assert got == Counter((e.ord, made.methods[e.t]["is_static"]) for e in made.calls)


def test_p23_confidence(made):
    assert made.rows("p23_confidence", "edge_ord", "call_type", "confidence") == Counter((e.ord, e.type, dict(CONFIDENCE).get(e.type, 0.8)) for e in made.edges)


def test_p28_call_filter(made):
    words = ("delete", "remove", "update", "save")  # verbs of names that are dangerous
    got = {k: n for k, n in made.rows("p28_call_filter", "edge_ord", "dangerous").items()}
    assert set(got.values()) == {1} and {o for o, _ in got} == {e.ord for e in made.calls}
    assert {e.ord for e in made.calls if made.methods[e.t]["name"].startswith(words)} <= {o for o, dangerous in got if dangerous}


def test_j2_valid_calls(made):
    assert made.rows("j2_valid_calls", "from_id", "to_id", "call_type", "line", "from_class", "to_class") == Counter((e.f, e.t, e.type, e.line, e.fc["id"], e.tc["id"]) for e in made.calls)


def test_j9_cross_layer_calls(made):
    assert made.rows("j9_cross_layer_calls", "from_id", "to_id", "from_layer", "to_layer") == Counter((e.f, e.t, e.fc["layer"], e.tc["layer"]) for e in made.calls if e.fc["layer"] != e.tc["layer"])


def test_j10_optional_call_stats(made):
    out, into = grouped((e.f, e.t) for e in made.edges), grouped((e.t, e.f) for e in made.edges)
    assert made.rows("j10_optional_call_stats", "id", "n_out", "n_in") == Counter((m, len(out[m]), len(into[m])) for m in made.methods)


def test_j11_foreign_dependencies(made):
    to = grouped((e.fc["id"], e.tc["id"]) for e in made.calls if e.fc["id"] != e.tc["id"])
    assert made.rows("j11_foreign_dependencies", "id", "n_dependencies") == Counter((c, len(to[c])) for c in made.classes)


def test_j15_methods_with_calls(made):
    assert made.rows("j15_methods_with_calls", "id") == Counter((m,) for m in {e.f for e in made.edges} & set(made.methods))


def test_j20_consecutive_pairs(made):
    by = defaultdict(list)
    for e in made.calls:
        by[e.f].append((e.line, e.ord, e.t))
    want = Counter((f, a[0], a[2], b[2]) for f, x in by.items() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
    assert made.rows("j20_consecutive_pairs", "from_id", "line", "to_id", "next_id") == want


def test_a1_graph_totals(made):
    c = made.classes.values()
    want = {"classes": len(c), "methods": len(made.methods), "edges": len(made.edges), "interfaces": sum(x["is_interface"] for x in c), "extends": sum(x["super_id"] is not None for x in c)}
    assert made.rows("a1_graph_totals", "what", "n") == Counter(want.items())


def test_a1_call_type_distribution(made):
    assert made.rows("a1_call_type_distribution", "call_type", "n") == Counter(Counter(e.type for e in made.edges).items())


def test_a7_degrees(made):
    out, into = Counter(e.f for e in made.edges), Counter(e.t for e in made.edges)
    assert made.rows("a7_degrees", "id", "out_degree", "in_degree") == Counter((m, out[m], into[m]) for m in out.keys() | into.keys())


def test_a9_caller_layers(made):
    callers = {(e.tc["id"], e.fc["layer"], e.fc["name"], made.methods[e.f]["name"]) for e in made.calls}
    assert made.rows("a9_caller_layers", "to_class", "from_layer", "n_callers") == Counter((*k, n) for k, n in Counter(x[:2] for x in callers).items())


def test_a10_distinct_neighbours(made):
    ids, names = grouped((e.fc["id"], e.tc["id"]) for e in made.calls), grouped((e.fc["id"], e.tc["name"]) for e in made.calls)
    assert made.rows("a10_distinct_neighbours", "from_class", "n", "names") == Counter((c, len(ids[c]), ",".join(sorted(names[c]))) for c in ids)


def test_a11_first_neighbours(made):
    layers, names = grouped((e.fc["id"], e.tc["layer"]) for e in made.calls), grouped((e.fc["id"], e.tc["name"]) for e in made.calls)
    assert made.rows("a11_first_neighbours", "from_class", "layers", "names") == Counter((c, ",".join(sorted(layers[c])[:3]), ",".join(sorted(names[c])[:5])) for c in names)
