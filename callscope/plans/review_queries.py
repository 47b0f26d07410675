"""Call paths of a review, cascades through interfaces, and scores over labels; their SQL is written apart from the plans.

A review asks of changed methods: here those whose id is divisible by ``ASKED``; all calls answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.operators import traverse
from callscope.plans.bridge import GRAPH_CTES
from callscope.plans.graph import CodeGraph
from callscope.plans.tree_queries import ASKED

FIRST = 10  # callers or callees of a method that become paths
PICKED = 4  # one class of so many is changed
MOST_LAYERS = 2  # a class that depends on more layers gives a cross-layer path


def labelled(g: CodeGraph) -> DataFrame:
    """``id, class_id, label, layer`` of methods."""
    c = g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "layer")
    return g.methods.join(c, "class_id").select("id", "class_id", F.concat_ws(".", "class_name", "name").alias("label"), "layer")


def changed(g: CodeGraph) -> DataFrame:
    return labelled(g).where(F.col("id") % ASKED == 0)


def direct_paths(g: CodeGraph) -> DataFrame:
    """A path of one method for each changed method, and of the class alone where a changed file, which a hash of its class's name picks, has no changed method."""
    own = changed(g)
    picked = F.conv(F.substring(F.md5("name"), 1, 4), 16, 10).cast("long") % PICKED == 0
    classes = g.classes.where(picked).select(F.col("id").alias("class_id"), "name").join(own.select("class_id").distinct(), "class_id", "left_anti")
    return own.select(F.lit("direct").alias("family"), F.col("label").alias("path")).unionByName(classes.select(F.lit("class").alias("family"), F.col("name").alias("path"))).distinct()


def neighbour_paths(g: CodeGraph, up: bool) -> DataFrame:
    """Paths of two methods: the ``FIRST`` most frequent callers, or callees, of each changed method."""
    near, far = ("to_id", "from_id") if up else ("from_id", "to_id")
    all_ = labelled(g)
    calls = g.edges.join(changed(g).select(F.col("id").alias(near), F.col("label").alias("own")), near).join(all_.select(F.col("id").alias(far), F.col("label").alias("other")), far)
    counted = calls.groupBy(near, "own", "other").agg(F.count(F.lit(1)).alias("calls"))
    nth = F.row_number().over(Window.partitionBy(near).orderBy(F.desc("calls"), "other"))
    path: Column = F.concat_ws("->", "other", "own") if up else F.concat_ws("->", "own", "other")
    return counted.withColumn("nth", nth).where(F.col("nth") <= FIRST).select(F.lit("upstream" if up else "downstream").alias("family"), path.alias("path"), "calls")


def cross_layer_paths(g: CodeGraph) -> DataFrame:
    """A path for each class with a changed method whose dependencies stand in more than two layers."""
    all_ = labelled(g)
    a, b = (all_.select(F.col("id").alias(f"{x}_id"), F.col("class_id").alias(f"{x}_class"), F.col("layer").alias(f"{x}_layer")) for x in ("from", "to"))
    layers = g.edges.join(a, "from_id").join(b, "to_id").where("from_class != to_class").groupBy("from_class").agg(F.countDistinct("to_layer").alias("n_layers")).where(F.col("n_layers") > MOST_LAYERS)
    asked = changed(g).select(F.col("class_id").alias("from_class")).distinct()
    names = g.classes.select(F.col("id").alias("from_class"), "name")
    return layers.join(asked, "from_class", "left_semi").join(names, "from_class").select(F.lit("cross-layer").alias("family"), F.concat(F.col("name"), F.lit(".main")).alias("path"), F.col("n_layers"))


def family_rows(g: CodeGraph) -> DataFrame:
    """``ord, family, path, key`` of the four families, one after the other; ``key`` is the methods of a path, sorted."""
    parts = [(1, direct_paths(g)), (2, neighbour_paths(g, True)), (3, neighbour_paths(g, False)), (4, cross_layer_paths(g))]
    rows = None
    for ord_, part in parts:
        one = part.select(F.lit(ord_).alias("ord"), "family", "path", F.array_join(F.array_sort(F.split("path", "->")), "->").alias("key"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def families(g: CodeGraph) -> DataFrame:
    """The four families; of equal sets of methods the first stays."""
    first = family_rows(g).groupBy("key").agg(F.min(F.struct("ord", "path", "family")).alias("f"))
    return first.select("f.family", "f.path")


def concrete(g: CodeGraph) -> DataFrame:
    """``interface_id, class_id``: classes that implement an interface, through any chain of supertypes, and can be made."""
    up = g.classes.where("super_id IS NOT NULL").select(F.col("super_id").alias("from_id"), F.col("id").alias("to_id")).unionByName(g.classes.where("interface_id IS NOT NULL").select(F.col("interface_id").alias("from_id"), F.col("id").alias("to_id")))
    sources = g.classes.where("is_interface").select(F.col("id").alias("src"))
    able = g.classes.where("NOT is_interface AND NOT is_abstract").select(F.col("id").alias("node"))
    return traverse.reach(up, sources, 20).where("depth > 0").join(able, "node").select(F.col("src").alias("interface_id"), F.col("node").alias("class_id"))


def cascaded(g: CodeGraph) -> DataFrame:
    """Calls to interface methods led on, one step, to the methods of the same name and number of parameters that implement them."""
    impl = concrete(g)
    im = g.methods.select(F.col("id").alias("interface_method"), F.col("class_id").alias("interface_id"), "name", "n_params")
    m = g.methods.select(F.col("id").alias("impl_method"), "class_id", "name", "n_params")
    pairs = im.join(impl, "interface_id").join(m, ["class_id", "name", "n_params"])
    calls = g.edges.select(F.col("from_id").alias("caller"), F.col("to_id").alias("interface_method")).distinct()
    return calls.join(pairs, "interface_method").select("caller", "interface_method", "impl_method")


def normalised(x: Column) -> Column:
    """A type name without white space and the packages that go without saying."""
    return F.replace(F.replace(F.regexp_replace(x, r"\s", ""), F.lit("java.lang.")), F.lit("java.util."))


def types(g: CodeGraph) -> DataFrame:
    raw = F.concat(F.lit("java.util.Map< java.lang.String , \tcom.shop."), F.initcap(F.lower("return_type")), F.lit(" >"))
    return g.methods.select("id", raw.alias("raw"), normalised(raw).alias("type"))


REVIEW: dict[str, Callable[[CodeGraph], DataFrame]] = {
    "d12_direct_paths": direct_paths,
    "d14_upstream_paths": lambda g: neighbour_paths(g, True),
    "d14_downstream_paths": lambda g: neighbour_paths(g, False),
    "d15_cross_layer_paths": cross_layer_paths,
    "u3_path_families": families,
    "g16_cascaded_implementations": cascaded,
    "g17_concrete_implementations": concrete,
    "j7_normalised_types": types,
}

_LABELLED = f"""labelled AS (SELECT m.id, m.class_id, c.name || '.' || m.name AS label, c.layer FROM methods m JOIN classes c ON c.id = m.class_id),
changed AS (SELECT * FROM labelled WHERE id % {ASKED} = 0)"""
_DIRECT = "direct AS (SELECT DISTINCT 'direct' AS family, label AS path FROM changed UNION ALL SELECT DISTINCT 'class', name FROM classes c WHERE CAST('0x' || substr(md5(name), 1, 4) AS BIGINT) % 4 = 0 AND NOT EXISTS (SELECT 1 FROM changed x WHERE x.class_id = c.id))"
_UP = f"""upstream AS (SELECT 'upstream' AS family, other || '->' || own AS path, calls FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY calls DESC, other) AS nth FROM (
    SELECT x.id, x.label AS own, o.label AS other, count(*) AS calls FROM edges e JOIN changed x ON x.id = e.to_id JOIN labelled o ON o.id = e.from_id GROUP BY ALL) c) n WHERE nth <= {FIRST})"""
_DOWN = f"""downstream AS (SELECT 'downstream' AS family, own || '->' || other AS path, calls FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY calls DESC, other) AS nth FROM (
    SELECT x.id, x.label AS own, o.label AS other, count(*) AS calls FROM edges e JOIN changed x ON x.id = e.from_id JOIN labelled o ON o.id = e.to_id GROUP BY ALL) c) n WHERE nth <= {FIRST})"""
_CROSS = f"""crossing AS (SELECT 'cross-layer' AS family, c.name || '.main' AS path, n_layers FROM classes c JOIN (
  SELECT f.class_id, count(DISTINCT t.layer) AS n_layers FROM edges e JOIN labelled f ON f.id = e.from_id JOIN labelled t ON t.id = e.to_id WHERE f.class_id <> t.class_id GROUP BY f.class_id HAVING count(DISTINCT t.layer) > {MOST_LAYERS}) k
  ON k.class_id = c.id WHERE c.id IN (SELECT class_id FROM changed))"""
_CONCRETE = """kin AS (SELECT super_id AS up, id AS down FROM classes WHERE super_id IS NOT NULL UNION SELECT interface_id, id FROM classes WHERE interface_id IS NOT NULL),
below AS (SELECT id AS interface_id, id AS node FROM classes WHERE is_interface UNION SELECT b.interface_id, k.down FROM below b JOIN kin k ON k.up = b.node),
concrete AS (SELECT DISTINCT b.interface_id, c.id AS class_id FROM below b JOIN classes c ON c.id = b.node WHERE b.node <> b.interface_id AND NOT c.is_interface AND NOT c.is_abstract)"""
_SORTED = "array_to_string(list_sort(string_split(path, '->')), '->')"


def with_graph(*ctes: str) -> str:
    *before, last = ctes
    return "WITH RECURSIVE " + ",\n".join([GRAPH_CTES, *before]) + "\n" + last


REVIEW_SQL = {
    "d12_direct_paths": with_graph(_LABELLED, _DIRECT, "SELECT * FROM direct"),
    "d14_upstream_paths": with_graph(_LABELLED, _UP, "SELECT * FROM upstream"),
    "d14_downstream_paths": with_graph(_LABELLED, _DOWN, "SELECT * FROM downstream"),
    "d15_cross_layer_paths": with_graph(_LABELLED, _CROSS, "SELECT * FROM crossing"),
    "u3_path_families": with_graph(
        _LABELLED, _DIRECT, _UP, _DOWN, _CROSS,
        "every AS (SELECT 1 AS ord, family, path FROM direct UNION ALL SELECT 2, family, path FROM upstream UNION ALL SELECT 3, family, path FROM downstream UNION ALL SELECT 4, family, path FROM crossing)",
        f"SELECT family, path FROM (SELECT *, row_number() OVER (PARTITION BY {_SORTED} ORDER BY ord, path, family) AS nth FROM every) x WHERE nth = 1",
    ),
    "g16_cascaded_implementations": with_graph(
        _CONCRETE,
        "SELECT DISTINCT e.from_id AS caller, im.id AS interface_method, m.id AS impl_method FROM edges e JOIN methods im ON im.id = e.to_id JOIN concrete k ON k.interface_id = im.class_id JOIN methods m ON m.class_id = k.class_id AND m.name = im.name AND m.n_params = im.n_params",
    ),
    "g17_concrete_implementations": with_graph(_CONCRETE, "SELECT * FROM concrete"),
    "j7_normalised_types": with_graph("SELECT id, raw, 'Map<String,com.shop.' || word || '>' AS type FROM (SELECT id, word, 'java.util.Map< java.lang.String , ' || chr(9) || 'com.shop.' || word || ' >' AS raw FROM (SELECT id, upper(return_type[1]) || lower(return_type[2:]) AS word FROM methods) x) y"),
}

#: All paths of all families with the key that tells equal ones.
FAMILY_CTES = [_LABELLED, _DIRECT, _UP, _DOWN, _CROSS, f"every AS (SELECT *, {_SORTED} AS key FROM (SELECT 1 AS ord, family, path FROM direct UNION ALL SELECT 2, family, path FROM upstream UNION ALL SELECT 3, family, path FROM downstream UNION ALL SELECT 4, family, path FROM crossing) x)"]


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well two plain rules on texts agree with ``labels``: counts, precision, recall and F1, and F1 weighted over the rules."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    both = docs.join(labels, "doc_id").select((F.length("text") < 400).alias("short"), F.lower("text").contains("idiot").alias("rude"), (F.col("quality") == 0).alias("bad"), (F.col("toxic") == 1).alias("toxic"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("double")
    out = None
    for rule, said, true, weight in (("short", "short", "bad", 0.4), ("rude", "rude", "toxic", 0.3)):
        one = both.agg(n(F.col(said) & F.col(true)).alias("hits"), n(F.col(said)).alias("said"), n(F.col(true)).alias("truth"))
        one = one.select(F.lit(rule).alias("rule"), "hits", "said", "truth", F.round(F.col("hits") / F.nullif("said", F.lit(0.0)), 6).alias("precision"), F.round(F.col("hits") / F.nullif("truth", F.lit(0.0)), 6).alias("recall"), F.round(2 * F.col("hits") / F.nullif(F.col("said") + F.col("truth"), F.lit(0.0)), 6).alias("f1"), F.round(weight * 2 * F.col("hits") / F.nullif(F.col("said") + F.col("truth"), F.lit(0.0)), 6).alias("weighted"))
        out = one if out is None else out.unionByName(one)
    return out


def _score_sql(rule: str, said: str, true: str, weight: float) -> str:
    return f"""SELECT '{rule}' AS rule, hits, said, truth, round(hits / nullif(said, 0), 6) AS precision, round(hits / nullif(truth, 0), 6) AS recall, round(2 * hits / nullif(said + truth, 0), 6) AS f1, round({weight} * 2 * hits / nullif(said + truth, 0), 6) AS weighted
      FROM (SELECT CAST(count(*) FILTER (WHERE {said} AND {true}) AS DOUBLE) AS hits, CAST(count(*) FILTER (WHERE {said}) AS DOUBLE) AS said, CAST(count(*) FILTER (WHERE {true}) AS DOUBLE) AS truth FROM documents JOIN labels USING (doc_id))"""


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"a27_rule_scores": rule_scores}
TABLES_SQL = {"a27_rule_scores": _score_sql("short", "length(text) < 400", "quality = 0", 0.4) + " UNION ALL " + _score_sql("rude", "contains(lower(text), 'idiot')", "toxic = 1", 0.3)}
