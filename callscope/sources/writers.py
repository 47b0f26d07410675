"""Writers: graph tables, graph scripts, statistics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.durable import cut
from callscope.functions.rules import CONFIDENCE, lookup
from callscope.plans.graph import CodeGraph


def write_graph(graph: CodeGraph, path: str, mode: str = "overwrite") -> DataFrame:
    """Write the tables; returns how many rows each now holds."""
    for name in ("classes", "methods", "edges"):
        getattr(graph, name).write.mode(mode).parquet(f"{path}/{name}")
    held = [graph.spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")) for n in ("classes", "methods", "edges")]
    return held[0].unionByName(held[1]).unionByName(held[2])


def escaped(x: Column) -> Column:
    """A single-quoted literal; null is the empty string."""
    y = F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), y, F.lit("'"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``n``, their place from 0 in the order given, without gaps and without a task that sees all rows.

    Rows are range-partitioned and kept so; a first pass counts each partition, a second numbers the rows within theirs. The counts, one a partition, are broadcast.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    counts = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("count_"))
    before = F.coalesce(F.sum("count_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return placed.withColumn("at_", at).join(F.broadcast(counts.select("part_", before.alias("before_"))), "part_").withColumn("n", F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def chunked(rows: DataFrame, line: Column, order: str, size: int, kind: str) -> DataFrame:
    """``kind, chunk, n_rows, body``: lines joined by ``size``; only the last chunk is smaller."""
    x = numbered(rows.select(F.col(order).alias("o"), line.alias("line")), "o", "line").withColumn("chunk", F.floor(F.col("n") / size))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])
    return x.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(in_order, ",\n").alias("body")).select(F.lit(kind).alias("kind"), "chunk", "n_rows", "body")


def fields(**columns: Column) -> Column:
    """``  {name: value, ...}`` of values already written."""
    parts = []
    for name, x in columns.items():
        parts += [F.lit(f"{', ' if parts else ''}{name}: "), x]
    return F.concat(F.lit("  {"), *parts, F.lit("}"))


def plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def bodies(graph: CodeGraph) -> DataFrame:
    """``kind, chunk, n_rows, body`` of all rows of a graph: classes and methods by 50, calls and supertypes by 100."""
    c, m, e = graph.classes, graph.methods, graph.edges
    sure = F.expr(lookup("call_type", CONFIDENCE, 0.8)).cast("string")
    of_class = fields(id=escaped(F.col("id")), name=escaped(F.col("name")), qualifiedName=escaped(F.col("qualified_name")), package=escaped(F.col("package")), layer=escaped(F.col("layer")), superClass=escaped(F.col("super_id")), isAbstract=plain("is_abstract"), isInterface=plain("is_interface"), filePath=escaped(F.col("file_path")))
    of_method = fields(id=escaped(F.col("id")), name=escaped(F.col("name")), classId=escaped(F.col("class_id")), returnType=escaped(F.col("return_type")), isConstructor=plain("is_ctor"), isStatic=plain("is_static"), isPublic=plain("is_public"), isAbstract=plain("is_abstract"))
    of_call = fields(fromId=escaped(F.col("from_id")), toId=escaped(F.col("to_id")), callType=escaped(F.col("call_type")), lineNumber=plain("line"), confidence=sure)
    kin = lambda key: fields(child=escaped(F.col("id")), parent=escaped(F.col(key)))
    out = chunked(c, of_class, "id", 50, "4-classes")
    for rows, line, order, size, kind in ((m, of_method, "id", 50, "5-methods"), (e, of_call, "edge_ord", 100, "7-calls"), (c.where("super_id IS NOT NULL"), kin("super_id"), "id", 100, "8-extends"), (c.where("interface_id IS NOT NULL"), kin("interface_id"), "id", 100, "9-implements")):
        out = out.unionByName(chunked(rows, line, order, size, kind))
    return out


# Names of indexes, constraints and relations that the store's queries rely on.
INDEXES = [("class_id_index", "Class", "id"), ("method_id_index", "Method", "id"), ("class_name_index", "Class", "name"), ("method_name_index", "Method", "name"), ("layer_index", "Class", "layer"), ("package_index", "Class", "package")]
UNIQUE = [("class_id_unique", "Class"), ("method_id_unique", "Method")]
AFTER = {
    "4-classes": "CREATE (x:Class) SET x = r;",
    "5-methods": "CREATE (x:Method) SET x = r;",
    "7-calls": "MATCH (a:Method {id: r.fromId}) MATCH (b:Method {id: r.toId}) CREATE (a)-[:CALLS {callType: r.callType, lineNumber: r.lineNumber, confidence: r.confidence}]->(b);",
    "8-extends": "MATCH (a:Class {id: r.child}) MATCH (b:Class {id: r.parent}) CREATE (a)-[:EXTENDS]->(b);",
    "9-implements": "MATCH (a:Class {id: r.child}) MATCH (b:Class {id: r.parent}) CREATE (a)-[:IMPLEMENTS]->(b);",
}


def script(graph: CodeGraph) -> DataFrame:
    """``kind, chunk, n_rows, statement`` of a graph script: cleanup, indexes, constraints, rows in chunks, and the relations."""
    fixed = [("1-cleanup", "MATCH (n) DETACH DELETE n;")]
    fixed += [("2-indexes", f"CREATE INDEX {n} IF NOT EXISTS FOR (x:{of}) ON (x.{key});") for n, of, key in INDEXES]
    fixed += [("3-constraints", f"CREATE CONSTRAINT {n} IF NOT EXISTS FOR (x:{of}) REQUIRE x.id IS UNIQUE;") for n, of in UNIQUE]
    fixed += [("6-contains", "MATCH (c:Class), (m:Method) WHERE c.id = m.classId CREATE (c)-[:CONTAINS]->(m);")]
    head = graph.spark.createDataFrame([(k, i, 0, t) for i, (k, t) in enumerate(fixed)], "kind string, chunk long, n_rows long, statement string")
    after = F.lit(None).cast("string")
    for kind, text in AFTER.items():
        after = F.when(F.col("kind") == kind, F.lit(text)).otherwise(after)
    rows = bodies(graph).select("kind", "chunk", "n_rows", F.concat(F.lit("WITH [\n"), "body", F.lit("\n] AS rows UNWIND rows AS r\n"), after).alias("statement"))
    return head.unionByName(rows)


def write_script(graph: CodeGraph, path: str) -> DataFrame:
    """Write the script as text files that hold it in their order; returns ``kind, n_written, n_rows`` as read back from what was written and held against the graph.

    The statements are written once as Parquet beside the text, so that both passes read the same.
    """
    spark = graph.spark
    script(graph).write.mode("overwrite").parquet(f"{path}/statements")
    held = spark.read.parquet(f"{path}/statements")
    held.repartitionByRange("kind", "chunk").sortWithinPartitions("kind", "chunk").select("statement").write.mode("overwrite").text(f"{path}/text")
    want = {"4-classes": graph.classes, "5-methods": graph.methods, "7-calls": graph.edges}
    written = held.groupBy("kind").agg(F.sum("n_rows").alias("n_written"))
    out = None
    for kind, rows in want.items():
        one = rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out.join(written, "kind", "left").select("kind", F.coalesce("n_written", F.lit(0)).alias("n_written"), "n_rows")


def json_batches(graph: CodeGraph) -> DataFrame:
    """``kind, chunk, n_rows, json``: nodes in arrays of 50 and edges in arrays of 100, as a client that streams them would take them."""
    parts = []
    for rows, order, size, kind in ((graph.classes.select(F.struct("*").alias("x"), F.col("id").alias("o")), "o", 50, "class"), (graph.methods.select(F.struct("*").alias("x"), F.col("id").alias("o")), "o", 50, "method"), (graph.edges.select(F.struct("*").alias("x"), F.col("edge_ord").alias("o")), "o", 100, "edge")):
        x = numbered(rows.select(order, F.to_json("x").alias("line")), "o", "line").withColumn("chunk", F.floor(F.col("n") / size))
        told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), ",")
        parts.append(x.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), told.alias("body")).select(F.lit(kind).alias("kind"), "chunk", "n_rows", F.concat(F.lit("["), "body", F.lit("]")).alias("json")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def statistics_json(graph: CodeGraph) -> DataFrame:
    """One row: totals and layer distribution as JSON."""
    layers = graph.classes.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layers"))
    totals = [getattr(graph, n).agg(F.count(F.lit(1)).alias(n)) for n in ("classes", "methods", "edges")]
    one = layers.crossJoin(totals[0]).crossJoin(totals[1]).crossJoin(totals[2])  # one row each
    return one.select(F.to_json(F.struct("classes", "methods", "edges", "layers")).alias("json"))


def report(graph: CodeGraph) -> DataFrame:
    """``section, line`` of a Markdown report: totals, layer shares, largest classes, cross-layer calls, advice."""
    from callscope.plans.graph_queries import ask

    totals = ask(graph, "a1_graph_totals").select(F.lit("1 totals").alias("section"), F.format_string("- %s: %d", "what", "n").alias("line"))
    share = graph.classes.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    layers = share.select(F.lit("2 layers").alias("section"), F.format_string("- %s: %d (%.1f%%)", "layer", "n", "share").alias("line"))
    large = ask(graph, "t1_largest_classes").select(F.lit("3 largest classes").alias("section"), F.format_string("- %s: %d", "name", "n_methods").alias("line"))
    called = ask(graph, "t2_most_called").select(F.lit("4 most called").alias("section"), F.format_string("- %s (%d): %d", "name", "id", "in_degree").alias("line"))
    cross = ask(graph, "a20_cross_layer_histogram").select(F.lit("5 cross-layer calls").alias("section"), F.format_string("- %s: %d", "direction", "n").alias("line"))
    advice = share.where(((F.col("layer") == "UNKNOWN") & (F.col("share") > 20)) | ((F.col("layer") == "UTIL") & (F.col("share") > 30))).select(F.lit("6 advice").alias("section"), F.format_string("- too many %s classes", "layer").alias("line"))
    out = totals
    for part in (layers, large, called, cross, advice):
        out = out.unionByName(part)
    return out
