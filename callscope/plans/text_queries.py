"""Queries over whole texts: line diffs of documents, and scans of source files that are made of the code graph's calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.diff import line_diff
from callscope.plans.bridge import CALL_TYPES, GRAPH_CTES, code_graph, pick
from callscope.sources import scanner


def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, old, new``: each document after the one before it by id; null where there is none.

    An equi-join on ids: each text is shuffled twice, and no group gathers texts.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old"))
    return d.select("doc_id", F.col("text").alias("new")).join(before, "doc_id", "left")


def d1_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document shares with the one before it, in order, and how many come and go."""
    d = consecutive(spark, sf_dir).select("doc_id", line_diff(F.col("old"), F.col("new")).alias("d"))
    return d.select("doc_id", F.col("d.lcs").alias("n_common"), "d.added", "d.removed")


def d2_line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that come and go, in the order in which they are told."""
    d = consecutive(spark, sf_dir).select("doc_id", line_diff(F.col("old"), F.col("new")).alias("d"))
    changed = F.filter("d.changes", lambda c: c["kind"] != "UNCHANGED")
    x = d.select("doc_id", F.posexplode(changed).alias("nth", "c"))
    return x.select("doc_id", "nth", "c.kind", F.coalesce("c.old_no", "c.new_no").alias("line_no"), "c.line")


#: How a call of each type is written in a method of a made file: N is the called method, C its class. Each holds something that only looks like a call.
WRITTEN = {
    "DIRECT": ("  // dead.call(1);\n  this.held.N(a, \"x.y(1); }\", '(');\n", [("CALL", "held", "N", 0)], 1),
    "INTERFACE": ("  if (ok) {\n    Plain held = make();\n    held.N(a);\n  } else if (b == null) { held.N(b); }\n", [("CALL", None, "make", 0), ("CALL", "held", "N", 0), ("CALL", "held", "N", 0)], 3),
    "INHERITANCE": ("  super.N(a);\n\n  do { a++; } while (a < 9);\n", [("CALL", "super", "N", 0)], 1),
    "STATIC": ("  for (int i = 0; i < a; i++) C.N(i);\n", [("CALL", "C", "N", 0)], 2),
    "REFLECTION": ("  /* C.M(\n  */\n  new C<Map<A, B>>(a).N();\n", [("NEW", None, "C", 0), ("CALL", None, "N", 0)], 1),
    "ASYNC": ("  try { run(new Task() { public void go(KeyManager held) { held.N(a); } }); } catch (E e) { }\n", [("CALL", None, "run", 0), ("NEW", None, "Task", 0), ("CALL", "held", "N", 0)], 2),
    "LAMBDA": ("  each(x -> { while (x.more()) C.N(x); });\n", [("CALL", None, "each", 0), ("LAMBDA", None, None, 0), ("CALL", "x", "more", 1), ("CALL", "C", "N", 1)], 2),
    "METHOD_REFERENCE": ("  switch (a) { case 1: use(C::N); break; default: use(null); }\n", [("CALL", None, "use", 0), ("METHOD_REF", "C", "N", 0), ("CALL", None, "use", 0)], 3),
}


#: The field ``held`` of a made file: by its type or its annotation injected, or neither.
FIELDS = [" private HeldService held;\n", " @Autowired\n @Qualifier(\"held\") private Plain held;\n", " private final Plain held = new Plain();\n"]
# What marks an injected receiver.
INJECTING = "Autowired|Resource|Inject|Component|Service"
INJECTED = "Service|Repository|Component|Manager"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text``: a file for each order, with a class that has a method for each call among the order's parts.

    An order has a few calls, so no file and no group grows with the data. Files are small but take long to scan, so there are four tasks a core at least, a
    number that isn't lessened by the size of the texts.
    """
    g = code_graph(spark, sf_dir)
    owners = g.methods.join(g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("c")), "class_id").select(F.col("id").alias("to_id"), F.concat("name", F.col("to_id").cast("string")).alias("n"), "c")
    e = g.edges.join(owners, "to_id")
    body = F.lit("")
    for kind, (text, *_) in WRITTEN.items():
        body = F.when(F.col("call_type") == kind, F.lit(text)).otherwise(body)
    body = F.replace(F.replace(body, F.lit("N"), F.col("n")), F.lit("C."), F.concat("c", F.lit(".")))
    body = F.replace(F.replace(body, F.lit("C:"), F.concat("c", F.lit(":"))), F.lit("C<"), F.concat("c", F.lit("<")))
    method = F.concat(F.lit(" public void m"), F.col("edge_ord").cast("string"), F.lit("(int a, Map<String, List<Long>> b) throws E {\n"), body, F.lit(" }\n"))
    n_tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = e.select(F.floor(F.col("edge_ord") / 1000).alias("k"), "edge_ord", method.alias("t")).repartition(n_tasks, "k")
    files = e.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "t"))), lambda s: s["t"]), "").alias("t"))
    name = F.concat(F.lit("Flow"), F.col("k").cast("string"))
    return files.select(F.concat(F.lit("app/src/main/"), name, F.lit(".java")).alias("path"), F.concat(F.lit("package app;\n// class Dead { void m() { x(); } }\npublic class "), name, F.lit(" {\n"), pick(FIELDS, F.col("k") % 3), "t", F.lit("}\n")).alias("text"))


def s3_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites of all four kinds, counted for each method of the files."""
    found = scanner.sites(scanner.scanned(source_files(spark, sf_dir)))
    return found.groupBy("path", "method", "kind", "receiver", "name", "lambdas").agg(F.count(F.lit(1)).alias("n"))


def s17_method_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, lines and cyclomatic complexity of each method of the files."""
    return scanner.scanned(source_files(spark, sf_dir)).select("path", "type", "method", "n_params", "loc", "complexity", "is_public", F.size("sites").alias("n_sites"))


def p28_injected_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on a receiver, the type it is declared with where the call stands, and whether that is injected."""
    r = scanner.resolved(source_files(spark, sf_dir)).where("kind = 'CALL'")
    injected = F.exists("annotations", lambda a: a.rlike(INJECTING)) | F.col("receiver_type").rlike(INJECTED)
    return r.select("path", "method", "receiver", "name", "line", "receiver_type", F.coalesce(injected, F.lit(False)).alias("injected"))


def _told(name: str | None) -> str:
    return "NULL" if name is None else {"N": "n", "C": "c"}.get(name, f"'{name}'")


_CALLED = f"""WITH RECURSIVE {GRAPH_CTES},
called AS (SELECT 'app/src/main/Flow' || edge_ord // 1000 || '.java' AS path, 'Flow' || edge_ord // 1000 AS type, 'm' || edge_ord AS method, call_type, m.name || to_id AS n, c.name AS c
  FROM edges JOIN methods m ON m.id = to_id JOIN classes c ON c.id = m.class_id)"""
_SITES = " UNION ALL ".join(f"SELECT path, method, '{kind}' AS kind, {_told(r)} AS receiver, {_told(n)} AS name, {d} AS lambdas FROM called WHERE call_type = '{t}'" for t in CALL_TYPES for kind, r, n, d in WRITTEN[t][1])
_LINES = {t: sum(1 for x in ("{\n" + WRITTEN[t][0] + " }").split("\n") if x.strip()) for t in CALL_TYPES}
TEXTS_SQL: dict[str, str] = {  # diffs by recursion are too slow over whole tables; tests hold them against the full table of lengths
    "s3_call_sites": f"{_CALLED} SELECT path, method, kind, CAST(receiver AS VARCHAR) AS receiver, CAST(name AS VARCHAR) AS name, lambdas, count(*) AS n FROM ({_SITES}) GROUP BY ALL",
    "s17_method_bodies": f"{_CALLED} SELECT path, type, method, 2 AS n_params, CASE call_type {' '.join(f"WHEN '{t}' THEN {_LINES[t]}" for t in CALL_TYPES)} END AS loc, CASE call_type {' '.join(f"WHEN '{t}' THEN {WRITTEN[t][2]}" for t in CALL_TYPES)} END AS complexity, TRUE AS is_public, CASE call_type {' '.join(f"WHEN '{t}' THEN {len(WRITTEN[t][1])}" for t in CALL_TYPES)} END AS n_sites FROM called",
}
# each method's receivers in turn: line within the method, receiver, type (H: the field's), injected
_RECEIVERS = {
    "DIRECT": [(2, "held", "H")],
    "INTERFACE": [(3, "held", "'Plain'"), (4, "held", "H")],
    "INHERITANCE": [(1, "super", "NULL")],
    "STATIC": [(1, "C", "NULL")],
    "REFLECTION": [],
    "ASYNC": [(1, "held", "'KeyManager'")],
    "LAMBDA": [(1, "x", "NULL"), (1, "C", "NULL")],
    "METHOD_REFERENCE": [],
}
_HEIGHT = {t: WRITTEN[t][0].count("\n") + 2 for t in CALL_TYPES}
_ROWS = " UNION ALL ".join(
    f"SELECT path, method, k, {_told(r)} AS receiver, {chr(39) + 'more' + chr(39) if r == 'x' else 'n'} AS name, top + {line} AS line, {'field' if of == 'H' else of} AS receiver_type, {'k % 3 < 2' if of == 'H' else ('TRUE' if 'Manager' in of else 'FALSE')} AS injected FROM placed WHERE call_type = '{t}'"
    for t in CALL_TYPES for line, r, of in _RECEIVERS[t]
)
TEXTS_SQL["p28_injected_calls"] = f"""{_CALLED},
sized AS (SELECT *, CAST(substr(type, 5) AS BIGINT) AS k, CAST(substr(method, 2) AS BIGINT) AS ord, CASE call_type {' '.join(f"WHEN '{t}' THEN {h}" for t, h in _HEIGHT.items())} END AS height FROM called),
placed AS (SELECT *, CASE k % 3 WHEN 0 THEN 'HeldService' ELSE 'Plain' END AS field, 4 + CASE k % 3 WHEN 1 THEN 2 ELSE 1 END + coalesce(sum(height) OVER (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM sized)
SELECT path, method, CAST(receiver AS VARCHAR) AS receiver, name, CAST(line AS INTEGER) AS line, CAST(receiver_type AS VARCHAR) AS receiver_type, injected FROM ({_ROWS})"""
TEXTS = {f.__name__: f for f in (d1_line_diff, d2_line_changes, s3_call_sites, s17_method_bodies, p28_injected_calls)}
