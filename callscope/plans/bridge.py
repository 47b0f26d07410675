"""A code graph derived from the supplied tables, so that graph queries can run and be checked on them.

Suppliers are classes, parts methods, and consecutive parts of an order calls; see SURVEY 7.2. Every line item is read. In the graph of trees, paths and
neighbourhoods parts that are shipped in different quarters don't call each other, so that it falls into many call trees, with methods that no tree holds; ``whole``
is the graph with all calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.plans.graph import CodeGraph

LAYERS = ["CONTROLLER", "SERVICE", "MAPPER", "REPOSITORY", "UTIL", "ENTITY", "CONFIG", "COMPONENT", "UNKNOWN"]
SUFFIXES = ["Controller", "Service", "Mapper", "Repository", "Util", "Entity", "Config", "Component", "Thing"]
DOMAINS = ["USER", "ORDER", "PRODUCT", "PAYMENT", "AUTH", "SYSTEM", "COMMON", "UNKNOWN"]
VERBS = ["create", "save", "update", "delete", "process", "handle", "validate", "get", "find", "list", "set", "check"]
CALL_TYPES = ["DIRECT", "INTERFACE", "INHERITANCE", "STATIC", "REFLECTION", "ASYNC", "LAMBDA", "METHOD_REFERENCE"]


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("s_suppkey")
    layer, suffix, domain = pick(LAYERS, k % 9), pick(SUFFIXES, k % 9), pick(DOMAINS, F.col("s_nationkey") % 8)
    package = F.concat(F.lit("com."), F.lower(F.regexp_replace("n_name", " ", "")), F.lit("."), F.lower(domain))
    name = F.concat(F.initcap(F.lower(domain)), k.cast("string"), suffix)
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"),
        name.alias("name"),
        F.concat(package, F.lit("."), name).alias("qualified_name"),
        package.alias("package"),
        layer.alias("layer"),
        domain.alias("domain"),
        F.when(k % 2 == 0, suffix).alias("annotation"),
        F.when((k % 5 == 1) & (k >= 3), F.floor(k / 3)).alias("super_id"),
        F.when(k >= 4, k % 4).alias("interface_id"),
        (k % 11 == 0).alias("is_abstract"),
        (k < 4).alias("is_interface"),
        F.concat(F.lit("app/src/main/"), F.translate(package, ".", "/"), F.lit("/"), name, F.lit(".java")).alias("file_path"),
    )


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.count(F.lit(1)).alias("n_classes"))
    k = F.col("p_partkey")
    word = F.coalesce(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(""))
    return p.crossJoin(F.broadcast(n)).select(  # one row
        k.alias("id"),
        (k % F.col("n_classes")).alias("class_id"),
        F.concat(pick(VERBS, k % 12), F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100)).alias("name"),
        (F.col("p_size") % 4).cast("int").alias("n_params"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("return_type"),
        (F.col("p_size") % 5 != 0).alias("is_public"),
        (F.col("p_size") % 7 == 0).alias("is_static"),
        (F.col("p_size") % 11 == 0).alias("is_abstract"),
        (F.col("p_size") % 13 == 0).alias("is_ctor"),
    )


def edges(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Calls between consecutive parts of an order: of all its line items if ``whole``, else of those shipped in one quarter."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    together = w if whole else Window.partitionBy("l_orderkey", F.year("l_shipdate"), F.quarter("l_shipdate")).orderBy(*order)
    placed = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.row_number().over(w).alias("rn"))  # first, so that its partitions serve both
    e = placed.select("l_orderkey", "l_linenumber", F.lag("l_partkey").over(together).alias("from_id"), F.col("l_partkey").alias("to_id"), "rn")
    return e.where("from_id is not null and from_id != to_id").select("from_id", "to_id", pick(CALL_TYPES, (F.col("from_id") + F.col("to_id")) % 8).alias("call_type"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_orderkey") * 1000 + F.col("rn")).alias("edge_ord"))


def code_graph(spark: SparkSession, sf_dir: str, whole: bool = False) -> CodeGraph:
    return CodeGraph(classes(spark, sf_dir), methods(spark, sf_dir), edges(spark, sf_dir, whole))


def _case(names: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: The same derivation for the checking engine.
GRAPH_CTES = f"""
classes AS (
  SELECT k AS id, nm AS name, pk || '.' || nm AS qualified_name, pk AS package, layer, domain,
         CASE WHEN k % 2 = 0 THEN suffix END AS annotation,
         CASE WHEN k % 5 = 1 AND k >= 3 THEN k // 3 END AS super_id,
         CASE WHEN k >= 4 THEN k % 4 END AS interface_id,
         k % 11 = 0 AS is_abstract, k < 4 AS is_interface,
         'app/src/main/' || replace(pk, '.', '/') || '/' || nm || '.java' AS file_path
  FROM (SELECT *, 'com.' || lower(replace(n_name, ' ', '')) || '.' || lower(domain) AS pk,
               upper(substr(domain, 1, 1)) || lower(substr(domain, 2)) || k || suffix AS nm
        FROM (SELECT s_suppkey AS k, n_name, {_case(LAYERS, "s_suppkey % 9")} AS layer, {_case(SUFFIXES, "s_suppkey % 9")} AS suffix,
                     {_case(DOMAINS, "s_nationkey % 8")} AS domain
              FROM supplier JOIN nation ON s_nationkey = n_nationkey))),
methods AS (
  SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) AS class_id,
         {_case(VERBS, "p_partkey % 12")} || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS name,
         CAST(p_size % 4 AS INTEGER) AS n_params, split_part(p_type, ' ', 1) AS return_type, p_size % 5 <> 0 AS is_public, p_size % 7 = 0 AS is_static,
         p_size % 11 = 0 AS is_abstract, p_size % 13 = 0 AS is_ctor
  FROM part),
edges AS (
  SELECT from_id, to_id, {_case(CALL_TYPES, "(from_id + to_id) % 8")} AS call_type, CAST(l_linenumber AS INTEGER) AS line, l_orderkey * 1000 + rn AS edge_ord
  FROM (SELECT l_orderkey, l_linenumber, l_partkey AS to_id, lag(l_partkey) OVER together AS from_id, row_number() OVER w AS rn
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), together AS (PARTITION BY l_orderkey, year(l_shipdate), quarter(l_shipdate) ORDER BY l_linenumber, l_partkey, l_suppkey))
  WHERE from_id IS NOT NULL AND from_id <> to_id)"""

#: With calls of all consecutive parts of an order.
WHOLE_CTES = GRAPH_CTES.replace("lag(l_partkey) OVER together", "lag(l_partkey) OVER w").replace(", together AS (PARTITION BY l_orderkey, year(l_shipdate), quarter(l_shipdate) ORDER BY l_linenumber, l_partkey, l_suppkey)", "")
