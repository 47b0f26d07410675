"""Files of a review: their tests, the call paths they touch, and the methods that a diff's hunks change.

Business files stand for documents and test files for labelled documents, under names of several forms; their SQL is written apart from the plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.operators.contains import containing
from callscope.plans.bridge import GRAPH_CTES, code_graph, pick
from callscope.plans.change_queries import CHANGE_CTES, diff_lines, parsed_diff

KINDS = ["Controller", "Service", "Config", "Util", "Notes"]
CONTROL = "if|for|while|switch|try|catch"
START = r"(public |private |protected )"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, name, is_test, n_methods`` of changed files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stem = F.concat(F.initcap("lang"), F.col("doc_id").cast("string"))
    named = d.select("doc_id", "source", stem.alias("stem"), F.concat(stem, pick(KINDS, F.col("doc_id") % 5)).alias("name"), F.col("n_chars"))
    business = named.select(F.concat(F.lit("src/main/"), "source", F.lit("/"), "name", F.lit(".java")).alias("path"), (F.col("n_chars") % 5).alias("n_methods"))
    told = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = F.col("name")
    form = [F.concat(n, F.lit("Test.java")), F.concat(n, F.lit("Spec.kt")), F.concat("stem", F.lit("Test.java")), F.concat(F.lower(n), F.lit("IT.java")), F.concat(F.lit("Abstract"), n, F.lit("Tests.java")), F.lit("Test.java")]
    folder = F.when(F.col("doc_id") % 6 == 3, "src/test/integration/").otherwise(F.concat(F.lit("src/test/"), "source", F.lit("/")))
    tests = told.join(named.hint("merge"), "doc_id").select(F.concat(folder, F.element_at(F.array(*form), (F.col("doc_id") % 6 + 1).cast("int"))).alias("path"), (1 + F.col("quality")).cast("long").alias("n_methods"))
    every = business.unionByName(tests).groupBy("path").agg(F.sum("n_methods").alias("n_methods"))
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return every.select("path", name.alias("name"), F.lower("path").rlike("test|spec").alias("is_test"), "n_methods")


def stem_of(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("Test"), F.lit("")), F.lit("Spec"), F.lit(""))


def tests_of_files(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``path, test_path, n_methods`` of business files and their tests by name, in either direction and without regard to case.

    The second table is of the tests whose name is empty without its words, so that they are tests of every file; they aren't paired.
    """
    business = f.where(~F.col("is_test")).select("path", F.lower("name").alias("b"))
    tests = f.where("is_test").select(F.col("path").alias("test_path"), "n_methods", F.lower("name").alias("t"), F.lower(stem_of(F.col("name"))).alias("stem"))
    whole = containing(business.select("b"), tests.select("t")).select(F.col("needle").alias("b"), F.col("hay").alias("t"))
    part = containing(tests.select("stem"), business.select("b")).select(F.col("needle").alias("stem"), F.col("hay").alias("b"))
    # sorted joins: tables of names would be held by the driver, one for each join, as long as each is just small enough to be sent out
    pairs = business.join(whole.hint("merge"), "b").join(tests.hint("merge"), "t").select("path", "test_path", "n_methods")
    pairs = pairs.unionByName(business.join(part.hint("merge"), "b").join(tests.hint("merge"), "stem").select("path", "test_path", "n_methods"))
    return pairs.distinct(), tests.where("stem = ''")


def j13_tests_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business files and the tests that their names tell, but for tests of every file."""
    return tests_of_files(files(spark, sf_dir))[0].select("path", "test_path")


def coverage(f: DataFrame) -> DataFrame:
    """``path, n_tests, coverage, completeness`` of each business file."""
    pairs, of_all = tests_of_files(f)
    integration = F.max(F.lower("test_path").contains("integration"))
    mine = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("n_methods").alias("m"), integration.alias("i"))
    everywhere = of_all.agg(F.count(F.lit(1)).alias("n_all"), F.coalesce(F.sum("n_methods"), F.lit(0)).alias("m_all"), F.coalesce(integration, F.lit(False)).alias("i_all"))
    # a test of every file contains no business name, unless that is empty too
    out = f.where(~F.col("is_test")).select("path", F.col("n_methods").alias("own")).join(mine.hint("merge"), "path", "left").crossJoin(F.broadcast(everywhere))  # one row
    n, m = F.coalesce("n", F.lit(0)) + F.col("n_all"), F.coalesce("m", F.lit(0)) + F.col("m_all")
    kind = F.when(n == 0, "NO_TESTS").when(n == 1, "BASIC_COVERAGE").when(F.coalesce("i", F.lit(False)) | F.col("i_all"), "COMPREHENSIVE_COVERAGE").otherwise("PARTIAL_COVERAGE")
    complete = F.when(n == 0, 0.0).when(F.col("own") > 0, F.least(m / F.col("own"), F.lit(1.0))).otherwise(1.0)
    return out.select("path", n.alias("n_tests"), kind.alias("coverage"), F.round(complete, 6).alias("completeness"))


def a19_file_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(files(spark, sf_dir))


def a19_coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: business files, those with a test, and their share (1 without files)."""
    c = coverage(files(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n_tests") > 0).alias("n_covered"))
    return c.select("n_files", "n_covered", F.when(F.col("n_files") > 0, F.round(F.col("n_covered") / F.col("n_files"), 6)).otherwise(1.0).alias("ratio"))


def j19_missing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business files that the pairs of names leave without a test of their own."""
    f = files(spark, sf_dir)
    return f.where(~F.col("is_test")).select("path").join(tests_of_files(f)[0].hint("merge"), "path", "left_anti")


def j14_changed_files_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each call, a path of two methods, the changed files whose path contains the name of either class: how many, and the first."""
    g = code_graph(spark, sf_dir)
    changed = g.classes.select(F.col("file_path").alias("path")).unionByName(files(spark, sf_dir).select("path")).distinct()
    found = containing(g.classes.select(F.lower("name")), changed.select(F.lower("path"))).select(F.col("needle").alias("low"), F.col("hay").alias("low_path"))
    of_class = g.classes.select("id", F.lower("name").alias("low")).join(found, "low").join(changed.select("path", F.lower("path").alias("low_path")), "low_path").select("id", "path")
    owner = g.methods.select("id", "class_id")
    ends = g.edges.join(owner.toDF("from_id", "a"), "from_id").join(owner.toDF("to_id", "b"), "to_id")
    each = ends.select("edge_ord", F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).join(of_class, "id")
    return each.groupBy("edge_ord").agg(F.count_distinct("path").alias("n_files"), F.min("path").alias("first_path"))


def j13_tests_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Util classes, read as tests, and the classes that share a name with them; its SQL stands among the graph's."""
    c = code_graph(spark, sf_dir).classes.select("name", F.lower("name").alias("low"), (F.col("layer") == "UTIL").alias("is_test"))
    tests = c.where("is_test").select(F.col("name").alias("test_name"), F.lower(F.replace("name", F.lit("Util"), F.lit(""))).alias("stem"))
    business = c.where("NOT is_test").select(F.col("name").alias("business_name"), "low")
    part = containing(tests.select("stem"), business.select("low")).toDF("stem", "low")
    whole = containing(business.select("low"), tests.select("stem")).toDF("low", "stem")
    return tests.join(part.unionByName(whole).distinct(), "stem").join(business, "low").select("test_name", "business_name")


def segments(lines: DataFrame) -> DataFrame:
    """Methods that hunks touch, of parsed diff lines: from each line that starts a method to the next, or to the hunk's end.

    The start line gives the signature and isn't counted; lines before a hunk's first start belong to no method.
    """
    trimmed = F.trim("content")
    starts = trimmed.rlike(START) & F.contains(trimmed, F.lit("(")) & F.contains(trimmed, F.lit(")")) & F.contains(trimmed, F.lit("{"))
    running = Window.partitionBy("path", "hunk").orderBy("ix")
    x = lines.withColumn("start", starts).withColumn("segment", F.count_if("start").over(running)).where("segment > 0")
    inner = ~F.col("start")
    x = x.groupBy("path", "hunk", "segment").agg(
        F.max(F.when(F.col("start"), trimmed)).alias("signature"),
        F.count_if(inner & (F.col("kind") == "ADDED")).alias("added"),
        F.count_if(inner & (F.col("kind") == "DELETED")).alias("deleted"),
        F.count_if(inner).alias("n_lines"),
        F.count_if(inner & F.col("content").rlike(CONTROL)).alias("complexity"),
    )
    change = F.when((F.col("added") > 0) & (F.col("deleted") > 0), "MODIFIED").when(F.col("added") > 0, "ADDED").when(F.col("deleted") > 0, "DELETED").otherwise("UNCHANGED")
    return x.withColumn("change", change)


def w2_method_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(parsed_diff(diff_lines(spark, sf_dir)))


def d5_changed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of each file that its diff touches, all hunks together."""
    s = segments(parsed_diff(diff_lines(spark, sf_dir)))
    return s.groupBy("path").agg(F.count(F.lit(1)).alias("n_methods"), F.sum("complexity").alias("complexity"), F.max("complexity").alias("most"), F.count_if(F.col("change") != "UNCHANGED").alias("n_changed"), F.sum("n_lines").alias("n_lines"))


_NAME = "regexp_extract(path, '([^/]*)[.][^./]*$', 1)"
_KIND = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
FILE_CTES = f"""
named AS (SELECT doc_id, source, n_chars, upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || doc_id AS stem, upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || doc_id || {_KIND} AS name FROM documents),
written AS (
  SELECT 'src/main/' || source || '/' || name || '.java' AS path, n_chars % 5 AS n_methods FROM named
  UNION ALL
  SELECT CASE WHEN doc_id % 6 = 3 THEN 'src/test/integration/' ELSE 'src/test/' || source || '/' END || CASE doc_id % 6 WHEN 0 THEN name || 'Test.java' WHEN 1 THEN name || 'Spec.kt' WHEN 2 THEN stem || 'Test.java' WHEN 3 THEN lower(name) || 'IT.java' WHEN 4 THEN 'Abstract' || name || 'Tests.java' ELSE 'Test.java' END, 1 + quality
  FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) JOIN named USING (doc_id)),
files AS (SELECT path, {_NAME} AS name, regexp_matches(lower(path), 'test|spec') AS is_test, CAST(sum(n_methods) AS BIGINT) AS n_methods FROM written GROUP BY path),
tested AS (SELECT DISTINCT b.path, t.path AS test_path, t.n_methods FROM files b, files t WHERE NOT b.is_test AND t.is_test
  AND (contains(lower(t.name), lower(b.name)) OR contains(lower(b.name), lower(replace(replace(t.name, 'Test', ''), 'Spec', ''))))),
own AS (SELECT tested.* FROM tested JOIN files t ON t.path = test_path WHERE replace(replace(t.name, 'Test', ''), 'Spec', '') <> ''),
covered AS (SELECT b.path, count(test_path) AS n_tests, CASE count(test_path) WHEN 0 THEN 'NO_TESTS' WHEN 1 THEN 'BASIC_COVERAGE' ELSE CASE WHEN max(CASE WHEN contains(lower(test_path), 'integration') THEN 1 ELSE 0 END) = 1 THEN 'COMPREHENSIVE_COVERAGE' ELSE 'PARTIAL_COVERAGE' END END AS coverage,
  round(CASE WHEN count(test_path) = 0 THEN 0.0 WHEN b.n_methods > 0 THEN least(sum(t.n_methods) / b.n_methods, 1.0) ELSE 1.0 END, 6)::DOUBLE AS completeness
  FROM files b LEFT JOIN tested t ON t.path = b.path WHERE NOT b.is_test GROUP BY b.path, b.n_methods)"""
_HEADER = "'^@@ -([0-9]+),?([0-9]*) [+]([0-9]+),?([0-9]*) @@'"
SEGMENT_CTES = f"""
numbered AS (SELECT path, ix, line, sum(CASE WHEN regexp_matches(line, {_HEADER}) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ix) AS hunk FROM diff_lines),
inside AS (SELECT path, hunk, ix, line[1] AS mark, line[2:] AS content FROM numbered WHERE hunk > 0 AND NOT starts_with(line, '@@')),
begun AS (SELECT *, regexp_matches(content, '(public |private |protected )') AND regexp_matches(content, '[(]') AND regexp_matches(content, '[)]') AND regexp_matches(content, '[{{]') AS start FROM inside),
labelled AS (SELECT *, (SELECT max(s.ix) FROM begun s WHERE s.path = b.path AND s.hunk = b.hunk AND s.start AND s.ix <= b.ix) AS begins FROM begun b),
methods_of AS (
  SELECT path, CAST(hunk AS BIGINT) AS hunk, begins, max(CASE WHEN start THEN trim(content) END) AS signature,
         count(*) FILTER (WHERE NOT start AND mark = '+') AS added, count(*) FILTER (WHERE NOT start AND mark = '-') AS deleted, count(*) FILTER (WHERE NOT start) AS n_lines,
         count(*) FILTER (WHERE NOT start AND regexp_matches(content, '{CONTROL}')) AS complexity
  FROM labelled WHERE begins IS NOT NULL GROUP BY path, hunk, begins),
segmented AS (SELECT *, rank() OVER (PARTITION BY path, hunk ORDER BY begins) AS segment, CASE WHEN added > 0 AND deleted > 0 THEN 'MODIFIED' WHEN added > 0 THEN 'ADDED' WHEN deleted > 0 THEN 'DELETED' ELSE 'UNCHANGED' END AS change FROM methods_of)"""

FILES = {f.__name__: f for f in (j13_tests_of_files, j13_tests_of_classes, a19_file_coverage, a19_coverage_ratio, j19_missing_tests, j14_changed_files_of_calls, w2_method_segments, d5_changed_methods)}
FILES_SQL = {
    "j13_tests_of_files": f"WITH {FILE_CTES} SELECT path, test_path FROM own",
    "a19_file_coverage": f"WITH {FILE_CTES} SELECT path, n_tests, coverage, completeness FROM covered",
    "a19_coverage_ratio": f"WITH {FILE_CTES} SELECT count(*) AS n_files, count(*) FILTER (WHERE n_tests > 0) AS n_covered, round(avg(CASE WHEN n_tests > 0 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM covered",
    "j19_missing_tests": f"WITH {FILE_CTES} SELECT path FROM files WHERE NOT is_test AND path NOT IN (SELECT path FROM own)",
    "j14_changed_files_of_calls": f"""WITH RECURSIVE {GRAPH_CTES}, {FILE_CTES},
        changed AS (SELECT file_path AS path FROM classes UNION SELECT path FROM files),
        of_class AS (SELECT c.id, f.path FROM classes c JOIN changed f ON contains(lower(f.path), lower(c.name))),
        ends AS (SELECT edge_ord, a.class_id AS id FROM edges JOIN methods a ON a.id = from_id JOIN methods b ON b.id = to_id UNION SELECT edge_ord, b.class_id FROM edges JOIN methods a ON a.id = from_id JOIN methods b ON b.id = to_id)
        SELECT edge_ord, count(DISTINCT path) AS n_files, min(path) AS first_path FROM ends JOIN of_class USING (id) GROUP BY edge_ord""",
    "w2_method_segments": f"WITH {CHANGE_CTES}, {SEGMENT_CTES} SELECT path, hunk, segment, signature, added, deleted, n_lines, complexity, change FROM segmented",
    "d5_changed_methods": f"WITH {CHANGE_CTES}, {SEGMENT_CTES} SELECT path, count(*) AS n_methods, CAST(sum(complexity) AS BIGINT) AS complexity, max(complexity) AS most, count(*) FILTER (WHERE change <> 'UNCHANGED') AS n_changed, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM segmented GROUP BY path",
}
