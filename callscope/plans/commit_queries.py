"""Commits, chosen paths and the gate of a review; their SQL is written apart from the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions import rules as r
from callscope.functions.durable import cut
from callscope.plans.bridge import code_graph
from callscope.plans.change_queries import CHANGE_CTES, CHANGES, diff_lines, log_lines
from callscope.plans.review_queries import FAMILY_CTES, family_rows, with_graph
from callscope.plans.texts import Duck, Spark
from callscope.plans.weight_queries import _WITH, PATH_CTES, changed_files, r13_screening, steps

KEYWORDS = [*r.COMMIT_TERMS, *r.COMMIT_ACTIONS]
MINIMUM = 60
# Scores of levels, and words of risk and trade.
IMPACT_SCORES = [("timeout|lock|transaction|payment|auth|security|user|order", 100), ("service|controller|api|database|cache|session|validation", 80), ("util|helper|format|convert|parse|calculate", 60)]
HIGH_RISK, MEDIUM_RISK = "delete|remove|transaction|lock|security|auth", "exception|error"
TRADE = ["controller", "service", "repository", "api", "business"]
RELEVANT = 100


def w3_commit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the keywords of a commit and the one before it in its conversation are common: intersection over union, 0 without any."""
    parts = F.split("line", r"\|")
    low = F.lower(F.get(parts, F.lit(3)))
    words = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k))
    before = F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = log_lines(spark, sf_dir).select("conv_id", "turn", words.alias("words")).withColumn("before", before).where("before IS NOT NULL")
    union = F.size(F.array_union("words", "before"))
    return c.select("conv_id", "turn", F.when(union > 0, F.round(F.size(F.array_intersect("words", "before")) / union, 6)).otherwise(0.0).alias("similarity"))


def d16_dedup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose methods, sorted, are the same: the first of them and how many there are."""
    rows = family_rows(code_graph(spark, sf_dir))
    first = F.min(F.struct("ord", "path", "family"))
    return rows.groupBy("key").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).select("key", "f.family", "f.path", "n")


def d17_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred paths that are more than a name: of several methods or across layers, and not of tests or mocks. All are of changed files."""
    p = d16_dedup_paths(spark, sf_dir)
    order = F.expr("CASE family WHEN 'direct' THEN 1 WHEN 'class' THEN 1 WHEN 'upstream' THEN 2 WHEN 'downstream' THEN 3 ELSE 4 END")
    significant = F.contains("path", F.lit("->")) | (F.col("family") == "cross-layer")
    kept = p.where(significant & ~F.lower("path").rlike("test|mock")).withColumn("ord", order)
    return kept.orderBy("ord", "path", "family").limit(RELEVANT).select("family", "path")


def ranked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with ``lines``, the changed lines of the files of their classes, and how many methods they have."""
    g = code_graph(spark, sf_dir)
    p = d16_dedup_paths(spark, sf_dir).select("key", "family", "path")
    changed = changed_files(spark, sf_dir, g).join(g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name")), "class_id").select("class_name", (F.col("added") + F.col("deleted")).alias("lines"))
    named = p.select("key", F.explode(F.array_distinct(F.transform(F.split("path", "->"), lambda m: F.split_part(m, F.lit("."), F.lit(1))))).alias("class_name"))
    sums = named.join(changed, "class_name").groupBy("key").agg(F.sum("lines").alias("lines"))
    return p.join(sums, "key", "left").select("family", "path", F.lower("path").alias("low"), "lines", F.size(F.split("path", "->")).alias("n_methods"))


def t4_business_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by business impact: level, risk, size of the change and words; the highest first."""
    p = ranked_paths(spark, sf_dir)
    level = F.expr(r.first_match("low", IMPACT_SCORES, 40))
    risk = F.when(F.col("low").rlike(HIGH_RISK), 40).when(F.col("low").rlike(MEDIUM_RISK), 30).otherwise(20)
    size = F.when(F.col("lines").isNull(), 0).otherwise(steps(F.col("lines"), [(50, 30), (20, 25), (5, 20)], 15))
    return p.select("family", "path", (level + risk + size + F.expr(r.points("low", r.IMPACT_POINTS))).alias("score")).orderBy(F.desc("score"), "path", "family")


def t5_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by relevance: two or three methods, several layers, words of the trade, and the size of the change; the highest first."""
    p = ranked_paths(spark, sf_dir)
    length = F.when(F.col("n_methods") == 2, 3.0).when(F.col("n_methods") == 3, 4.0).when(F.col("n_methods") == 4, 2.0).otherwise(1.0)
    words = sum((F.contains("low", F.lit(w)).cast("int") for w in TRADE), F.lit(0)) * 0.5
    lines = F.coalesce("lines", F.lit(0))
    size = F.when(lines > 100, 2.0).when(lines > 50, 1.5).when(lines > 10, 1.0).otherwise(0.5)
    return p.select("family", "path", (length + F.when(F.col("family") == "cross-layer", 2.0).otherwise(0.0) + words + size).alias("score")).orderBy(F.desc("score"), "path", "family")


def d9_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changed file with its changed lines, whether it is a hotspot, and the review's impact radius and risk of regression."""
    chosen = r13_screening(spark, sf_dir).agg(F.count_if(F.col("side") == "golden").alias("golden"), F.count_if(F.col("side") == "risk").alias("risky"))  # at most seven rows
    files = cut(changed_files(spark, sf_dir, code_graph(spark, sf_dir)).select("path", (F.col("added") + F.col("deleted")).alias("n")))
    whole = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    x = files.crossJoin(F.broadcast(whole.crossJoin(chosen)))  # one row
    risk = F.least(F.col("lines") * 0.01 + (F.col("golden") + F.col("risky")) * 0.1, F.lit(1.0))
    return x.select("path", "n", (F.col("n") > 50).alias("hotspot"), (F.col("golden") + 2 * F.col("risky")).alias("radius"), F.round(risk, 6).alias("regression_risk"))


def p32_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each file passes, and why not: score, level of risk, critical findings."""
    lines = diff_lines(spark, sf_dir)
    score = spark.sql(CHANGES["a23_review_score"](Spark()), diff_lines=lines)
    danger = spark.sql(CHANGES["d22_danger_severity"](Spark()), diff_lines=lines).where("severity = 'CRITICAL'").select("path")
    logic = spark.sql(CHANGES["d19_critical_logic"](Spark()), diff_lines=lines).where("risk > 0").select("path")
    critical = danger.unionByName(logic).groupBy("path").agg(F.count(F.lit(1)).alias("n_critical"))
    x = score.join(critical, "path", "left").fillna(0, ["n_critical"])
    reasons = F.array_compact(F.array(F.when(F.col("score") < MINIMUM, "score"), F.when(F.col("risk").isin("HIGH", "CRITICAL"), "risk"), F.when(F.col("n_critical") > 0, "critical")))
    return x.select("path", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"), "n_critical")


def _body(name: str) -> str:
    return CHANGES[name](Duck()).strip().replace("{", "").replace("}", "")


_WORDS = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_FIRST = "(SELECT key, arg_min(family, (ord, path, family)) AS family, arg_min(path, (ord, path, family)) AS path, min(ord) AS ord, count(*) AS n FROM every GROUP BY key)"
COMMITS = {f.__name__: f for f in (w3_commit_similarity, d16_dedup_paths, d17_relevant, t4_business_impact, t5_relevance, d9_impact, p32_quality_gate)}
_RANKED = f"""WITH RECURSIVE {PATH_CTES}, {", ".join(FAMILY_CTES)},
  kept AS (SELECT key, family, path, lower(path) AS low, len(string_split(path, '->')) AS n_methods FROM {_FIRST}),
  sums AS (SELECT k.key, sum(f.added + f.deleted) AS lines FROM kept k JOIN files f ON list_contains(list_transform(string_split(k.path, '->'), lambda x: string_split(x, '.')[1]), (SELECT name FROM classes c WHERE c.id = f.class_id)) GROUP BY k.key),
  rows AS (SELECT k.*, lines FROM kept k LEFT JOIN sums USING (key))"""
COMMITS_SQL = {
    "t4_business_impact": f"{_RANKED} SELECT family, path, CAST({r.first_match('low', IMPACT_SCORES, 40)} + CASE WHEN regexp_matches(low, '{HIGH_RISK}') THEN 40 WHEN regexp_matches(low, '{MEDIUM_RISK}') THEN 30 ELSE 20 END + CASE WHEN lines IS NULL THEN 0 WHEN lines > 50 THEN 30 WHEN lines > 20 THEN 25 WHEN lines > 5 THEN 20 ELSE 15 END + {r.points('low', r.IMPACT_POINTS)} AS INTEGER) AS score FROM rows",
    "t5_relevance": f"{_RANKED} SELECT family, path, CAST(CASE n_methods WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 2 ELSE 1 END + CASE WHEN family = 'cross-layer' THEN 2 ELSE 0 END + 0.5 * ({' + '.join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in TRADE)}) + CASE WHEN coalesce(lines, 0) > 100 THEN 2.0 WHEN coalesce(lines, 0) > 50 THEN 1.5 WHEN coalesce(lines, 0) > 10 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS score FROM rows",
    "w3_commit_similarity": f"""WITH {CHANGE_CTES}, c AS (SELECT conv_id, turn, list_filter({_WORDS}, lambda x: contains(lower(string_split(line, '|')[4]), x)) AS w FROM log_lines),
        p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)
        SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(w, b))) > 0 THEN round(len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))), 6) ELSE 0.0 END AS similarity FROM p WHERE b IS NOT NULL""",
    "d16_dedup_paths": with_graph(*FAMILY_CTES, f"SELECT key, family, path, n FROM {_FIRST}"),
    "d17_relevant": with_graph(*FAMILY_CTES, f"SELECT family, path FROM {_FIRST} WHERE (contains(path, '->') OR family = 'cross-layer') AND NOT regexp_matches(lower(path), 'test|mock') ORDER BY ord, path, family LIMIT {RELEVANT}"),
    "d9_impact": f"""{_WITH}, chosen AS (SELECT least(2, count(*) FILTER (WHERE intent > 60)) AS golden, least(5, count(*) FILTER (WHERE risk > 70)) AS risky FROM ranked), whole AS (SELECT coalesce(sum(added + deleted), 0) AS lines FROM files)
        SELECT path, added + deleted AS n, added + deleted > 50 AS hotspot, golden + 2 * risky AS radius, round(least(lines * 0.01 + (golden + risky) * 0.1, 1.0), 6)::DOUBLE AS regression_risk FROM files, chosen, whole""",
    "p32_quality_gate": f"""WITH {CHANGE_CTES}, scored AS ({_body("a23_review_score")}), wrong AS (SELECT path, count(*) AS n FROM (SELECT path FROM ({_body("d22_danger_severity")}) a WHERE severity = 'CRITICAL' UNION ALL SELECT path FROM ({_body("d19_critical_logic")}) b WHERE risk > 0) u GROUP BY path),
        judged AS (SELECT s.path, coalesce(n, 0) AS n_critical, concat_ws(',', CASE WHEN score < {MINIMUM} THEN 'score' END, CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 'risk' END, CASE WHEN coalesce(n, 0) > 0 THEN 'critical' END) AS reasons FROM scored s LEFT JOIN wrong w ON w.path = s.path)
        SELECT path, reasons = '' AS passed, reasons, n_critical FROM judged""",
}
