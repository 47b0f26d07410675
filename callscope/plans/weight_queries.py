"""Intent and risk of call paths of two methods, their order and their screening; the SQL of risk is written apart from the plan.

A review has changed files: those of the classes that a hash of their name picks, each with the diff of the document of its number. A path is related to the files of its
two classes. Method and class scores are made once, cut, and joined to the paths' ends; callers are made distinct before the second hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import rules as r
from callscope.functions.durable import cut
from callscope.plans.bridge import GRAPH_CTES, code_graph
from callscope.plans.change_queries import CHANGE_CTES, CHANGES, diff_lines, parsed_diff
from callscope.plans.graph import CodeGraph
from callscope.plans.graph_queries import ALLOWED, CALLS
from callscope.plans.review_queries import PICKED
from callscope.plans.rule_queries import INTENT
from callscope.plans.texts import Duck, Spark

KINDS = ["ADDED", "MODIFIED", "DELETED"]
GOLDEN, RISKY = (60, 2, 0.8), (70, 5, 0.7)  # more than, how many, confidence


def changed_files(spark: SparkSession, sf_dir: str, g: CodeGraph) -> DataFrame:
    """``class_id, path, change, added, deleted, ops, critical`` of the review's files; ``ops`` has a bit for each sensitive word among added lines."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Controller.java", "Service.java", "Config.yml", "Util.kt", "notes.md")]), (F.col("doc_id") % 5 + 1).cast("int"))
    of_doc = d.select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"), kind).alias("diff_path"))
    picked = g.classes.where(F.conv(F.substring(F.md5("name"), 1, 4), 16, 10).cast("long") % PICKED == 0).select(F.col("id").alias("class_id"), F.col("file_path").alias("path"))
    picked = picked.join(of_doc, picked["class_id"] == of_doc["doc_id"]).select("class_id", "path", "diff_path")
    lines = diff_lines(spark, sf_dir)
    low = F.lower("content")
    bits = sum((F.when(F.contains(low, F.lit(w)), 1 << i).otherwise(0) for i, (w, _) in enumerate(r.ADDED_RISK)), F.lit(0))
    added, deleted = F.col("kind") == "ADDED", F.col("kind") == "DELETED"
    told = parsed_diff(lines).groupBy(F.col("path").alias("diff_path")).agg(F.count_if(added).alias("added"), F.count_if(deleted).alias("deleted"), F.bit_or(F.when(added, bits).otherwise(0)).alias("ops"))
    wrong = spark.sql(CHANGES["d19_critical_logic"](Spark()), diff_lines=lines).groupBy(F.col("path").alias("diff_path")).agg(F.max("risk").alias("critical"))
    change = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("class_id") % 3 + 1).cast("int"))
    zero = {"added": 0, "deleted": 0, "ops": 0, "critical": 0}
    return picked.join(told, "diff_path", "left").join(wrong, "diff_path", "left").fillna(zero).select("class_id", "path", change.alias("change"), *zero)


def steps(x: Column, tiers: list[tuple[int, int]], least: int) -> Column:
    """The points of the first bound that is exceeded."""
    out = F.lit(least)
    for bound, points in reversed(tiers):
        out = F.when(x > bound, points).otherwise(out)
    return out


def of_review(files: DataFrame) -> DataFrame:
    """One row: what all changed files add to the risk of each path, by their size, deletions and configuration."""
    low = F.lower("path")
    config = low.rlike(r"\.(properties|yml|yaml|xml)$|config")
    t = files.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("a"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") == "DELETED").alias("gone"), F.count_if(config).alias("c"))
    size = F.least(steps(F.col("a") + F.col("d"), [(1000, 20), (500, 15), (200, 12), (100, 8)], 5) + steps(F.col("n"), [(20, 5), (10, 3)], 0), F.lit(25))
    deletion = F.least(F.col("gone") * 5 + steps(F.col("d"), [(500, 10), (200, 8), (100, 6), (50, 4)], 2), F.lit(15))
    return t.select((size + deletion + F.least(F.col("c") * 5, F.lit(10))).alias("review"))


def architecture(g: CodeGraph, calls: DataFrame) -> DataFrame:
    """Risk of each class's place: dependencies, implementations of an interface, parents and children."""
    deps = calls.where("from_class != to_class").groupBy(F.col("from_class").alias("id")).agg(F.count_distinct("to_class").alias("deps"))
    impls = g.classes.where("interface_id IS NOT NULL").groupBy(F.col("interface_id").alias("id")).agg(F.count(F.lit(1)).alias("impls"))
    kids = g.classes.where("super_id IS NOT NULL").groupBy(F.col("super_id").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    c = g.classes.select("id", "super_id").join(deps, "id", "left").join(impls, "id", "left").join(kids, "id", "left").fillna(0, ["deps", "impls", "kids"])
    kin = F.col("kids") + F.col("super_id").isNotNull().cast("int")
    over = lambda x, least, points, most: F.least(F.greatest(x - least, F.lit(0)) * points, F.lit(most))
    return c.select("id", (steps(F.col("deps"), [(15, 40), (10, 25), (5, 10)], 5) + over(F.col("impls"), 5, 5, 30) + over(kin, 4, 6, 25)).alias("arch"))


def blast(g: CodeGraph, calls: DataFrame) -> DataFrame:
    """Risk of each method's reach: classes that call it directly or by one method between, and their layers."""
    heads = calls.select(F.col("to_id").alias("id"), F.col("from_id").alias("via"), F.col("from_class").alias("c"), F.col("from_layer").alias("l")).distinct()
    beside = heads.select(F.col("id").alias("via"), "c", "l").distinct()
    two = heads.select("id", "via").join(beside, "via").select("id", "c", "l").distinct()
    every = heads.select("id", "c", "l", F.lit(1).alias("k")).unionByName(two.withColumn("k", F.lit(2)))
    n = every.groupBy("id").agg(F.count_distinct(F.when(F.col("k") == 1, F.col("c"))).alias("d"), F.count_distinct(F.when(F.col("k") == 2, F.col("c"))).alias("i"), F.count_distinct("l").alias("layers"))
    m = g.methods.select("id").join(n, "id", "left").fillna(0)
    points = steps(F.col("d"), [(20, 40), (10, 30), (5, 20)], 10) + steps(F.col("i"), [(50, 30), (20, 20), (10, 10)], 5) + 8 * F.greatest(F.col("layers") - 3, F.lit(0)) + steps(F.col("d") + F.col("i"), [(30, 20)], 0)
    return m.select("id", F.least(points, F.lit(80)).alias("blast"))


def file_points(path: Column) -> Column:
    out = F.lit(3)
    for words, points in reversed(r.FILE_RISK):
        out = F.when(F.lower(path).rlike(words.replace(".", "[.]")), points).otherwise(out)
    return out


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edge_ord, from_id, to_id, intent, risk, critical`` of all calls, unrounded."""
    g = code_graph(spark, sf_dir)
    calls = cut(g.sql(f"WITH {CALLS} SELECT edge_ord, from_id, to_id, from_class, to_class, from_layer, to_layer FROM calls"))
    intent = cut(g.sql(f"WITH {CALLS}, {INTENT} SELECT id, 0.40 * upstream + 0.35 * importance + 0.25 * least(frequency, 100) AS intent FROM intent").withColumn("intent", F.col("intent").cast("double")).join(blast(g, calls), "id"))
    files = cut(changed_files(spark, sf_dir, g))
    of_class = architecture(g, calls).join(files.select(F.col("class_id").alias("id"), file_points(F.col("path")).alias("points"), "ops", "critical"), "id", "left").fillna(0, ["points", "ops", "critical"])
    of_class = cut(of_class)
    end = lambda t, key, mark: t.select(F.col("id").alias(key), *[F.col(c).alias(mark + c) for c in t.columns if c != "id"])
    x = calls.join(end(intent, "from_id", "a_"), "from_id").join(end(intent, "to_id", "b_"), "to_id").join(end(of_class, "from_class", "a_"), "from_class").join(end(of_class, "to_class", "b_"), "to_class")
    x = x.crossJoin(F.broadcast(of_review(files)))  # one row
    both = F.col("from_class") != F.col("to_class")
    fine = F.concat_ws(">", "from_layer", "to_layer").isin([f"{a}>{b}" for a, b in ALLOWED])
    violation = F.when(~fine & (F.col("to_layer") != "UNKNOWN") & (F.col("from_layer") != F.col("to_layer")), 30).otherwise(0)
    ops = F.col("a_ops").bitwiseOR(F.col("b_ops"))
    words = sum((F.when(ops.bitwiseAND(F.lit(1 << i)) != 0, p).otherwise(0) for i, (_, p) in enumerate(r.ADDED_RISK)), F.lit(0))
    touched = F.col("a_points") + F.when(both, F.col("b_points")).otherwise(0)
    git = F.least(F.least(touched, F.lit(30)) + F.col("review") + F.least(words, F.lit(20)), F.lit(100))
    critical = F.greatest("a_critical", "b_critical")
    arch, reach = F.least((F.col("a_arch") + F.col("b_arch")) / 2, F.lit(100.0)), (F.col("a_blast") + F.col("b_blast")) / 2
    plain = (arch * 0.35 + reach * 0.3 + violation * 0.15) * 0.8 + git * 0.2
    return x.select("edge_ord", "from_id", "to_id", ((F.col("a_intent") + F.col("b_intent")) / 2).alias("intent"), F.when(critical > 0, critical.cast("double")).otherwise(plain).alias("risk"), critical.alias("critical"))


def r6_risk_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each path: what critical logic errors in its files say, or else graph (80 %) and change (20 %)."""
    return paths(spark, sf_dir).select("edge_ord", F.round("risk", 6).alias("risk"), (F.col("critical") > 0).alias("critical"))


def r12_dual_weights_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both weights of each path, the heaviest first."""
    p = paths(spark, sf_dir).select("edge_ord", F.round("intent", 6).alias("intent"), F.round("risk", 6).alias("risk"))
    return p.withColumn("total", F.round(F.col("intent") + F.col("risk"), 6)).orderBy(F.desc("total"), "edge_ord")


def r13_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fall-back choice of paths, in the order of both weights: two of high intent, five of high risk."""
    p = cut(r12_dual_weights_sorted(spark, sf_dir))
    out = None
    for side, column, (least, most, confidence) in (("golden", "intent", GOLDEN), ("risk", "risk", RISKY)):
        one = p.where(F.col(column) > least).orderBy(F.desc("total"), "edge_ord").limit(most).select(F.lit(side).alias("side"), "edge_ord", F.lit(confidence).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def t6_order_by_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred first paths of each kind of analysis: by intent, by risk, or by both."""
    p = cut(r12_dual_weights_sorted(spark, sf_dir))
    out = None
    for analysis, column in (("INTENT_FOCUSED", "intent"), ("RISK_FOCUSED", "risk"), ("COMPREHENSIVE", "total")):
        one = p.orderBy(F.desc(column), "edge_ord").limit(100).select(F.lit(analysis).alias("analysis"), "edge_ord", F.col(column).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


def a22_top_risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What raises the risk of most paths, of all that the rules name."""
    p = paths(spark, sf_dir).select(F.explode(F.array_compact(F.array(F.when(F.col("critical") > 0, F.concat(F.lit("critical logic "), F.col("critical").cast("string"))), F.when(F.col("risk") > 70, "high risk"), F.when(F.col("risk") > 40, "raised risk"), F.when(F.col("intent") > 60, "high intent")))).alias("factor"))
    return p.groupBy("factor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "factor").limit(10)


def _tiers(x: str, tiers: list[tuple[int, int]], least: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {b} THEN {p}" for b, p in tiers) + f" ELSE {least} END"


_PATH = "'src/' || source || '/' || lang || doc_id || CASE doc_id % 5 WHEN 0 THEN 'Controller.java' WHEN 1 THEN 'Service.java' WHEN 2 THEN 'Config.yml' WHEN 3 THEN 'Util.kt' ELSE 'notes.md' END"
_DANGER = CHANGES["d19_critical_logic"](Duck()).strip().replace("{", "").replace("}", "")[5:]
_DANGER_CTES, _DANGER_SELECT = _DANGER.rsplit("SELECT path, hunk, max(", 1)
_LINES = "regexp_matches(line, '^[+]')"
_OPS = " + ".join(f"max(CASE WHEN {_LINES} AND contains(lower(line), '{w}') THEN {1 << i} ELSE 0 END)" for i, (w, _) in enumerate(r.ADDED_RISK))
_WORDS = " + ".join(f"CASE WHEN (a.ops | b.ops) & {1 << i} <> 0 THEN {p} ELSE 0 END" for i, (_, p) in enumerate(r.ADDED_RISK))
_POINTS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p.path), '{w}')" for w in words.split("|")) + f" THEN {p}" for words, p in r.FILE_RISK) + " ELSE 3 END"
_INTENT = f"{CALLS}, {INTENT}".replace("{", "").replace("}", "")
_FINE = " OR ".join(f"(from_layer = '{a}' AND to_layer = '{b}')" for a, b in ALLOWED)
PATH_CTES = f"""{GRAPH_CTES}, {CHANGE_CTES}, {_DANGER_CTES},
danger AS (SELECT path, max(risk) AS critical FROM (SELECT path, hunk, max({_DANGER_SELECT}) z GROUP BY path),
{_INTENT},
shown AS (SELECT path AS diff_path, count(*) FILTER (WHERE {_LINES}) AS added, count(*) FILTER (WHERE starts_with(line, '-')) AS deleted, {_OPS} AS ops FROM diff_lines WHERE NOT starts_with(line, '@@') GROUP BY path),
picked AS (SELECT c.id AS class_id, file_path AS path, {_PATH} AS diff_path, CASE c.id % 3 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'MODIFIED' ELSE 'DELETED' END AS change FROM classes c JOIN documents d ON d.doc_id = c.id WHERE CAST('0x' || substr(md5(c.name), 1, 4) AS BIGINT) % {PICKED} = 0),
files AS (SELECT p.*, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(ops, 0) AS ops, coalesce(critical, 0) AS critical, {_POINTS} AS points FROM (SELECT * FROM picked) p LEFT JOIN shown USING (diff_path) LEFT JOIN danger g ON g.path = p.diff_path),
review AS (SELECT least({_tiers("a + d", [(1000, 20), (500, 15), (200, 12), (100, 8)], 5)} + {_tiers("n", [(20, 5), (10, 3)], 0)}, 25) + least(5 * gone + {_tiers("d", [(500, 10), (200, 8), (100, 6), (50, 4)], 2)}, 15) + least(5 * conf, 10) AS review
  FROM (SELECT coalesce(sum(added), 0) AS a, coalesce(sum(deleted), 0) AS d, count(*) AS n, count(*) FILTER (WHERE change = 'DELETED') AS gone, count(*) FILTER (WHERE regexp_matches(lower(path), '[.](properties|yml|yaml|xml)$|config')) AS conf FROM files) t),
arch AS (SELECT c.id, {_tiers("(SELECT count(DISTINCT to_class) FROM calls WHERE from_class = c.id AND to_class <> c.id)", [(15, 40), (10, 25), (5, 10)], 5)}
  + least(5 * greatest((SELECT count(*) FROM classes k WHERE k.interface_id = c.id) - 5, 0), 30) + least(6 * greatest((SELECT count(*) FROM classes k WHERE k.super_id = c.id) + CASE WHEN c.super_id IS NULL THEN 0 ELSE 1 END - 4, 0), 25) AS arch FROM classes c),
near AS (SELECT DISTINCT to_id AS id, from_id, from_class AS c, from_layer AS l FROM calls),
far AS (SELECT DISTINCT a.id, b.c, b.l FROM near a JOIN near b ON b.id = a.from_id),
wide AS (SELECT m.id, (SELECT count(DISTINCT c) FROM near n WHERE n.id = m.id) AS d, (SELECT count(DISTINCT c) FROM far f WHERE f.id = m.id) AS i, (SELECT count(DISTINCT l) FROM (SELECT id, l FROM near UNION SELECT id, l FROM far) u WHERE u.id = m.id) AS layers FROM methods m),
reached AS (SELECT id, least(80, {_tiers("d", [(20, 40), (10, 30), (5, 20)], 10)} + {_tiers("i", [(50, 30), (20, 20), (10, 10)], 5)} + 8 * greatest(layers - 3, 0) + CASE WHEN d + i > 30 THEN 20 ELSE 0 END) AS blast FROM wide),
place AS (SELECT a.id, arch, coalesce(points, 0) AS points, coalesce(ops, 0) AS ops, coalesce(critical, 0) AS critical FROM arch a LEFT JOIN files f ON f.class_id = a.id),
weighed AS (SELECT id, CAST(0.40 * upstream + 0.35 * importance + 0.25 * least(frequency, 100) AS DOUBLE) AS intent FROM intent),
paths AS (SELECT edge_ord, round((p.intent + q.intent) / 2, 6) AS intent, greatest(a.critical, b.critical) AS critical,
  round(CASE WHEN greatest(a.critical, b.critical) > 0 THEN greatest(a.critical, b.critical)::DOUBLE ELSE
    (least((a.arch + b.arch) / 2, 100.0) * 0.35::DOUBLE + (x.blast + y.blast) / 2 * 0.3::DOUBLE + CASE WHEN NOT ({_FINE}) AND to_layer <> 'UNKNOWN' AND from_layer <> to_layer THEN 30 ELSE 0 END * 0.15::DOUBLE) * 0.8::DOUBLE
    + least(100, least(30, a.points + CASE WHEN a.id = b.id THEN 0 ELSE b.points END) + review + least(20, {_WORDS})) * 0.2::DOUBLE END, 6) AS risk
  FROM calls JOIN place a ON a.id = from_class JOIN place b ON b.id = to_class JOIN reached x ON x.id = from_id JOIN reached y ON y.id = to_id JOIN weighed p ON p.id = from_id JOIN weighed q ON q.id = to_id, review),
ranked AS (SELECT *, round(intent + risk, 6) AS total FROM paths)"""
_WITH = f"WITH RECURSIVE {PATH_CTES}"
_TOP = "(SELECT '{0}' AS analysis, edge_ord, {1} AS weight FROM ranked ORDER BY {1} DESC, edge_ord LIMIT 100)"
PATHS = {f.__name__: f for f in (r6_risk_weight, r12_dual_weights_sorted, r13_screening, t6_order_by_analysis, a22_top_risk_factors)}
PATHS_SQL = {
    "r6_risk_weight": f"{_WITH} SELECT edge_ord, risk, critical > 0 AS critical FROM paths",
    "r12_dual_weights_sorted": f"{_WITH} SELECT edge_ord, intent, risk, total FROM ranked",
    "r13_screening": f"{_WITH} (SELECT 'golden' AS side, edge_ord, 0.8::DOUBLE AS confidence FROM ranked WHERE intent > 60 ORDER BY total DESC, edge_ord LIMIT 2) UNION ALL (SELECT 'risk', edge_ord, 0.7::DOUBLE FROM ranked WHERE risk > 70 ORDER BY total DESC, edge_ord LIMIT 5)",
    "t6_order_by_analysis": f"{_WITH} " + " UNION ALL ".join(_TOP.format(a, c) for a, c in (("INTENT_FOCUSED", "intent"), ("RISK_FOCUSED", "risk"), ("COMPREHENSIVE", "total"))),
    "a22_top_risk_factors": f"{_WITH} SELECT factor, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN critical > 0 THEN 'critical logic ' || critical END, CASE WHEN risk > 70 THEN 'high risk' END, CASE WHEN risk > 40 THEN 'raised risk' END, CASE WHEN intent > 60 THEN 'high intent' END], lambda x: x IS NOT NULL)) AS factor FROM paths) f GROUP BY factor ORDER BY n DESC, factor LIMIT 10",
}
