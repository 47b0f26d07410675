"""Answers of a review read back into rows: typed JSON where it is well formed, labelled sections of text where it isn't.

Answers are made of conversation turns in four forms: fenced JSON, JSON amid text with fields left out, JSON that breaks off, and labelled lists. The SQL says what they must
give without reading any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.diff import java_hash
from callscope.plans.bridge import pick

PATHS = "array<struct<path_id:string,reason:string,confidence:double>>"
SCHEMA = f"golden_paths {PATHS}, risk_paths {PATHS}, _corrupt_record string"
# Labels of sections, words of severities and categories, and the confidence of what is read from text.
GOLDEN, RISK = "意图路径|Golden Path", "风险路径|Risk Path"
TOLD = 0.7
SEVERITIES = [("严重|critical", "CRITICAL"), ("高|high", "HIGH"), ("中|medium", "MEDIUM")]
CATEGORIES = [("架构|architecture", "ARCHITECTURE"), ("性能|performance", "PERFORMANCE"), ("安全|security", "SECURITY"), ("可维护|maintainability", "MAINTAINABILITY")]
FLAW, NO_IMPACT = "风险|问题|Flaw", "可能的系统影响"
SAID = ["Critical", "high", "a medium", "small"]
KINDS = ["Architecture", "performance", "security", "maintainability", "other"]
ENDS = ["APPROVED", "rejected", "under conditions", "none"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, answer`` of every turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = F.trim(F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z ]", ""))
    w = F.when(words == "", "none").otherwise(words)
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    fenced = F.format_string('Here:\n```json\n{"golden_paths": [{"path_id": "g%s", "reason": "%s", "confidence": 0.9}],\n "risk_paths": [{"path_id": "r1", "reason": "%s"}, {"path_id": "r2"}], "more": 1}\n```\nDone.', key, w, w)
    partial = F.format_string('Answer: {"risk_paths": [{"path_id": "r%s", "reason": "%s {x}", "confidence": 0.25}]} so far', key, w)
    broken = F.format_string('{"golden_paths": [{"path_id": "x"\n## Golden Path\n- %s one\n  * %s two\nnothing\n', w, w)
    labelled = F.format_string("- lost\n意图路径:\n* %s\n- Risk Path follows\n-\n - %s risk\nFlaw: %s %s\nthen %s\nThe decision is %s", w, w, pick(SAID, F.col("conv_id") % 4), pick(KINDS, F.col("turn") % 5), w, pick(ENDS, (F.col("conv_id") + F.col("turn")) % 4))
    form = (F.col("conv_id") + 3 * F.col("turn")) % 4
    return c.select("conv_id", "turn", F.when(form == 0, fenced).when(form == 1, partial).when(form == 2, broken).otherwise(labelled).alias("answer"))


def parsed(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, form, side, nth, path_id, reason, confidence`` of answers.

    Fences are taken off, or what stands between the outer braces is read. A record that is corrupt, or that has neither list, is read as text: a line that names a section opens
    it, and of the lines after it those that begin with a dash or star are its paths.
    """
    fenced = F.regexp_extract("answer", r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    body = F.when(fenced != "", fenced).otherwise(bare)
    x = rows.select(*keys, "answer", F.from_json(body, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    good = F.col("j").isNotNull() & F.col("j._corrupt_record").isNull() & (F.col("j.golden_paths").isNotNull() | F.col("j.risk_paths").isNotNull())
    x = x.withColumn("good", F.coalesce(good, F.lit(False)))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"j.{s}_paths").alias("paths")) for s in ("golden", "risk")])
    typed = x.where("good").select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", F.posexplode("s.paths").alias("nth", "p"))
    typed = typed.select(*keys, F.lit("JSON").alias("form"), "side", (F.col("nth") + 1).alias("nth"), "p.path_id", F.coalesce("p.reason", F.lit("")).alias("reason"), F.coalesce("p.confidence", F.lit(TOLD)).alias("confidence"))
    lines = x.where("NOT good").select(*keys, F.posexplode(F.split("answer", "\n")).alias("at", "line"))
    label = F.when(F.col("line").rlike(GOLDEN), "golden").when(F.col("line").rlike(RISK), "risk")
    so_far = Window.partitionBy(*keys).orderBy("at")
    lines = lines.withColumn("label", label).withColumn("side", F.last("label", ignorenulls=True).over(so_far))
    item = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^-", ""), r"^\*", ""))
    items = lines.where("label IS NULL AND side IS NOT NULL").where(F.trim("line").rlike(r"^[-*]")).withColumn("reason", item).where("reason != ''")
    nth = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("at"))
    told = items.select(*keys, F.lit("TEXT").alias("form"), "side", nth.alias("nth"), F.concat(F.lit("text_extracted_"), java_hash(F.col("reason")).cast("string")).alias("path_id"), "reason", F.lit(TOLD).alias("confidence"))
    return typed.unionByName(told)


def first_of(line: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for words, name in reversed(rules):
        out = F.when(F.lower(line).rlike(words), name).otherwise(out)
    return out


def findings(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, at, description, severity, category, impact, decision``: lines of an answer that tell a flaw; the line after is its impact. Blank lines don't count."""
    low = F.lower("answer")
    decision = F.when(low.contains("approved"), "APPROVED").when(low.contains("rejected"), "REJECTED").otherwise("APPROVED_WITH_CONDITIONS")
    lines = F.filter(F.split("answer", "\n"), lambda s: F.trim(s) != "")
    x = rows.select(*keys, decision.alias("decision"), lines.alias("lines")).select(*keys, "decision", "lines", F.posexplode("lines").alias("at", "line"))
    impact = F.coalesce(F.get("lines", F.col("at") + 1), F.lit(NO_IMPACT))
    return x.where(F.col("line").rlike(FLAW)).select(*keys, "at", F.trim("line").alias("description"), first_of(F.col("line"), SEVERITIES, "LOW").alias("severity"), first_of(F.col("line"), CATEGORIES, "GENERAL").alias("category"), impact.alias("impact"), "decision")


def risk_level(found: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, n_serious, level``: one critical flaw, two high ones or more than three at all make the level."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    level = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 1, "HIGH").when(F.col("n") > 3, "MEDIUM").otherwise("LOW")
    return n.select(*keys, "n", (F.col("critical") + F.col("high")).alias("n_serious"), level.alias("level"))


def r15_parsed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(answers(spark, sf_dir), "conv_id", "turn")


def r15_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(answers(spark, sf_dir), "conv_id", "turn")


def r15_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of whole conversations."""
    return risk_level(findings(answers(spark, sf_dir), "conv_id", "turn"), "conv_id")


_HASH = "(SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) AS h))"
_CTES = """
c AS (SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(substr(text, 1, 60), '[^A-Za-z ]', '', 'g')), ''), 'none') AS w, conv_id || '-' || turn AS k, (conv_id + 3 * turn) % 4 AS form FROM conversations)"""


def _case(words: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(words)) + " END"


_TOLD = f"""told AS (SELECT conv_id, turn, 'golden' AS side, 1 AS nth, w || ' one' AS reason FROM c WHERE form = 2 UNION ALL SELECT conv_id, turn, 'golden', 2, w || ' two' FROM c WHERE form = 2
  UNION ALL SELECT conv_id, turn, 'golden', 1, w FROM c WHERE form = 3 UNION ALL SELECT conv_id, turn, 'risk', 1, w || ' risk' FROM c WHERE form = 3)"""
_FLAWS = f"""flaws AS (SELECT conv_id, turn, 6 AS at, 'Flaw: ' || {_case(SAID, 'conv_id % 4')} || ' ' || {_case(KINDS, 'turn % 5')} AS description, {_case(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], 'conv_id % 4')} AS severity, {_case(['ARCHITECTURE', 'PERFORMANCE', 'SECURITY', 'MAINTAINABILITY', 'GENERAL'], 'turn % 5')} AS category,
  'then ' || w AS impact, CASE WHEN contains(lower(w), 'approved') OR (conv_id + turn) % 4 = 0 THEN 'APPROVED' WHEN contains(lower(w), 'rejected') OR (conv_id + turn) % 4 = 1 THEN 'REJECTED' ELSE 'APPROVED_WITH_CONDITIONS' END AS decision FROM c WHERE form = 3)"""
RESPONSES = {f.__name__: f for f in (r15_parsed_paths, r15_findings, r15_risk_levels)}
RESPONSES_SQL = {
    "r15_parsed_paths": f"""WITH {_CTES}, {_TOLD}
        SELECT conv_id, turn, 'JSON' AS form, 'golden' AS side, 1 AS nth, 'g' || k AS path_id, w AS reason, 0.9::DOUBLE AS confidence FROM c WHERE form = 0
        UNION ALL SELECT conv_id, turn, 'JSON', 'risk', 1, 'r1', w, {TOLD}::DOUBLE FROM c WHERE form = 0 UNION ALL SELECT conv_id, turn, 'JSON', 'risk', 2, 'r2', '', {TOLD}::DOUBLE FROM c WHERE form = 0
        UNION ALL SELECT conv_id, turn, 'JSON', 'risk', 1, 'r' || k, w || ' {{x}}', 0.25::DOUBLE FROM c WHERE form = 1
        UNION ALL SELECT conv_id, turn, 'TEXT', side, nth, 'text_extracted_' || {_HASH.format('reason')}, reason, {TOLD}::DOUBLE FROM told""",
    "r15_findings": f"WITH {_CTES}, {_FLAWS} SELECT * FROM flaws",
    "r15_risk_levels": f"WITH {_CTES}, {_FLAWS} SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS n_serious, CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE severity = 'HIGH') > 1 THEN 'HIGH' WHEN count(*) > 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM flaws GROUP BY conv_id",
}
