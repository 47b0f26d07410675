"""Change data: name-status, unified diffs and commit logs, and the rules that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import rules as r
from callscope.plans.bridge import pick
from callscope.plans.texts import Spark, Text

HEADER = "^@@ -([0-9]+),?([0-9]*) [+]([0-9]+),?([0-9]*) @@ ?(.*)$"
CODE = "if (ready) { for (int i = 0; i < n; i++) { step(i); } }"  # a line of code among the texts, as are imports
CHECKED, UNCHECKED = "if (!user.validate()) return;", "if (true) { step(); }"  # a check that goes, and what comes for it
ACTIONS, TERMS = r.COMMIT_ACTIONS[:8], r.COMMIT_TERMS[:16]


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a unified diff made of the lines of all documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"), pick(["Controller.java", "Service.java", "Config.yml", "Util.kt", "notes.md"], F.col("doc_id") % 5))
    x = d.select(path.alias("path"), "source", "lang", F.posexplode(F.split("text", "\n")).alias("ix", "content"))
    head = F.concat(F.lit("@@ -"), (F.col("ix") + 1).cast("string"), F.lit(",3 +"), (F.col("ix") + 2).cast("string"), F.when(F.col("ix") % 12 == 0, ",4").otherwise(""), F.lit(" @@ hdr"))
    code = F.when(F.col("ix") % 60 == 27, F.lit(UNCHECKED)).when(F.col("ix") % 12 == 7, F.concat(F.lit("import "), "source", F.lit("."), "lang", F.lit(";"))).when(F.col("ix") % 12 == 9, F.concat(F.lit("import com."), "lang", F.lit(";"))).when(F.col("ix") % 12 == 3, F.lit(CODE)).when(F.col("ix") % 10 == 2, F.concat(F.lit("  private int step"), F.col("ix").cast("string"), F.lit("(int n) {"))).when(F.col("ix") % 60 == 28, F.lit(CHECKED)).otherwise(F.col("content"))
    x = x.withColumn("content", code)
    line = F.when(F.col("ix") % 6 == 0, head).otherwise(F.concat(pick(["+", "-", " "], F.col("ix") % 3), "content"))
    return x.select("path", F.col("ix").cast("long").alias("ix"), line.alias("line"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ``hash|author|date|message`` of a commit log made of all conversation turns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.col("conv_id") + F.col("turn")
    line = F.concat_ws("|", F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))), "role", F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0")), F.concat(pick(ACTIONS, k % 8), F.lit(" "), pick(TERMS, F.col("conv_id") % 16), F.lit(" "), F.regexp_replace("text", "\n", " ")))
    return c.select("conv_id", "turn", line.alias("line"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated status and path of all documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"), pick(["Controller.java", "Service.java", "Config.yml", "Util.kt", "notes.md"], F.col("doc_id") % 5))
    return d.select(F.concat_ws("\t", pick(["A", "M", "D", "R100", "R095", "C100"], F.col("doc_id") % 6), path).alias("line"))


def _case(names: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_PATH = f"'src/' || source || '/' || lang || doc_id || {_case(['Controller.java', 'Service.java', 'Config.yml', 'Util.kt', 'notes.md'], 'doc_id % 5')}"
CHANGE_CTES = f"""
diff_lines AS (
  SELECT path, ix, CASE WHEN ix % 6 = 0 THEN '@@ -' || (ix + 1) || ',3 +' || (ix + 2) || CASE WHEN ix % 12 = 0 THEN ',4' ELSE '' END || ' @@ hdr'
                        ELSE {_case(['+', '-', ' '], 'ix % 3')} || content END AS line
  FROM (SELECT path, ix, CASE WHEN ix % 60 = 27 THEN '{UNCHECKED}' ELSE CASE ix % 12 WHEN 7 THEN 'import ' || source || '.' || lang || ';' WHEN 9 THEN 'import com.' || lang || ';' WHEN 3 THEN '{CODE}' ELSE CASE WHEN ix % 10 = 2 THEN '  private int step' || ix || '(int n) {{' WHEN ix % 60 = 28 THEN '{CHECKED}' ELSE content END END END AS content
        FROM (SELECT {_PATH} AS path, source, lang, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS ix FROM documents))),
log_lines AS (
  SELECT conv_id, turn, md5(conv_id || ':' || turn) || '|' || role || '|2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') || '|' || {_case(ACTIONS, '(conv_id + turn) % 8')} || ' ' || {_case(TERMS, 'conv_id % 16')} || ' ' || replace(text, chr(10), ' ') AS line
  FROM conversations),
status_lines AS (SELECT {_case(['A', 'M', 'D', 'R100', 'R095', 'C100'], 'doc_id % 6')} || chr(9) || {_PATH} AS line FROM documents)"""


def hunks(d: Spark) -> str:
    start = d.found("line", HEADER, 3)
    return f"""marked AS (SELECT path, ix, line, CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END AS head, CASE WHEN line LIKE '+%' THEN 'ADDED' WHEN line LIKE '-%' THEN 'DELETED' ELSE 'CONTEXT' END AS kind FROM {{diff_lines}}),
numbered AS (SELECT *, CAST(sum(head) OVER (PARTITION BY path ORDER BY ix) AS BIGINT) AS hunk FROM marked),
opened AS (SELECT *, max(CASE WHEN head = 1 THEN CAST({start} AS BIGINT) END) OVER (PARTITION BY path, hunk) AS new_start FROM numbered WHERE hunk > 0),
placed AS (SELECT path, hunk, ix, kind, substr(line, 2) AS content, CASE WHEN kind = 'DELETED' THEN NULL ELSE new_start + coalesce(CAST(sum(CASE WHEN kind = 'DELETED' OR head = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY path, hunk ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) END AS line_no FROM opened WHERE head = 0)"""


def measured(d: Spark) -> str:
    """Lines that aren't blank, and one more than the branches, of each path; a branch is a whole word before a bracket, or a case."""
    branch = "(^|[^A-Za-z0-9_])((if|while|for|catch) ?[(]|case )"
    return f"measured AS (SELECT path, CAST(1 + sum({d.count('content', branch)}) AS BIGINT) AS complexity, CAST(sum(CASE WHEN trim(content) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS loc FROM placed WHERE kind <> 'DELETED' GROUP BY path)"


def words(column: str, text: str) -> str:
    return r.has(column, text)


#: deleted and added lines of one hunk met, for the rules on replaced logic
PAIRED = """d AS (SELECT path, hunk, lower(content) AS x FROM placed WHERE kind = 'DELETED'), a AS (SELECT path, hunk, lower(content) AS y FROM placed WHERE kind = 'ADDED'), met AS (SELECT d.path, d.hunk, x, y FROM d JOIN a ON d.path = a.path AND d.hunk = a.hunk)"""
COMMITS = """commits AS (SELECT conv_id, turn, split_part(line, '|', 1) AS hash, split_part(line, '|', 2) AS author, split_part(line, '|', 3) AS date, split_part(line, '|', 4) AS message FROM {log_lines})"""
FILES = """files AS (SELECT split_part(line, TAB, 2) AS path, CASE WHEN s = 'A' THEN 'ADDED' WHEN s = 'M' THEN 'MODIFIED' WHEN s = 'D' THEN 'DELETED' WHEN s IN ('R', 'R100') THEN 'RENAMED' WHEN s IN ('C', 'C100') THEN 'COPIED' ELSE 'MODIFIED' END AS change FROM (SELECT line, split_part(line, TAB, 1) AS s FROM {status_lines}) x)""".replace("TAB", "chr(9)")


def blob(d: Spark, kind: str | None = None) -> str:
    """Lower-case text of each hunk."""
    where = f"WHERE kind = '{kind}'" if kind else ""
    joined = "string_agg(content, ' ') WITHIN GROUP (ORDER BY ix)" if d.name == "spark" else "string_agg(content, ' ' ORDER BY ix)"
    return f"(SELECT path, hunk, lower({joined}) AS t, CAST(count(*) AS BIGINT) AS n FROM placed {where} GROUP BY path, hunk)"


CHANGES: dict[str, Text] = {
    "s4_branches": lambda d: "SELECT DISTINCT CASE WHEN b LIKE 'origin/%' THEN substr(b, 8) ELSE b END AS branch FROM (SELECT 'origin/' || split_part(line, '|', 2) AS b FROM {log_lines} UNION ALL SELECT split_part(line, '|', 3) FROM {log_lines}) x WHERE b <> 'HEAD' ORDER BY branch",
    "s6_branch_ref": lambda d: f"WITH {COMMITS} SELECT a.author, coalesce(min(b.hash), a.author) AS ref FROM (SELECT DISTINCT author FROM commits) a LEFT JOIN commits b ON b.author = a.author AND b.turn = 1 GROUP BY a.author",
    "s7_name_status": lambda d: f"WITH {FILES} SELECT path, change FROM files WHERE {d.rx('path', '[.](java|kt|scala|xml|properties|yml|yaml)$')}",
    "s8_unified_diff": lambda d: f"WITH {hunks(d)} SELECT path, hunk, CAST(ix AS BIGINT) AS ix, kind, content, line_no FROM placed",
    "s9_hunk_headers": lambda d: f"SELECT path, CAST(ix AS BIGINT) AS ix, CAST({d.found('line', HEADER, 1)} AS BIGINT) AS old_start, CAST(coalesce(nullif({d.found('line', HEADER, 2)}, ''), '1') AS BIGINT) AS old_count, CAST({d.found('line', HEADER, 3)} AS BIGINT) AS new_start, CAST(coalesce(nullif({d.found('line', HEADER, 4)}, ''), '1') AS BIGINT) AS new_count, {d.found('line', HEADER, 5)} AS header FROM {{diff_lines}} WHERE line LIKE '@@%'",
    "s10_commit_log": lambda d: f"WITH {COMMITS} SELECT hash, author, date, message FROM commits",
    "s11_line_totals": lambda d: f"WITH {hunks(d)} SELECT path, CAST(sum(CASE WHEN kind = 'ADDED' THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN kind = 'DELETED' THEN 1 ELSE 0 END) AS BIGINT) AS deleted FROM placed GROUP BY path",
    "s15_project_root": lambda d: f"WITH {FILES} SELECT path, {d.found(chr(39) + '/work/' + chr(39) + ' || path', '^(.*?)/src/')} AS root FROM files",
    "s16_source_scan": lambda d: f"WITH {FILES} SELECT path FROM files WHERE {d.rx('path', '[.](java|kt)$')} AND NOT {d.rx('lower(path)', 'test')}",
    "j21_replaced_lines": lambda d: f"WITH {hunks(d)}, {PAIRED} SELECT path, hunk, CAST(count(*) AS BIGINT) AS n_pairs FROM met GROUP BY path, hunk",
    "w1_running_line_number": lambda d: f"WITH {hunks(d)} SELECT path, hunk, min(line_no) AS first_no, max(line_no) AS last_no, CAST(count(line_no) AS BIGINT) AS n FROM placed GROUP BY path, hunk",
    "w4_first_last_commit": lambda d: f"WITH {COMMITS} SELECT conv_id, min_by(hash, turn) AS first_hash, max_by(hash, turn) AS last_hash, CAST(count(*) AS BIGINT) AS n FROM commits GROUP BY conv_id",
    "w9_change_islands": lambda d: f"WITH {hunks(d)}, c AS (SELECT path, ix, lag(ix) OVER (PARTITION BY path ORDER BY ix) AS p FROM placed WHERE kind <> 'CONTEXT'), g AS (SELECT path, ix, CAST(sum(CASE WHEN p IS NULL OR ix - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ix) AS BIGINT) AS island FROM c) SELECT path, island, CAST(min(ix) AS BIGINT) AS lo, CAST(max(ix) AS BIGINT) AS hi, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY path, island",
    "a18_change_scope": lambda d: f"WITH {FILES} SELECT change, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY change",
    "a19_test_coverage": lambda d: f"WITH {FILES}, f AS (SELECT split_part(path, '/', 2) AS module, CASE WHEN {d.rx('lower(path)', 'util|notes')} THEN 1 ELSE 0 END AS t FROM files) SELECT module, CAST(sum(t) AS BIGINT) AS tests, CAST(sum(1 - t) AS BIGINT) AS business, round(least(sum(t) * 1.0E0 / nullif(sum(1 - t), 0), 1.0E0), 6) AS completeness, CASE WHEN sum(t) = 0 THEN 'NO_TESTS' WHEN sum(t) = 1 THEN 'BASIC' ELSE 'PARTIAL' END AS coverage FROM f GROUP BY module",
    "a24_change_summary": lambda d: f"WITH {hunks(d)} SELECT kind, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT path) AS BIGINT) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM placed GROUP BY kind",
    "d3_changed_files": lambda d: f"WITH {hunks(d)} SELECT path, CASE WHEN sum(CASE WHEN kind = 'DELETED' THEN 1 ELSE 0 END) = 0 THEN 'ADDED' WHEN sum(CASE WHEN kind = 'ADDED' THEN 1 ELSE 0 END) = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM placed WHERE content <> '' AND kind <> 'CONTEXT' GROUP BY path",
    "d4_hunk_summary": lambda d: f"WITH {hunks(d)} SELECT path, hunk, CAST(sum(CASE WHEN kind = 'ADDED' THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN kind = 'DELETED' THEN 1 ELSE 0 END) AS BIGINT) AS deleted, CAST(sum(CASE WHEN kind = 'CONTEXT' THEN 1 ELSE 0 END) AS BIGINT) AS context FROM placed GROUP BY path, hunk",
    "d5_complexity": lambda d: f"WITH {hunks(d)} SELECT path, CAST(sum(CASE WHEN {d.rx('content', 'if|for|while|switch|try|catch')} THEN 1 ELSE 0 END) AS BIGINT) AS complexity, CAST(count(*) AS BIGINT) AS n FROM placed GROUP BY path",
    "d6_dependency_changes": lambda d: f"""WITH {hunks(d)} SELECT path, CASE kind WHEN 'ADDED' THEN 'ADDED' ELSE 'REMOVED' END AS change, trim(split_part(substr(content, strpos(content, 'import ') + 7), ';', 1)) AS dependency, CAST(count(*) AS BIGINT) AS n
        FROM placed WHERE contains(content, 'import ') AND kind IN ('ADDED', 'DELETED') GROUP BY 1, 2, 3""".replace("strpos", "locate_" if d.name == "spark" else "strpos").replace("locate_(content, 'import ')", "locate('import ', content)"),
    "d7_commit_keywords": lambda d: f"WITH {COMMITS} SELECT hash, {r.hits('lower(message)', r.COMMIT_TERMS)} AS terms, {r.hits('lower(message)', r.COMMIT_ACTIONS)} AS actions FROM commits",
    "d8_paths": lambda d: f"WITH {FILES} SELECT path, split_part(path, '/', 1) AS module, {r.first_match('lower(path)', r.PATH_LAYERS)} AS layer, {r.hits('lower(path)', r.PATTERN_WORDS)} AS patterns FROM files",
    "d10_hunk_impact": lambda d: f"WITH {hunks(d)} SELECT path, hunk, {r.first_match('t', r.HUNK_IMPACT, 'LOW')} AS impact, CASE WHEN {r.has('t', 'delete|remove|transaction|lock|security|auth')} THEN 'HIGH' WHEN {r.has('t', 'exception|error')} THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM {blob(d)} b",
    "d11_key_changes": lambda d: f"WITH {hunks(d)} SELECT path, hunk, {r.hits('t', ['return', 'throw', 'break', 'continue', 'lock', 'unlock', 'timeout'])} AS keywords FROM {blob(d)} b",
    "d13_inferred_methods": lambda d: f"WITH {FILES} SELECT path, {r.first_match('path', [('Controller', 'handle,process,get,post,put,delete'), ('Service', 'process,execute,handle,create,update,delete'), ('Repository', 'save,find,delete,update,query'), ('Util', 'convert,validate,format,process')], 'main,process,execute')} AS methods FROM files",
    "d18_impact_score": lambda d: f"WITH {hunks(d)} SELECT path, hunk, {r.points('t', r.IMPACT_POINTS)} + CASE WHEN n > 50 THEN 30 WHEN n > 20 THEN 25 WHEN n > 5 THEN 20 ELSE 15 END AS score FROM {blob(d)} b",
    "d19_critical_logic": lambda d: f"WITH {hunks(d)}, {PAIRED} SELECT path, hunk, max(CASE WHEN ({words('x', 'auth|permission|validate|check|verify|secure|access|role')}) AND {words('x', 'if|return')} AND contains(y, 'true') AND NOT ({words('y', 'auth|permission|validate|check|verify|secure|access|role')}) THEN 90 WHEN {words('x', 'timeout|expire|deadline|duration|nanotime|currenttime')} AND {d.rx('x', '[><]|==')} AND {d.rx('y', 'true|false|1|0')} AND NOT ({words('y', 'timeout|expire|deadline|duration|nanotime|currenttime')}) THEN 95 WHEN {words('x', 'try|catch')} AND NOT ({words('y', 'try|catch')}) THEN 85 WHEN {words('x', 'validate|verify|check|ensure|assert|require')} AND contains(x, 'if') AND contains(y, 'return') THEN 80 ELSE 0 END) AS risk FROM met GROUP BY path, hunk",
    "d21_dangerous_text": lambda d: f"WITH {hunks(d)} SELECT path, hunk, {d.rx('t', 'select [*] from|delete from.*where|update.*set.*where')} AS sql_risk, {d.rx('t', '[.]keys *[(]|[.]flush(db|all) *[(]|[.]config *[(]')} AS cache_risk FROM {blob(d)} b",
    "d22_danger_severity": lambda d: f"WITH {hunks(d)} SELECT path, hunk, CASE WHEN contains(t, 'redis') AND contains(t, 'keys(') THEN 'CRITICAL' WHEN contains(t, 'redis') THEN 'HIGH' WHEN {words('t', 'sql|select|update')} THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM {blob(d)} b",
    "d23_static_issues": lambda d: f"WITH {hunks(d)} SELECT path, hunk, CAST(ix AS BIGINT) AS ix, 'MINOR' AS severity, 'CODE_STYLE' AS category FROM placed WHERE length(content) > 120 UNION ALL SELECT path, hunk, CAST(ix AS BIGINT), 'INFO', 'DOCUMENTATION' FROM placed WHERE contains(lower(content), 'todo') UNION ALL SELECT path, hunk, CAST(ix AS BIGINT), 'MAJOR', 'BUG_RISK' FROM placed WHERE contains(content, '!!') AND path LIKE '%.kt'",
    "a23_review_score": lambda d: f"WITH {hunks(d)}, i AS (SELECT path, CASE WHEN length(content) > 120 THEN 5 ELSE 0 END + CASE WHEN contains(lower(content), 'todo') THEN 1 ELSE 0 END + CASE WHEN contains(content, '!!') AND path LIKE '%.kt' THEN 10 ELSE 0 END AS p, CASE WHEN contains(content, '!!') AND path LIKE '%.kt' THEN 2 WHEN length(content) > 120 THEN 1 ELSE 0 END AS k FROM placed) SELECT path, CAST(greatest(100 - sum(p), 0) AS BIGINT) AS score, CASE max(k) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM i GROUP BY path",
    "r9_file_intent": lambda d: f"WITH {FILES} SELECT path, round(CAST(least(1.0, CASE change WHEN 'ADDED' THEN 0.8 WHEN 'MODIFIED' THEN 0.6 WHEN 'DELETED' THEN 0.4 ELSE 0 END + {r.first_match('lower(path)', [('controller', 0.3), ('service', 0.25), ('repository', 0.2), ('config', 0.15), ('util', 0.05)], 0.0)}) AS DOUBLE), 6) AS intent FROM files",
    "r10_file_risk": lambda d: f"WITH {FILES} SELECT path, round(CAST(least(1.0, {r.first_match('lower(path)', [('config', 0.8), ('security', 0.9), ('controller', 0.6), ('service', 0.5), ('repository', 0.7), ('entity', 0.6), ('util', 0.4), ('test', 0.1)], 0.3)} + CASE WHEN change = 'DELETED' THEN 0.4 ELSE 0 END) AS DOUBLE), 6) AS risk FROM files",
    "r11_dual_flow": lambda d: f"WITH {FILES}, s AS (SELECT path, change, least(1.0E0, CASE change WHEN 'ADDED' THEN 0.8E0 WHEN 'MODIFIED' THEN 0.6E0 ELSE 0.4E0 END) AS i, {r.first_match('lower(path)', [('config', 0.8), ('controller', 0.6), ('service', 0.5), ('util', 0.4)], 0.3)} AS k FROM files), c AS (SELECT *, CAST(0.4 * i + 0.6 * k AS DOUBLE) AS combined FROM s) SELECT path, round(combined, 6) AS combined, CASE WHEN round(combined, 6) >= 0.8 THEN 'HIGH' WHEN round(combined, 6) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, {r.first_match('lower(path)', [('security', 'security-expert'), ('config', 'devops-engineer'), ('controller', 'api-expert'), ('service', 'business-analyst'), ('repository', 'database-expert')], 'senior-developer')} AS reviewer, CAST(floor(round(CASE change WHEN 'ADDED' THEN 20 WHEN 'MODIFIED' THEN 15 ELSE 10 END * (1 + combined), 6)) AS BIGINT) AS minutes FROM c",
    "r6_git_risk": lambda d: f"WITH {FILES}, {hunks(d)}, added AS (SELECT path, max({r.points('lower(content)', r.ADDED_RISK)}) AS ops FROM placed WHERE kind = 'ADDED' GROUP BY path) SELECT f.path, least(100, least({r.first_match('lower(f.path)', r.FILE_RISK, 3)}, 30) + least(coalesce(a.ops, 0), 20) + CASE WHEN f.change = 'DELETED' THEN 5 ELSE 0 END + CASE WHEN {d.rx('lower(f.path)', 'config|[.](properties|yml|yaml)$')} THEN 5 ELSE 0 END) AS risk FROM files f LEFT JOIN added a ON a.path = f.path",
    "w2_segments": lambda d: f"WITH {hunks(d)} SELECT path, hunk, min(ix) AS first_ix, max(ix) AS last_ix, CAST(count(*) AS BIGINT) AS n_lines FROM placed GROUP BY path, hunk",
    "a13_cyclomatic": lambda d: f"WITH {hunks(d)}, {measured(d)} SELECT path, complexity, loc FROM measured",
    "c33_text_smells": lambda d: f"WITH {hunks(d)}, {measured(d)} SELECT path, 'LONG_METHOD' AS smell, loc AS n FROM measured WHERE loc > 50 UNION ALL SELECT path, 'HIGH_COMPLEXITY', complexity FROM measured WHERE complexity > 10",
}


def changes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A change query over the supplied tables."""
    text = CHANGES[name](Spark())
    held = {"diff_lines": diff_lines, "log_lines": log_lines, "status_lines": status_lines}
    return spark.sql(text, **{k: f(spark, sf_dir) for k, f in held.items() if "{" + k + "}" in text})


def parsed_diff(lines: DataFrame) -> DataFrame:
    """``path, hunk, ix, kind, content, line_no`` of any diff given as (path, ix, line)."""
    return lines.sparkSession.sql(CHANGES["s8_unified_diff"](Spark()), diff_lines=lines)

