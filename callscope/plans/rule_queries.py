"""Classification, inclusion and scoring of classes and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callscope.functions import rules as r
from callscope.plans.graph import CodeGraph
from callscope.plans.graph_queries import CALLS
from callscope.plans.texts import Spark, Text

LAYER = r.cascade(r.first_match("coalesce(c.annotation, '')", r.ANNOTATION_LAYERS, how="is"), r.first_match("lower(c.package)", r.PACKAGE_LAYERS), r.first_match("lower(c.name)", r.SUFFIX_LAYERS, how="ends"), r.first_match("lower(coalesce(p.name, i.name, ''))", r.SUPER_LAYERS))
DOMAIN = r.cascade(r.first_match("lower(c.package)", r.PACKAGE_DOMAINS), r.first_match("lower(c.name)", r.NAME_DOMAINS), r.first_match("coalesce(c.annotation, '')", r.ANNOTATION_DOMAINS), "CASE WHEN c.layer IN ('CONFIG', 'UTIL') THEN 'COMMON' ELSE 'UNKNOWN' END")
METHODS_OF = "(SELECT class_id, count(*) AS n, sum(CASE WHEN " + r.has("lower(m.name)", "get|post|put|delete", "starts") + " OR contains(lower(m.name), 'mapping') THEN 1 ELSE 0 END) AS web, sum(CASE WHEN " + r.has("lower(m.name)", "process|handle|execute|business") + " THEN 1 ELSE 0 END) AS work, sum(CASE WHEN " + r.has("lower(m.name)", "find|save|update|delete|insert|select", "starts") + " THEN 1 ELSE 0 END) AS data, sum(CASE WHEN contains(lower(m.name), 'mapper') THEN 1 ELSE 0 END) AS mapped, sum(CASE WHEN m.is_public AND m.is_static THEN 1 ELSE 0 END) AS statics FROM {methods} m GROUP BY class_id)"
BY_METHODS = "CASE WHEN web > 0 THEN 'CONTROLLER' WHEN work > 0 THEN 'SERVICE' WHEN data > 0 AND mapped > 0 THEN 'MAPPER' WHEN data > 0 THEN 'REPOSITORY' WHEN statics > 0.7 * n THEN 'UTIL' ELSE 'UNKNOWN' END"
RELATED = "{classes} c LEFT JOIN {classes} p ON c.super_id = p.id LEFT JOIN {classes} i ON c.interface_id = i.id"
OWNED = "{methods} m JOIN {classes} c ON m.class_id = c.id"
GETTER = "(m.name LIKE 'get%' OR m.name LIKE 'set%' OR m.name LIKE 'is%')"
OBJECT = "m.name IN ('toString', 'equals', 'hashCode', 'clone', 'finalize')"
ROOT = f"(c.layer = 'CONTROLLER' AND m.is_public AND NOT m.is_ctor AND (({r.has('c.annotation', 'Controller|RequestMapping')} AND {r.has('lower(m.name)', r.WEB_STARTS, 'starts')}) OR {r.has('lower(m.name)', r.ROOT_STARTS, 'starts')}))"
DATA_ACCESS = r.has("lower(m.name)", "find|get|save|update|delete|insert|select|query", "starts")
BUSINESS = r.has("lower(m.name)", "process|handle|execute|calculate|validate|generate")
KEEP_METHOD = f"(m.is_public AND NOT {OBJECT} AND (c.layer = 'CONTROLLER' OR NOT {GETTER}) AND CASE WHEN c.layer = 'CONTROLLER' THEN NOT {GETTER} WHEN c.layer IN ('SERVICE', 'UNKNOWN') THEN NOT m.is_ctor WHEN c.layer IN ('REPOSITORY', 'MAPPER') THEN {DATA_ACCESS} WHEN c.layer = 'UTIL' THEN m.is_static WHEN c.layer = 'ENTITY' THEN m.n_params > 1 ELSE TRUE END)"

DEGREES = "deg AS (SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM {edges} UNION ALL SELECT to_id, 0, 1 FROM {edges}) x GROUP BY id)"
CROSS_POINTS = "CASE WHEN coalesce(x.n, 0) >= 5 THEN 20 WHEN coalesce(x.n, 0) >= 3 THEN 15 WHEN coalesce(x.n, 0) >= 2 THEN 10 WHEN coalesce(x.n, 0) = 1 THEN 5 ELSE 0 END"
CLASS_POINTS = "CASE WHEN coalesce(x.n, 0) >= 5 THEN 25 WHEN coalesce(x.n, 0) >= 3 THEN 18 WHEN coalesce(x.n, 0) >= 2 THEN 12 WHEN coalesce(x.n, 0) = 1 THEN 6 ELSE 0 END"
NAME_WEIGHT = r.first_match("lower(m.name)", r.METHOD_NAME_WEIGHTS, 0.0).replace("ELSE 0.0 END", f"WHEN {r.has('lower(m.name)', 'is|has', 'starts')} THEN 0.3 ELSE 0.0 END")
# {crossed} and {class_crossed} hold the number of trees of each method and class, {tree_roots} the roots that have a tree
METHOD_TERMS = [
    r.lookup("c.layer", r.METHOD_LAYER_WEIGHTS, 0.5),
    CROSS_POINTS,
    f"0.5 * {r.lookup('c.domain', r.DOMAIN_PRIORITY, 1)}",
    "CASE WHEN m.is_public THEN 2 ELSE 0 END + CASE WHEN m.is_static THEN 1 ELSE 0 END + CASE WHEN m.is_abstract THEN 1.5 ELSE 0 END - CASE WHEN m.is_ctor THEN 1 ELSE 0 END",
    "0.5 * sqrt(CAST(coalesce(d.n_in, 0) + coalesce(d.n_out, 0) AS DOUBLE))",
    "CASE WHEN t.root IS NOT NULL THEN 15 ELSE 0 END",
    NAME_WEIGHT,
]
WEIGHTED = f"""{DEGREES}, weighted AS (
  SELECT m.id, m.class_id, CAST(greatest(0.0, {" + ".join(METHOD_TERMS)}) AS DOUBLE) AS weight, CAST(coalesce(x.n, 0) AS BIGINT) AS cross_count
  FROM {OWNED} LEFT JOIN deg d ON d.id = m.id LEFT JOIN {{crossed}} x ON x.id = m.id LEFT JOIN {{tree_roots}} t ON t.root = m.id)"""
# methods still weigh nothing when classes are weighed, so a class's seventh term is 0
CLASS_TERMS = [
    r.lookup("c.layer", r.CLASS_LAYER_WEIGHTS, 1.0),
    CLASS_POINTS,
    r.lookup("c.domain", r.DOMAIN_PRIORITY, 1),
    "CASE WHEN c.is_interface THEN 5 ELSE 0 END + CASE WHEN c.is_abstract THEN 3 ELSE 0 END",
    "2 * log10(CAST(coalesce(k.n, 0) + 1 AS DOUBLE))",
    "CASE WHEN c.super_id IS NOT NULL OR c.interface_id IS NOT NULL THEN 2 ELSE 0 END",
]
CLASS_WEIGHTED = f"""{WEIGHTED}, class_weighted AS (
  SELECT c.id, CAST({" + ".join(CLASS_TERMS)} AS DOUBLE) AS weight, CAST(coalesce(x.n, 0) AS BIGINT) AS cross_count
  FROM {{classes}} c LEFT JOIN {{class_crossed}} x ON x.id = c.id LEFT JOIN (SELECT class_id, count(*) AS n FROM {{methods}} GROUP BY class_id) k ON k.class_id = c.id)"""

# intent and risk, per call (a path of two methods)
INTENT = f"""ups AS (SELECT to_id AS id, count(DISTINCT from_id) AS callers, count(DISTINCT from_layer) AS layers, sum(CASE WHEN from_layer = 'CONTROLLER' THEN 15 WHEN from_layer = 'SERVICE' THEN 5 ELSE 2 END) AS points, count(*) AS n FROM calls GROUP BY to_id),
downs AS (SELECT from_id AS id, count(DISTINCT to_id) AS callees, count(*) AS n FROM calls GROUP BY from_id),
deps AS (SELECT from_class AS id, count(DISTINCT to_class) AS n FROM calls WHERE from_class <> to_class GROUP BY from_class),
intent AS (SELECT m.id, c.id AS class_id,
  CAST(least(100, least(8 * coalesce(u.callers, 0), 40) + least(coalesce(u.points, 0), 35) + least(5 * coalesce(u.layers, 0), 25)) AS DOUBLE) AS upstream,
  CAST(least(100, {r.lookup('c.layer', [('CONTROLLER', 25), ('SERVICE', 35), ('REPOSITORY', 20), ('UTIL', 10)], 15)} + least({r.points("lower(c.name || '.' || m.name)", r.INTENT_WORDS)}, 25) + least(3 * coalesce(p.n, 0), 20) + CASE WHEN c.interface_id IS NULL THEN 0 ELSE 8 END) AS DOUBLE) AS importance,
  0.3 * least(coalesce(u.n, 0), 50) + 0.2 * least(coalesce(w.n, 0), 50) + 0.5 * least(2 * (coalesce(u.callers, 0) + coalesce(w.callees, 0)), 30) AS frequency
  FROM {OWNED} LEFT JOIN ups u ON u.id = m.id LEFT JOIN downs w ON w.id = m.id LEFT JOIN deps p ON p.id = c.id)"""
#: The report's own cascade: exact annotations, words of the package and suffixes in their case, the superclass.
REPORT_LAYER = r.cascade(r.first_match("coalesce(c.annotation, '')", r.REPORT_ANNOTATIONS, how="is"), r.first_match("c.package", r.REPORT_PACKAGES), r.first_match("c.name", r.REPORT_SUFFIXES, how="ends"), r.first_match("coalesce(p.name, '')", [("Controller", "CONTROLLER"), ("Service", "SERVICE")]))

RULES: dict[str, Text] = {
    "p1_layer_cascade": lambda d: f"SELECT c.id, {r.cascade(LAYER, BY_METHODS)} AS layer FROM {RELATED} LEFT JOIN {METHODS_OF} k ON k.class_id = c.id",
    "p2_layer_by_annotation": lambda d: f"SELECT c.id, {r.first_match('c.annotation', r.ANNOTATION_LAYERS, how='is')} AS layer FROM {{classes}} c WHERE c.annotation IS NOT NULL",
    "p3_layer_by_package": lambda d: f"SELECT c.id, {r.first_match('lower(c.package)', r.PACKAGE_LAYERS)} AS layer FROM {{classes}} c",
    "p4_layer_by_suffix": lambda d: f"SELECT c.id, {r.first_match('lower(c.name)', r.SUFFIX_LAYERS, how='ends')} AS layer FROM {{classes}} c",
    "p5_layer_by_inheritance": lambda d: f"SELECT c.id, {r.first_match('lower(coalesce(p.name, i.name))', r.SUPER_LAYERS)} AS layer FROM {RELATED} WHERE p.id IS NOT NULL OR i.id IS NOT NULL",
    "p6_layer_by_methods": lambda d: f"SELECT class_id, CASE WHEN web > 0 THEN 'CONTROLLER' WHEN work > 0 THEN 'SERVICE' WHEN data > 0 AND mapped > 0 THEN 'MAPPER' WHEN data > 0 THEN 'REPOSITORY' WHEN statics > 0.7 * n THEN 'UTIL' ELSE 'UNKNOWN' END AS layer FROM (SELECT class_id, count(*) AS n, sum(CASE WHEN {r.has('lower(m.name)', 'get|post|put|delete', 'starts')} OR contains(lower(m.name), 'mapping') THEN 1 ELSE 0 END) AS web, sum(CASE WHEN {r.has('lower(m.name)', 'process|handle|execute|business')} THEN 1 ELSE 0 END) AS work, sum(CASE WHEN {r.has('lower(m.name)', 'find|save|update|delete|insert|select', 'starts')} THEN 1 ELSE 0 END) AS data, sum(CASE WHEN contains(lower(m.name), 'mapper') THEN 1 ELSE 0 END) AS mapped, sum(CASE WHEN m.is_public AND m.is_static THEN 1 ELSE 0 END) AS statics FROM {{methods}} m GROUP BY class_id) x",
    "p7_report_layer": lambda d: f"SELECT c.id, {REPORT_LAYER} AS layer FROM {{classes}} c LEFT JOIN {{classes}} p ON c.super_id = p.id",
    "p8_layer_by_name_only": lambda d: f"SELECT c.id, {r.first_match('lower(c.name)', r.NAME_ONLY_LAYERS)} AS layer FROM {{classes}} c",
    "p9_domain_cascade": lambda d: f"SELECT c.id, {DOMAIN} AS domain FROM {{classes}} c",
    "p10_domain_relatedness": lambda d: f"SELECT a.domain AS a, b.domain AS b, CAST({r.relatedness('a.domain', 'b.domain')} AS DOUBLE) AS related FROM (SELECT DISTINCT domain FROM {{classes}}) a JOIN (SELECT DISTINCT domain FROM {{classes}}) b ON a.domain <= b.domain",
    "p11_same_tree": lambda d: f"WITH {CALLS} SELECT from_id, to_id, CAST({r.relatedness('from_domain', 'to_domain')} AS DOUBLE) AS related FROM calls WHERE {r.relatedness('from_domain', 'to_domain')} >= 0.6",
    "p12_domain_priority": lambda d: f"SELECT c.id, {r.lookup('c.domain', r.DOMAIN_PRIORITY, 1)} AS priority FROM {{classes}} c",
    "p13_tree_domain": lambda d: f"SELECT m.id, CASE WHEN c.domain <> 'UNKNOWN' THEN c.domain ELSE {r.first_match('lower(m.name)', r.TREE_DOMAINS)} END AS domain FROM {OWNED}",
    "p15_method_inclusion": lambda d: f"SELECT m.id, {KEEP_METHOD} AS kept FROM {OWNED}",
    "p16_annotation_sets": lambda d: "SELECT c.id, coalesce(c.annotation IN ('Controller', 'RestController', 'ControllerAdvice'), FALSE) AS web, coalesce(c.annotation IN ('Service', 'Stateless', 'Stateful'), FALSE) AS service, coalesce(c.annotation IN ('Repository', 'Mapper'), FALSE) AS data, coalesce(c.annotation IN ('Configuration', 'SpringBootApplication'), FALSE) AS config FROM {classes} c",
    "p17_method_predicates": lambda d: f"SELECT m.id, {GETTER} AS getter, {OBJECT} AS of_object, {DATA_ACCESS} AS data_access, {BUSINESS} AS business FROM {{methods}} m",
    "p18_inclusion_rate": lambda d: f"SELECT c.layer, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN {KEEP_METHOD} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS rate FROM {OWNED} GROUP BY c.layer",
    "j17_orphan_methods": lambda d: f"SELECT m.id, m.name FROM {OWNED} WHERE NOT EXISTS (SELECT 1 FROM {{edges}} e WHERE e.from_id = m.id) AND NOT EXISTS (SELECT 1 FROM {{edges}} e WHERE e.to_id = m.id) AND NOT coalesce({ROOT}, FALSE)",
    "p19_root_methods": lambda d: f"SELECT m.id, m.name, c.name AS class_name FROM {OWNED} WHERE {ROOT}",
    "p21_tree_inclusion": lambda d: "SELECT m.id, (m.is_public AND NOT m.is_ctor AND NOT contains(lower(c.name), 'util') AND NOT contains(lower(c.name), 'helper') AND NOT (contains(lower(c.package), 'util') OR (contains(lower(c.package), 'common') AND c.layer = 'UTIL'))) AS kept FROM {methods} m JOIN {classes} c ON m.class_id = c.id",
    "p22_call_type": lambda d: f"WITH {CALLS} SELECT k.edge_ord, CASE WHEN t.is_static THEN 'STATIC' WHEN tc.is_interface THEN 'INTERFACE' WHEN fc.super_id = tc.id THEN 'INHERITANCE' WHEN t.is_ctor THEN 'DIRECT' WHEN contains(lower(t.name), 'invoke') THEN 'REFLECTION' WHEN contains(lower(t.name), 'async') THEN 'ASYNC' ELSE 'DIRECT' END AS kind FROM calls k JOIN {{methods}} t ON t.id = k.to_id JOIN {{classes}} tc ON tc.id = k.to_class JOIN {{classes}} fc ON fc.id = k.from_class",
    "p23_confidence": lambda d: f"SELECT e.edge_ord, e.call_type, CAST({r.lookup('e.call_type', r.CONFIDENCE, 0.8)} AS DOUBLE) AS confidence FROM {{edges}} e",
    "p24_visibility": lambda d: "SELECT m.id, CASE WHEN m.is_public THEN 'public' ELSE 'private' END AS visibility, (m.is_public AND NOT m.is_ctor AND NOT m.is_static) AS business FROM {methods} m",
    "p25_lookup_by_layer_and_domain": lambda d: "SELECT id, name, layer, domain FROM {classes} WHERE layer = 'SERVICE' OR domain = 'ORDER'",
    "p26_file_predicates": lambda d: f"SELECT c.id, {d.rx('c.file_path', '[.](java|kt|scala|xml|properties|yml|yaml)$')} AS relevant, {d.rx('c.file_path', '[.](java|kt)$')} AS source, {d.rx('lower(c.file_path)', 'test|spec')} AS test FROM {{classes}} c",
    "p27_cross_layer_tiers": lambda d: f"WITH {CALLS} SELECT DISTINCT from_layer, to_layer, CASE WHEN from_layer = 'CONTROLLER' AND to_layer = 'SERVICE' THEN 'NORMAL' WHEN from_layer = 'SERVICE' AND to_layer IN ('REPOSITORY', 'MAPPER') THEN 'NORMAL' WHEN from_layer = 'CONTROLLER' AND to_layer IN ('REPOSITORY', 'MAPPER') THEN 'SKIPS_SERVICE' WHEN to_layer = 'UTIL' THEN 'HELPER' WHEN to_layer = 'CONTROLLER' THEN 'REVERSED' ELSE 'OTHER' END AS tier FROM calls WHERE from_layer <> to_layer",
    "p28_call_filter": lambda d: f"WITH {CALLS} SELECT edge_ord, ((to_name LIKE 'get%' AND length(to_name) <= 15 AND NOT contains(to_name, 'All') AND NOT contains(to_name, 'By')) OR (to_name LIKE 'set%' AND length(to_name) <= 15) OR (to_name LIKE 'is%' AND length(to_name) <= 10) OR {r.has('lower(to_class_name)', 'log|logger|request|response|dto|vo|model|entity|bean')}) AS excluded, {r.has('lower(to_name)', '|'.join(r.DANGEROUS_METHODS))} AS dangerous FROM calls",
    "p29_package_filter": lambda d: "SELECT c.package, CAST(count(*) AS BIGINT) AS n FROM {classes} c WHERE c.package LIKE 'com.%' GROUP BY c.package",
    "g4_core_path_weight": lambda d: f"WITH {CALLS} SELECT edge_ord, CAST({r.lookup('from_layer', r.PATH_LAYER_WEIGHTS, 1.0)} + 0.1 * {r.lookup('from_domain', r.DOMAIN_PRIORITY, 1)} + {r.lookup('to_layer', r.PATH_LAYER_WEIGHTS, 1.0)} + 0.1 * {r.lookup('to_domain', r.DOMAIN_PRIORITY, 1)} AS DOUBLE) AS weight, CASE WHEN from_layer = to_layer THEN 0 ELSE 1 END AS layer_cross FROM calls",
    "r3_method_name_weight": lambda d: f"SELECT m.id, CAST({NAME_WEIGHT} AS DOUBLE) AS weight FROM {{methods}} m",
    "r5_intent_weight": lambda d: f"WITH {CALLS}, {INTENT} SELECT id, round(least(100, 0.40 * upstream + 0.35 * importance + 0.25 * least(frequency, 100)), 6) AS intent FROM intent",
}

#: Scores over built trees.
WEIGHTS: dict[str, Text] = {
    "r1_method_weight": lambda d: f"WITH {WEIGHTED} SELECT id, class_id, round(weight, 6) AS weight, cross_count FROM weighted",
    "r2_class_weight": lambda d: f"WITH {CLASS_WEIGHTED} SELECT id, round(weight, 6) AS weight, cross_count FROM class_weighted",
    "a2_weight_summary": lambda d: f"""WITH {CLASS_WEIGHTED}, every AS (SELECT 'method' AS kind, weight, cross_count FROM weighted UNION ALL SELECT 'class', weight, cross_count FROM class_weighted)
        SELECT kind, CAST(sum(CASE WHEN cross_count > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_crossed, max(cross_count) AS max_cross, round(avg(weight), 6) AS avg_weight FROM every GROUP BY kind""",
    "a3_weight_statistics": lambda d: f"""WITH {CLASS_WEIGHTED}, every AS (
          SELECT 'method weight' AS kind, weight AS v FROM weighted UNION ALL SELECT 'class weight', weight FROM class_weighted
          UNION ALL SELECT 'method cross', CAST(cross_count AS DOUBLE) FROM weighted UNION ALL SELECT 'class cross', CAST(cross_count AS DOUBLE) FROM class_weighted)
        SELECT kind, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, round(median(v), 6) AS mid FROM every GROUP BY kind""",
    "t3_heaviest_methods": lambda d: f"""WITH {WEIGHTED}, top AS (SELECT id, round(weight, 6) AS weight, cross_count FROM weighted)
        SELECT 'weight' AS by, id, weight AS v FROM (SELECT * FROM top ORDER BY weight DESC, id LIMIT 10) x UNION ALL SELECT 'cross', id, CAST(cross_count AS DOUBLE) FROM (SELECT * FROM top ORDER BY cross_count DESC, id LIMIT 10) y""",
}


def classify(graph: CodeGraph, name: str) -> DataFrame:
    """The rows of a rule or score over any code graph."""
    return graph.sql(RULES[name](Spark()))
