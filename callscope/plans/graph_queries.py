"""Canned questions to a code graph: callers, callees, architecture, reach, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callscope.functions.durable import cut
from callscope.plans.graph import CodeGraph
from callscope.plans.texts import Spark, Text

#: Allowed next layers in a chain; a layer that isn't listed allows none, and UNKNOWN never violates.
ALLOWED = [("CONTROLLER", "SERVICE"), ("CONTROLLER", "UTIL"), ("SERVICE", "REPOSITORY"), ("SERVICE", "UTIL"), ("SERVICE", "MODEL"), ("REPOSITORY", "UTIL"), ("REPOSITORY", "MODEL"), ("UTIL", "MODEL"), ("FILTER", "CONTROLLER"), ("FILTER", "SERVICE"), ("FILTER", "UTIL")]
LAYER_ORDER = [("CONTROLLER", 0), ("SERVICE", 1), ("MAPPER", 2), ("REPOSITORY", 3), ("UTIL", 4), ("ENTITY", 5), ("CONFIG", 6), ("COMPONENT", 7), ("UNKNOWN", 8)]

# Calls with the methods and classes at both ends; calls to or from unknown methods drop out.
CALLS = """calls AS (
  SELECT e.from_id, e.to_id, e.call_type, e.line, e.edge_ord, f.name AS from_name, f.class_id AS from_class, t.name AS to_name, t.class_id AS to_class,
         fc.name AS from_class_name, fc.layer AS from_layer, fc.domain AS from_domain, tc.name AS to_class_name, tc.layer AS to_layer, tc.domain AS to_domain
  FROM {edges} e JOIN {methods} f ON e.from_id = f.id JOIN {methods} t ON e.to_id = t.id
  JOIN {classes} fc ON f.class_id = fc.id JOIN {classes} tc ON t.class_id = tc.id)"""


def layer_values() -> str:
    return "(VALUES " + ", ".join(f"('{n}', {o})" for n, o in LAYER_ORDER) + ") AS v(layer, ord)"


def allowed_values() -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED) + ") AS a(src, dst)"


def hops(callers: bool, callees: bool) -> str:
    """Typed one- and two-hop calls around every class, between classes."""
    down = """SELECT DISTINCT from_class AS center, 'callee' AS role, from_class_name AS src, to_class_name AS dst, 1 AS hop FROM calls
  UNION SELECT DISTINCT a.from_class, 'callee', b.from_class_name, b.to_class_name, 2 FROM links a JOIN links b ON a.to_class = b.from_class"""
    up = """SELECT DISTINCT to_class AS center, 'caller' AS role, from_class_name AS src, to_class_name AS dst, 1 AS hop FROM calls
  UNION SELECT DISTINCT a.to_class, 'caller', b.from_class_name, b.to_class_name, 2 FROM links a JOIN links b ON a.from_class = b.to_class"""
    return "\n  UNION ".join([down] * callees + [up] * callers)


# distinct calls between classes, before they are joined with themselves
LINKS = f"{CALLS}, links AS (SELECT DISTINCT from_class, from_class_name, to_class, to_class_name FROM calls)"


GRAPH: dict[str, Text] = {
    # joins
    "j1_contains": lambda d: "SELECT c.id AS class_id, c.name AS class_name, m.id AS method_id, m.name AS method_name FROM {methods} m JOIN {classes} c ON m.class_id = c.id",
    "j2_valid_calls": lambda d: f"WITH {CALLS} SELECT from_id, to_id, call_type, line, from_class, to_class FROM calls",
    "j3_extends": lambda d: "SELECT c.id AS child_id, c.name AS child, p.id AS parent_id, p.name AS parent FROM {classes} c JOIN {classes} p ON c.super_id = p.id AND p.qualified_name <> 'java.lang.Object'",
    "j4_implements": lambda d: "SELECT c.id AS impl_id, c.name AS impl, i.id AS interface_id, i.name AS interface_name FROM {classes} c JOIN {classes} i ON c.interface_id = i.id AND i.is_interface",
    "j5_interface_implementations": lambda d: f"SELECT i.name AS interface_name, CAST(count(*) AS BIGINT) AS n_impl, {d.set('c.name')} AS impls FROM {{classes}} c JOIN {{classes}} i ON c.interface_id = i.id WHERE i.is_interface AND NOT c.is_interface GROUP BY i.name",
    "j6_method_implementations": lambda d: """SELECT im.id AS interface_method, m.id AS impl_method, i.id AS interface_class, c.id AS impl_class, md5(CAST(im.id AS STRING) || '->' || CAST(m.id AS STRING)) AS mapping_md5
        FROM {classes} c JOIN {classes} i ON c.interface_id = i.id AND i.is_interface AND NOT c.is_interface
        JOIN {methods} im ON im.class_id = i.id JOIN {methods} m ON m.class_id = c.id AND m.name = im.name AND m.n_params = im.n_params
        WHERE m.is_public AND NOT m.is_static AND NOT im.is_static""",
    "j8_mapping_validation": lambda d: """SELECT c.id AS class_id, CASE WHEN c.interface_id IS NULL THEN 'NO_INTERFACE' WHEN i.id IS NULL THEN 'MISSING_INTERFACE' WHEN NOT i.is_interface THEN 'NOT_AN_INTERFACE' ELSE 'VALID' END AS verdict
        FROM {classes} c LEFT JOIN {classes} i ON c.interface_id = i.id""",
    "j9_cross_layer_calls": lambda d: f"WITH {CALLS} SELECT from_id, to_id, from_layer, to_layer FROM calls WHERE from_layer <> to_layer",
    "j10_optional_call_stats": lambda d: """SELECT m.id, m.name, CAST(coalesce(o.n, 0) AS BIGINT) AS n_out, CAST(coalesce(i.n, 0) AS BIGINT) AS n_in
        FROM {methods} m LEFT JOIN (SELECT from_id, count(DISTINCT to_id) AS n FROM {edges} GROUP BY from_id) o ON o.from_id = m.id
        LEFT JOIN (SELECT to_id, count(DISTINCT from_id) AS n FROM {edges} GROUP BY to_id) i ON i.to_id = m.id""",
    "j11_foreign_dependencies": lambda d: f"WITH {CALLS} SELECT c.id, c.name, CAST(count(DISTINCT k.to_class) AS BIGINT) AS n_dependencies FROM {{classes}} c LEFT JOIN calls k ON k.from_class = c.id AND k.to_class <> c.id GROUP BY c.id, c.name",
    "j12_by_simple_or_qualified_name": lambda d: "SELECT id, name, qualified_name FROM {classes} WHERE name = 'User0Controller' OR qualified_name LIKE '%.order.%' OR contains(qualified_name, 'Payment')",
    "j13_tests_of_classes": lambda d: """SELECT t.name AS test_name, b.name AS business_name FROM (SELECT name, lower(replace(name, 'Util', '')) AS stem FROM {classes} WHERE layer = 'UTIL') t
        JOIN {classes} b ON b.layer <> 'UTIL' AND (contains(lower(b.name), t.stem) OR contains(t.stem, lower(b.name)))""",
    "j15_methods_with_calls": lambda d: "SELECT m.id, m.name FROM {methods} m LEFT SEMI JOIN {edges} e ON m.id = e.from_id" if d.name == "spark" else "SELECT m.id, m.name FROM methods m WHERE EXISTS (SELECT 1 FROM edges e WHERE m.id = e.from_id)",
    "j18_dangling_references": lambda d: "SELECT 'super' AS kind, c.id FROM {classes} c LEFT JOIN {classes} p ON c.super_id = p.id WHERE c.super_id IS NOT NULL AND p.id IS NULL UNION ALL SELECT 'class', m.id FROM {methods} m LEFT JOIN {classes} c ON m.class_id = c.id WHERE c.id IS NULL UNION ALL SELECT 'edge', e.edge_ord FROM {edges} e LEFT JOIN {methods} m ON e.to_id = m.id WHERE m.id IS NULL",
    "j20_consecutive_pairs": lambda d: f"WITH {CALLS} SELECT from_id, line, to_id, next_id FROM (SELECT from_id, line, to_id, lead(to_id) OVER (PARTITION BY from_id ORDER BY line, edge_ord) AS next_id FROM calls) x WHERE next_id IS NOT NULL",
    # aggregations
    "a1_graph_totals": lambda d: """SELECT 'classes' AS what, CAST(count(*) AS BIGINT) AS n FROM {classes} UNION ALL SELECT 'methods', CAST(count(*) AS BIGINT) FROM {methods} UNION ALL SELECT 'edges', CAST(count(*) AS BIGINT) FROM {edges}
        UNION ALL SELECT 'interfaces', CAST(count(*) AS BIGINT) FROM {classes} WHERE is_interface UNION ALL SELECT 'extends', CAST(count(*) AS BIGINT) FROM {classes} WHERE super_id IS NOT NULL""",
    "a1_layer_distribution": lambda d: f"SELECT v.layer, CAST(count(c.id) AS BIGINT) AS n FROM {layer_values()} LEFT JOIN {{classes}} c ON c.layer = v.layer GROUP BY v.layer",
    "a1_call_type_distribution": lambda d: "SELECT call_type, CAST(count(*) AS BIGINT) AS n FROM {edges} GROUP BY call_type",
    "a1_domain_distribution": lambda d: "SELECT domain, CAST(count(*) AS BIGINT) AS n, round(avg(n_methods), 6) AS avg_methods FROM (SELECT c.id, c.domain, count(m.id) AS n_methods FROM {classes} c LEFT JOIN {methods} m ON m.class_id = c.id GROUP BY c.id, c.domain) x GROUP BY domain",
    "a7_degrees": lambda d: "SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM {edges} UNION ALL SELECT to_id, 0, 1 FROM {edges}) x GROUP BY id",
    "a8_callers_by_class": lambda d: f"WITH {CALLS} SELECT to_class, from_class_name, from_layer, from_name, CAST(count(*) AS BIGINT) AS n FROM calls GROUP BY to_class, from_class_name, from_layer, from_name",
    "a9_caller_layers": lambda d: f"WITH {CALLS} SELECT to_class, from_layer, CAST(count(*) AS BIGINT) AS n_callers FROM (SELECT DISTINCT to_class, from_class_name, from_layer, from_name FROM calls) x GROUP BY to_class, from_layer",
    "a10_distinct_neighbours": lambda d: f"WITH {CALLS} SELECT from_class, CAST(count(DISTINCT to_class) AS BIGINT) AS n, {d.set('to_class_name')} AS names FROM calls GROUP BY from_class",
    "a11_first_neighbours": lambda d: f"WITH {CALLS} SELECT from_class, {d.top('to_layer', 3)} AS layers, {d.top('to_class_name', 5)} AS names FROM calls GROUP BY from_class",
    # in Spark each side is counted before they are joined; they are independent within a class
    "a12_up_and_down_layers": lambda d: f"WITH {CALLS}, u AS (SELECT to_class, from_layer, count(DISTINCT from_class) AS n FROM calls GROUP BY to_class, from_layer), w AS (SELECT from_class, to_layer, count(DISTINCT to_class) AS n FROM calls GROUP BY from_class, to_layer) SELECT u.to_class AS center, u.from_layer AS up_layer, w.to_layer AS down_layer, u.n AS n_up, w.n AS n_down FROM u JOIN w ON u.to_class = w.from_class" if d.name == "spark" else f"WITH {CALLS} SELECT u.to_class AS center, u.from_layer AS up_layer, w.to_layer AS down_layer, CAST(count(DISTINCT u.from_class) AS BIGINT) AS n_up, CAST(count(DISTINCT w.to_class) AS BIGINT) AS n_down FROM (SELECT DISTINCT to_class, from_class, from_layer FROM calls) u JOIN (SELECT DISTINCT from_class, to_class, to_layer FROM calls) w ON u.to_class = w.from_class GROUP BY u.to_class, u.from_layer, w.to_layer",
    "a14_project_stats": lambda d: "SELECT return_type, CAST(count(*) AS BIGINT) AS n, round(avg(n_params), 6) AS avg_params, max(n_params) AS max_params, CAST(sum(n_params) AS BIGINT) AS sum_params FROM {methods} GROUP BY return_type",
    "a20_cross_layer_histogram": lambda d: f"WITH {CALLS} SELECT from_layer || ' -> ' || to_layer AS direction, CAST(count(*) AS BIGINT) AS n FROM calls WHERE from_layer <> to_layer GROUP BY from_layer, to_layer",
    "a26_graph_stats": lambda d: """SELECT CAST(count(*) AS BIGINT) AS n_nodes, round(avg(o), 6) AS avg_out, CAST(max(o) AS BIGINT) AS max_out, round(avg(i), 6) AS avg_in, CAST(max(i) AS BIGINT) AS max_in
        FROM (SELECT m.id, count(DISTINCT e.edge_ord) AS o, max(coalesce(k.i, 0)) AS i FROM {methods} m LEFT JOIN {edges} e ON e.from_id = m.id LEFT JOIN (SELECT to_id, count(*) AS i FROM {edges} GROUP BY to_id) k ON k.to_id = m.id GROUP BY m.id) x""",
    # top-k and sets
    "t1_largest_classes": lambda d: "SELECT c.id, c.name, CAST(count(*) AS BIGINT) AS n_methods FROM {classes} c JOIN {methods} m ON m.class_id = c.id GROUP BY c.id, c.name ORDER BY n_methods DESC, c.id LIMIT 10",
    "t2_most_called": lambda d: "SELECT m.id, m.name, CAST(count(*) AS BIGINT) AS in_degree FROM {methods} m JOIN {edges} e ON e.to_id = m.id GROUP BY m.id, m.name ORDER BY in_degree DESC, m.id LIMIT 10",
    "t9_multi_key_order": lambda d: f"WITH {CALLS} SELECT from_layer, to_layer, from_class_name, CAST(count(*) AS BIGINT) AS n FROM calls GROUP BY from_layer, to_layer, from_class_name ORDER BY n DESC, from_layer, to_layer, from_class_name LIMIT 60",
    "u1_direct_or_two_hop": lambda d: f"WITH {CALLS} SELECT from_id AS src, to_id AS dst FROM calls UNION SELECT a.from_id, b.to_id FROM (SELECT DISTINCT from_id, to_id FROM calls) a JOIN (SELECT DISTINCT from_id, to_id FROM calls) b ON a.to_id = b.from_id",
    "u2_stats_union": lambda d: "SELECT 'layer' AS dimension, layer AS k, CAST(count(*) AS BIGINT) AS n FROM {classes} GROUP BY layer UNION ALL SELECT 'domain', domain, CAST(count(*) AS BIGINT) FROM {classes} GROUP BY domain UNION ALL SELECT 'call', call_type, CAST(count(*) AS BIGINT) FROM {edges} GROUP BY call_type",
    "u5_distinct_calls": lambda d: "SELECT DISTINCT from_id, to_id FROM {edges}",
    # canned questions
    "c1_class_info": lambda d: "SELECT c.id, c.name, c.qualified_name, c.layer, c.domain, c.is_interface, c.is_abstract, CAST(count(m.id) AS BIGINT) AS n_methods FROM {classes} c LEFT JOIN {methods} m ON m.class_id = c.id GROUP BY ALL",
    "c2_class_methods": lambda d: "SELECT class_id, id, name, n_params, return_type, CASE WHEN is_public THEN 'public' ELSE 'private' END AS visibility FROM {methods}",
    "c3_method_calls": lambda d: f"WITH {CALLS} SELECT from_id, to_class_name, to_name, CAST(count(*) AS BIGINT) AS call_count FROM calls GROUP BY from_id, to_class_name, to_name",
    "c4_method_callers": lambda d: f"WITH {CALLS} SELECT to_id, from_class_name, from_name, CAST(count(*) AS BIGINT) AS call_count FROM calls GROUP BY to_id, from_class_name, from_name",
    "c6_implementations": lambda d: f"SELECT i.name AS interface_name, c.name AS class_name, CAST(count(m.id) AS BIGINT) AS n_methods, {d.set('m.name')} AS method_names FROM {{classes}} i JOIN {{classes}} c ON c.interface_id = i.id LEFT JOIN {{methods}} m ON m.class_id = c.id WHERE i.is_interface GROUP BY i.name, c.name",
    "c7_architecture_analysis": lambda d: f"WITH {CALLS} SELECT c.id, c.name, coalesce(u.n, 0) AS n_up, coalesce(w.n, 0) AS n_down, coalesce(u.names, '') AS up_names, coalesce(w.names, '') AS down_names FROM {{classes}} c LEFT JOIN (SELECT to_class, CAST(count(DISTINCT from_class) AS BIGINT) AS n, {d.top('from_class_name', 5)} AS names FROM calls WHERE from_class <> to_class GROUP BY to_class) u ON u.to_class = c.id LEFT JOIN (SELECT from_class, CAST(count(DISTINCT to_class) AS BIGINT) AS n, {d.top('to_class_name', 5)} AS names FROM calls WHERE from_class <> to_class GROUP BY from_class) w ON w.from_class = c.id",
    "c8_hot_methods": lambda d: f"WITH {CALLS} SELECT to_class_name, to_id, to_name, CAST(count(*) AS BIGINT) AS call_count FROM calls GROUP BY to_class_name, to_id, to_name HAVING count(*) > 1 ORDER BY call_count DESC, to_id LIMIT 20",
    "c9_class_call_stats": lambda d: f"WITH {CALLS} SELECT c.id, c.name, coalesce(o.n_methods, 0) AS n_calling, coalesce(o.n_classes, 0) AS n_called_classes, coalesce(i.n_methods, 0) AS n_called, coalesce(i.n_classes, 0) AS n_calling_classes, coalesce(o.layers, '') AS down_layers, coalesce(i.layers, '') AS up_layers FROM {{classes}} c LEFT JOIN (SELECT from_class, CAST(count(DISTINCT from_id) AS BIGINT) AS n_methods, CAST(count(DISTINCT to_class) AS BIGINT) AS n_classes, {d.top('to_layer', 3)} AS layers FROM calls GROUP BY from_class) o ON o.from_class = c.id LEFT JOIN (SELECT to_class, CAST(count(DISTINCT to_id) AS BIGINT) AS n_methods, CAST(count(DISTINCT from_class) AS BIGINT) AS n_classes, {d.top('from_layer', 3)} AS layers FROM calls GROUP BY to_class) i ON i.to_class = c.id",
    "c10_architecture_stats": lambda d: f"WITH {CALLS} SELECT from_layer, to_layer, CAST(count(DISTINCT from_class) AS BIGINT) AS n_from, CAST(count(DISTINCT to_class) AS BIGINT) AS n_to, CAST(count(*) AS BIGINT) AS n_calls FROM calls GROUP BY from_layer, to_layer",
    "c11_method_info": lambda d: "SELECT m.id, m.name, c.name AS class_name, c.layer, m.n_params, m.return_type, m.is_static, m.is_abstract, m.is_ctor FROM {methods} m JOIN {classes} c ON m.class_id = c.id",
    "c12_method_call_stats": lambda d: f"WITH {CALLS}, o AS (SELECT from_id AS id, CAST(count(DISTINCT to_class) AS BIGINT) AS n FROM calls GROUP BY from_id), i AS (SELECT to_id AS id, CAST(count(DISTINCT from_class) AS BIGINT) AS n FROM calls GROUP BY to_id) SELECT m.id, coalesce(o.n, 0) AS n_called_classes, coalesce(i.n, 0) AS n_calling_classes FROM {{methods}} m LEFT JOIN o ON o.id = m.id LEFT JOIN i ON i.id = m.id",
    "c13_class_call_graph": lambda d: f"WITH {CALLS} SELECT from_class_name AS src, 'CALLS' AS rel, to_class_name AS dst, CAST(count(*) AS BIGINT) AS n FROM calls WHERE from_class <> to_class GROUP BY from_class_name, to_class_name",
    "c14_implementation_graph": lambda d: "SELECT 'implements' AS role, c.name AS src, i.name AS dst FROM {classes} c JOIN {classes} i ON c.interface_id = i.id WHERE i.is_interface UNION SELECT 'contains', i.name, m.name FROM {classes} i JOIN {methods} m ON m.class_id = i.id WHERE i.is_interface",
    "c16_dependency_graph": lambda d: f"WITH {LINKS} {hops(True, True)}",
    "c17_layer_graph": lambda d: f"WITH {CALLS} SELECT DISTINCT from_class_name AS src, to_class_name AS dst, CASE WHEN a.ord = b.ord THEN 'same' WHEN a.ord < b.ord THEN 'lower' ELSE 'upper' END AS relation FROM calls JOIN {layer_values().replace('v(layer, ord)', 'a(layer, ord)')} ON a.layer = from_layer JOIN {layer_values().replace('v(layer, ord)', 'b(layer, ord)')} ON b.layer = to_layer WHERE from_class <> to_class",
    "c18_call_graph_two_levels": lambda d: f"WITH {LINKS} {hops(False, True)}",
    "c19_caller_graph_two_levels": lambda d: f"WITH {LINKS} {hops(True, False)}",
    "c20_bidirectional": lambda d: f"WITH {LINKS} SELECT center, role, src, dst, hop FROM ({hops(True, True)}) x WHERE src <> dst",
    "c21_method_context": lambda d: f"WITH {CALLS} SELECT 'sibling' AS role, a.id AS method_id, b.name AS other FROM {{methods}} a JOIN {{methods}} b ON a.class_id = b.class_id AND a.id <> b.id UNION SELECT 'callee', from_id, to_name FROM calls WHERE to_class <> from_class UNION SELECT 'caller', to_id, from_name FROM calls WHERE to_class <> from_class",
    "c22_method_callers": lambda d: f"WITH {CALLS} SELECT to_id AS method_id, from_class_name AS caller_class, from_layer AS caller_layer, from_name AS caller_method, CAST(count(*) AS BIGINT) AS call_count FROM calls GROUP BY to_id, from_class_name, from_layer, from_name ORDER BY call_count DESC, method_id",
    "c23_method_callees": lambda d: f"WITH {CALLS} SELECT from_id AS method_id, to_class_name AS callee_class, to_layer AS callee_layer, to_name AS callee_method, CAST(count(*) AS BIGINT) AS call_count FROM calls GROUP BY from_id, to_class_name, to_layer, to_name",
    "c24_class_architecture": lambda d: f"WITH {CALLS}, deps AS (SELECT from_class, {d.set('to_class_name')} AS names, CAST(count(DISTINCT to_class) AS BIGINT) AS n, {d.set('to_layer')} AS layers FROM calls WHERE from_class <> to_class GROUP BY from_class), kids AS (SELECT super_id, {d.set('name')} AS names, CAST(count(*) AS BIGINT) AS n FROM {{classes}} WHERE super_id IS NOT NULL GROUP BY super_id), impls AS (SELECT interface_id, CAST(count(*) AS BIGINT) AS n FROM {{classes}} WHERE interface_id IS NOT NULL GROUP BY interface_id) SELECT c.id, c.name, p.name AS parent, i.name AS interface_name, coalesce(k.n, 0) AS n_children, coalesce(k.names, '') AS children, coalesce(x.n, 0) AS n_impls, coalesce(q.n, 0) AS n_dependencies, coalesce(q.layers, '') AS layers FROM {{classes}} c LEFT JOIN {{classes}} p ON c.super_id = p.id LEFT JOIN {{classes}} i ON c.interface_id = i.id AND i.is_interface LEFT JOIN kids k ON k.super_id = c.id LEFT JOIN impls x ON x.interface_id = c.id LEFT JOIN deps q ON q.from_class = c.id",
    "c26_blast_radius": lambda d: f"WITH {CALLS}, near AS (SELECT to_id AS m, from_id AS o, from_class AS c, from_layer AS l FROM calls), far AS (SELECT a.m, b.from_id AS o, b.from_class AS c, b.from_layer AS l FROM near a JOIN calls b ON b.to_id = a.o), down AS (SELECT from_id AS m, to_class AS c, to_layer AS l FROM calls), down2 AS (SELECT a.from_id AS m, b.to_class AS c, b.to_layer AS l FROM calls a JOIN calls b ON b.from_id = a.to_id), every AS (SELECT m, c, l, 1 AS k FROM near UNION ALL SELECT m, c, l, 2 FROM far UNION ALL SELECT m, c, l, 3 FROM down UNION ALL SELECT m, c, l, 4 FROM down2) SELECT m AS method_id, CAST(count(DISTINCT CASE WHEN k = 1 THEN c END) AS BIGINT) AS direct_callers, CAST(count(DISTINCT CASE WHEN k = 2 THEN c END) AS BIGINT) AS indirect_callers, CAST(count(DISTINCT CASE WHEN k = 3 THEN c END) AS BIGINT) AS direct_callees, CAST(count(DISTINCT CASE WHEN k = 4 THEN c END) AS BIGINT) AS indirect_callees, {d.set('l')} AS layers FROM every GROUP BY m",
    "c28_layer_samples": lambda d: f"SELECT layer, CAST(count(*) AS BIGINT) AS n, {d.top('name', 3)} AS samples FROM {{classes}} GROUP BY layer",
    "c29_import_counts": lambda d: "SELECT CAST((SELECT count(*) FROM {classes}) AS BIGINT) AS n_classes, CAST((SELECT count(*) FROM {methods}) AS BIGINT) AS n_methods, CAST((SELECT count(*) FROM {methods} m JOIN {classes} c ON m.class_id = c.id) AS BIGINT) AS n_contains, CAST((SELECT count(*) FROM {edges}) AS BIGINT) AS n_calls, CAST((SELECT count(*) FROM {classes} WHERE super_id IS NOT NULL) AS BIGINT) AS n_extends, CAST((SELECT count(*) FROM {classes} WHERE interface_id IS NOT NULL) AS BIGINT) AS n_implements",
    "c30_stats_pack": lambda d: f"WITH {CALLS} SELECT 'layer' AS kind, layer AS k, CAST(count(*) AS BIGINT) AS n FROM {{classes}} GROUP BY layer UNION ALL SELECT 'call', call_type, CAST(count(*) AS BIGINT) FROM {{edges}} GROUP BY call_type UNION ALL SELECT 'cross', from_layer || '>' || to_layer, CAST(count(*) AS BIGINT) FROM calls WHERE from_layer <> to_layer GROUP BY from_layer, to_layer",
    "c31_class_dependencies": lambda d: f"WITH {CALLS} SELECT from_class_name, to_class_name, CAST(count(*) AS BIGINT) AS n FROM calls GROUP BY from_class_name, to_class_name",
    "c33_code_smells": lambda d: "SELECT c.id, c.name, 'LARGE_CLASS' AS smell, CAST(count(*) AS BIGINT) AS n FROM {classes} c JOIN {methods} m ON m.class_id = c.id GROUP BY c.id, c.name HAVING count(*) > 20",
    # bounded reach
    "g9_inheritance": lambda d: "WITH p AS (SELECT id, super_id AS anc FROM {classes} WHERE super_id IS NOT NULL), q AS (SELECT id, anc, 1 AS hop FROM p UNION ALL SELECT a.id, b.anc, 2 FROM p a JOIN p b ON a.anc = b.id UNION ALL SELECT a.id, c.anc, 3 FROM p a JOIN p b ON a.anc = b.id JOIN p c ON b.anc = c.id) SELECT q.id, q.anc AS ancestor_id, q.hop, x.name AS ancestor FROM q JOIN {classes} x ON x.id = q.anc",
    "g10_caller_chains": lambda d: f"WITH {CALLS}, one AS (SELECT m, a FROM (SELECT to_id AS m, from_id AS a, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS rn FROM (SELECT DISTINCT to_id, from_id FROM calls) x) y WHERE rn <= 3) SELECT o.m, o.a AS caller, t.a AS caller_of_caller FROM one o LEFT JOIN one t ON t.m = o.a",
    "g11_callee_chains": lambda d: f"WITH {CALLS}, one AS (SELECT m, a FROM (SELECT from_id AS m, to_id AS a, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS rn FROM (SELECT DISTINCT to_id, from_id FROM calls) x) y WHERE rn <= 3) SELECT o.m, o.a AS callee, t.a AS callee_of_callee FROM one o LEFT JOIN one t ON t.m = o.a",
    "g14_edges_without_class": lambda d: """SELECT c.id AS removed, CAST((SELECT count(*) FROM {edges}) - coalesce(g.n, 0) AS BIGINT) AS n_left, CAST(coalesce(g.n, 0) AS BIGINT) AS n_gone FROM {classes} c
        LEFT JOIN (SELECT class_id, count(*) AS n FROM (SELECT f.class_id, e.edge_ord FROM {edges} e JOIN {methods} f ON f.id = e.from_id UNION SELECT t.class_id, e.edge_ord FROM {edges} e JOIN {methods} t ON t.id = e.to_id) x GROUP BY class_id) g ON g.class_id = c.id""",
    "g15_dependency_analysis": lambda d: f"WITH {CALLS} SELECT DISTINCT m, o, k FROM (SELECT from_id AS m, to_id AS o, 'called' AS k FROM calls UNION ALL SELECT to_id, from_id, 'calling' FROM calls UNION ALL SELECT a.from_id, b.to_id, 'related' FROM (SELECT DISTINCT from_id, to_id FROM calls) a JOIN (SELECT DISTINCT from_id, to_id FROM calls) b ON a.to_id = b.from_id) x",
    "g18_repeated_classes": lambda d: f"WITH {CALLS}, p AS (SELECT a.from_id AS m1, a.to_id AS m2, b.to_id AS m3, a.from_class AS c1, a.to_class AS c2, b.to_class AS c3 FROM calls a JOIN calls b ON a.to_id = b.from_id) SELECT m1, m2, m3, CASE WHEN c1 = c2 AND c2 = c3 THEN 3 ELSE 2 END AS cycle_length FROM p WHERE c1 = c2 OR c2 = c3 OR c1 = c3",
    "g19_layer_violations": lambda d: f"WITH {CALLS} SELECT from_id, to_id, from_layer, to_layer FROM calls LEFT JOIN {allowed_values()} ON a.src = from_layer AND a.dst = to_layer WHERE a.src IS NULL AND to_layer <> 'UNKNOWN' AND from_layer <> to_layer",
    # windows
    "w3_consecutive_calls": lambda d: "SELECT from_id, to_id, edge_ord, lag(to_id) OVER (PARTITION BY from_id ORDER BY edge_ord) AS previous FROM {edges}",
    "w4_first_last_call": lambda d: "SELECT from_id, CAST(min(edge_ord) AS BIGINT) AS first_ord, CAST(max(edge_ord) AS BIGINT) AS last_ord, min_by(to_id, edge_ord) AS first_to, max_by(to_id, edge_ord) AS last_to FROM {edges} GROUP BY from_id",
    "w5_path_index": lambda d: "SELECT from_id, to_id, edge_ord, CAST(row_number() OVER (PARTITION BY from_id ORDER BY edge_ord) - 1 AS BIGINT) AS path_index FROM {edges}",
    "w7_first_callers": lambda d: "SELECT to_id, from_id, rn FROM (SELECT to_id, from_id, edge_ord, CAST(row_number() OVER (PARTITION BY to_id ORDER BY edge_ord) AS BIGINT) AS rn FROM {edges}) x WHERE rn <= 10",
    "w8_first_and_last_wins": lambda d: "SELECT from_id, to_id, first_ord, last_ord FROM (SELECT from_id, to_id, min(edge_ord) OVER (PARTITION BY from_id, to_id) AS first_ord, max(edge_ord) OVER (PARTITION BY from_id, to_id) AS last_ord, row_number() OVER (PARTITION BY from_id, to_id ORDER BY edge_ord) AS rn FROM {edges}) x WHERE rn = 1",
}
GRAPH["j6_method_implementations"] = lambda d, f=GRAPH["j6_method_implementations"]: f(d) if d.name == "spark" else f(d).replace("STRING", "VARCHAR")


#: Around each class: callers and callees, callees only, callers only; without a class's calls of itself.
HOPS = {"c16_dependency_graph": (True, True, "true"), "c18_call_graph_two_levels": (False, True, "true"), "c19_caller_graph_two_levels": (True, False, "true"), "c20_bidirectional": (True, True, "src <> dst")}


def two_hops(graph: CodeGraph, callers: bool, callees: bool, where: str) -> DataFrame:
    """The rows of ``hops`` without a shuffle of all of them.

    Links are distinct, so a pair of hops comes up once wherever the class between has a name and an id of its own; only what leads by other classes
    (or starts from one whose id is there twice) is made distinct.
    """
    links = cut(graph.sql(f"WITH {LINKS} SELECT * FROM links"))
    parts = []
    for on, role, center, mid in ((callees, "callee", "from_class", "to_class"), (callers, "caller", "to_class", "from_class")):
        if on:
            parts.append(f"SELECT DISTINCT {center} AS center, '{role}' AS role, from_class_name AS src, to_class_name AS dst, 1 AS hop FROM {{links}}")
            pair = f"""SELECT a.{center} AS center, '{role}' AS role, b.src, b.dst, 2 AS hop FROM (SELECT l.{center}, l.{mid}, o.id IS NOT NULL OR p.id IS NOT NULL AS odd FROM {{links}} l LEFT JOIN odd o ON o.id = l.{center} LEFT JOIN odd p ON p.id = l.{mid}) a
                JOIN (SELECT DISTINCT {center} AS id, from_class_name AS src, to_class_name AS dst FROM {{links}}) b ON b.id = a.{mid}"""
            parts += [f"{pair} WHERE NOT a.odd", f"SELECT DISTINCT * FROM ({pair} WHERE a.odd) x"]
    odd = "odd AS (SELECT DISTINCT id FROM (SELECT id, count(*) OVER (PARTITION BY id) AS n_id, count(*) OVER (PARTITION BY name) AS n_name FROM {classes}) x WHERE n_id > 1 OR n_name > 1)"
    return graph.sql(f"WITH {odd} SELECT * FROM (" + " UNION ALL ".join(parts) + f") y WHERE {where}", links=links)


def ask(graph: CodeGraph, name: str) -> DataFrame:
    """The answer to a canned question about any code graph."""
    if name in HOPS:
        return two_hops(graph, *HOPS[name])
    return graph.sql(GRAPH[name](Spark()))
