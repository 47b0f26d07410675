"""Methods with nested parameters, implementations matched by their types, and cascades of calls through interfaces; SQL apart from the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.durable import cut
from callscope.plans.bridge import GRAPH_CTES, pick
from callscope.plans.graph import CodeGraph
from callscope.plans.review_queries import _CONCRETE, ASKED, cascaded, normalised

TYPES = ["String", "Long", "Map<String,List<Long>>", "HttpServletRequest", "UserForm", "Order[]", "ResponseEntity<String>", "int"]
# What a web framework's parameters are of.
WEB = "HttpServletRequest|HttpServletResponse|HttpSession|Model|ModelAndView|RequestParam|PathVariable|RequestBody|ResponseEntity|MultipartFile"
WEB_ENDS = "Request|DTO|Form"
DEPTH = 3


def written(index: Column, id_: Column) -> Column:
    """A type, written as different sources would: plain, with its package, or with white space."""
    t = pick(TYPES, index % len(TYPES))
    packaged = F.replace(t, F.lit("String"), F.lit("java.lang.String"))
    spaced = F.regexp_replace(F.regexp_replace(t, ",", " ,\t"), "<", "< ")
    return F.when(id_ % 4 == 1, packaged).when(id_ % 4 == 2, spaced).when(id_ % 4 == 3, F.replace(t, F.lit("Map"), F.lit("java.util.Map"))).otherwise(t)


def signatures(g: CodeGraph) -> DataFrame:
    """Methods with ``params``, an array of (name, type), and written return types; of equal names most, not all, take and return the same."""
    id_, length = F.col("id"), F.length("name")
    other = (id_ % 7 == 3).cast("int")
    params = F.transform(F.filter(F.array(*[F.lit(i) for i in range(1, 4)]), lambda i: i <= F.col("n_params")), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("name"), written(length + i + other, id_).alias("type")))
    return g.methods.withColumns({"params": params, "return_type": F.when(id_ % 5 == 4, "void").otherwise(written(length, id_))})


def s2_class_methods(g: CodeGraph) -> DataFrame:
    """Each class's methods and constructors, with their signatures."""
    c = g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    listed = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", normalised(p["type"]), p["name"])), ", ")
    name = F.when(F.col("is_ctor"), F.col("class_name")).otherwise(F.col("name"))
    return signatures(g).join(c, "class_id").select("class_name", "id", F.when(F.col("is_ctor"), "CONSTRUCTOR").otherwise("METHOD").alias("kind"), F.concat(name, F.lit("("), listed, F.lit(")")).alias("signature"))


def j6_typed_implementations(g: CodeGraph) -> DataFrame:
    """Methods of implementing classes that take and return what the interface's method does, types compared one by one without packages and white space.

    Lists of normalised types are equal exactly if their pairs are, so that they are keys of the join.
    """
    s = signatures(g).withColumns({"types": F.transform("params", lambda p: normalised(p["type"])), "returns": normalised(F.col("return_type"))})
    of_interface = g.classes.where("is_interface").select(F.col("id").alias("interface_id"))
    asked = s.where("NOT is_static").join(of_interface, F.col("class_id") == F.col("interface_id")).select("interface_id", F.col("id").alias("interface_method"), "name", "types", "returns")
    impl = g.classes.where("NOT is_interface").select(F.col("id").alias("class_id"), "interface_id")
    mine = s.where("is_public").join(impl, "class_id").select("interface_id", F.col("id").alias("impl_method"), "name", "types", "returns")
    return asked.join(mine, ["interface_id", "name", "types", "returns"]).select("interface_method", "impl_method", F.array_join("types", ";").alias("types"), "returns")


def p20_web_parameters(g: CodeGraph) -> DataFrame:
    """Whether a method has a parameter of a web framework's types or of a type whose name ends as theirs do."""
    web = F.exists("params", lambda p: p["type"].rlike(f"{WEB}|({WEB_ENDS})$"))
    return signatures(g).select("id", web.alias("web"))


def cascade_tree(steps: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``root, call_id, parent_id, level, method``: calls led on through ``steps`` (caller, callee, label), as a tree written flat.

    ``call_id`` is the way from the root, which tells two calls of one method apart. Callees of one call that share a label are one; a method that is on the way
    already isn't called again, so cycles end. A level is a join of the last level's calls with all steps.
    """
    first = steps.groupBy("caller", "label").agg(F.min("callee").alias("callee")).where("caller != callee")
    level = roots.select(F.col("id").alias("root"), F.lit("").alias("parent_id"), F.col("id").cast("string").alias("call_id"), F.lit(0).alias("level"), F.col("id").alias("method"), F.array("id").alias("way"))
    out = None
    for n in range(1, depth + 1):
        new = level.join(first, level["method"] == first["caller"]).where(~F.array_contains("way", F.col("callee")))
        level = cut(new.select("root", F.col("call_id").alias("parent_id"), F.concat_ws(">", "call_id", "callee").alias("call_id"), F.lit(n).alias("level"), F.col("callee").alias("method"), F.array_append("way", F.col("callee")).alias("way")))
        out = level if out is None else out.unionByName(level)
    return out.drop("way")


def g16_cascade_tree(g: CodeGraph) -> DataFrame:
    """Cascades from the changed methods through interfaces to their implementations, ``DEPTH`` calls deep."""
    label = g.methods.join(g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("c")), "class_id").select(F.col("id").alias("callee"), F.concat_ws(".", "c", "name").alias("label"))
    steps = cascaded(g).select("caller", F.col("impl_method").alias("callee")).distinct().join(label, "callee")
    return cascade_tree(steps, g.methods.where(F.col("id") % ASKED == 0).select("id"), DEPTH)


_TYPE = "CASE (i) % 8 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(TYPES)) + " END"


def _written(index: str, id_: str = "id") -> str:
    t = _TYPE.replace("(i)", f"({index})")
    return f"CASE {id_} % 4 WHEN 1 THEN replace({t}, 'String', 'java.lang.String') WHEN 2 THEN replace(replace({t}, ',', ' ,' || chr(9)), '<', '< ') WHEN 3 THEN replace({t}, 'Map', 'java.util.Map') ELSE {t} END"


def _norm(x: str) -> str:
    return f"replace(replace(regexp_replace({x}, '\\s+', '', 'g'), 'java.lang.', ''), 'java.util.', '')"


_SIGNED = f"""params AS (SELECT id, i.i AS pos, {_written("length(name) + i.i + CASE WHEN id % 7 = 3 THEN 1 ELSE 0 END")} AS type FROM methods JOIN (SELECT unnest([1, 2, 3]) AS i) i ON i.i <= n_params),
listed AS (SELECT id, string_agg({_norm("type")}, ';' ORDER BY pos) AS types, string_agg({_norm("type")} || ' p' || pos, ', ' ORDER BY pos) AS shown, bool_or(regexp_matches(type, '{WEB}|({WEB_ENDS})$')) AS web FROM params GROUP BY id),
signed AS (SELECT m.*, coalesce(types, '') AS types, coalesce(shown, '') AS shown, coalesce(web, FALSE) AS web, {_norm(f"CASE WHEN m.id % 5 = 4 THEN 'void' ELSE {_written('length(m.name)', 'm.id')} END")} AS returns FROM methods m LEFT JOIN listed l ON l.id = m.id)"""
_STEPS = f"""{_CONCRETE},
steps AS (SELECT e.from_id AS caller, c.name || '.' || m.name AS label, min(m.id) AS callee FROM edges e JOIN methods im ON im.id = e.to_id JOIN concrete k ON k.interface_id = im.class_id
  JOIN methods m ON m.class_id = k.class_id AND m.name = im.name AND m.n_params = im.n_params JOIN classes c ON c.id = m.class_id GROUP BY 1, 2 HAVING min(m.id) <> e.from_id),
tree AS (SELECT id AS root, '' AS parent_id, CAST(id AS VARCHAR) AS call_id, 0 AS level, id AS method, [id] AS way FROM methods WHERE id % {ASKED} = 0
  UNION ALL SELECT t.root, t.call_id, t.call_id || '>' || s.callee, t.level + 1, s.callee, list_append(t.way, s.callee) FROM tree t JOIN steps s ON s.caller = t.method WHERE t.level < {DEPTH} AND NOT list_contains(t.way, s.callee))"""

SIGNED = {f.__name__: f for f in (s2_class_methods, j6_typed_implementations, p20_web_parameters, g16_cascade_tree)}
_WITH = f"WITH RECURSIVE {GRAPH_CTES}"
SIGNED_SQL = {
    "s2_class_methods": f"{_WITH}, {_SIGNED} SELECT c.name AS class_name, s.id, CASE WHEN is_ctor THEN 'CONSTRUCTOR' ELSE 'METHOD' END AS kind, CASE WHEN is_ctor THEN c.name ELSE s.name END || '(' || shown || ')' AS signature FROM signed s JOIN classes c ON c.id = class_id",
    "j6_typed_implementations": f"{_WITH}, {_SIGNED} SELECT im.id AS interface_method, m.id AS impl_method, m.types, m.returns FROM classes i JOIN signed im ON im.class_id = i.id AND i.is_interface AND NOT im.is_static JOIN classes c ON c.interface_id = i.id AND NOT c.is_interface JOIN signed m ON m.class_id = c.id AND m.is_public AND m.name = im.name AND m.types = im.types AND m.returns = im.returns",
    "p20_web_parameters": f"{_WITH}, {_SIGNED} SELECT id, web FROM signed",
    "g16_cascade_tree": f"{_WITH}, {_STEPS} SELECT root, parent_id, call_id, level, method FROM tree WHERE level > 0",
}
