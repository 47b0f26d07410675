"""Which classes enter a graph, with the sets of annotations and the predicates on methods that decide; SQL apart from the plans.

Methods of the bridge carry no annotations or bodies: every third has an annotation by its number, and one with at most one parameter stands for one with a body of one statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.plans.bridge import GRAPH_CTES, pick
from callscope.plans.graph import CodeGraph

MARKS = ["GetMapping", "Bean", "Transactional", "Query", "PostMapping", "Cacheable", "SelectProvider", "PreAuthorize", "Override"]
# Sets of annotations, and words of names.
CLASS_SETS = {"controller": "Controller|RestController|ControllerAdvice", "service": "Service|Stateless|Stateful", "repository": "Repository|Mapper", "config": "Configuration|SpringBootApplication", "component": "Component"}
METHOD_SETS = {"mapping": "RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping", "bean": "Bean", "business": "Transactional|Cacheable|PreAuthorize"}
TEST_WORDS, STORE_WORDS = "Test|junit", "Query|Select|Insert|Update|Delete"
MAPPED, LOGIC, ACCESS = "handle|get|post|put|delete", "process|handle|execute|calculate|validate|generate", "find|get|save|update|delete|insert|select|query"
OBJECT = ["toString", "equals", "hashCode", "clone", "finalize"]
DATA_ENDS, DATA_PACKAGES = "dto|vo|do|po|entity|model", "[.]dto|[.]vo|[.]entity|[.]model|[.]domain"


def marked(g: CodeGraph) -> DataFrame:
    id_ = F.col("id")
    return g.methods.withColumn("annotation", F.when(id_ % 3 == 0, pick(MARKS, F.floor(id_ / 3) % len(MARKS))))


def member(annotation: Column, names: str) -> Column:
    return F.coalesce(annotation.isin(names.split("|")), F.lit(False))


def predicates(m: DataFrame) -> DataFrame:
    """Six predicates of a method beside its columns: getter or setter, of every object, store access, mapped name, logic, and plain public work."""
    name = F.col("name")
    getter = name.rlike("^(get|set|is)") & (F.col("is_abstract") | (F.col("n_params") <= 1))
    of_object = name.isin(OBJECT)
    m = m.withColumns({"getter": getter, "of_object": of_object, "access": name.rlike(f"^({ACCESS})"), "mapped": member(F.col("annotation"), METHOD_SETS["mapping"]) | name.rlike(f"^({MAPPED})"), "logic": F.col("is_public") & name.rlike(LOGIC)})
    return m.withColumn("work", F.col("is_public") & ~F.col("getter") & ~F.col("of_object") & ~F.col("is_ctor"))


def p16_class_sets(g: CodeGraph) -> DataFrame:
    a = F.col("annotation")
    return g.classes.select("id", *[member(a, names).alias(k) for k, names in CLASS_SETS.items()], F.coalesce(a.rlike(TEST_WORDS), F.lit(False)).alias("test"))


def p16_method_sets(g: CodeGraph) -> DataFrame:
    a = F.col("annotation")
    return marked(g).select("id", *[member(a, names).alias(k) for k, names in METHOD_SETS.items()], F.coalesce(a.rlike(STORE_WORDS), F.lit(False)).alias("store"))


def p17_name_predicates(g: CodeGraph) -> DataFrame:
    return predicates(marked(g)).select("id", "getter", "of_object", "access", "mapped", "logic", "work")


def p14_class_inclusion(g: CodeGraph) -> DataFrame:
    """Whether a class is kept: none that only carries data or tests; of the others what its layer asks for by annotation or methods."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    m = predicates(marked(g)).groupBy(F.col("class_id").alias("id")).agg(
        any_(~F.col("is_ctor") & ~F.col("getter") & ~F.col("of_object")).alias("more"),
        any_(F.col("mapped")).alias("mapped"),
        any_(F.col("logic")).alias("logic"),
        any_(F.col("access")).alias("access"),
        any_(F.col("is_public") & F.col("is_static") & ~F.col("of_object")).alias("statics"),
        any_(member(F.col("annotation"), METHOD_SETS["bean"])).alias("beans"),
        any_(F.col("work")).alias("work"),
    )
    c = g.classes.join(m, "id", "left").fillna(False, ["more", "mapped", "logic", "access", "statics", "beans", "work"])
    low, whole, layer = F.lower("name"), F.lower("qualified_name"), F.col("layer")
    data = low.rlike(f"({DATA_ENDS})$") | whole.rlike(DATA_PACKAGES) | ~F.col("more")
    test = low.contains("test") | whole.contains("test") | F.coalesce(F.col("annotation").rlike(TEST_WORDS), F.lit(False))
    has = lambda k: member(F.col("annotation"), CLASS_SETS[k])
    fit = (
        F.when(layer == "CONTROLLER", has("controller") | F.col("mapped"))
        .when(layer == "SERVICE", has("service") | F.col("logic"))
        .when(layer.isin("REPOSITORY", "MAPPER"), has("repository") | F.col("access"))
        .when(layer == "UTIL", F.col("statics"))
        .when(layer == "CONFIG", has("config") | F.col("beans"))
        .when(layer == "COMPONENT", has("component") | F.col("work"))
        .when(layer == "ENTITY", True)
        .otherwise(F.col("work"))
    )
    return c.select("id", (~data & ~test & fit).alias("kept"))


#: A class's block by its annotation, or else by the end of its name.
BLOCKS = [("Entity", "ENTITY"), ("Repository", "REPOSITORY"), ("Service", "SERVICE"), ("Controller", "CONTROLLER"), ("Component", "SERVICE"), ("Configuration", "CONFIG")]
NAMED_BLOCKS = [("(DTO|Dto)$", "DTO"), ("(Util|Utils)$", "UTIL")]
ENDPOINTS = "RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping"
SENSITIVE = "Transactional|Async|Scheduled|Cacheable|PreAuthorize|PostAuthorize|Lock"
CLIENTS = "RestTemplate|WebClient|HttpClient"


def block_of(name: Column, annotation: Column | None) -> Column:
    out = F.lit("UNKNOWN")
    for words, block in reversed(NAMED_BLOCKS):
        out = F.when(name.rlike(words), block).otherwise(out)
    for word, block in reversed(BLOCKS if annotation is not None else []):
        out = F.when(annotation.contains(word), block).otherwise(out)
    return out


def blocked(g: CodeGraph) -> DataFrame:
    """Methods with their annotation and block: an endpoint's is CONTROLLER, a test's UNKNOWN, any other's what its class's name alone tells."""
    c = g.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "is_interface")
    a = F.col("annotation")
    block = F.when(a.contains("Test"), "UNKNOWN").when(a.rlike(ENDPOINTS), "CONTROLLER").when(F.col("name").startswith("test"), "UNKNOWN").otherwise(block_of(F.col("class_name"), None))
    return marked(g).join(c, "class_id").withColumn("block", block)


def p31_block_type(g: CodeGraph) -> DataFrame:
    """Blocks of classes and of methods."""
    classes = g.classes.select(F.lit("class").alias("kind"), "id", block_of(F.col("name"), F.col("annotation")).alias("block"))
    return classes.unionByName(blocked(g).select(F.lit("method").alias("kind"), "id", "block"))


def p30_path_predicates(g: CodeGraph) -> DataFrame:
    """What a call's path of two methods is about: its endpoint, blocks, annotations and names."""
    m = blocked(g).select("id", "name", "annotation", "block", "is_interface")
    a, b = (m.select(F.col("id").alias(f"{x}_id"), F.struct("*").alias(x)) for x in ("from", "to"))
    x = g.edges.select("edge_ord", "from_id", "to_id").join(a, "from_id").join(b, "to_id")
    either = lambda test: test(F.col("from")) | test(F.col("to"))
    blocks = lambda *names: either(lambda m: m["block"].isin(*names))
    marks = F.array_compact(F.array("from.annotation", "to.annotation"))
    return x.select(
        "edge_ord",
        F.coalesce(F.col("from.annotation").rlike(ENDPOINTS), F.lit(False)).alias("rest_endpoint"),
        blocks("ENTITY", "DTO").alias("data_model"),
        blocks("REPOSITORY", "MAPPER").alias("db_operation"),
        F.array_contains(marks, "Transactional").alias("transactional"),
        either(lambda m: m["name"].rlike(CLIENTS)).alias("external_api"),
        blocks("UTIL").alias("utility"),
        blocks("CONFIG").alias("config"),
        either(lambda m: m["is_interface"]).alias("through_interface"),
        F.array_join(F.filter(marks, lambda n: n.isin(SENSITIVE.split("|"))), ",").alias("sensitive"),
    )


def _in(column: str, names: str) -> str:
    return f"coalesce({column} IN ({', '.join(repr(n) for n in names.split('|'))}), FALSE)"


_MARK = "CASE id // 3 % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(MARKS)) + " END"
_STARTS = lambda words: "(" + " OR ".join(f"starts_with(name, '{w}')" for w in words.split("|")) + ")"
_CTES = f"""{GRAPH_CTES},
marked AS (SELECT *, CASE WHEN id % 3 = 0 THEN {_MARK} END AS annotation FROM methods),
told AS (SELECT *, {_STARTS('get|set|is')} AND (is_abstract OR n_params <= 1) AS getter, name IN ({', '.join(repr(n) for n in OBJECT)}) AS of_object, {_STARTS(ACCESS)} AS access,
  {_in('annotation', METHOD_SETS['mapping'])} OR {_STARTS(MAPPED)} AS mapped, is_public AND ({' OR '.join(f"contains(name, '{w}')" for w in LOGIC.split('|'))}) AS logic FROM marked),
known AS (SELECT *, is_public AND NOT getter AND NOT of_object AND NOT is_ctor AS work FROM told)"""
_HAS = lambda what: f"EXISTS (SELECT 1 FROM known m WHERE m.class_id = c.id AND {what})"
_FIT = f"""CASE WHEN layer = 'CONTROLLER' THEN {_in('c.annotation', CLASS_SETS['controller'])} OR {_HAS('mapped')} WHEN layer = 'SERVICE' THEN {_in('c.annotation', CLASS_SETS['service'])} OR {_HAS('logic')}
  WHEN layer IN ('REPOSITORY', 'MAPPER') THEN {_in('c.annotation', CLASS_SETS['repository'])} OR {_HAS('access')} WHEN layer = 'UTIL' THEN {_HAS('is_public AND is_static AND NOT of_object')}
  WHEN layer = 'CONFIG' THEN {_in('c.annotation', CLASS_SETS['config'])} OR {_HAS("m.annotation = 'Bean'")} WHEN layer = 'COMPONENT' THEN {_in('c.annotation', CLASS_SETS['component'])} OR {_HAS('work')} WHEN layer = 'ENTITY' THEN TRUE ELSE {_HAS('work')} END"""
INCLUDED = {f.__name__: f for f in (p14_class_inclusion, p16_class_sets, p16_method_sets, p17_name_predicates, p30_path_predicates, p31_block_type)}
_BY_NAME = "CASE " + " ".join("WHEN " + " OR ".join(f"name LIKE '%{w}'" for w in words.strip("()$").rstrip(")").split("|")) + f" THEN '{b}'" for words, b in NAMED_BLOCKS) + " ELSE 'UNKNOWN' END"
_BLOCKED = f"""{_CTES}, named AS (SELECT id AS class_id, is_interface, {_BY_NAME} AS by_name FROM classes),
blocked AS (SELECT m.id, m.name, annotation, is_interface, CASE WHEN contains(annotation, 'Test') THEN 'UNKNOWN' WHEN regexp_matches(annotation, '{ENDPOINTS}') THEN 'CONTROLLER' WHEN starts_with(m.name, 'test') THEN 'UNKNOWN' ELSE by_name END AS block FROM marked m JOIN named USING (class_id))"""
_EITHER = lambda names: "(a.block IN (" + names + ") OR b.block IN (" + names + "))"
INCLUDED_SQL = {
    "p31_block_type": f"WITH {_BLOCKED} SELECT 'class' AS kind, id, CASE " + " ".join(f"WHEN contains(annotation, '{w}') THEN '{b}'" for w, b in BLOCKS) + f" ELSE {_BY_NAME} END AS block FROM classes UNION ALL SELECT 'method', id, block FROM blocked",
    "p30_path_predicates": f"""WITH {_BLOCKED} SELECT edge_ord, coalesce(regexp_matches(a.annotation, '{ENDPOINTS}'), FALSE) AS rest_endpoint, {_EITHER("'ENTITY', 'DTO'")} AS data_model, {_EITHER("'REPOSITORY', 'MAPPER'")} AS db_operation,
        coalesce(a.annotation = 'Transactional', FALSE) OR coalesce(b.annotation = 'Transactional', FALSE) AS transactional, regexp_matches(a.name, '{CLIENTS}') OR regexp_matches(b.name, '{CLIENTS}') AS external_api, {_EITHER("'UTIL'")} AS utility, {_EITHER("'CONFIG'")} AS config,
        a.is_interface OR b.is_interface AS through_interface, concat_ws(',', CASE WHEN {_in('a.annotation', SENSITIVE)} THEN a.annotation END, CASE WHEN {_in('b.annotation', SENSITIVE)} THEN b.annotation END) AS sensitive
        FROM edges JOIN blocked a ON a.id = from_id JOIN blocked b ON b.id = to_id""",
    "p14_class_inclusion": f"WITH {_CTES} SELECT id, NOT (regexp_matches(lower(name), '({DATA_ENDS})$') OR regexp_matches(lower(qualified_name), '{DATA_PACKAGES}') OR NOT {_HAS('NOT is_ctor AND NOT getter AND NOT of_object')}) AND NOT (contains(lower(name), 'test') OR contains(lower(qualified_name), 'test') OR coalesce(regexp_matches(c.annotation, '{TEST_WORDS}'), FALSE)) AND {_FIT} AS kept FROM classes c",
    "p16_class_sets": f"WITH {_CTES} SELECT id, " + ", ".join(f"{_in('annotation', n)} AS {k}" for k, n in CLASS_SETS.items()) + f", coalesce(regexp_matches(annotation, '{TEST_WORDS}'), FALSE) AS test FROM classes",
    "p16_method_sets": f"WITH {_CTES} SELECT id, " + ", ".join(f"{_in('annotation', n)} AS {k}" for k, n in METHOD_SETS.items()) + f", coalesce(regexp_matches(annotation, '{STORE_WORDS}'), FALSE) AS store FROM marked",
    "p17_name_predicates": f"WITH {_CTES} SELECT id, getter, of_object, access, mapped, logic, work FROM known",
}
