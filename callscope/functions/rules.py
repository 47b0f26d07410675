"""Ordered first-match rules for layers, domains, methods, files and findings.

A rule list is read top down; the first row with a hit gives the result. ``first_match`` makes one CASE of it,
which Spark compiles into the stage that reads the rows.
"""

from __future__ import annotations

Rules = list[tuple[str, str]]

# Words that must equal the reference's, in its order. "a|b" means a or b.
PACKAGE_LAYERS: Rules = [("controller|web", "CONTROLLER"), ("service|business", "SERVICE"), ("mapper|dao", "MAPPER"), ("repository|repo", "REPOSITORY"), ("util|utils|helper", "UTIL"), ("entity|model|domain", "ENTITY"), ("config|configuration", "CONFIG"), ("component", "COMPONENT")]
SUFFIX_LAYERS: Rules = [("controller", "CONTROLLER"), ("service|serviceimpl", "SERVICE"), ("mapper|dao", "MAPPER"), ("repository|repo", "REPOSITORY"), ("util|utils|helper", "UTIL"), ("entity|model|do|dto|vo|po", "ENTITY"), ("config|configuration", "CONFIG"), ("component", "COMPONENT")]
SUPER_LAYERS: Rules = [("controller", "CONTROLLER"), ("service", "SERVICE"), ("repository", "REPOSITORY"), ("mapper", "MAPPER")]
ANNOTATION_LAYERS: Rules = [("Controller|RestController|ControllerAdvice", "CONTROLLER"), ("Service|Stateless|Stateful|Singleton", "SERVICE"), ("Repository|JpaRepository|MongoRepository", "REPOSITORY"), ("Mapper|MapperScan", "MAPPER"), ("Configuration|ConfigurationProperties|SpringBootApplication", "CONFIG"), ("Component", "COMPONENT"), ("Entity|Document", "ENTITY")]
REPORT_ANNOTATIONS: Rules = [("Controller|RestController", "CONTROLLER"), ("Service", "SERVICE"), ("Repository", "REPOSITORY"), ("Mapper|MapperScan", "MAPPER"), ("Configuration|ConfigurationProperties", "CONFIG"), ("Entity|Document", "ENTITY")]
REPORT_PACKAGES: Rules = [("controller", "CONTROLLER"), ("service", "SERVICE"), ("mapper|dao", "MAPPER"), ("repository", "REPOSITORY"), ("util|utils", "UTIL"), ("entity|model|domain", "ENTITY"), ("config", "CONFIG")]
REPORT_SUFFIXES: Rules = [("Controller", "CONTROLLER"), ("Service|ServiceImpl", "SERVICE"), ("Mapper|Dao|DAO", "MAPPER"), ("Repository", "REPOSITORY"), ("Util|Utils|Helper", "UTIL"), ("Entity|Model|DO|DTO|VO", "ENTITY"), ("Config|Configuration", "CONFIG")]
PACKAGE_DOMAINS: Rules = [("user|account|profile", "USER"), ("order|purchase|cart", "ORDER"), ("product|goods|item|catalog", "PRODUCT"), ("payment|pay|billing|finance", "PAYMENT"), ("auth|security|login|permission", "AUTH"), ("system|admin|manage", "SYSTEM"), ("common|util|base", "COMMON")]
NAME_DOMAINS: Rules = [("user|account|profile|member|customer|person", "USER"), ("order|purchase|cart|shopping|checkout", "ORDER"), ("product|goods|item|sku|catalog|inventory", "PRODUCT"), ("payment|pay|billing|invoice|refund|wallet", "PAYMENT"), ("auth|login|security|permission|role|token", "AUTH"), ("system|admin|config|setting|monitor", "SYSTEM"), ("common|util|helper|base|abstract", "COMMON")]
ANNOTATION_DOMAINS: Rules = [("User|Account", "USER"), ("Order|Purchase", "ORDER"), ("Product|Catalog", "PRODUCT"), ("Payment|Billing", "PAYMENT"), ("Security|Auth", "AUTH"), ("System|Admin", "SYSTEM")]
TREE_DOMAINS: Rules = [("user|account", "USER"), ("order|purchase", "ORDER"), ("product|goods", "PRODUCT"), ("payment|pay", "PAYMENT"), ("auth|login", "AUTH"), ("system|admin", "SYSTEM")]
NAME_ONLY_LAYERS: Rules = [("controller", "CONTROLLER"), ("service", "SERVICE"), ("repository|dao|mapper", "REPOSITORY"), ("util|helper", "UTIL"), ("entity|model|dto", "MODEL"), ("filter", "FILTER")]
PATH_LAYERS: Rules = [("controller", "CONTROLLER"), ("service", "SERVICE"), ("repository|dao", "REPOSITORY"), ("entity|model", "MODEL"), ("config", "CONFIG"), ("util|helper", "UTIL")]
DOMAIN_PRIORITY = [("USER", 10), ("ORDER", 9), ("PAYMENT", 8), ("PRODUCT", 7), ("AUTH", 6), ("SYSTEM", 3), ("COMMON", 2), ("UNKNOWN", 1)]
CONFIDENCE = [("DIRECT", 1.0), ("STATIC", 1.0), ("INTERFACE", 0.9), ("INHERITANCE", 0.9), ("ASYNC", 0.8), ("LAMBDA", 0.8), ("METHOD_REFERENCE", 0.8), ("REFLECTION", 0.6)]
ROOT_STARTS = "regist|register|login|logout|upload|download|save|edit|modify|cancel|handle|process"
WEB_STARTS = "get|post|put|delete|create|update|remove|find|search|list"
METHOD_NAME_WEIGHTS = [("process|handle|execute", 3.0), ("create|save|update|delete", 2.5), ("validate|check|verify", 2.0), ("calculate|compute|generate", 2.0), ("find|search|query", 1.5), ("get|list", 1.0), ("set", 0.5)]
METHOD_LAYER_WEIGHTS = [("CONTROLLER", 10.0), ("SERVICE", 8.0), ("REPOSITORY", 6.0), ("MAPPER", 5.0), ("COMPONENT", 4.0), ("CONFIG", 3.0), ("UTIL", 2.0), ("ENTITY", 1.0)]
CLASS_LAYER_WEIGHTS = [("CONTROLLER", 15.0), ("SERVICE", 12.0), ("REPOSITORY", 9.0), ("MAPPER", 7.0), ("COMPONENT", 6.0), ("CONFIG", 4.0), ("UTIL", 3.0), ("ENTITY", 2.0)]
PATH_LAYER_WEIGHTS = [("CONTROLLER", 10.0), ("SERVICE", 8.0), ("REPOSITORY", 6.0), ("COMPONENT", 4.0), ("UTIL", 2.0)]
COMMIT_TERMS = "user order product payment auth login register cart checkout inventory customer account profile api service controller repository database cache security permission role token session".split()
COMMIT_ACTIONS = "create add implement update modify fix delete remove refactor optimize improve enhance validate".split()
HUNK_IMPACT: Rules = [("timeout|lock|transaction|payment|auth|security|user|order", "VERY_HIGH"), ("service|controller|api|database|cache|session|validation", "HIGH"), ("util|helper|format|convert|parse|calculate", "MEDIUM"), ("test|mock|debug|log|comment", "LOW")]
IMPACT_POINTS = [("lock", 15), ("timeout", 15), ("transaction", 12), ("auth", 12), ("security", 12), ("payment", 10), ("user", 8), ("order", 8), ("service", 6), ("controller", 6), ("api", 5)]
INTENT_WORDS = [("user", 8), ("order", 8), ("payment", 10), ("transaction", 10), ("auth", 9), ("login", 7), ("security", 9), ("account", 6), ("product", 6), ("inventory", 7), ("checkout", 8), ("cart", 5), ("create", 6), ("save", 6), ("update", 7), ("delete", 8), ("process", 7), ("execute", 6), ("handle", 5), ("validate", 6)]
FILE_RISK = [("config|.properties|.yml|.yaml", 25), ("security|auth", 20), ("controller|rest", 12), ("database|migration|.sql", 15), ("util|common", 18), ("service", 8)]
ADDED_RISK = [("@transactional", 8), ("delete", 6), ("drop", 10), ("truncate", 9), ("alter", 5), ("@async", 4), ("@scheduled", 4), ("@preauthorize", 7), ("@postauthorize", 6), ("password", 5), ("token", 4), ("secret", 8)]
DANGEROUS_METHODS = "delete remove clear drop truncate update insert keys scan flushall flushdb eval exec multi execute query save persist merge".split()
PATTERN_WORDS = "factory builder adapter facade strategy observer proxy decorator".split()


def quoted(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def has(column: str, words: str, how: str = "contains") -> str:
    """Whether a column contains, starts with, ends with or equals one of the words."""
    test = {"contains": lambda w: f"contains({column}, {quoted(w)})", "starts": lambda w: f"{column} LIKE {quoted(w + '%')}", "ends": lambda w: f"{column} LIKE {quoted('%' + w)}", "is": lambda w: f"{column} = {quoted(w)}"}[how]
    return "(" + " OR ".join(test(w) for w in words.split("|")) + ")"


def first_match(column: str, rules: list[tuple[str, object]], default: object = "UNKNOWN", how: str = "contains") -> str:
    """CASE of the first rule with a hit."""
    return "CASE " + " ".join(f"WHEN {has(column, words, how)} THEN {quoted(result)}" for words, result in rules) + f" ELSE {quoted(default)} END"


def lookup(column: str, values: list[tuple[str, object]], default: object) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {quoted(k)} THEN {quoted(v)}" for k, v in values) + f" ELSE {quoted(default)} END"


def points(column: str, values: list[tuple[str, int]]) -> str:
    """Sum of the points of all words that a column contains."""
    return "(" + " + ".join(f"CASE WHEN contains({column}, {quoted(w)}) THEN {p} ELSE 0 END" for w, p in values) + ")"


def hits(column: str, words: list[str]) -> str:
    """The words that a column contains, in their order, as one string."""
    return "concat_ws(','," + ", ".join(f"CASE WHEN contains({column}, {quoted(w)}) THEN {quoted(w)} END" for w in words) + ")"


def cascade(*stages: str) -> str:
    """The first stage that isn't UNKNOWN."""
    return "coalesce(" + ", ".join(f"nullif({s}, 'UNKNOWN')" for s in stages) + ", 'UNKNOWN')"


def relatedness(a: str, b: str) -> str:
    """Relatedness of two domains, symmetric."""
    pair = lambda x, y: f"(({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}'))"
    either = lambda x: f"({a} = '{x}' OR {b} = '{x}')"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {pair('USER', 'AUTH')} THEN 0.9 WHEN {pair('ORDER', 'PAYMENT')} THEN 0.9 WHEN {pair('ORDER', 'PRODUCT')} THEN 0.8 WHEN {pair('USER', 'ORDER')} THEN 0.7 WHEN {pair('USER', 'PAYMENT')} THEN 0.6 WHEN {either('COMMON')} THEN 0.5 WHEN {either('SYSTEM')} THEN 0.4 WHEN {either('UNKNOWN')} THEN 0.1 ELSE 0.2 END"
