"""Scripts and batches of a graph as rows; the SQL writes the same lines by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.rules import CONFIDENCE, lookup
from callscope.plans.bridge import GRAPH_CTES
from callscope.plans.graph import CodeGraph
from callscope.sources import writers


def k1_script_chunks(g: CodeGraph) -> DataFrame:
    """Each chunk of the script: how many rows, and a digest of what is written of them."""
    return writers.bodies(g).select("kind", "chunk", "n_rows", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


def k9_json_batches(g: CodeGraph) -> DataFrame:
    """Each batch of nodes or edges: how many rows and what the first and last are."""
    rows = F.from_json("json", "array<struct<id:long,edge_ord:long>>")
    x = writers.json_batches(g).select("kind", "chunk", "n_rows", rows.alias("r"))
    key = lambda s: F.coalesce(s["id"], s["edge_ord"])
    return x.select("kind", "chunk", "n_rows", F.size("r").cast("long").alias("n_read"), key(F.get("r", F.lit(0))).alias("first"), key(F.element_at("r", -1)).alias("last"))


def _text(x: str) -> str:
    return f"chr(39) || replace(replace(coalesce(CAST({x} AS VARCHAR), ''), '\\', '\\\\'), chr(39), '\\' || chr(39)) || chr(39)"


def _line(**columns: str) -> str:
    return "'  {' || " + " || ', ' || ".join(f"'{n}: ' || {x}" for n, x in columns.items()) + " || '}'"


_PARTS = [
    ("4-classes", 50, "id", "classes", _line(id=_text("id"), name=_text("name"), qualifiedName=_text("qualified_name"), package=_text("package"), layer=_text("layer"), superClass=_text("super_id"), isAbstract="is_abstract", isInterface="is_interface", filePath=_text("file_path"))),
    ("5-methods", 50, "id", "methods", _line(id=_text("id"), name=_text("name"), classId=_text("class_id"), returnType=_text("return_type"), isConstructor="is_ctor", isStatic="is_static", isPublic="is_public", isAbstract="is_abstract")),
    ("7-calls", 100, "edge_ord", "edges", _line(fromId=_text("from_id"), toId=_text("to_id"), callType=_text("call_type"), lineNumber="line", confidence=f"CAST(({lookup('call_type', CONFIDENCE, 0.8)}) AS DOUBLE)")),
    ("8-extends", 100, "id", "classes WHERE super_id IS NOT NULL", _line(child=_text("id"), parent=_text("super_id"))),
    ("9-implements", 100, "id", "classes WHERE interface_id IS NOT NULL", _line(child=_text("id"), parent=_text("interface_id"))),
]
_ALL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, (row_number() OVER (ORDER BY {o}) - 1) // {size} AS chunk, {o} AS o, {line} AS line FROM {of}" for kind, size, o, of, line in _PARTS)
_KEYS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, (row_number() OVER (ORDER BY {o}) - 1) // {size} AS chunk, {o} AS o FROM {of}" for kind, size, o, of in (("class", 50, "id", "classes"), ("method", 50, "id", "methods"), ("edge", 100, "edge_ord", "edges")))
SCRIPTS = {f.__name__: f for f in (k1_script_chunks, k9_json_batches)}
SCRIPTS_SQL = {
    "k1_script_chunks": f"WITH RECURSIVE {GRAPH_CTES}, l AS ({_ALL}) SELECT kind, chunk, count(*) AS n_rows, length(string_agg(line, ',' || chr(10) ORDER BY o)) AS n_chars, md5(string_agg(line, ',' || chr(10) ORDER BY o)) AS body_md5 FROM l GROUP BY kind, chunk",
    "k9_json_batches": f"WITH RECURSIVE {GRAPH_CTES}, k AS ({_KEYS}) SELECT kind, chunk, count(*) AS n_rows, count(*) AS n_read, min(o) AS first, max(o) AS last FROM k GROUP BY kind, chunk",
}
