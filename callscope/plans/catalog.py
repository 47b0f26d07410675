"""All queries of the library over the supplied tables, and their SQL for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.plans.bridge import WHOLE_CTES, code_graph
from callscope.plans.change_queries import CHANGE_CTES, CHANGES, changes
from callscope.plans.commit_queries import COMMITS, COMMITS_SQL
from callscope.plans.file_queries import FILES, FILES_SQL
from callscope.plans.graph_queries import GRAPH, ask
from callscope.plans.inclusion_queries import INCLUDED, INCLUDED_SQL
from callscope.plans.response_queries import RESPONSES, RESPONSES_SQL
from callscope.plans.review_queries import REVIEW, REVIEW_SQL, TABLES, TABLES_SQL
from callscope.plans.rule_queries import RULES, classify
from callscope.plans.script_queries import SCRIPTS, SCRIPTS_SQL
from callscope.plans.signature_queries import SIGNED, SIGNED_SQL
from callscope.plans.stream_queries import STREAMS, STREAMS_SQL
from callscope.plans.text_queries import TEXTS, TEXTS_SQL
from callscope.plans.texts import for_checking
from callscope.plans.tree_queries import TREE, TREE_SQL
from callscope.plans.weight_queries import PATHS, PATHS_SQL

Query = Callable[[SparkSession, str], DataFrame]


#: Queries over the calls of all consecutive parts of an order.
WHOLE = frozenset("""p11_same_tree p22_call_type p23_confidence p28_call_filter j2_valid_calls j9_cross_layer_calls j10_optional_call_stats j11_foreign_dependencies j15_methods_with_calls
    j20_consecutive_pairs a1_graph_totals a1_call_type_distribution a7_degrees a9_caller_layers a10_distinct_neighbours a11_first_neighbours a12_up_and_down_layers""".split())


def _over_graph(answer: Callable, name: str) -> Query:
    return lambda spark, sf_dir: answer(code_graph(spark, sf_dir, name in WHOLE), name)


def queries() -> dict[str, Query]:
    over_changes = {n: (lambda spark, sf_dir, n=n: changes(spark, sf_dir, n)) for n in CHANGES}
    return {n: _over_graph(ask, n) for n in GRAPH} | {n: _over_graph(classify, n) for n in RULES} | over_changes | {n: (lambda spark, sf_dir, f=f: f(code_graph(spark, sf_dir))) for n, f in (TREE | REVIEW | SIGNED | SCRIPTS | INCLUDED).items()} | TABLES | TEXTS | FILES | PATHS | COMMITS | RESPONSES | STREAMS


def oracle_sql() -> dict[str, str]:
    return {n: for_checking(t, *[WHOLE_CTES] * (n in WHOLE)) for n, t in (GRAPH | RULES).items()} | {n: for_checking(t, CHANGE_CTES) for n, t in CHANGES.items()} | TREE_SQL | REVIEW_SQL | TABLES_SQL | TEXTS_SQL | FILES_SQL | SIGNED_SQL | PATHS_SQL | COMMITS_SQL | RESPONSES_SQL | SCRIPTS_SQL | STREAMS_SQL | INCLUDED_SQL
