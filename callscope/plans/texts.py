"""Small differences between Spark's SQL and the SQL of the engine that checks it."""

from __future__ import annotations

from collections.abc import Callable

from callscope.plans.bridge import GRAPH_CTES


class Spark:
    name = "spark"

    def set(self, x: str) -> str:
        """Distinct values as one sorted string."""
        return f"array_join(array_sort(collect_set(CAST({x} AS STRING))), ',')"

    def top(self, x: str, n: int) -> str:
        return f"array_join(slice(array_sort(collect_set(CAST({x} AS STRING))), 1, {n}), ',')"

    def rx(self, x: str, pattern: str) -> str:
        return f"{x} RLIKE '{pattern}'"

    def found(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def count(self, x: str, pattern: str) -> str:
        """How often a pattern occurs."""
        return f"CAST(size(regexp_extract_all({x}, '{pattern}', 0)) AS BIGINT)"

    def div(self, x: str, y: str) -> str:
        return f"CAST(floor(({x}) / ({y})) AS BIGINT)"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}')"


class Duck(Spark):
    name = "duck"

    def set(self, x: str) -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT CAST({x} AS VARCHAR)) FILTER (WHERE {x} IS NOT NULL)), ','), '')"

    def top(self, x: str, n: int) -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT CAST({x} AS VARCHAR)) FILTER (WHERE {x} IS NOT NULL))[1:{n}], ','), '')"

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


Text = Callable[[Spark], str]


def for_checking(text: Text, ctes: str = GRAPH_CTES) -> str:
    """The text as one statement, with the derivation of its tables before it."""
    body = text(Duck()).strip().replace("{", "").replace("}", "")
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[5:].removeprefix('RECURSIVE ')}"
    return f"WITH RECURSIVE {ctes}\n{body}"
