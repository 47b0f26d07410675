"""The code graph as a bundle of DataFrames, and SQL over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CodeGraph:
    """Classes, methods and call edges.

    classes: id, name, qualified_name, package, layer, domain, annotation (nullable), super_id (nullable),
    interface_id (nullable), is_abstract, is_interface, file_path.
    methods: id, class_id, name, n_params, return_type, is_public, is_static, is_abstract, is_ctor.
    edges: from_id, to_id, call_type, line, edge_ord.
    """

    classes: DataFrame
    methods: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.classes.sparkSession

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Run SQL in which {classes}, {methods}, {edges} and the given names stand for DataFrames."""
        held = {"classes": self.classes, "methods": self.methods, "edges": self.edges, **more}
        return self.spark.sql(text, **{k: v for k, v in held.items() if "{" + k + "}" in text})
