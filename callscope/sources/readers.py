"""Readers of code graphs and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans.graph import CodeGraph
from callscope.sources import scanner

# Fixed value: folders that hold no sources of the project.
SKIPPED = r"/\.m2/repository/|/build/|/target/"


def source_files(spark: SparkSession, path: str, pattern: str = "*.java") -> DataFrame:
    """``path, text`` of source files under a folder, but for built and downloaded ones."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(SKIPPED))


def call_sites(files: DataFrame) -> DataFrame:
    """``path, type, method, kind, receiver, name, line, lambdas`` of each call site in the texts."""
    return scanner.sites(scanner.scanned(files))


def read_graph(spark: SparkSession, path: str) -> CodeGraph:
    """A graph that ``write_graph`` wrote."""
    return CodeGraph(*(spark.read.parquet(f"{path}/{n}") for n in ("classes", "methods", "edges")))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change, old_text, new_text`` between two snapshots (path, text)."""
    a, b = before.select("path", F.col("text").alias("old_text")), after.select("path", F.col("text").alias("new_text"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("old_text").isNull(), "ADDED").when(F.col("new_text").isNull(), "DELETED").otherwise("MODIFIED")
    return both.where(~F.col("old_text").eqNullSafe(F.col("new_text"))).select("path", change.alias("change"), "old_text", "new_text")
