"""A training-data pipeline: toxicity, line dedup, near-dedup, mixing and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's result as Parquet in the shared folder, reads it for the next, and then deletes
what the stage and those before it had written.

In all stages null and empty texts are texts without words, rows with a null id are judged by themselves, repeated rows share
their fate but for near-dedup, where one id stays, and an empty table stays empty; the operators' docstrings say more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import linededup, mixing, neardup, packing, toxicity
from callscope.llm.common import materialize, release, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; null and empty texts score as texts without words, repeated rows alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of words go from the texts, no row goes; null texts stay null; of ties the least id is the first place."""
    return linededup.dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return neardup.drop_near_duplicates(docs, shingle_words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens are kept, with sources and languages weighed flatter than they are; groups with too little for that are kept whole.

    Null sources and languages are groups; rows with one id share a decision; of tied or repeated rows all go or stay.
    """
    return mixing.mix(docs, keep=0.9, alphas={"source": 0.7, "lang": 0.8, "topic": 1.0}, tolerance=1e-4).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and offset."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: The stages before the last learn models and hash; SQL can't express them. Tests hold each stage's operator against brute force or
#: planted cases, and the stages one after the other against what they must keep.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
