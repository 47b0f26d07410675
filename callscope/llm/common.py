"""Helpers shared by the corpus operators: durable intermediate tables and Arrow batch access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rule of every operator: words are ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]+"


_written: list[str] = []  # folders of materialized tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one where unset and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="callscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files survive the loss of any executor, unlike cached blocks or local checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this process has materialized and not released."""
    return len(_written)


def release(spark: SparkSession, since: int) -> None:
    """Delete what was materialized since then, but for the last table; for callers that won't read the others again."""
    jvm = spark.sparkContext._jvm
    for path in _written[since:-1]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _written[since:-1]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs inside hand at most so many rows at once to Python: for rows that carry texts, of which one may be long and in every row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = 256 * 1024) -> Iterator[None]:
    """Jobs inside broadcast no table of more bytes, though the session allow it: the driver builds several at once, each many times its compressed size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, allowed = spark.conf.get(name), spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(name, str(min(allowed, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def encoded(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) over unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def sliced(b: pa.RecordBatch, column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most_bytes``, so that long texts don't meet in memory."""
    sizes = np.cumsum([len(x) for x in encoded(b.column(column))]) if b.num_rows else np.zeros(0, int)
    at = 0
    while at < b.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        yield b.slice(at, end - at)
        at = end
