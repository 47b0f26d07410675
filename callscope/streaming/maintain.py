"""A graph kept up to date from a stream of files: only what changed is read and written, and batches that come again change nothing.

A store is a folder in shared storage. Edges lie in ``buckets`` by a hash of their file's path; a commit writes anew the buckets of changed files, and the change of each node's degrees as a
small table of sums. A manifest names the folders that count now, and is put in place by a rename after all else is written; a failure before that leaves the store as it was. Each file's version is
kept with its edges: a batch counts only where its version of a file is newer, so neither a repeated batch, nor a restart with a new checkpoint, nor the number of a batch matters.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "path string, version long, src string, dst string"
DEGREES = "node string, n_out long, n_in long"


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, deltas: int = 16) -> None:
        self.spark, self.path, self.buckets, self.deltas = spark, path.rstrip("/"), buckets, deltas

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """What counts now: commits so far, the folder of each bucket and those of the degrees' sums."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return {"commits": 0, "edges": {}, "degrees": []}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifest").first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, new = self._fs(f"{self.path}/manifest-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        old = self._fs(f"{self.path}/manifest")[1]
        if fs.exists(old):
            fs.delete(old, False)
        fs.rename(new, old)

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def edges(self) -> DataFrame:
        return self._read(sorted(set(self.manifest()["edges"].values())), EDGES).where("src IS NOT NULL")

    def degrees(self) -> DataFrame:
        """``node, n_out, n_in`` of all nodes that have an edge."""
        sums = self._read(self.manifest()["degrees"], DEGREES).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
        return sums.where("n_out != 0 OR n_in != 0")

    def apply(self, batch: DataFrame) -> int:
        """Put in the files of ``batch`` (``EDGES``, whole files; one row with null ends for a file without edges) that are newer than what is held; returns how many."""
        now = self.manifest()
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        newest = batch.groupBy("path").agg(F.max("version").alias("version"))
        touched = [str(r[0]) for r in newest.select(bucket).distinct().collect()]  # at most as many as there are buckets
        held = self._read(sorted({now["edges"][b] for b in touched if b in now["edges"]}), EDGES)
        known = held.groupBy("path").agg(F.max("version").alias("known"))
        work = f"{self.path}/work-{uuid.uuid4().hex}"
        newest.join(known, "path", "left").where("known IS NULL OR version > known").select("path", "version").write.parquet(f"{work}/changed")
        changed = self.spark.read.schema("path string, version long").parquet(f"{work}/changed")
        n = changed.count()
        if not n:
            return 0
        gone = held.join(changed.select("path"), "path", "left_semi")
        come = batch.join(changed, ["path", "version"], "left_semi").select("path", "version", "src", "dst")
        kept = held.join(changed.select("path"), "path", "left_anti")
        kept.unionByName(come).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{work}/edges")
        ends = lambda rows, sign: rows.where("src IS NOT NULL").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(sign).alias("n_out"), F.lit(0).alias("n_in")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("n_out"), F.lit(sign).alias("n_in")))).alias("e")).select("e.*")
        sums = ends(gone, -1).unionByName(ends(come, 1)).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")).where("n_out != 0 OR n_in != 0")
        sums.write.parquet(f"{work}/degrees")
        degrees = [*now["degrees"], f"{work}/degrees"]
        if len(degrees) > self.deltas:  # sums of sums, so that reading them stays cheap
            self._read(degrees, DEGREES).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")).where("n_out != 0 OR n_in != 0").write.parquet(f"{work}/sums")
            degrees = [f"{work}/sums"]
        self._commit({"commits": now["commits"] + 1, "edges": {**now["edges"], **{b: f"{work}/edges/bucket={b}" for b in touched}}, "degrees": degrees})
        return n

    def replaced_by(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function; it doesn't look at the batch's number."""

        def run(batch: DataFrame, _epoch: int) -> None:
            self.apply(batch)

        return run


def rebuilt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and degrees of the newest version of each file, from all of them."""
    newest = files.groupBy("path").agg(F.max("version").alias("version"))
    edges = files.join(newest, ["path", "version"], "left_semi").where("src IS NOT NULL").select("path", "version", "src", "dst")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("n_out"), F.lit(0).alias("n_in")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("n_out"), F.lit(1).alias("n_in")))).alias("e")).select("e.*")
    return edges, ends.groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
