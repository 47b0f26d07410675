"""Streams over the supplied tables, run to the end of what has arrived; their SQL gives the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.durable import shared
from callscope.streaming import maintain, reindex


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


def page_links(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Pages as files whose edges go from the page's host to each place that it links to; ``page_id`` is the version."""
    p = source(spark, sf_dir, "pages") if stream else spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    return p.select(F.col("url").alias("path"), F.col("page_id").alias("version"), host.alias("src"), F.explode_outer(links).alias("dst")).withColumn("src", F.when(F.col("dst").isNotNull(), F.col("src")))


def g14_maintained_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of hosts and places, kept up by a stream of pages in a store of its own."""
    at = f"{shared(spark)}/pages-{uuid.uuid4().hex}"
    store = maintain.Store(spark, f"{at}/store")
    page_links(spark, sf_dir, stream=True).writeStream.foreachBatch(store.replaced_by()).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.degrees()


def stream_reindex_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-index runs that the watermark has closed: bursts of a user's events half an hour apart, an hour behind the latest event."""
    at = f"{shared(spark)}/reindex-{uuid.uuid4().hex}"
    return reindex.to_parquet(reindex.reindexed(source(spark, sf_dir, "events")), f"{at}/out", f"{at}/checkpoint")


STREAMS = {f.__name__: f for f in (g14_maintained_degrees, stream_reindex_runs)}
STREAMS_SQL = {
    "g14_maintained_degrees": """WITH newest AS (SELECT * FROM pages QUALIFY page_id = max(page_id) OVER (PARTITION BY url)),
        e AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM newest)
        SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) x GROUP BY node""",
    "stream_reindex_runs": """WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM t),
        r AS (SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM b GROUP BY user_id, burst)
        SELECT user_id, start, stop, n FROM r WHERE stop + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
