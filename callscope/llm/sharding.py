"""K-d tree partitioning of documents into shards of near equal bytes (operator 8).

What the tree divides are groups of equal texts, each with its bytes and the least metadata of its rows, so copies stay in one shard; a
group with more than ``1 / PARTS`` of a shard's bytes, or a shard's rows, is dealt into parts of that size by row.
Each level splits every node at a weighted quantile, by bytes, of its widest metadata dimension, in the proportion of the
shards that its two sides still have to give, so any number of shards comes out. The quantiles are exact and distributed: groups
are range-partitioned by (node, dimension, text), bytes are summed for each partition, the few sums show in which
partition a node's cut lies, and only there groups are summed one by one. Text is read once; what moves
afterwards is one narrow row a group. Facts about nodes are small tables that are joined, a row for each node.

Dimensions are turned into order-preserving numbers: a string by its first six bytes, a length by itself.

Defined results: null text counts no bytes (size 1, checksum 0) and is a group with empty ones; null metadata sorts first; repeated rows
are placed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import materialize, parallelism


def code(column: Column, kind: str) -> Column:
    """An order-preserving number of a metadata value."""
    if kind == "string":
        prefix = F.rpad(F.hex(F.substring(F.encode(F.coalesce(column, F.lit("")), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(prefix, 16, 10).cast("double")
    return F.coalesce(column.cast("double"), F.lit(0.0))


def ranged(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df`` sorted over its partitions by ``keys``, written, with the place of each row: ``part``, ``at``."""
    order = df.repartitionByRange(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ord_ = F.monotonically_increasing_id()
    return materialize(order.withColumn("ord_", ord_).withColumn("part", F.shiftright("ord_", 33)).withColumn("at", F.col("ord_").bitwiseAND(F.lit((1 << 33) - 1))).drop("ord_"), label)


PARTS = 8


def kd_shards(docs: DataFrame, *, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), n_shards: int = 16, target_bytes: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless in its shard) of each document.

    ``target_bytes`` overrides ``n_shards``: as many shards as hold at most about that each.
    """
    kinds = dict(docs.dtypes)
    meta = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        *[code(F.col(d), kinds[d]).alias(f"dim_{i}") for i, d in enumerate(dimensions)],
    )
    dims = [f"dim_{i}" for i in range(len(dimensions))]
    rows = materialize(meta.withColumn("row_id", F.monotonically_increasing_id()), "kd-meta")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shards = n_shards if target_bytes is None else max(1, -(-total // target_bytes))
    by = ["h", "text_crc32"]
    parts = F.greatest(F.ceil(F.sum("size") * (PARTS * shards) / total), F.ceil(F.count(F.lit(1)) * shards / n))
    large = rows.groupBy(*by).agg(parts.alias("parts")).where("parts > 1")  # fewer than 2 * PARTS * shards
    rows = rows.join(F.broadcast(large), by, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    groups = materialize(rows.groupBy(*by, "piece").agg(F.sum("size").alias("size"), *[F.min(d).alias(d) for d in dims]).withColumn("node", F.lit(0).cast("long")), "kd-groups")
    leaves, done, root = {0: shards}, [], None
    while any(k > 1 for k in leaves.values()):
        seen = groups.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()  # a row for each node: at most the number of shards
        root = root or [max(r[f"hi_{d}"] for r in seen) - min(r[f"lo_{d}"] for r in seen) for d in dims]
        facts = []
        for r in seen:
            k = leaves[r["node"]]
            widest = max(range(len(dims)), key=lambda i, r=r: (r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"]) / (root[i] or 1))
            facts.append((r["node"], widest, r["bytes"] * (k // 2) / k))
        groups = split(groups, dims, facts)
        leaves = {child: m for node, k in leaves.items() for child, m in ((2 * node + 1, k // 2), (2 * node + 2, k - k // 2))}
        ready = [node for node, k in leaves.items() if k == 1]
        if ready and len(ready) < len(leaves):
            done.append(groups.join(F.broadcast(small(groups, [(x,) for x in ready], "node long")), "node"))
            groups = groups.join(F.broadcast(small(groups, [(x,) for x in ready], "node long")), "node", "left_anti")
            leaves = {node: k for node, k in leaves.items() if k > 1}
    placed = groups.select(*by, "piece", "node")
    for d in done:
        placed = placed.unionByName(d.select(*by, "piece", "node"))
    numbers = placed.select("node").distinct().collect()  # a row for each shard
    shard_of = small(rows, [(r["node"], k) for k, r in enumerate(sorted(numbers))], "node long, shard int")
    found = rows.join(placed, [*by, "piece"]).join(F.broadcast(shard_of), "node")
    placed = ranged(found.select("doc_id", "size", "text_crc32", "shard", "row_id"), ["shard", "doc_id", "row_id"], "kd-placed")
    before = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition and shard
    return placed.join(F.broadcast(before), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at") - F.col("first_at")).cast("long").alias("slot"))


def small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each node, which are at most twice the shards."""
    return df.sparkSession.createDataFrame(rows, schema)


def split(groups: DataFrame, dims: list[str], facts: list[tuple[int, int, float]]) -> DataFrame:
    """Groups of node k go to node 2k + 1 up to its cut in the order of the widest dimension, else to 2k + 2; ``facts``: node, widest dimension, bytes to the left."""
    wide = groups.join(F.broadcast(small(groups, facts, "node long, widest int, need double")), "node")
    order = ["v", "text_crc32", "h", "piece"]
    placed = ranged(wide.withColumn("v", F.element_at(F.array(*dims), F.col("widest") + 1)).drop("widest", "need"), ["node", *order], "kd-level")
    sums = placed.groupBy("node", "part").agg(F.sum("size").alias("s")).orderBy("node", "part").collect()  # partitions and nodes: a bounded number
    need = {node: bytes_ for node, _, bytes_ in facts}
    before: dict[int, int] = {}
    where = []
    for r in sums:
        b = before.get(r["node"], 0)
        if b < need[r["node"]] <= b + r["s"]:
            where.append((r["node"], r["part"], need[r["node"]] - b))
        before[r["node"]] = b + r["s"]
    inside = placed.join(F.broadcast(small(groups, where, "node long, part long, rest double")), ["node", "part"])
    running = F.sum("size").over(Window.partitionBy("node", "part").orderBy("at"))
    near = inside.withColumn("run", running).where(F.col("run") - F.col("size") / 2 <= F.col("rest"))  # the cut nearest to the bytes asked for
    found = {r["node"]: r["at"] for r in near.groupBy("node").agg(F.max("at").alias("at")).collect()}
    cuts = [(node, part, found.get(node, -1)) for node, part, _ in where]
    both = placed.join(F.broadcast(small(groups, cuts, "node long, cut_part long, cut_at long")), "node", "left")
    left = (F.col("part") < F.col("cut_part")) | ((F.col("part") == F.col("cut_part")) & (F.col("at") <= F.col("cut_at")))
    return both.withColumn("node", F.col("node") * 2 + F.when(left, 1).otherwise(2)).drop("part", "at", "v", "cut_part", "cut_at")
