"""Exact top-k inner-product search with M-trees (operator 10).

Components become integers; inner products are exact. Vectors are laid in a metric space by the usual
augmentation: with M the largest norm, v gets the coordinate sqrt(M^2 - |v|^2) and a query 0, so that
distance^2 = |q|^2 + M^2 - 2 <q, v> falls as the product grows. Spark sorts the vectors by their nearest
pivot (of a bounded sample) and the distance to it, and cuts that order into pages. A page is an M-tree
node of nodes: routing objects with covering radii and each entry's distance to its parent.

Every query meets every group of pages, in blocks, under a bound that its best products with the sampled
vectors already give. A page, then a node, is opened in order of its least possible distance and skipped
when that is beyond the bound; an entry is skipped, unseen, when the difference between its parent distance
and the query's distance to that parent is beyond it. Bounds carry a slack, so rounding can't lose a tie.

Defined results: vectors that are null, empty, hold null or non-finite components, or have no id take no part; a query
meets vectors of its own length only; rows that share the query's id are its own; repeated rows are each a candidate and, with an id that is asked for, each a query with rows of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import materialize, parallelism

FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
PAGE = T.StructType([T.StructField("page", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType()), T.StructField("router", T.BinaryType()), T.StructField("radius", T.DoubleType()), T.StructField("routers", T.BinaryType()), T.StructField("radii", T.BinaryType()), T.StructField("parent_d", T.BinaryType()), T.StructField("starts", T.BinaryType()), T.StructField("entry_d", T.BinaryType())])
SLACK = 1e-6


def integers(vectors: DataFrame, *, scale: int, key: str, column: str) -> DataFrame:
    """``vec_id``, ``dim`` and the integer vector of the rows that take part."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad).select(F.col(key).cast("long").alias("vec_id"), F.size(x).alias("dim"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal length as float64, in which integers below 2^53 are exact."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; Python integers where 53 bits could overflow."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[-1] < 2**53:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=object)


class Space:
    """Distances of the augmented space under a largest norm."""

    def __init__(self, most: float) -> None:
        self.most = most

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.most**2 - (v * v).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def build(ids: np.ndarray, v: np.ndarray, space: Space, fan: int) -> dict:
    """One page: entries in groups around routing objects that lie far from each other."""
    x = space.lift(v)
    centre = int(np.argmin(distances(x, x.mean(0)[None])[:, 0]))
    from_centre = distances(x, x[centre : centre + 1])[:, 0]
    picks, near = [centre], from_centre.copy()
    while len(picks) < min(fan, len(x)) and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[picks[-1] :][:1])[:, 0])
    d = distances(x, x[picks])
    owner = d.argmin(1)
    order = np.lexsort((ids, owner))
    own_d = d[np.arange(len(x)), owner][order]
    starts = np.searchsorted(owner[order], np.arange(len(picks) + 1))
    radii = np.array([own_d[a:b].max() if b > a else 0.0 for a, b in zip(starts, starts[1:])])
    return {"ids": ids[order].astype("<i8").tobytes(), "vectors": v[order].astype("<f8").tobytes(), "router": x[centre].tobytes(), "radius": float(from_centre.max()), "routers": x[picks].tobytes(), "radii": radii.tobytes(), "parent_d": from_centre[picks].tobytes(), "starts": starts.astype("<i4").tobytes(), "entry_d": own_d.tobytes()}


class Page:
    def __init__(self, row: dict) -> None:
        read = lambda name, kind="<f8": np.frombuffer(row[name], kind)
        self.dim, self.radius = row["dim"], row["radius"]
        self.ids, self.v = read("ids", "<i8"), read("vectors").reshape(-1, self.dim)
        self.router, self.routers = read("router"), read("routers").reshape(-1, self.dim + 1)
        self.radii, self.parent_d, self.starts, self.entry_d = read("radii"), read("parent_d"), read("starts", "<i4"), read("entry_d")


def best(query_id: int, q: np.ndarray, floor_: float, pages: list[Page], to_router: np.ndarray, most: float, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) in the pages that are at least ``floor_``, by best-first search."""
    top: list[tuple[int, int]] = []  # (score, -id): the worst first
    x = np.append(q, 0.0)
    norm2 = float(q @ q) + most**2
    reach = lambda: np.sqrt(max(norm2 - 2 * float(max(floor_, top[0][0] if len(top) == k else floor_)), 0.0)) + SLACK * (1 + np.sqrt(norm2))  # noqa: E731  distance at the bound
    queue = [(max(float(d) - p.radius, 0.0), n, -1) for n, (d, p) in enumerate(zip(to_router, pages, strict=True))]
    heapq.heapify(queue)
    while queue:
        least, n, node = heapq.heappop(queue)
        p, r = pages[n], reach()
        if least > r:
            break
        if node < 0:
            # a routing object whose parent distance alone rules it out isn't compared
            maybe = np.flatnonzero(np.abs(to_router[n] - p.parent_d) - p.radii <= r)
            if len(maybe):
                d = distances(x[None], p.routers[maybe])[0]
                for j, dj in zip(maybe, d, strict=True):
                    if (low := max(float(dj) - p.radii[j], 0.0)) <= r:
                        heapq.heappush(queue, (low, n, int(j)))
            continue
        a, b = p.starts[node], p.starts[node + 1]
        dj = float(np.sqrt(((x - p.routers[node]) ** 2).sum()))
        maybe = a + np.flatnonzero(np.abs(dj - p.entry_d[a:b]) <= r)
        if not len(maybe):
            continue
        for s, i in zip(products(q[None], p.v[maybe])[0].tolist(), p.ids[maybe].tolist(), strict=True):
            if i != query_id and s >= floor_:
                item = (int(s), -i)
                if len(top) < k:
                    heapq.heappush(top, item)
                elif item > top[0]:
                    heapq.heapreplace(top, item)
    return [(s, -i) for s, i in top]


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, n_pivots: int = 128, page_rows: int = 1024, fan: int = 16, group_pages: int = 32, block: int = 2048, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of every row whose id is divisible by ``every``.

    ``n_pivots`` bounds the sample that pages are laid around; every vector is in a page.
    """
    spark = vectors.sparkSession
    all_ = materialize(integers(vectors, scale=scale, key=key, column=column).withColumn("row", F.monotonically_increasing_id()), "mtree-vectors")  # written, so a row keeps its number
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    dims = all_.groupBy("dim").agg(F.max(F.sqrt(norm)).alias("most"), F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # a row for each vector length
    found = None
    for row in dims:
        dim, n = row["dim"], row["n"]
        most = float(row["most"]) * (1 + 1e-9) + 1e-9
        mine = all_.where(F.col("dim") == dim)
        sample = mine.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(n_pivots).toArrow()
        pages = materialize(paged(mine, dim, most, matrix(sample.column("v"), dim), page_rows, fan), "mtree-pages")
        groups = max(1, -(-n // (page_rows * group_pages)))
        blocks = max(1, -(-n // (every * block)))
        part = searched(mine, pages, dim, most, sample, k, every, groups, blocks)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")  # at most k rows from each group of pages
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def paged(mine: DataFrame, dim: int, most: float, pivots: np.ndarray, page_rows: int, fan: int) -> DataFrame:
    """M-tree pages of all vectors: sorted by nearest pivot and distance, cut where a page is full."""
    space = Space(most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = space.lift(pivots)
        for b in batches:
            d = distances(space.lift(matrix(b.column(1), dim)), p)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "v", "pivot", "d"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                ids = t.column("vec_id").to_numpy()
                x = build(ids, matrix(t.column("v"), dim), space, fan)
                yield pa.RecordBatch.from_pylist([{"page": int(ids[0]), "dim": dim, **x}], schema=to_arrow(PAGE))
                held.clear()

        for b in batches:
            pivot = b.column("pivot").to_numpy()
            a = 0
            while a < len(pivot):
                if held and held[0].column("pivot")[0].as_py() != pivot[a]:
                    yield from flush()
                room = page_rows - sum(h.num_rows for h in held)
                end = min(a + room, int(np.searchsorted(pivot, pivot[a], side="right")))
                held.append(b.slice(a, end - a))
                a = end
                if sum(h.num_rows for h in held) >= page_rows:
                    yield from flush()
        yield from flush()

    placed = mine.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, pivot int, d double")
    order = ["pivot", "d", "vec_id"]
    return placed.repartitionByRange(parallelism(mine.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(cut, PAGE)


def to_arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def searched(mine: DataFrame, pages: DataFrame, dim: int, most: float, sample: pa.Table, k: int, every: int, groups: int, blocks: int) -> DataFrame:
    """The k best of each query in each group of pages."""
    sample_ids, sample_v = sample.column("vec_id").to_numpy(), matrix(sample.column("v"), dim)

    def run(_key: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        held = [Page(r) for r in found.to_pylist()]
        if held and queries.num_rows:
            q = matrix(queries.column("v"), dim)
            routers = np.array([p.router for p in held])
            to_router = distances(np.hstack([q, np.zeros((len(q), 1))]), routers)
            seen = products(q, sample_v)
            for i, (query_id, row) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("row").to_pylist(), strict=True)):
                others = np.sort(seen[i][sample_ids != query_id])
                floor_ = others[-k] if len(others) >= k else -np.inf
                out += ((query_id, row, v, s) for s, v in best(query_id, q[i], floor_, held, to_router[i], most, k))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], [], []))], names=FOUND.names)

    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    both = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = mine.where(F.col("vec_id") % every == 0).select("vec_id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), each.alias("grp"))
    spread = pages.withColumn("grp", F.pmod(F.xxhash64("page"), F.lit(groups)).cast("int")).withColumn("block", both)
    return queries.groupBy("grp", "block").cogroup(spread.groupBy("grp", "block")).applyInArrow(run, FOUND)
