"""MinHash near-duplicate detection by a multi-index Hamming join (operator 1).

A document is the set of its word shingles. Sets that are equal form one class; a class has a signature
of ``n_hashes`` minima, each cut to 16 bits (b-bit minwise hashing), so two classes of similarity s differ in
about (1 - s) of the positions. The distance allowed, ``n_hashes * (1 - s)`` and 4.2 standard deviations,
is split by pigeonhole: chunks each allow one error, so that within the allowed distance some chunk has at
most one; the errors are enumerated by leaving out one position of the chunk in turn, which stands for all
values that it could take. So each class has ``n_hashes`` keys, and every pair within the allowed signature
distance shares a key.

No group is expanded into pairs. Each key's members meet the first member of the key in one order by hash, which
is the same for all keys, so that members of a large group that share many keys meet few partners. Pairs within the
signature distance are confirmed on full shingle sets, and confirmed links merge into components. Keys that then still
hold more than one component are gone through in full: up to ``SPLIT`` members as pairs across components, confirmed in
the same way; larger ones, and what these connect, are split into blocks of about ``BLOCK`` members and ``BLOCK_BYTES``
that meet each other in a task of two blocks, which counts common shingles over an index and returns no more links than
merge its components. What is skipped is only pairs that are already connected. Components are found by contraction.

Defined results: texts without words, and null texts, have an empty set and link with nothing; texts with
fewer words than a shingle have one shingle, the whole; repeated rows and repeated ids are one document;
a null id is never linked; an empty table gives no rows; other columns are kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import encoded, materialize, mix64, parallelism, sliced, small_batches, small_broadcasts

SPLIT, BLOCK, BLOCK_BYTES = 24, 768, 2_000_000
_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, with a bounded memory of those seen."""
    if len(_words) > 200_000:
        _words.clear()
    get, out = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))))
    with np.errstate(over="ignore"):
        for j in range(min(k, len(h))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


class Scheme:
    """Signature and keys for a similarity threshold."""

    def __init__(self, similarity: float, n_hashes: int = 64) -> None:
        self.n = n_hashes
        p = 1 - similarity
        self.most = math.floor(n_hashes * p + 4.2 * math.sqrt(n_hashes * p * (1 - p)))
        n_chunks = max(1, min(n_hashes // 2, -(-(self.most + 1) // 2)))  # each allows one error: n_chunks * 2 > most
        self.chunks = [c.tolist() for c in np.array_split(np.arange(n_hashes), n_chunks)]
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(1, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n_hashes, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        low = np.full(self.n, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 4096):
                low = np.minimum(low, (s[None, at : at + 4096] * self.a[:, None] + self.b[:, None]).min(1))
        return (mix64(low) & np.uint64(0xFFFF)).astype("<u2")

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """Keys of each row of signatures: for each chunk, its positions but one."""
        out = np.empty(sig.shape, np.int64)
        at = 0
        with np.errstate(over="ignore"):
            for c in self.chunks:
                for gone in c:
                    h = np.full(len(sig), np.uint64(gone + 1))
                    for j in c:
                        if j != gone:
                            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j].astype(np.uint64))
                    out[:, at] = h.view(np.int64)
                    at += 1
        return out


def signed(docs: DataFrame, scheme: Scheme, k: int, text: str, key: str) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (digest of the set) and ``sig`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                n, digests, sigs = [], [], []
                for t in encoded(b.column(1)):
                    s = shingles(t, k)
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_intdigest(s.tobytes()))
                    sigs.append(scheme.signature(s).tobytes() if len(s) else None)
                half = lambda shift: np.array([(d >> shift) & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(half(64)), pa.array(half(0)), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def live_keys(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """``key, id, pivot`` of keys with two members or more; pivot is the key's first member in the order of ``xxhash64(id)``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, scheme.n)
            if len(sig):
                keys = scheme.keys(sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), scheme.n))], names=["key", "id"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by (key, hash): a run's first row is its pivot; one row is held back to see whether a run goes on
        last: tuple[int, int] | None = None
        pivot, shown = 0, False
        for b in batches:
            key, id_ = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[:1] = last is None or key[0] != last[0] if len(key) else new[:1]
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            pivots = np.where(which >= 0, id_[starts[np.maximum(which, 0)]] if len(starts) else 0, pivot)
            follows = ~new
            # a run's first row is written when its second row is seen
            firsts = np.flatnonzero(follows & np.append(True, new[:-1])) if len(key) else np.zeros(0, int)
            k2, i2, p2 = [key[follows]], [id_[follows]], [pivots[follows]]
            for f in firsts:
                if f == 0:
                    if last is not None and not shown:
                        k2.append(key[:1])
                        i2.append(np.array([pivot]))
                        p2.append(np.array([pivot]))
            own = firsts[firsts > 0]
            k2.append(key[own - 1])
            i2.append(id_[own - 1])
            p2.append(id_[own - 1])
            if len(key):
                shown = bool(follows[-1])
                pivot = int(pivots[-1])
                last = (int(key[-1]), int(id_[-1]))
            out = [np.concatenate(x) for x in (k2, i2, p2)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["key", "id", "pivot"])

    n = parallelism(reps.sparkSession)
    keyed = reps.where("sig is not null").select("id", "sig").mapInArrow(spread, "key long, id long").repartition(n, "key")
    return keyed.sortWithinPartitions("key", F.xxhash64("id"), "id").mapInArrow(runs, "key long, id long, pivot long")


def close(pairs: DataFrame, sigs: DataFrame, scheme: Scheme) -> DataFrame:
    """The rows of ``pairs`` (a, b, more) within the allowed signature distance."""
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, scheme.n) for c in ("sa", "sb"))
            near = (x != y).sum(1) <= scheme.most
            yield b.select(kept).filter(pa.array(near))

    s = sigs.select("id", "sig")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    return both.select(*kept, "sa", "sb").mapInArrow(run, pairs.schema)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, more) whose full shingle sets have the similarity: exact, in hundredths."""
    percent, kept = round(similarity * 100), pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            held: dict[int, np.ndarray] = {}
            keep = []
            for a, c, x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("ta"), b.column("tb"), strict=True):
                if len(held) > 500:
                    held.clear()
                for i, z in ((a, x), (c, y)):
                    if i not in held:
                        held[i] = shingles(unpack(z.as_py()), k)
                common = len(np.intersect1d(held[a], held[c], assume_unique=True))
                keep.append(100 * common >= percent * (len(held[a]) + len(held[c]) - common))
            yield b.select(kept).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("packed").alias("tb")), "b")
    return both.select(*kept, "ta", "tb").mapInArrow(run, pairs.schema)


def block_links(hot: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """``ca, cb``: links between components among the members of large keys (``id, component, pivot``), block by block."""
    percent = round(similarity * 100)
    group = components(hot.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    of = materialize(hot.select("id", "component").distinct().join(group.withColumnRenamed("component", "grp"), "id").join(texts.select("id", "bytes"), "id"), "dup-groups")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    placed = of.join(of.groupBy("grp").agg(blocks.alias("blocks"), F.countDistinct("component").alias("n")).where("n > 1"), "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "component", "grp", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        ids, comp, block = (t.column(c).to_pylist() for c in ("id", "component", "block"))
        hi = t.column("hi")[0].as_py()
        two = t.column("lo")[0].as_py() != hi
        sets = [shingles(unpack(x.as_py()), k) for x in t.column("packed")]
        right = [i for i in range(len(ids)) if not two or block[i] == hi]
        sizes = np.array([len(sets[i]) for i in right], np.int64)
        owner = np.repeat(np.arange(len(right)), sizes)
        every = np.concatenate([sets[i] for i in right] or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        out: list[tuple[int, int]] = []
        for i in range(len(ids)):
            if two and block[i] == hi:
                continue
            a, b = np.searchsorted(every, sets[i]), np.searchsorted(every, sets[i], side="right")
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            common = np.bincount(owner[at], minlength=len(right))
            for j in np.flatnonzero(100 * common >= percent * (sizes + len(sets[i]) - common)).tolist():
                x, y = root(comp[i]), root(comp[right[j]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(x, y), max(x, y)))
        return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["ca", "cb"])

    return met.join(texts.select("id", "packed"), "id").groupBy("grp", "lo", "hi").applyInArrow(compare, "ca long, cb long")


def packed_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``id, packed, bytes``: each text compressed, so that it moves and is kept small, and the size of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [pack(t) for t in encoded(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), pa.array(map(len, texts), pa.int64())], names=["id", "packed", "bytes"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null").mapInArrow(run, "id long, packed binary, bytes long")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``id, component`` (smallest id reachable) of the ids in ``links`` (a, b), by contraction.

    In a round each node joins that of its neighbours and itself which an order by hash puts first, and links are led
    over to these; a node stays only if it comes before all its neighbours, so each round leaves half the nodes at
    most, and far fewer in dense groups. The first round's order is the one that chooses pivots, so what links to one
    pivot becomes one node at once; later rounds have an order each. Then the rounds' labels are put together from the last to the first.
    """
    links = materialize(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct(), "cc-links")
    labels: list[DataFrame] = []
    while not links.isEmpty():
        if len(labels) == most_rounds:
            raise RuntimeError("components did not settle")
        order = lambda c: F.xxhash64(F.col(c), *[F.lit(len(labels))] * bool(labels))  # noqa: E731, B023
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", order("v")).alias("v"))
        label = materialize(first.select(F.col("u").alias("id"), F.when(order("v") < order("u"), F.col("v")).otherwise(F.col("u")).alias("label")), "cc-labels")
        x, y = (label.select(F.col("id").alias(n), F.col("label").alias("l" + n)) for n in "uv")
        led = links.join(x, "u").join(y, "v").where("lu != lv")
        links = materialize(led.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "cc-links")
        labels.append(label)
    if not labels:
        return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = labels.pop()
    while labels:
        later = out.select(F.col("id").alias("label"), F.col("label").alias("root"))
        out = labels.pop().join(later, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    out = materialize(out, "cc-roots")
    return out.join(out.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component")


def found_classes(docs: DataFrame, *, shingle_words: int, similarity: float, n_hashes: int, text: str, key: str) -> DataFrame:
    scheme = Scheme(similarity, n_hashes)
    signs = materialize(signed(docs, scheme, shingle_words, text, key), "dup-signs")
    reps = materialize(signs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "dup-classes")
    live = materialize(live_keys(reps, scheme), "dup-keys")
    ids = live.select("id").distinct()
    texts = materialize(packed_texts(docs, text, key).join(ids, "id", "left_semi").dropDuplicates(["id"]), "dup-texts")

    tried = materialize(close(live.where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), reps, scheme), "dup-pairs")
    with small_batches(docs.sparkSession):
        of = materialize(components(confirmed(tried, texts, shingle_words, similarity)), "dup-components")

    member = live.join(of, "id", "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("component"))
    open_ = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi and n > 2").select("key", "n")
    rest = materialize(member.join(open_, "key"), "dup-open")
    few = rest.where((F.col("n") <= SPLIT) & (F.col("id") != F.col("pivot")))  # the pivot has met all
    x, y = few.select("key", F.col("id").alias("a"), F.col("component").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    across = x.join(y, "key").where("a < b and ca != cb").select("a", "b", "ca", "cb").distinct()
    more = confirmed(close(across, reps, scheme), texts, shingle_words, similarity).select("ca", "cb")
    more = more.unionByName(block_links(rest.where(F.col("n") > SPLIT), texts, shingle_words, similarity))
    with small_batches(docs.sparkSession):
        merged = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("root"))
    named = reps.select("d1", "d2", "id").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rep_of = named.join(merged, "component", "left").select("d1", "d2", F.coalesce("root", "component").alias("component_id"))
    out = signs.where("n_shingles > 0 and doc_id is not null").join(rep_of, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def classes_of(docs: DataFrame, *, shingle_words: int, similarity: float, n_hashes: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row."""
    with small_broadcasts(docs.sparkSession):  # written inside, as a plan takes the limit of when it runs
        return materialize(found_classes(docs, shingle_words=shingle_words, similarity=similarity, n_hashes=n_hashes, text=text, key=key), "dup-found")


def drop_near_duplicates(docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents of which no smaller id is a near-duplicate, with all their columns."""
    gone = classes_of(docs, shingle_words=shingle_words, similarity=similarity, text=text, key=key).where("not kept").select(F.col("doc_id").alias("__dup_id")).distinct()
    return docs.join(gone.hint("merge"), docs[key] == gone["__dup_id"], "left_anti")  # ids that go grow with the input: never broadcast
