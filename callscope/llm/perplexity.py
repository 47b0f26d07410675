"""Perplexity filter by an interpolated modified Kneser-Ney bigram model (operator 2).

The model is trained on trusted text: all documents that the labels call good, but for a quarter of them that
calibrates. Words are hashed to ``2^VOCABULARY`` classes, so what is kept for each word (its total, its
discounted mass, its continuations) are arrays of a fixed size, which are broadcast; bigrams are a pair of
classes, whose counts grow with the corpus and stay in shards.

    P(w | v) = max(c(vw) - D, 0) / c(v) + g(v) * N1+(.w) / N1+(..)

with the three discounts of modified Kneser-Ney from the counts of counts. A document's log-probability is the
sum of log(g(v) P1(w)) over its bigrams, which its own task knows, and of a gain for those bigrams that the model has seen,
which is joined: tasks send each shard the sorted keys and document numbers of a batch as one compressed block, and the
shard answers with a sum for each document. A filter of fixed size (``FILTER`` bits) over the seen bigrams keeps most others from being
sent; it never loses a seen one, so results don't depend on it.

A document is kept if its perplexity is at most the ``quantile`` of the held-out trusted documents of its language, however many
those are, or of all where a language has none.

Defined results: a text with fewer than two words has no perplexity and is kept; null texts count as empty; a null
language is a language of its own; without trusted text every document is kept; repeated rows score alike (a repeated
id takes one row's language); a null id is scored by itself; an empty table gives no rows; other columns are ignored, or kept by ``keep_fluent``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import encoded, materialize, mix64, parallelism, sliced

VOCABULARY, FILTER = 20, 27  # bits
_classes: dict[bytes, int] = {}
BLOCK = "shard int, block long, kind int, payload binary"


def word_classes(words: list[bytes]) -> np.ndarray:
    if len(_classes) > 1_000_000:
        _classes.clear()
    out = list(map(_classes.get, words))
    if None in out:
        mask = (1 << VOCABULARY) - 1
        for i, c in enumerate(out):
            if c is None:
                out[i] = _classes[words[i]] = xxhash.xxh3_64_intdigest(words[i]) & mask
    return np.array(out, np.int64)


def scrambled(pair: np.ndarray) -> np.ndarray:
    """A bijection of bigram keys (2 * VOCABULARY bits) that spreads them evenly."""
    bits, mask = np.uint64(2 * VOCABULARY), np.uint64((1 << 2 * VOCABULARY) - 1)
    x = pair.astype(np.uint64)
    with np.errstate(over="ignore"):
        for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            x = (x * np.uint64(m | 1)) & mask
            x ^= x >> (bits // np.uint64(2))
    return x


def unscrambled(x: np.ndarray) -> np.ndarray:
    bits, mask = np.uint64(2 * VOCABULARY), np.uint64((1 << 2 * VOCABULARY) - 1)
    with np.errstate(over="ignore"):
        for m in (0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15):
            x = x ^ (x >> (bits // np.uint64(2)))
            x = (x * np.uint64(pow(m | 1, -1, 1 << 2 * VOCABULARY))) & mask
    return x.astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of a block, each split into byte planes, compressed."""
    planes = [np.frombuffer(c.astype(c.dtype.newbyteorder("<")).tobytes(), np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.frombuffer(raw[: n * size].reshape(size, n).T.tobytes(), k))
        raw = raw[n * size :]
    return out


def bigrams(text: bytes) -> np.ndarray:
    """Keys of the adjacent word pairs of a text; ASCII lower case."""
    c = word_classes(text.lower().split())
    return c[:-1] << VOCABULARY | c[1:]


def by_shard(x: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted scrambled keys."""
    edges = (np.arange(shards + 1, dtype=np.float64) * (1 << 2 * VOCABULARY) / shards).astype(np.uint64)
    return np.searchsorted(x, edges)


def rows_out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "block", "kind", "payload"])


def counted(trusted: DataFrame, shards: int) -> DataFrame:
    """Bigram counts of all trusted texts: one row a shard, ``shard, n, keys, counts`` sorted by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", 16_000_000):
                keys, n = np.unique(scrambled(np.concatenate([bigrams(t) for t in encoded(b.column(0))] or [np.zeros(0, np.int64)])), return_counts=True)
                at = by_shard(keys, shards)
                rows = []
                for s in range(shards):
                    k, c = keys[at[s] : at[s + 1]], n[at[s] : at[s + 1]]
                    if len(k):
                        rows.append((s, len(k), 0, packed(np.diff(k, prepend=np.uint64(0)), c.astype("<u4"))))
                yield rows_out(rows)

    def merge(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate([keys, *(x for x, _ in held)]), return_inverse=True)
            return k, np.bincount(inverse.ravel(), np.concatenate([counts, *(c for _, c in held)]), len(k)).astype(np.int64)

        for b in batches:
            for r in b.to_pylist():
                shard = r["shard"]
                d, c = unpacked(r["payload"], r["block"], "<u8", "<u4")
                held.append((np.cumsum(d, dtype=np.uint64), c.astype(np.int64)))
                if sum(len(x) for x, _ in held) > 2_000_000:
                    keys, counts = fold()
                    held.clear()
        keys, counts = fold()
        yield rows_out([(shard, len(keys), 0, packed(np.diff(keys, prepend=np.uint64(0)), counts.astype("<u4")))])

    return trusted.select("text").mapInArrow(count, BLOCK).groupBy("shard").applyInArrow(merge, BLOCK)


class Model:
    """What is kept for each word class, and the filter of seen bigrams: all of fixed size."""

    def __init__(self, discounts: np.ndarray, total: np.ndarray, mass: np.ndarray, continuation: np.ndarray, seen: np.ndarray) -> None:
        self.discounts, self.total, self.mass, self.continuation, self.seen = discounts, total, mass, continuation, seen

    def ready(self) -> Model:
        """With what follows from the sums; tasks derive it, so that it isn't sent."""
        if not hasattr(self, "p1"):
            n1 = max(1.0, float(self.continuation.sum(dtype=np.float64)))
            # unseen classes share one more continuation, so nothing has probability 0
            self.p1 = ((self.continuation + 1.0 / len(self.continuation)) / (n1 + 1.0)).astype(np.float32)
            self.backoff = np.where(self.total > 0, self.mass / np.maximum(self.total, 1), 1.0).astype(np.float32)
            self.log_low = np.log(np.maximum(self.backoff, 1e-9))
            self.log_p1 = np.log(self.p1)
        return self

    def base(self, pair: np.ndarray) -> np.ndarray:
        return self.log_low[pair >> VOCABULARY] + self.log_p1[pair & ((1 << VOCABULARY) - 1)]

    def gain(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What a seen bigram's log-probability has over its base."""
        v, w = pair >> VOCABULARY, pair & ((1 << VOCABULARY) - 1)
        low = np.maximum(self.backoff[v], 1e-9).astype(np.float64) * self.p1[w]
        d = self.discounts[np.minimum(count, 3)]
        return np.log1p(np.maximum(count - d, 0) / np.maximum(self.total[v], 1) / low)

    def maybe(self, x: np.ndarray) -> np.ndarray:
        bit = x >> np.uint64(2 * VOCABULARY - FILTER)
        return (self.seen[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def discounts_of(n: list[int]) -> np.ndarray:
    """D for counts 0 to 3 and more, from n1 to n4 (numbers of bigrams seen that often)."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def model_of(counts: DataFrame) -> Model:
    """The statistics of all shards, summed by Spark to arrays of a fixed size."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << VOCABULARY
        for b in batches:
            for r in b.to_pylist():
                d, c = unpacked(r["payload"], r["block"], "<u8", "<u4")
                x = np.cumsum(d, dtype=np.uint64)
                pair, c = unscrambled(x), c.astype(np.int64)
                v, w = pair >> VOCABULARY, pair & (size - 1)
                cols = [np.bincount(v, c, size), *(np.bincount(v[c == k], minlength=size) for k in (1, 2)), np.bincount(v[c > 2], minlength=size), np.bincount(w, minlength=size)]
                on = np.flatnonzero(cols[0] + cols[4])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(on), np.int32)), pa.array(on), *(pa.array(k[on].astype(np.int64)) for k in cols)], names=names)
                n = [int((c == k).sum()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([0]), *(pa.array([k]) for k in (*n, 0))], names=names)

    names = ["kind", "at", "c", "n1", "n2", "n3", "cont"]
    parts = counts.mapInArrow(words, "kind int, at long, c long, n1 long, n2 long, n3 long, cont long").groupBy("kind", "at")
    summed = materialize(parts.agg(*[F.sum(n).alias(n) for n in names[2:]]), "lm-sums")  # at most 2^VOCABULARY + 1 rows

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard is a range of keys, so its part of the filter is a range of words
        for b in batches:
            for r in b.to_pylist():
                if r["block"]:
                    d, _ = unpacked(r["payload"], r["block"], "<u8", "<u4")
                    bit = np.cumsum(d, dtype=np.uint64) >> np.uint64(2 * VOCABULARY - FILTER)
                    at, first = np.unique(bit >> np.uint64(6), return_index=True)
                    low, high = int(at[0]), int(at[-1])
                    part = np.zeros(high - low + 1, np.uint64)
                    part[(at - np.uint64(low)).astype(np.int64)] = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
                    yield rows_out([(r["shard"], low, len(part), zstandard.ZstdCompressor(level=1).compress(part.tobytes()))])

    tops = summed.where("kind = 1").select("c", "n1", "n2", "n3").first() or (0, 0, 0, 0)
    d = discounts_of([int(x) for x in tops])
    size = 1 << VOCABULARY
    mass = d[1] * F.col("n1") + d[2] * F.col("n2") + d[3] * F.col("n3")
    t = summed.where("kind = 0").select(F.col("at").cast("int").alias("at"), F.col("c").cast("double").alias("total"), mass.cast("float").alias("mass"), F.col("cont").cast("float").alias("cont")).toArrow()
    dense = []
    for name in ("total", "mass", "cont"):
        x = t.column(name).to_numpy()
        dense.append(np.zeros(size, x.dtype))
        dense[-1][t.column("at").to_numpy()] = x
    seen = np.zeros(1 << (FILTER - 6), np.uint64)
    for r in counts.mapInArrow(filters, BLOCK).toLocalIterator():  # 2^(FILTER - 3) bytes in all
        seen[r["block"] : r["block"] + r["kind"]] |= np.frombuffer(zstandard.ZstdDecompressor().decompress(r["payload"]), np.uint64)
    return Model(d, *dense, seen)


def scored(docs: DataFrame, counts: DataFrame, model: Model, shards: int) -> DataFrame:
    """``doc_id, lang, n_bigrams, log_p`` of each row of ``docs`` (doc_id, lang, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    meta = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("log_p", pa.float64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, part, block = held.value.ready(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in sliced(whole, "text", 16_000_000):
                n, base, pairs = [], [], []
                for t in encoded(b.column(2)):
                    p = bigrams(t)
                    n.append(len(p))
                    base.append(float(m.base(p).sum()))
                    pairs.append(p)
                x = scrambled(np.concatenate(pairs))
                doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
                on = m.maybe(x)
                x, doc = x[on], doc[on]
                order = np.lexsort((doc, x))
                x, doc = x[order], doc[order]
                at = by_shard(x, shards)
                name = part << 24 | block
                rows = [(s, name, 1, (at[s + 1] - at[s]).astype("<u4").tobytes() + packed(np.diff(x[at[s] : at[s + 1]], prepend=np.uint64(0)), doc[at[s] : at[s + 1]])) for s in range(shards) if at[s + 1] > at[s]]
                facts = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(base, pa.float64())], schema=meta)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, meta) as w:
                    w.write_batch(facts)
                yield rows_out([*rows, (name % shards, name, 2, sink.getvalue().to_pybytes())])
                block += 1

    def answer(_key: tuple, asked: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, keys, seen = held.value.ready(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch_ in asked:  # the shard's counts come first
            for r in batch_.to_pylist():
                if r["kind"] == 0:
                    d, c = unpacked(r["payload"], r["block"], "<u8", "<u4")
                    keys = np.cumsum(d, dtype=np.uint64)
                    seen = m.gain(unscrambled(keys), c.astype(np.int64))
                elif r["kind"] == 1:
                    n = int(np.frombuffer(r["payload"][:4], "<u4")[0])
                    d, doc = unpacked(r["payload"][4:], n, "<u8", "<u4")
                    x = np.cumsum(d, dtype=np.uint64)
                    at = np.searchsorted(keys, x)
                    hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == x) if len(keys) else np.zeros(n, bool)
                    gain = np.bincount(doc[hit], seen[at[hit]]).astype("<f4")
                    yield rows_out([(r["shard"], r["block"], 1, zstandard.ZstdCompressor(level=1).compress(gain.tobytes()))])
                else:
                    yield rows_out([(r["shard"], r["block"], 2, r["payload"])])

    def total(t: pa.Table) -> pa.Table:
        facts, gains = None, []
        for kind, payload in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
            if kind == 2:
                facts = pa.ipc.open_stream(payload).read_all()
            else:
                gains.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "<f4"))
        log_p = facts.column("log_p").to_numpy().copy()
        for g in gains:
            log_p[: len(g)] += g
        return pa.table([facts.column("doc_id"), facts.column("lang"), facts.column("n"), pa.array(log_p)], names=["doc_id", "lang", "n_bigrams", "log_p"])

    asked = docs.select("doc_id", "lang", "text").mapInArrow(ask, BLOCK)
    both = asked.unionByName(counts).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "block")
    parts = both.groupBy("shard").applyInArrow(answer, BLOCK)
    return parts.groupBy("block").applyInArrow(total, "doc_id long, lang string, n_bigrams long, log_p double")  # a block is one batch of texts


def calibrates(key: Column) -> Column:
    """The quarter of trusted documents that sets thresholds."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(5)), F.lit(4)) == 0


def judged(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, label: str = "quality", text: str = "text", key: str = "doc_id", lang: str = "lang", most_ids: int = 4_000_000) -> DataFrame:
    """``doc_id, lang, n_bigrams, perplexity, threshold, kept`` of each document."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    trusted = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id")).distinct()
    training = trusted.where(~calibrates(F.col("doc_id")))
    small = training.count() <= most_ids  # ids are broadcast only up to a checked number; else the join is shuffled
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(parallelism(spark), -(-total // 96_000_000))
    counts = materialize(counted(d.join(F.broadcast(training) if small else training, "doc_id", "left_semi"), shards), "lm-counts")
    scores = materialize(scored(d, counts, model_of(counts), shards).withColumn("perplexity", F.when(F.col("n_bigrams") > 0, F.exp(-F.col("log_p") / F.col("n_bigrams")))), "lm-scores")
    late = trusted.where(calibrates(F.col("doc_id")))
    held = scores.join(F.broadcast(late) if small else late, "doc_id", "left_semi").where("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = held.groupBy(F.col("lang").alias("l")).agg(at.alias("by_lang"))
    overall = held.agg(at.alias("overall")).first()[0]
    out = scores.join(by_lang, scores["lang"].eqNullSafe(by_lang["l"]), "left")
    limit = F.coalesce("by_lang", F.lit(overall).cast("double"))
    return out.select("doc_id", "lang", "n_bigrams", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"))


def keep_fluent(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", **how: object) -> DataFrame:
    """The documents that are kept, with their columns."""
    gone = judged(docs, labels, key=key, **how).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__lm_id")).distinct()
    return docs.join(gone, docs[key] == gone["__lm_id"], "left_anti")
