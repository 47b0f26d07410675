"""Line dedup by winnowing (operator 3).

A text is a sequence of words, parted by ASCII white space; how they are parted doesn't count. Each ``SHINGLE`` words on end
are a shingle. Winnowing: of the shingles that start within a window of ``GUARANTEE - SHINGLE + 1`` words, the one with the
least hash is a fingerprint; a run of ``GUARANTEE`` words or more that stands in two places so gives both the same fingerprint,
wherever sentences and lines begin or end.

Spark finds each fingerprint's first place (least id, then word) with a partial aggregate, and joins it with the
later places. A match is extended word by word both ways by at most ``CONTEXT`` words, which is as far as a run can go on beyond its
first or last fingerprint; only the first places of repeated fingerprints fetch the hashes of the words around them. The matched words
of the later place are deleted, so each run keeps its first place only; a deleted word still stands at an earlier place.

Limits: up to ``CONTEXT`` words at an end of a later run stay where the end's fingerprint has its first place in other
surroundings. A line (which ends at a line break or a sentence's stop) is never cut by itself: where both places begin in one
line of one document, the later stays.

Defined results: null texts stay null, empty ones empty; a text that is wholly a repetition becomes empty, its row stays;
rows with a repeated id are one document, changed alike where they are alike; rows with a null id are never changed; a run repeated inside one
document is deleted too; an empty table gives no rows; all columns stay, ``n_chars`` follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import encoded, materialize, mix64, sliced

GUARANTEE, SHINGLE = 50, 30
CONTEXT = GUARANTEE - SHINGLE
STOPS = re.compile(r"[.!?\n]+")
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def lines(text: str) -> list[str]:
    """The lines of a text; together they are the text."""
    out, at, n = [], 0, len(text)
    for m in STOPS.finditer(text):
        end = m.end()
        if end == n or text[end - 1] == "\n" or text[end].isspace():
            out.append(text[at:end])
            at = end
    if at < n:
        out.append(text[at:])
    return out


def hashes(text: bytes) -> np.ndarray:
    """A hash of each word."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    x = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = (x != 32) & ((x < 9) | (x > 13))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def ahead(x: np.ndarray, n: int, fill: int | np.uint64) -> np.ndarray:
    """``x[i + n]`` at each i."""
    return np.concatenate([x[n:], np.full(min(n, len(x)), fill, x.dtype)])


def shingled(h: np.ndarray, power: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of the ``SHINGLE`` words from each word on, by doubling; the last ones lack words."""
    out, done, x = np.zeros(len(h), np.uint64), 0, h
    with np.errstate(over="ignore"):
        scale = 1
        for bit in range(SHINGLE.bit_length()):
            if SHINGLE >> bit & 1:
                out += np.uint64(scale) * ahead(x, done, 0)
                done += 1 << bit
                scale = scale * power & (1 << 64) - 1
            x = x + np.uint64(power) * ahead(x, 1 << bit, 0)
            power = power * power & (1 << 64) - 1
    return mix64(out)


def slid(x: np.ndarray, n: int, f: Callable, fill: int | np.uint64) -> np.ndarray:
    """``f`` over ``x[i] .. x[i + n - 1]`` at each i."""
    size = 1
    while 2 * size <= n:
        x = f(x, ahead(x, size, fill))
        size *= 2
    return f(x, ahead(x, n - size, fill))


def fingerprints(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each winnowed shingle of texts of hashed words."""
    sizes = np.array([len(x) for x in texts], np.int64)
    h = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(h)) - first
    last = sizes[doc] - SHINGLE  # the last shingle of the text
    valid = at <= last
    g = np.where(valid, np.minimum(shingled(h), NONE - np.uint64(1)), NONE)
    # texts are kept apart by the SHINGLE - 1 words without a shingle, which no window spans
    window = CONTEXT + 1
    least = np.where(valid & ((at + CONTEXT <= last) | (at == 0)), slid(g, window, np.minimum, NONE), 0)
    best = slid(least[::-1], window, np.maximum, 0)[::-1]
    picked = np.flatnonzero(valid & (best == g))
    # neighbours with one hash (a word said again and again): one of a window stands for them
    follows = np.zeros(len(picked), bool)
    follows[1:] = (picked[1:] == picked[:-1] + 1) & (g[picked[1:]] == g[picked[:-1]]) & (doc[picked[1:]] == doc[picked[:-1]])
    if follows.any():
        order = np.arange(len(picked))
        nth = order - np.maximum.accumulate(np.where(follows, 0, order))
        picked = picked[nth % window == 0]
    return g[picked], doc[picked], at[picked].astype(np.int32)


def around(h: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """32-bit hashes of the ``CONTEXT`` words before (-1) or after (1) the shingles at ``at``, the nearest first; 0 where there are no more."""
    to = (at if step < 0 else at + SHINGLE - 1)[:, None] + step * np.arange(1, CONTEXT + 1)[None]
    inside = (to >= 0) & (to < len(h))
    return np.where(inside, (h[np.where(inside, to, 0)] & np.uint64(0xFFFFFFFF)) | np.uint64(1), 0).astype("<u4")


def second(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another hash of the shingles at ``at``, so that no text goes for a collision of the first."""
    return shingled(mix64(h), 0xD6E8FEB86659FD93)[at].view(np.int64)


def standing(h: np.ndarray, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which fingerprints stand at ``at`` in a text; rows with a repeated id may differ."""
    n = len(h) - SHINGLE + 1
    return (at < n) & (np.minimum(shingled(h), NONE - np.uint64(1))[np.minimum(at, max(n - 1, 0))] == fp.view(np.uint64)) if n > 0 else np.zeros(len(at), bool)


def found(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Each fingerprint's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "t", 4_000_000):
                g, row, at = fingerprints([hashes(t) for t in encoded(b.column(1))])
                doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(doc), pa.array(at)], names=["fp", "doc", "at"])

    t = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    return t.mapInArrow(run, "fp long, doc long, at int")


def surrounded(docs: DataFrame, firsts: DataFrame, text: str, key: str) -> DataFrame:
    """``fp, doc0, at0, other, before, after``: first places with another hash of the shingle and those of the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "t", 4_000_000):
                out: list[list] = [[], [], [], [], [], []]
                for d, t, asked in zip(b.column(0).to_pylist(), encoded(b.column(1)), b.column(2), strict=True):
                    h, fp, at = hashes(t), *(asked.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    on = standing(h, fp, at)
                    fp, at = fp[on], at[on]
                    parts = [fp, np.full(len(fp), d, np.int64), at.astype(np.int32), second(h, at), around(h, at, -1), around(h, at, 1)]
                    for o, p in zip(out, parts, strict=True):
                        o.append(p)
                columns = [np.concatenate(x) for x in out]
                wide = [pa.Array.from_buffers(pa.binary(4 * CONTEXT), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in columns[4:]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), *wide], names=["fp", "doc0", "at0", "other", "before", "after"])

    asked = firsts.groupBy("doc0").agg(F.collect_list(F.struct("fp", "at0")).alias("asked"))  # at most as many as the document has words
    t = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    rows = t.join(asked, F.col("d") == F.col("doc0")).select("d", "t", "asked").mapInArrow(run, "fp long, doc0 long, at0 int, other long, before binary, after binary")
    return rows.groupBy("fp").agg(F.max(F.struct("doc0", "at0", "other", "before", "after")).alias("f")).select("fp", "f.*")  # rows with a repeated id say the same


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc, matches``: the later places of fingerprints in each document, with the words around the first place, or ``own``, its first word, if that is in the document too."""
    places = materialize(found(docs, text, key), "line-places")  # read twice
    firsts = materialize(places.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("f")).where("n > 1").select("fp", F.col("f.doc").alias("doc0"), F.col("f.at").alias("at0")), "line-firsts")
    # written first, so that the join has a shuffle of its own, whose hot fingerprints AQE can split
    known = materialize(surrounded(docs, firsts, text, key), "line-surroundings")
    same = F.col("doc") == F.col("doc0")
    both = places.join(known, "fp").where("doc != doc0 or at != at0").select("doc", F.struct("at", "fp", F.when(same, F.col("at0")).alias("own"), F.when(~same, F.col("before")).alias("before"), F.when(~same, F.col("after")).alias("after"), F.when(~same, F.col("other")).alias("other")).alias("m"))
    return both.groupBy("doc").agg(F.collect_set("m").alias("matches"))  # at most as many as the document has words


def gone(text: bytes, h: np.ndarray, start: np.ndarray, matches: pa.StructArray) -> np.ndarray:
    """Which words of a text go."""
    at, fp = (matches.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    own = matches.field(2).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    on = standing(h, fp, at)
    outer = np.flatnonzero((own < 0) & on)
    on[outer] = second(h, at[outer]) == matches.field(5).fill_null(0).to_numpy(zero_copy_only=False)[outer]
    inner = np.flatnonzero(own >= 0)
    if len(inner):
        begins = np.cumsum([0, *(len(p.encode("utf-8", "surrogateescape")) for p in lines(text.decode("utf-8", "surrogateescape")))])
        line = np.searchsorted(begins, start, side="right")
        on[inner] &= standing(h, fp[inner], own[inner])
        inner = inner[on[inner]]
        on[inner] = (line[at[inner]] != line[own[inner]]) & (second(h, at[inner]) == second(h, own[inner]))
    reach = []
    for i, step in ((3, -1), (4, 1)):
        there = np.zeros((len(at), CONTEXT), "<u4")
        outer = own < 0
        if outer.any():
            there[outer] = np.frombuffer(b"".join(matches.field(i).filter(pa.array(outer)).to_pylist()), "<u4").reshape(-1, CONTEXT)
        keep = np.flatnonzero(~outer & on)
        there[keep] = around(h, own[keep], step)
        here = around(h, np.where(on, at, 0), step)
        reach.append(np.cumprod((here == there) & (here > 0), axis=1).sum(1))
    steps = np.zeros(len(h) + 1, np.int64)
    np.add.at(steps, (at - reach[0])[on], 1)
    np.add.at(steps, (at + SHINGLE + reach[1])[on], -1)
    return np.cumsum(steps[:-1]) > 0


def cut(text: bytes, matches: pa.StructArray) -> bytes:
    """The text without its repeated words; what stood apart stays apart, by a line break where one stood there."""
    h = hashes(text)
    start, end = bounds(text)
    off = gone(text, h, start, matches)
    if not off.any():
        return text
    steps = np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))
    out, kept_to = [], 0  # kept_to: the byte from which on the text is kept
    for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):  # words a .. b - 1 go
        if a:
            before = text[end[a - 1] : start[a]]
            out.append(text[kept_to : end[a - 1]])
            if b < len(start):
                behind = text[end[b - 1] : start[b]]
                out.append(behind if b"\n" in behind and b"\n" not in before else before)
        kept_to = int(start[b]) if b < len(start) else len(text)
    out.append(text[kept_to:])
    return b"".join(out)


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", count: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, without the later repeated runs of words."""
    runs = materialize(repeated(docs, text, key), "line-runs")
    shape = T.StructType([*docs.schema.fields])
    matched = "__line_matches"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matches = b.column(b.num_columns - 1)
            columns = list(b.columns[:-1])
            if matches.null_count < b.num_rows:
                held = b.column(text)
                new = {i: cut(held[i].as_py().encode("utf-8"), matches[i].values) for i in np.flatnonzero(matches.is_valid().to_numpy(zero_copy_only=False)).tolist() if held[i].is_valid}
                at = b.schema.get_field_index(text)
                columns[at] = pa.array([new[i].decode("utf-8") if i in new else t for i, t in enumerate(held.to_pylist())], b.schema.field(at).type)
                if count in shape.names:
                    i = b.schema.get_field_index(count)
                    columns[i] = pa.array([len(new[j].decode("utf-8")) if j in new else c for j, c in enumerate(columns[i].to_pylist())], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    g = runs.select(F.col("doc").alias("__line_doc"), F.col("matches").alias(matched))
    return docs.join(g, docs[key] == g["__line_doc"], "left").select(*docs.columns, matched).mapInArrow(run, shape)
