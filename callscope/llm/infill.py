"""Fill-in-the-middle transformation (operator 13) over succinct rank and select.

The texts of an Arrow batch lie in one buffer of bytes. Two bitvectors are packed over it, eight positions a byte: one has a
bit at the last byte of each token, the other at the first byte of each character. A directory holds the number of bits before
each block of ``BLOCK`` bytes of a vector, so ``rank`` is one directory entry and one block's popcounts, and ``select`` a search
of the directory and of one block. The tokens of a text are the rank at its end less the rank at its start; a cut after ``k``
tokens is one ``select`` away, and its place in characters one ``rank``. Cuts of all texts of a batch are taken at once.

A token is any white space before a word, with the word; white space at the end of a text is a token of its own. White space is
ASCII and a multi-byte character has no such byte, so bytes serve as well as characters.

Four numbers of the SHA-256 of the seed and the id decide: two for the cuts, one for whether a text stays plain, one for its form.
A lost task is run again with the same result, nothing is shuffled, and a batch in hand holds about ``most_bytes`` of texts, or one text.

Defined results: a null or empty text, and one that contains a marker, is plain with null cuts; a null id is
written as no digits; repeated rows become the same row each; a text of any length is taken whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import encoded, sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 64
POPCOUNT = np.array([x.bit_count() for x in range(256)], np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ROW = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


class Bits:
    """A packed bitvector with a directory of the bits before each block."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        blocks = len(packed) // BLOCK + 1
        self.packed = np.zeros(blocks * BLOCK, np.uint8)
        self.packed[: len(packed)] = packed
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(POPCOUNT[self.packed].reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64), out=self.before[1:])

    def _running(self, block: np.ndarray) -> np.ndarray:
        """Bits up to and with each byte of the blocks asked for."""
        return np.cumsum(POPCOUNT[self.packed.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits at the positions before each of ``at``."""
        block, byte = at // (8 * BLOCK), at // 8
        part = self.packed[byte] & ((1 << (at % 8)) - 1).astype(np.uint8)
        whole, inside = self._running(block), byte % BLOCK
        earlier = np.where(inside > 0, whole[np.arange(len(at)), inside - 1], 0)
        return self.before[block] + earlier + POPCOUNT[part]

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Positions of the ``nth`` bits, counted from 1."""
        block = np.searchsorted(self.before, nth, side="left") - 1
        left = nth - self.before[block]
        running = self._running(block)
        inside = (running < left[:, None]).sum(axis=1)
        left -= np.where(inside > 0, running[np.arange(len(nth)), inside - 1], 0)
        byte = block * BLOCK + inside
        bits = (self.packed[byte][:, None] >> np.arange(8)) & 1
        return byte * 8 + np.argmax(np.cumsum(bits, axis=1) >= left[:, None], axis=1)


def token_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each byte is the last of a token, for texts that end at ``ends``."""
    word = ~SPACE[data]
    after = np.ones(len(data), bool)  # whether white space or another text follows
    after[:-1] = ~word[1:]
    last = ends[ends > 0] - 1
    after[last] = True
    out = word & after
    out[last] = True
    return out


def draws(key: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16), int(digest[16:24], 16), int(digest[24:32], 16)


def _forms(b: pa.RecordBatch, seed: int, infill: int, spm: int) -> pa.RecordBatch:
    texts = list(encoded(b.column(1)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    tokens, chars = Bits(token_ends(data, ends)), Bits((data & 0xC0) != 0x80)
    first = tokens.rank(starts)
    n = tokens.rank(ends) - first
    keys = b.column(0).to_pylist()
    h = np.array([draws(k, seed) for k in keys], np.int64)
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (n == 0) | (h[:, 2] % 100 >= infill) | np.array([any(m in t for m in markers) for t in texts])
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.stack([starts, starts], axis=1)
    some = cuts > 0
    at[some] = tokens.select((first[:, None] + cuts)[some]) + 1
    begin = chars.rank(starts)
    places = np.stack([chars.rank(at[:, 0]), chars.rank(at[:, 1])], axis=1) - begin[:, None]
    forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    out = []
    for t, form, s, (x, y) in zip(texts, forms, starts, at, strict=True):
        p, m, e = t[: x - s], t[x - s : y - s], t[y - s :]
        out.append(t if form == "plain" else markers[0] + p + markers[1] + e + markers[2] + m if form == "psm" else markers[1] + e + markers[0] + p + markers[2] + m)
    return pa.RecordBatch.from_arrays(
        [
            b.column(0).cast(pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(forms.tolist(), pa.string()),
            pa.array(places[:, 0], pa.int64(), mask=plain),
            pa.array(places[:, 1] - places[:, 0], pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        names=ROW.names,
    )


def transform(docs: DataFrame, *, seed: int = 42, infill: int = 50, spm: int = 80, text: str = "text", key: str = "doc_id", most_bytes: int = 8_000_000) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of each row.

    ``infill`` of a hundred texts are cut, and ``spm`` of a hundred of these have their suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", most_bytes):
                if b.num_rows:
                    yield _forms(b, seed, infill, spm)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ROW)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for; a marker stands nowhere else, so its first place tells."""

    def between(start: str, end: str | None) -> Column:
        rest = F.substr(output, F.instr(output, start) + len(start))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
