"""Quality rules and a hashed n-gram classifier (operator 5).

Fixed rules reject short texts and texts that repeat themselves. What passes them is scored by a logistic
regression over hashed word unigrams, word bigrams and character trigrams (log counts, unit length), trained on a
bounded sample of labelled rows (``per_class`` of each class), calibrated on a third of the sample that it
hasn't seen, and kept from a fixed probability on. Scoring runs in Arrow batches over whole texts.

Defined results: null and empty texts have no words and fail the rules; without labelled rows of both classes
the method keeps what the rules keep; repeated rows score alike; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import mix64, sliced
from callscope.llm.learn import Rows, labelled_sample, logistic, platt, sigmoid
from callscope.llm.neardup import word_hashes

BITS = 16
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent
THRESHOLD = 0.3
FEATURES = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")]


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; ``ids`` numbers equal words alike."""
    if len(ids) < 4:
        return 0
    m = int(ids.max()) + 1
    if m < 2_000_000:
        _, inverse, counts = np.unique((ids[:-2] * m + ids[1:-1]) * m + ids[2:], return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    # a window covers its own start and the two places after it
    start = np.append(counts[inverse.ravel()] > 1, [False, False])
    cover = start.copy()
    cover[1:] |= start[:-1]
    cover[2:] |= start[:-2]
    return int(cover.sum())


def rules(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), len(text) - sum(text.count(c) for c in SPACE), sum(text.count(c) for c in SYMBOLS), dup, repeated_words(ids)


def hashed(raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text."""
    h = word_hashes(words) if words else np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
        chars = mix64((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) if len(b) > 2 else b[:0]
    ix = np.concatenate([x >> np.uint64(64 - BITS) for x in (mix64(h), pairs, chars)]).astype(np.int64)
    ix, n = np.unique(ix, return_counts=True)
    x = np.log1p(n)
    return ix, x / max(1e-9, float(np.sqrt(x @ x)))


class Classifier:
    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float) -> None:
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def margin(self, raw: bytes, words: list[bytes]) -> float:
        ix, x = hashed(raw, words)
        return float(self.weights[ix] @ x) + self.offset

    def probability(self, raw: bytes, words: list[bytes]) -> float:
        return float(sigmoid(np.float64(self.slope * self.margin(raw, words) + self.shift)))


def train(rows: Iterable[tuple[str, int]]) -> Classifier | None:
    docs = [(hashed(raw := t.encode("utf-8", "replace"), raw.split()), y) for t, y in rows]
    y = np.array([label for _, label in docs])
    late = np.arange(len(docs)) % 3 == 0
    if len(set(y[~late].tolist())) < 2 or len(set(y[late].tolist())) < 2:
        return None
    w, b = logistic(Rows([x for n, (x, _) in enumerate(docs) if not late[n]], 1 << BITS), y[~late], l2=1e-4)
    return Classifier(w, b, *platt(np.array([float(w[ix] @ x) + b for n, ((ix, x), _) in enumerate(docs) if late[n]]), y[late]))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2000, label: str = "quality", key: str = "doc_id") -> Classifier | None:
    return train(labelled_sample(docs, labels, label, per_class, key=key))


def score(docs: DataFrame, model: Classifier | None, *, threshold: float = THRESHOLD, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and those of ``FEATURES``, their names with ``prefix``."""
    shape = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, T._parse_datatype_string(t)) for n, t in FEATURES)])

    def of(t: str | None) -> tuple:
        t = t or ""
        raw = t.encode("utf-8", "replace")
        words = raw.split()
        found = rules(t, words)
        failed = found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED * found[0]
        p = model.probability(raw, words) if model else 1.0
        return (*found, failed, p, not failed and p >= threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, text):
                if b.num_rows:
                    new = [pa.array(c) for c in zip(*map(of, b.column(text).to_pylist()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *new], names=shape.names)

    return docs.mapInArrow(run, shape)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, per_class: int = 2000) -> DataFrame:
    """The documents that pass the rules and the classifier, with their columns."""
    return score(docs, fitted(docs, labels, per_class), threshold=threshold, prefix="__quality_").where("__quality_kept").select(*docs.columns)
