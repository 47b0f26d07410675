"""Toxicity by a subsequence string kernel and a support vector machine (operator 9).

The kernel of two words sums over their common three-letter subsequences, each weighted by a decay to
the power of its span in either word (at most ``SPAN`` letters), so a word with inserted letters still
resembles what it hides; it is normalised, and its exponential taken, which is a kernel again. Before that a word is
folded: case, accents, digits and signs that stand for letters, and signs between letters go, and letters written
apart are joined. A sentence's kernel with a landmark is the sum over its different words; word kernels under ``LEAST`` are
left out as small.

Landmarks are words and starts of words whose share of toxic training documents stands out from that of clean ones, the
clearest first, each unlike those before it. Nystrom: features are kernels with the landmarks times the inverse square
root of the landmarks' own kernel matrix; a linear support vector machine learns on sentences. A document's probability
follows from the margin of its worst sentence and from what the sentences beyond the boundary add up to, calibrated by Platt's method on
documents that the machine hasn't seen: one doubtful word is a chance, several are not.

Scoring reads every word of every text in Arrow batches. Most words are ruled out at once by an upper bound of
their kernel (vectorised over a batch's distinct words); only the others are compared with the landmarks.

Learning is from a bounded sample of labelled rows: ``per_class`` of each class.

Defined results: null and empty texts are scored as a text without words; without labelled rows of both
classes, or landmarks, every score is 0; repeated rows score alike; other columns are kept or ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import sliced
from callscope.llm.learn import labelled_sample, platt, sigmoid

SPAN, DECAY, LEAST, WIDTH, CHUNK = 6, 0.7, 0.5, 0.3, 24
MORE = 1.6
UNLIKE = 0.62  # the largest kernel of two landmarks, before its exponential
START, END = 30, 31  # marks of a word's ends, letters to the kernel
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: offsets of the 2nd and 3rd letter of a subsequence, and its weight
STEPS = [(i, j, DECAY ** (j + 1)) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
CODES = bytes(ord(STANDS_FOR.get(chr(c), chr(c))) - 96 if chr(c) in STANDS_FOR or chr(c).islower() and c < 128 else 0 for c in range(256))
DROPPED = bytes(c for c in range(256) if not CODES[c])
_codes: dict[str, bytes] = {}


def fold(word: str) -> bytes:
    """Letter codes of a word: 1-26 for a-z, 1-29 by the code point for letters of other scripts; all else goes."""
    core = word.lower().strip(".,;:!?\"'()[]")
    if not core.isascii():
        core = unicodedata.normalize("NFKD", core.replace("ß", "ss"))
        core = "".join(ch for ch in core if not unicodedata.combining(ch))
        if not core.isascii():
            return b"".join(bytes([1 + ord(ch) * 7 % 29]) if ch.isalpha() and ch > "\x7f" else ch.encode("ascii", "ignore").translate(CODES, DROPPED) for ch in core)
    return core.encode().translate(CODES, DROPPED)


def folded(words: list[str]) -> list[bytes]:
    """The folded form of each word."""
    if len(_codes) > 100_000:
        _codes.clear()
    out = list(map(_codes.get, words))
    if None in out:
        for i, c in enumerate(out):
            if c is None:
                out[i] = _codes[words[i]] = fold(words[i])
    return out


def apart(codes: list[bytes]) -> list[tuple[int, bytes]]:
    """Place and whole of words written as three letters or more, each by itself."""
    out, at = [], 0
    ones = [i for i, c in enumerate(codes) if len(c) == 1]
    while at < len(ones):
        end = at
        while end + 1 < len(ones) and ones[end + 1] == ones[end] + 1:
            end += 1
        if end - at >= 2:
            out.append((ones[at], b"".join(codes[i] for i in ones[at : end + 1])))
        at = end + 1
    return out


def parts(code: bytes) -> list[bytes]:
    """A word with its ends marked; a long one as overlapping parts."""
    code = bytes([START]) + code + bytes([END])
    return [code] if len(code) <= CHUNK else [code[i : i + CHUNK] for i in range(0, len(code) - 8, CHUNK - 8)]


def subsequences(code: bytes) -> dict[int, float]:
    out: dict[int, float] = {}
    for i, x in enumerate(code):
        for a, b, w in STEPS:
            if i + b < len(code):
                k = x << 10 | code[i + a] << 5 | code[i + b]
                out[k] = out.get(k, 0.0) + w
    return out


class Kernel:
    """Kernels of words with a set of landmarks, which are words, or starts of words, with their marks."""

    def __init__(self, landmarks: list[bytes]) -> None:
        self.landmarks = landmarks
        self.table = np.zeros((1 << 15, len(landmarks)), np.float32)
        for n, x in enumerate(landmarks):
            s = subsequences(x)
            norm = sum(v * v for v in s.values()) ** 0.5
            for k, v in s.items():
                self.table[k, n] = v / norm
        self.most = self.table.max(1) if landmarks else np.zeros(1 << 15, np.float32)

    def of(self, part: bytes) -> np.ndarray:
        """Kernels of a word's part with the landmarks, sharpened (an exponential of a kernel is one)."""
        s = subsequences(part)
        if not s:
            return np.zeros(len(self.landmarks), np.float32)
        v = np.array(list(s.values()), np.float32)
        k = v @ self.table[list(s)] / np.sqrt(v @ v)
        return np.where(k >= LEAST, np.exp((k - 1) / WIDTH), 0).astype(np.float32)

    def maybe(self, codes: list[bytes]) -> list[bytes]:
        """The parts whose kernel may reach ``LEAST``: all terms are positive, so repeats only raise the norm."""
        out: list[bytes] = []
        codes = sorted(codes, key=len, reverse=True)
        for at in range(0, len(codes), 20_000):
            some = codes[at : at + 20_000]
            size = np.fromiter(map(len, some), np.int64, len(some))
            grid = np.zeros((int(size[0]) + SPAN, len(some)), np.int32)
            flat = np.frombuffer(b"".join(some), np.uint8)
            grid[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(some)), size)] = flat
            top = np.zeros(len(some), np.float32)
            for i in range(int(size[0]) - 2):
                n = int(np.searchsorted(-size, -(i + 2)))  # those longer than i + 2 come first
                head = grid[i, :n] << 10
                for a, b, w in STEPS:
                    top[:n] += np.float32(w) * self.most[head | grid[i + a, :n] << 5 | grid[i + b, :n]]
            least = (LEAST - 1e-4) * least_norm(size)
            left = np.flatnonzero(top >= least)
            # the bound for each landmark by itself
            for begin in range(0, len(left), 2000):
                near = left[begin : begin + 2000]
                g, length = grid[:, near], size[near]
                each = np.zeros((len(near), len(self.landmarks)), np.float32)
                for i in range(int(length[0]) - 2):
                    n = int(np.searchsorted(-length, -(i + 2)))
                    head = g[i, :n] << 10
                    for a, b, w in STEPS:
                        each[:n] += np.float32(w) * self.table[head | g[i + a, :n] << 5 | g[i + b, :n]]
                out += [some[i] for i in near[each.max(1) >= least[near]]]
        return out


def least_norm(size: np.ndarray) -> np.ndarray:
    """The norm of a word of a length, were all its subsequences distinct: none is less."""
    squares = np.array([sum(w * w * max(0, n - b) for _, b, w in STEPS) for n in range(CHUNK + 1)])
    return np.sqrt(np.maximum(squares[size], 1e-12))


class Model:
    """Landmarks, the machine's weights, and the calibration; small when sent, as it learns words anew."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, offset: float, calibration: np.ndarray, name: str = "") -> None:
        self.kernel, self.weights, self.offset, self.calibration = Kernel(landmarks), weights, offset, calibration
        gram = np.array([self.kernel.of(w) for w in landmarks], np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        self.name = name or uuid.uuid4().hex
        self.seen: set[bytes] = set()
        self.known: dict[bytes, np.ndarray] = {}

    def __reduce__(self) -> tuple:
        return resident, (self.kernel.landmarks, self.weights, self.offset, self.calibration, self.name)

    def learn_words(self, codes: set[bytes]) -> None:
        """Kernels of the words that aren't ruled out."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        new = [c for c in codes - self.seen if len(c) > 2]
        self.seen.update(new)
        like = {p: k for p in self.kernel.maybe(sorted({p for c in new for p in parts(c)})) if (k := self.kernel.of(p)).any()}
        for c in new:
            if k := [like[p] for p in parts(c) if p in like]:
                self.known[c] = np.max(k, 0)

    def margin(self, words: list[str], codes: list[bytes]) -> float:
        """Of the worst sentence, raised by what the sentences beyond the boundary add up to, damped."""
        each = [float(self.mapped(k) @ self.weights) + self.offset for k in self.sentences(words, codes)]
        return max(each, default=self.offset) + MORE * float(np.log1p(sum(max(0.0, x) for x in each)))

    def mapped(self, kernels: np.ndarray) -> np.ndarray:
        """Features of a sentence; what many words add up to isn't more than one like a landmark."""
        z = kernels @ self.root
        return z / max(1.0, float(np.sqrt(z @ z)))

    def sentences(self, words: list[str], codes: list[bytes]) -> Iterator[np.ndarray]:
        """Kernels of the sentences that hold a word like a landmark; a sentence ends at a word with a full stop."""
        known = self.known
        hits = [i for i, c in enumerate(codes) if c in known]
        held = None
        said: set[bytes] = set()
        for n, i in enumerate(hits):
            k = known[codes[i]]
            same = n > 0 and not any(words[j][-1] in ".!?" for j in range(hits[n - 1], i))
            if held is not None and not same:
                yield held
                said.clear()
            if codes[i] not in said:
                held = held + k if held is not None and same else k
            said.add(codes[i])
        if held is not None:
            yield held
        for _, c in apart(codes):
            if c in known:
                yield known[c]

    def probability(self, words: list[str], codes: list[bytes]) -> float:
        return float(sigmoid(self.calibration[0] * self.margin(words, codes) + self.calibration[1]))


_resident: dict[str, Model] = {}


def resident(landmarks: list[bytes], weights: np.ndarray, offset: float, calibration: np.ndarray, name: str) -> Model:
    """The copy of a model that this worker has already scored with, which knows more words."""
    if name not in _resident:
        _resident.clear()
        _resident[name] = Model(landmarks, weights, offset, calibration, name)
    return _resident[name]


def forms(code: bytes) -> list[bytes]:
    """A word with its marks, and its starts."""
    whole = parts(code)[0]
    return [whole, *(whole[:n] for n in range(5, min(len(whole) - 1, 10)))]


def pick_landmarks(docs: list[tuple[set[bytes], int]], most: int, least_z: float = 4.5) -> list[bytes]:
    """Words and starts of words that stand out in toxic documents, each unlike those before it."""
    pos, neg = Counter(), Counter()
    for words, y in docs:
        if y:
            pos.update({f for w in words if len(w) >= 4 for f in forms(w)})
    n1, n0 = max(1, sum(y for _, y in docs)), max(1, sum(1 - y for _, y in docs))
    pos = {f: n for f, n in pos.items() if n >= 3}
    of: dict[bytes, list[bytes]] = {}
    for words, y in docs:
        if not y:
            found: set[bytes] = set()
            for w in words:
                if w not in of:
                    of[w] = [f for f in forms(w) if f in pos] if len(w) >= 4 else []
                found.update(of[w])
            neg.update(found)

    def z(f: bytes) -> float:
        p = (pos[f] + neg[f]) / (n1 + n0)
        return (pos[f] / n1 - neg[f] / n0) / (p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12) ** 0.5

    good = sorted((f for f in pos if z(f) >= least_z and pos[f] / n1 >= 4 * neg[f] / n0), key=lambda f: (-round(pos[f] / n1 - 2 * neg[f] / n0, 6), -len(f), f))
    out: list[bytes] = []
    table = np.zeros((1 << 15, most), np.float32)
    for f in good[: most * 20]:
        s = subsequences(f)
        at, v = list(s), np.array(list(s.values()), np.float32)
        v /= np.sqrt(v @ v)
        if len(out) < most and (v @ table[at, : len(out)]).max(initial=0.0) < UNLIKE:
            table[at, len(out)] = v
            out.append(f)
    return out


def train(rows: Iterable[tuple[str, int]], most_landmarks: int = 40) -> Model | None:
    same: dict[str, str] = {}  # equal words of all documents are one object
    docs = [(w := [same.setdefault(x, x) for x in t.split()], folded(w), y) for t, y in rows]
    if len({y for *_, y in docs}) < 2:
        return None
    fit, late = ([d for n, d in enumerate(docs) if (n % 3 == 0) == held] for held in (False, True))
    landmarks = pick_landmarks([(set(c), y) for _, c, y in fit], most_landmarks)
    if not landmarks:
        return None
    model = Model(landmarks, np.zeros(len(landmarks)), 0.0, np.zeros(2))
    kernel = model.kernel
    for at in range(0, len(docs), 500):
        model.learn_words({x for _, c, _ in docs[at : at + 500] for x in (*c, *(j for _, j in apart(c)))})
    # sentences: of a toxic document, those that resemble a landmark; of a clean one, all that do, and one that doesn't
    x, y = [np.zeros(len(landmarks), np.float32)], [0]
    for words, codes, label in fit:
        for k in model.sentences(words, codes):
            if label == 0 or k.max() >= 0.5:
                x.append(k)
                y.append(label)
    # insults disguised by a letter put in, doubled or left out
    for n, mark in enumerate(landmarks):
        word = mark[1:].rstrip(bytes([END]))
        for at in range(2, len(word) - 1):
            for other in (word[:at] + bytes([1 + (7 * n + 5 * at) % 26]) + word[at:], word[:at] + word[at - 1 : at] + word[at:], word[:at] + word[at + 1 :]):
                if len(word) > 4 and mark[-1] == END and (k := kernel.of(parts(other)[0])).any():
                    x.append(k)
                    y.append(1)
    x, y = np.array([model.mapped(k) for k in x]), np.array(y)
    model.weights, model.offset = svm(x, y)
    model.calibration = platt(np.array([model.margin(words, codes) for words, codes, _ in late]), np.array([label for *_, label in late]))
    _codes.clear()
    return Model(landmarks, model.weights, model.offset, model.calibration)


def svm(z: np.ndarray, y: np.ndarray, cost: float = 300.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine, classes weighted alike, by Newton steps over the rows within the margin."""
    s = np.where(y == 1, 1.0, -1.0)
    c = cost * np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    x = np.column_stack([z, np.ones(len(y))])
    ridge = np.append(np.ones(z.shape[1]), 1e-6)
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        gap = np.maximum(0, 1 - s * (x @ v))
        return float(ridge @ (v * v) / 2 + c @ (gap * gap))

    for _ in range(rounds):
        gap = 1 - s * (x @ w)
        on = gap > 0
        g = ridge * w - 2 * x[on].T @ (c * s * gap)[on]
        d = np.linalg.solve(np.diag(ridge) + 2 * (x[on].T * c[on]) @ x[on], g)
        step, now = 1.0, loss(w)
        while loss(w - step * d) > now - 1e-4 * step * (g @ d) and step > 1e-6:
            step /= 2
        w = w - step * d
        if np.abs(step * d).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2500, label: str = "toxic", key: str = "doc_id") -> Model | None:
    return train(labelled_sample(docs, labels, label, per_class, key=key))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that the text is toxic."""
    shape = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for whole in batches:
            for b in sliced(whole, text, 4_000_000):
                words = [(t or "").split() for t in b.column(text).to_pylist()]
                if m is None:
                    scores = [0.0] * len(words)
                else:
                    codes = [folded(w) for w in words]
                    m.learn_words(set().union(*codes).union(j for c in codes for _, j in apart(c)))
                    scores = [m.probability(w, c) for w, c in zip(words, codes, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, shape)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, per_class: int = 2500, key: str = "doc_id") -> DataFrame:
    """The documents that score under the threshold."""
    model = fitted(docs, labels.where(~held_out(F.col(key))), per_class, key=key)
    return score(docs, model, out="__tox_score").where(F.col("__tox_score") < threshold).select(*docs.columns)
