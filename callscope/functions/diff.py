"""Line diffs by longest common subsequence, per pair of texts, in Arrow batches.

Of several longest common subsequences one is meant: going back from both ends, equal lines are common, and of two steps that keep the
length the one along the new text is taken. ``common`` finds it in O((n + m) d) steps for d changed lines: fronts hold how far each
diagonal of the edit graph is reached with a number of changes. Going back needs all fronts in turn; every ``stride``-th is kept and those between
are made again, so memory is bounded by ``FRONT_CELLS`` and not by the product of the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIFF = "struct<lcs:int,added:int,removed:int,changes:array<struct<kind:string,line:string,old_no:int,new_no:int>>>"
FRONT_CELLS = 8_000_000
#: Characters of the texts, and 100 for each of their lines, after which diffs are sent on: a batch of Spark's is of thousands of texts.
BATCH_CHARS = 4_000_000


class Fronts:
    """How far into the old text each diagonal (old place less new place) is reached with a number of changes."""

    def __init__(self, old: np.ndarray, new: np.ndarray, cells: int = FRONT_CELLS) -> None:
        self.old, self.new, self.cells = old, new, cells
        self.low = -len(new) - 1  # of the diagonals; one more at either end is never reached
        self.stride, self.kept, self.held, self.between = 1, {}, 0, {}
        front = np.full(len(old) + len(new) + 3, -1, np.int64)
        front[-self.low] = self._slide(np.array([0]), np.array([0]))[0]
        self.last, end = 0, len(old) - len(new) - self.low
        self._keep(0, front)
        while front[end] < len(old):
            self.last += 1
            front = self._next(front, self.last)
            self._keep(self.last, front)

    def _slide(self, x: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """On along equal lines."""
        x = x.copy()
        go = np.flatnonzero((x >= 0) & (x < len(self.old)) & (x - diagonal < len(self.new)))
        while len(go):
            go = go[self.old[x[go]] == self.new[x[go] - diagonal[go]]]
            x[go] += 1
            go = go[(x[go] < len(self.old)) & (x[go] - diagonal[go] < len(self.new))]
        return x

    def _span(self, changes: int) -> tuple[int, int]:
        return max(1, -self.low - changes), min(len(self.old) + len(self.new) + 1, -self.low + changes)

    def _next(self, front: np.ndarray, changes: int) -> np.ndarray:
        a, b = self._span(changes)
        at = np.arange(a, b + 1)
        at = at[(at + self.low - changes) % 2 == 0]
        diagonal = at + self.low
        removed = np.where(front[at - 1] >= 0, front[at - 1] + 1, -1)
        removed[removed > len(self.old)] = -1
        added = front[at + 1]
        added = np.where((added >= 0) & (added - diagonal <= len(self.new)), added, -1)
        out = np.full_like(front, -1)
        out[at] = self._slide(np.maximum(removed, added), diagonal)
        return out

    def _keep(self, changes: int, front: np.ndarray) -> None:
        if changes % self.stride:
            return
        a, b = self._span(changes)
        self.kept[changes] = (a, front[a : b + 1].astype(np.int32))
        self.held += b + 1 - a
        if self.held > self.cells and len(self.kept) > 1:
            self.stride *= 2
            self.kept = {c: f for c, f in self.kept.items() if c % self.stride == 0}
            self.held = sum(len(f) for _, f in self.kept.values())

    def _whole(self, changes: int) -> np.ndarray:
        a, part = self.kept[changes]
        out = np.full(len(self.old) + len(self.new) + 3, -1, np.int64)
        out[a : a + len(part)] = part
        return out

    def reached(self, changes: int, diagonal: int) -> int:
        """How far a diagonal is reached; asked with ever fewer changes."""
        base = changes - changes % self.stride
        if changes not in self.between:
            front = self._whole(base)
            self.between = {base: front}
            for c in range(base + 1, changes + 1):
                front = self._next(front, c)
                self.between[c] = front
        return int(self.between[changes][diagonal - self.low])


def common(old: list[str], new: list[str], cells: int = FRONT_CELLS) -> list[str]:
    """The longest common subsequence of lines that the rule above means."""
    head, most = 0, min(len(old), len(new))
    while head < most and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < most - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    number: dict[str, int] = {}
    x = np.array([number.setdefault(line, len(number)) for line in a], np.int64)
    y = np.array([number.setdefault(line, len(number)) for line in b], np.int64)
    found: list[str] = []
    if len(a) and len(b):
        fronts = Fronts(x, y, cells)
        i, j, left = len(a), len(b), fronts.last
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                found.append(a[i])
                continue
            left -= 1
            if fronts.reached(left, i - j + 1) >= i:
                j -= 1
            else:
                i -= 1
    return [*old[:head], *reversed(found), *old[len(old) - tail :]]


def changes(old: list[str], new: list[str]) -> tuple[int, list[tuple[str, str, int | None, int | None]]]:
    """Length of the common subsequence, and the lines as kept, removed or added.

    The subsequence is followed from the start, each of its lines at its first place in either text; before it removals are told first.
    """
    held = common(old, new)
    out: list[tuple[str, str, int | None, int | None]] = []
    i = j = 0
    for line in held:
        while old[i] != line:
            out.append(("REMOVED", old[i], i + 1, None))
            i += 1
        while new[j] != line:
            out.append(("ADDED", new[j], None, j + 1))
            j += 1
        out.append(("UNCHANGED", line, i + 1, j + 1))
        i, j = i + 1, j + 1
    out += [("REMOVED", old[k], k + 1, None) for k in range(i, len(old))] + [("ADDED", new[k], None, k + 1) for k in range(j, len(new))]
    return len(held), out


def diffs(batches: Iterator[tuple[pd.Series, pd.Series]], chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The diffs of pairs of texts, in frames of whole pairs that end once they hold ``chars`` characters, whatever the size of the batches."""
    rows, held = [], 0
    for a, b in batches:
        for x, y in zip(a, b, strict=True):
            n, c = changes(x.split("\n") if x else [], y.split("\n") if y else [])
            rows.append((n, sum(k == "ADDED" for k, *_ in c), sum(k == "REMOVED" for k, *_ in c), [dict(zip(("kind", "line", "old_no", "new_no"), z, strict=True)) for z in c]))
            held += len(x or "") + len(y or "") + 100 * len(c)
            if held >= chars:
                yield pd.DataFrame(rows, columns=["lcs", "added", "removed", "changes"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["lcs", "added", "removed", "changes"])
            rows, held = [], 0


def line_diff(old: Column, new: Column) -> Column:
    """The diff of two texts, line by line; null counts as no lines, as does an empty text."""

    @F.pandas_udf(DIFF)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from diffs(batches)

    return run(old, new)


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial string hash (31 h + c) of ASCII text, as a column expression."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - 2**32).otherwise(h).cast("int")


def block_body(text: Column, start: Column) -> Column:
    """The text from ``start`` on up to the brace that closes the first one after it; null without one."""

    @F.pandas_udf("string")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        def one(x: str | None, key: str | None) -> str | None:
            at = x.find(key) if x and key else -1
            if at < 0 or (i := x.find("{", at)) < 0:
                return None
            depth = 0
            for n in range(i, len(x)):
                depth += (x[n] == "{") - (x[n] == "}")
                if not depth:
                    return x[at : n + 1]
            return None

        return pd.Series([one(x, k) for x, k in zip(t, s, strict=True)], dtype=object)

    return run(text, start)
