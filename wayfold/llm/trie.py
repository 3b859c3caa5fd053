"""Compact n-gram trie: Elias-Fano levels with monotone pointers and quantised probabilities."""

from __future__ import annotations

import numpy as np

from wayfold.llm.arrays import by_value

by_value(__name__)

#: Values decoded at once, and steps of a quantised log10 probability per decade.
STRIDE, GRID = 4096, 512


def quantise(log10_p: np.ndarray) -> np.ndarray:
    """Codes from 1 (near certain) to 65535; 0 is left for "not there"."""
    return np.clip(np.rint(-log10_p * GRID), 1, 65535).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return codes / -float(GRID)


class EliasFano:
    """A non-decreasing sequence of whole numbers: low bits side by side, high bits in unary.

    Works on three byte arrays, which may be views of a memory-mapped file; values are decoded in
    strides. ``marks`` holds where each stride begins in the unary part, ``heads`` its first value."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray, heads: np.ndarray):
        self.n, self.bits, self.low, self.high, self.marks, self.heads = n, bits, low, high, marks, heads

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, int(np.log2((int(values[-1]) + 1) / n))) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)) if bits and n else np.empty(0, np.uint8)
        at = (values >> bits) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, bits, low, np.packbits(unary), at[::STRIDE].astype(np.int64), values[::STRIDE].copy())

    def stride(self, b: int) -> np.ndarray:
        """Values of stride ``b``."""
        first, last = b * STRIDE, min(self.n, (b + 1) * STRIDE)
        begin = int(self.marks[b])
        end = int(self.marks[b + 1]) if b + 1 < len(self.marks) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8:-(-end // 8)])) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin):][:last - first]
        out = (ones - np.arange(first, last)) << self.bits
        if self.bits:
            lo, hi = first * self.bits, last * self.bits
            raw = np.unpackbits(self.low[lo // 8:-(-hi // 8)])[lo % 8:lo % 8 + hi - lo].reshape(-1, self.bits)
            out |= raw.astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        return out

    def _runs(self, of: np.ndarray):
        edges = np.flatnonzero(np.diff(of)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
            if hi > lo:
                yield int(of[lo]), lo, hi

    def take(self, at: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.empty(len(at), np.int64)
        for b, lo, hi in self._runs(at // STRIDE):
            out[lo:hi] = self.stride(b)[at[lo:hi] - b * STRIDE]
        return out

    def find(self, targets: np.ndarray) -> np.ndarray:
        """Position of each of the ascending targets, or -1: the successor is found in its stride
        and compared."""
        out = np.full(len(targets), -1, np.int64)
        if not self.n or not len(targets):
            return out
        strides = np.searchsorted(self.heads, targets, side="right") - 1
        for b, lo, hi in self._runs(strides):
            if b < 0:
                continue
            values = self.stride(b)
            at = np.searchsorted(values, targets[lo:hi])
            hit = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == targets[lo:hi])
            out[lo:hi][hit] = at[hit] + b * STRIDE
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.marks, self.heads]


class Trie:
    """Distinct rows of word ids with a code each.

    Level j holds the ids at place j. Brothers lie in ascending order and continue from the last
    value of the family before, so a level is one monotone sequence; pointers give each node's
    children and are monotone too. A lookup walks down the levels: the id wanted, set relative to
    its family, is searched as a successor there."""

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], codes: np.ndarray):
        self.levels, self.pointers, self.codes = levels, pointers, codes

    @classmethod
    def of(cls, rows: np.ndarray, codes: np.ndarray) -> "Trie":
        """``rows`` (n, order) sorted and distinct."""
        n, order = rows.shape
        levels, pointers = [], []
        new = np.zeros(n, bool)
        parent, families = np.zeros(n, np.int64), 1 if n else 0
        for j in range(order):
            new = new | np.concatenate((np.ones(min(n, 1), bool), rows[1:, j] != rows[:-1, j]))
            at = np.flatnonzero(new)
            family, values = parent[at], rows[at, j] + 1
            last = np.zeros(families, np.int64)
            last[family] = values  # brothers ascend, so the last one written is the largest
            base = np.cumsum(last) - last
            levels.append(EliasFano.of(base[family] + values))
            if j:
                pointers.append(EliasFano.of(np.searchsorted(family, np.arange(families + 1))))
            parent, families = np.cumsum(new) - 1, len(at)
        return cls(levels, pointers, codes.astype(np.uint16))

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Place of each of the sorted ``rows`` in the last level, -1 where a row is not there."""
        out = np.full(len(rows), -1, np.int64)
        alive, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for j, level in enumerate(self.levels):
            wanted = rows[alive, j] + 1
            if j:
                begin, end = self.pointers[j - 1].take(node), self.pointers[j - 1].take(node + 1)
                before = np.zeros(len(alive), np.int64)
                before[begin > 0] = level.take(begin[begin > 0] - 1)
                at = level.find(before + wanted)
                at[(at < begin) | (at >= end)] = -1
            else:
                at = level.find(wanted)
            alive, node = alive[at >= 0], at[at >= 0]
        out[alive] = node
        return out

    def save(self) -> bytes:
        """One block of bytes: a directory of array sizes, then the arrays, each on 8 bytes."""
        parts = [p for e in (*self.levels, *self.pointers) for p in e.parts()] + [self.codes]
        raw = [np.ascontiguousarray(p).view(np.uint8) for p in parts]
        head = np.array([len(self.levels), *map(len, raw)], np.int64).view(np.uint8)
        return np.array([len(head)], np.int64).tobytes() + head.tobytes() + b"".join(r.tobytes() + bytes(-len(r) % 8) for r in raw)

    @classmethod
    def open(cls, data: np.ndarray) -> "Trie":
        """A trie over the bytes of ``save``, best a memory-mapped file: nothing is copied."""
        size = int(data[:8].view(np.int64)[0])
        head = data[8:8 + size].view(np.int64)
        at, arrays = 8 + size, []
        for n in head[1:].tolist():
            arrays.append(data[at:at + n])
            at += n + -n % 8
        sequences = []
        for i in range(0, len(arrays) - 1, 5):
            meta, low, high, marks, heads = arrays[i:i + 5]
            n, bits = meta.view(np.int64).tolist()
            sequences.append(EliasFano(n, bits, low, high, marks.view(np.int64), heads.view(np.int64)))
        return cls(sequences[:int(head[0])], sequences[int(head[0]):], arrays[-1].view(np.uint16))
