"""An n-gram trie of two levels in Elias-Fano form: contexts, pointers, successors and quantised probabilities."""

from __future__ import annotations

import tempfile

import numpy as np

#: Values between two skip entries; a multiple of 8, so that the low bits of each segment start at a byte.
SEGMENT = 4096
#: Width of a quantisation step in log10, and the codes: 0 for an absent n-gram, then one per step below probability 1.
STEP, CODES = 0.02, 65535


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down, so that quantised probabilities never sum above the exact ones."""
    return np.where(p > 0, 1 + np.clip(np.ceil(-np.log10(np.where(p > 0, p, 1)) / STEP - 1e-9), 0, CODES - 1), 0).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(float) - 1) * STEP), 0.0)


class Levels:
    """Arrays kept in one memory-mapped scratch file, which is gone from the folder as soon as it is open."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.end = 0

    def keep(self, array: np.ndarray) -> np.ndarray:
        if not len(array):
            return array
        self.file.write(array.tobytes())
        self.file.flush()
        at, self.end = self.end, self.end + array.nbytes
        return np.memmap(self.file, array.dtype, "r", at, array.shape)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, skip entries for every SEGMENT values."""

    def __init__(self, values: np.ndarray, levels: Levels):
        values = np.asarray(values, np.int64)
        self.n = n = len(values)
        self.low_bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        packed = []
        for k in range(0, n, SEGMENT * 16):
            part = values[k : k + SEGMENT * 16]
            packed.append(np.packbits(((part[:, None] >> np.arange(self.low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little"))
        places = (values >> self.low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        self.low = levels.keep(np.concatenate(packed) if packed else np.empty(0, np.uint8))
        self.high = levels.keep(np.packbits(bits, bitorder="little"))
        self.skip, self.place = values[::SEGMENT].copy(), np.concatenate([places[::SEGMENT], [len(bits)]])

    def segment(self, k: int) -> np.ndarray:
        first, last = k * SEGMENT, min(self.n, (k + 1) * SEGMENT)
        a, b = int(self.place[k]), int(self.place[k + 1])
        set_ = np.flatnonzero(np.unpackbits(self.high[a >> 3 : (b >> 3) + 1], bitorder="little")) + (a >> 3 << 3)
        high = set_[set_ >= a][: last - first] - np.arange(first, last)
        count = (last - first) * self.low_bits
        at = first * self.low_bits >> 3
        low = np.unpackbits(self.low[at : at + (count + 7 >> 3)], count=count, bitorder="little").reshape(last - first, self.low_bits)
        return (high << self.low_bits) + (low @ (1 << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else 0)

    def _by_segment(self, segments: np.ndarray):
        order = np.argsort(segments, kind="stable")
        firsts = np.flatnonzero(np.diff(segments[order], prepend=-1))
        for rows in np.split(order, firsts[1:]) if len(order) else ():
            yield int(segments[rows[0]]), rows

    def access(self, index: np.ndarray) -> np.ndarray:
        out = np.empty(len(index), np.int64)
        for k, rows in self._by_segment(index // SEGMENT):
            out[rows] = self.segment(k)[index[rows] - k * SEGMENT]
        return out

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, value) of the first value at or above each target; (n, -1) where there is none."""
        index, value = np.full(len(targets), self.n, np.int64), np.full(len(targets), -1, np.int64)
        if not self.n:
            return index, value
        for k, rows in self._by_segment(np.maximum(np.searchsorted(self.skip, targets, "left") - 1, 0)):
            own = self.segment(k)
            at = np.searchsorted(own, targets[rows], "left")
            index[rows] = at + k * SEGMENT
            inside = at < len(own)
            value[rows[inside]] = own[at[inside]]
            if k + 1 < len(self.skip):
                value[rows[~inside]] = self.skip[k + 1]
        return index, value


class BigramTrie:
    """Pairs (context, word) with quantised probabilities, from arrays sorted by context, then word, without repeats.

    Level 1 holds the contexts and, for each, where its words start in level 2. Level 2 holds the words relative to their
    context: each plus 1 plus the last value before its context's range, which makes the whole level monotone.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, probabilities: np.ndarray):
        levels = Levels()
        starts = np.flatnonzero(np.diff(contexts, prepend=-1)) if len(contexts) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(contexts)]]))
        last = words[starts + sizes - 1] + 1 if len(starts) else starts
        base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(starts) else starts
        self.contexts = EliasFano(contexts[starts], levels)
        self.starts = EliasFano(np.concatenate([starts, [len(contexts)]]), levels)
        self.words = EliasFano(words + 1 + np.repeat(base, sizes), levels)
        self.codes = levels.keep(quantise(probabilities))

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each pair; 0 if it isn't there."""
        out = np.zeros(len(contexts), np.uint16)
        rank, value = self.contexts.successor(contexts)
        known = np.flatnonzero(value == contexts)
        start, end = self.starts.access(rank[known]), self.starts.access(rank[known] + 1)
        base = np.zeros(len(known), np.int64)
        later = start > 0
        base[later] = self.words.access(start[later] - 1)
        target = base + words[known] + 1
        at, found = self.words.successor(target)
        hit = (at >= start) & (at < end) & (found == target)
        out[known[hit]] = self.codes[at[hit]]
        return out
