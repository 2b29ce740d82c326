"""A compact n-gram trie: Elias-Fano levels in memory-mapped files, quantised smoothed probabilities beside them.

words: the ascending hashes of the words that follow a context here; contexts: the ascending hashes of the contexts;
pointers: where each context's successors begin (monotone); successors: a context's rank and a word's rank as one
ascending number, so that a search for a successor is relative to its context. Two bytes stand for a successor's smoothed
probability, and two for what a context leaves to shorter ones. The levels are read where they lie in the map: beside
them a task holds a number for each 64 bits of the high parts. The files are in a folder of the task's own machine, and
go when the task is done with them.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Codes of probabilities: steps of a constant share of -ln(p), and far finer ones near p = 1, where long texts would add up errors.
NONE, SCALE, NEAR = 65535, 4300.0, 1e-5
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: The place of the r-th set bit of a byte.
PLACE = np.array([[[k for k in range(8) if b >> k & 1][r] if r < bin(b).count("1") else 0 for r in range(8)] for b in range(256)], np.uint8)


def quantised(p: np.ndarray) -> np.ndarray:
    """The code of each probability above e^-33; `probability` gives it back with -ln(p) off by a part in 8,600 at most."""
    return np.minimum(np.rint(SCALE * np.log1p(-np.log(np.maximum(p, 1e-300)) / NEAR)), NONE - 1).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    """0 for the code of nothing."""
    return np.where(codes == NONE, 0.0, np.exp(-NEAR * np.expm1(codes / SCALE)))


class EliasFano:
    """Ascending numbers: the low bytes as they are, the high parts as a bit vector with a one for each number and a zero for each step."""

    def __init__(self, folder: str, name: str):
        load = lambda part: np.load(f"{folder}/{name}-{part}.npy", mmap_mode="r")
        self.width, self.n, self.top = (int(x) for x in np.load(f"{folder}/{name}-size.npy"))
        self.low, self.high = load("low"), load("high")
        ones = np.concatenate([[0], np.cumsum(ONES[self.high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64))])
        self.before = {True: ones, False: 64 * np.arange(len(ones)) - ones}

    @staticmethod
    def write(folder: str, name: str, values: np.ndarray) -> None:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(7, max(0, -(-max(0, (top // max(n, 1)).bit_length()) // 8)))  # whole bytes, so that rows stay aligned
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        np.save(f"{folder}/{name}-low.npy", np.ascontiguousarray(low))
        np.save(f"{folder}/{name}-high.npy", np.packbits(bits, bitorder="little").view("<u8"))
        np.save(f"{folder}/{name}-size.npy", np.array([width, n, int(high[-1]) if n else -1]))

    def select(self, at: np.ndarray, bit: bool) -> np.ndarray:
        """The place of each at-th one or zero: by the counts to a word, by its bytes to a byte, by a table to the bit."""
        before = self.before[bit]
        word = np.searchsorted(before, at, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        left = at - before[word]
        raw = np.ascontiguousarray(self.high[word] if bit else ~self.high[word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(ONES[raw], axis=1, dtype=np.int64)
        byte = np.minimum((sums <= left[:, None]).sum(1), 7)
        rows = np.arange(len(at))
        left = left - np.where(byte > 0, sums[rows, byte - 1], 0)
        return word * 64 + byte * 8 + PLACE[raw[rows, byte], np.minimum(left, 7)]

    def access(self, at: np.ndarray) -> np.ndarray:
        high = (self.select(at, True) - at).astype(np.uint64) << np.uint64(8 * self.width)
        return high | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            out |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not: by its high part to a short stretch, then by halving."""
        if not self.n:
            return np.full(len(keys), -1)
        high = (keys >> np.uint64(8 * self.width)).astype(np.int64)
        inside = (high >= 0) & (high <= self.top)
        high = np.where(inside, high, 0)
        hi = self.select(high, False) - high
        lo = np.where(high > 0, self.select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        want = keys & np.uint64((1 << 8 * self.width) - 1)
        end = hi.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) // 2
            less = (lo < hi) & (self._low(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        hit = inside & (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == want)
        return np.where(hit, lo, -1)


class NgramTrie:
    """Built from (context, word, count); queried for the codes of probabilities. A context manager: the files go at its end.

    A successor's probability is (count - discount) / total of its context, a context's weight is discount * successors /
    total. totals: (ascending hashes, totals) of contexts of which this trie holds a part only.
    """

    PART = 1 << 16

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float, totals: tuple[np.ndarray, np.ndarray] | None = None):
        self.folder = tempfile.mkdtemp(prefix="trie-")
        known, rank = np.unique(contexts, return_inverse=True)
        vocabulary, word = np.unique(words, return_inverse=True)
        self.step = np.uint64(max(len(vocabulary), 1))
        key = rank.astype(np.uint64) * self.step + word.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, counts = key[first], np.add.reduceat(counts, first) if len(first) else counts
        of = (key // self.step).astype(np.int64)
        begin = np.searchsorted(of, np.arange(len(known) + 1))
        total = np.bincount(of, counts, len(known))
        if totals is not None and len(totals[0]):
            at = np.minimum(np.searchsorted(totals[0], known), len(totals[0]) - 1)
            total = np.where(totals[0][at] == known, totals[1][at], total)
        for name, values in (("words", vocabulary), ("contexts", known), ("pointers", begin.astype(np.uint64)), ("successors", key)):
            EliasFano.write(self.folder, name, values)
        np.save(f"{self.folder}/codes.npy", quantised((counts - discount) / total[of]))
        np.save(f"{self.folder}/weights.npy", quantised(discount * np.diff(begin) / np.maximum(total, 1)))
        self.words, self.contexts, self.pointers, self.successors = (EliasFano(self.folder, x) for x in ("words", "contexts", "pointers", "successors"))
        self.codes, self.weights = (np.load(f"{self.folder}/{x}.npy", mmap_mode="r") for x in ("codes", "weights"))

    def __enter__(self) -> NgramTrie:
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def bytes(self) -> int:
        return sum(os.path.getsize(f"{self.folder}/{f}") for f in os.listdir(self.folder))

    def successors_of(self, contexts: np.ndarray) -> np.ndarray:
        """The number of successors of each context."""
        rank = self.contexts.find(contexts)
        out, at = np.zeros(len(contexts), np.int64), rank[rank >= 0]
        out[rank >= 0] = (self.pointers.access(at + 1) - self.pointers.access(at)).astype(np.int64)
        return out

    def query(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct contexts, each with `sizes` words: the codes of all pairs (NONE: not seen) and each context's weight (NONE: unknown)."""
        rank = self.contexts.find(contexts)
        weights = np.full(len(contexts), NONE, np.uint16)
        weights[rank >= 0] = self.weights[rank[rank >= 0]]
        each = np.repeat(rank, sizes)
        codes = np.full(len(words), NONE, np.uint16)
        for k in range(0, len(words), self.PART):
            context = each[k : k + self.PART]
            word = self.words.find(words[k : k + self.PART])
            here = np.flatnonzero((context >= 0) & (word >= 0))
            at = self.successors.find(context[here].astype(np.uint64) * self.step + word[here].astype(np.uint64))
            codes[k + here[at >= 0]] = self.codes[at[at >= 0]]
        return codes, weights
