"""Token counts by rank-synchronous merging of byte pairs over ragged arrays.

A batch of distinct pre-tokens is one flat array of symbol ids with row offsets. In each step every row applies all
occurrences of its lowest-ranked pair at once; rows are done when no pair has a rank. As a merged symbol only takes part
in pairs of higher rank than its own, this gives what merging one pair at a time gives. What is left is counted. Long
pre-tokens merge one by one in the same order of ranks, each rank at its own places only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import slices, tidy

#: Distinct pre-tokens whose counts a worker keeps within a partition; beyond it starts afresh (a count is then worked out again).
CACHE = 500_000
NONE = np.int64(1 << 40)
#: Bytes beyond which a pre-token is merged by itself, so that a rank costs its places and not the whole token.
LONG = 512


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each pre-token."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        left = np.array([len(r) for r in raw], np.int64)
        out, rows = left.copy(), np.arange(len(raw))
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        while len(symbols):
            row = np.repeat(np.arange(len(left)), left)
            inside = np.append(row[1:] == row[:-1], False)
            rank = np.full(len(symbols), NONE)
            at = np.flatnonzero(inside)
            rank[at] = self.rank(symbols[at], symbols[at + 1])
            best = np.minimum.reduceat(rank, np.cumsum(left) - left)
            live = best < NONE
            out[rows[~live]] = left[~live]
            if not live.any():
                break
            keep = live[row]  # rows that are done leave the arrays
            symbols, rank, row = symbols[keep], rank[keep], row[keep]
            rows, left, best = rows[live], left[live], best[live]
            row = np.repeat(np.arange(len(left)), left)
            hit = rank == best[row]
            if (hit[1:] & hit[:-1]).any():  # a run such as aaa: every second pair from the left
                at = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, 0))
                hit &= (at - begin) % 2 == 0
            symbols[hit] = self.made[rank[hit]]
            stay = ~np.append(False, hit[:-1])
            symbols = symbols[stay]
            left = np.add.reduceat(stay.astype(np.int64), np.cumsum(left) - left)
        return out

    def count_long(self, token: str) -> int:
        """Symbols left of one long pre-token: the same merges, but each rank visits only the places that have it.

        A merge makes pairs of higher rank than its own, so ranks come up in ascending order, each once.
        """
        symbols = self.first[np.frombuffer(token.encode("utf-8", "surrogatepass"), np.uint8)]
        n = len(symbols)
        before, after, alive = np.arange(-1, n - 1), np.arange(1, n + 1), np.ones(n, bool)
        rank = np.append(self.rank(symbols[:-1], symbols[1:]), NONE)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            cut = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cut) if len(at) else []:
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heappush(heap, r)
                places[r].append(part)

        put(np.arange(n))
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            chained = np.append(False, after[at[:-1]] == at[1:])  # a run such as aaa: every second pair from the left
            if chained.any():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbols[at], alive[gone], rank[gone], after[at] = self.made[r], False, NONE, follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            rank[touched] = NONE
            touched = touched[after[touched] < n]
            rank[touched] = self.rank(symbols[touched], symbols[after[touched]])
            put(touched)
        return int(alive.sum())

    def learn(self, tokens: set[str], most: int = 1 << 22) -> None:
        """Counts for pre-tokens that are new, in parts of about `most` characters."""
        part, size = [], 0
        for t in tokens:
            if t not in self.known:
                if len(t) > LONG:
                    self.known[t] = self.count_long(t)
                    continue
                part.append(t)
                size += len(t)
                if size >= most:
                    self.known.update(zip(part, self.count(part).tolist(), strict=True))
                    part, size = [], 0
        if part:
            self.known.update(zip(part, self.count(part).tolist(), strict=True))

    def totals(self, texts: list[str | None]) -> list[int]:
        cut, fixed = [], []
        for t in texts:
            pieces = self.special.split(t) if t and self.special else [t or ""]
            fixed.append(len(pieces) - 1)
            cut.append([x for p in pieces if p for x in self.split.findall(p)])
        wanted = set().union(*cut) if cut else set()
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn(wanted)
        get = self.known.__getitem__
        return [n + sum(map(get, c)) for n, c in zip(fixed, cut, strict=True)]


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One for each worker and vocabulary: reading the file costs a second."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def vocabulary(name: str) -> str:
    """The path of a vocabulary file on this machine (each executor has the library that carries them)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of each document. Null and empty texts have 0 of both; repeated rows give repeated rows.

    vocab: a name known to public_tokenizers or an absolute path of a byte-level byte-pair file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocab if vocab.startswith("/") else vocabulary(vocab))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                n = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(m.totals(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        m.known.clear()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op9_token_counts(docs: DataFrame, limit: int = 512) -> DataFrame:
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
