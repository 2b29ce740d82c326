"""Benchmark decontamination by spaced seeds, with verified overlaps around their hits.

Words are lower-cased and trimmed of punctuation. A stretch of a document counts when, laid word by word along a stretch of
an item, at least three of four words are equal, and at least `least_equal` of them: 10, or for items of eight to twelve
words four of five, or for still shorter ones all.

Seeds are windows of words under fixed masks that ignore the words at their zeros. Every stretch that counts holds one:
* four equal words in a row are a seed by themselves. Otherwise all runs of equal words have at most three;
* with c changed words the stretch has c + 1 runs (some may be empty) and at least 3c equal words, so that all runs
  together lack at most three words of three each. With 7 equal words or more, a run of three stands beside one that is
  not empty (of four runs or more one is whole, and an empty one uses up all that may lack; three runs hold 3 + 3 + 1 or
  3 + 2 + 2 words), and this makes the mask 11101 or 10111.
Window hashes of the benchmark are a sorted index; every window of every document is looked up in it. The diagonal of each
hit is then searched for the stretch with the most equal words among those that count.

A phrase that many items share would send a document that holds it to all of them. But the seeds of a stretch of ten equal
words or more together reach over at least EXTENT words (the tests go through all such patterns; a longer stretch holds a shorter one
that counts, as one of its halves does). So an item whose frequent seeds all lie within fewer words goes without them: each of its
stretches has a rare seed too. And a diagonal whose hits reach over fewer words is not looked at.

The index of a benchmark is small beside the corpus and is sent to the tasks, in parts of at most INDEX_ROWS windows: a
larger benchmark takes one pass over the documents for each part, never more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderloom.llm.common import arrow_schema, hash_words, mix, slices, staged, tidy, words_of

MASKS = ("1111", "11101", "10111")
#: Hits that are gathered at once, and words that are compared at once.
HITS, COMPARED = 1 << 20, 1 << 20
#: Places in items beyond which a seed is frequent.
FREQUENT = 64
#: Words over which the seeds of a stretch with ten equal words reach at least.
EXTENT = 6
#: Equal words for one changed word in a stretch, and the fewest words of an item.
FOR_ONE, LEAST_ITEM = 3, 5
INDEX_ROWS = 1 << 20
TRIM = " \t.,;:!?\"'()[]{}|<>-_*#"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and hashes of the trimmed words; words of punctuation alone are left out."""
    starts, flat = words_of(texts)
    coded = flat.dictionary_encode()
    bare = pc.utf8_lower(pc.utf8_trim(coded.dictionary, TRIM))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(bare, "").to_numpy(zero_copy_only=False).astype(bool)
    hashes = hash_words(bare)
    if full.all():
        return starts, hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    keep = full[codes]
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[starts], hashes[codes[keep]]


def least_equal(n: int) -> int:
    """The fewest equal words of a stretch with an item of n words."""
    return n if n < 8 else min(10, -(-4 * n // 5))


def windows(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of len(mask) words under the mask."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), mix(np.array([len(mask) * 31 + int(mask, 2)], np.uint64))[0])
    factors = mix(np.arange(1, len(mask) + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1" and n > 0:
                out += h[k : k + n] * factors[k]
    return mix(out)


class Index:
    """Window hashes of distinct benchmark texts, ascending, with the text and position of each; a small bit table tells most misses."""

    def __init__(self, items: list[tuple[int, str]]):
        starts, h = word_hashes(pa.array([t for _, t in items], pa.large_string()))
        self.ids, self.words, seen = [], [], set()
        self.same: list[tuple[int, int]] = []
        first: dict[bytes, int] = {}
        for (item, _), a, b in zip(items, starts[:-1], starts[1:], strict=True):
            key = h[a:b].tobytes()
            if b - a >= LEAST_ITEM:
                if key not in seen:
                    seen.add(key)
                    first[key] = item
                    self.ids.append(item)
                    self.words.append(h[a:b].copy())
                self.same.append((first[key], item))
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.every, self.begin = np.concatenate([*self.words, np.zeros(0, np.uint64)]), np.cumsum(self.length) - self.length
        self.least = np.array([least_equal(n) for n in self.length], np.int64)
        self.extent = np.where(self.least == 10, EXTENT, 0)
        seeds = {}
        for mask in MASKS if self.words else ():
            rows = [windows(w, mask) for w in self.words]
            size = np.array([len(r) for r in rows])
            text = np.repeat(np.arange(len(rows)), size)
            seeds[mask] = np.concatenate(rows), text, np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        frequent, first, last = {}, np.full(len(self.words), 1 << 40), np.full(len(self.words), -1)
        for mask, (hashes, text, at) in seeds.items():
            _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            frequent[mask] = often = count[back] > FREQUENT
            np.minimum.at(first, text[often], at[often])
            np.maximum.at(last, text[often], at[often] + len(mask))
        spared = last - first < self.extent
        self.masks = {}
        for mask, (hashes, text, at) in seeds.items():
            stay = ~(frequent[mask] & spared[text])
            hashes, text, at = hashes[stay], text[stay], at[stay]
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[hashes & np.uint64((1 << 22) - 1)] = True
            self.masks[mask] = hashes[order], text[order], at[order], bits

    def hits(self, starts: np.ndarray, h: np.ndarray) -> dict[str, tuple[np.ndarray, ...]]:
        """By mask: row, place in h, first place in the index and number of places of each window that the index holds, by row."""
        out = {}
        for mask, (hashes, _, _, bits) in self.masks.items():
            got = windows(h, mask)
            hit = np.flatnonzero(bits[got & np.uint64((1 << 22) - 1)])
            low, high = (np.searchsorted(hashes, got[hit], side=s) for s in ("left", "right"))
            row = np.searchsorted(starts, hit, side="right") - 1
            use = (high > low) & (hit + len(mask) <= starts[np.minimum(row + 1, len(starts) - 1)])
            out[mask] = row[use], hit[use], low[use], (high - low)[use]
        return out

    def diagonals(self, hits: dict[str, tuple[np.ndarray, ...]], lo: int, hi: int) -> np.ndarray:
        """row, text, start (the place in h of the text's first word), and the words over which the hits reach, for rows from lo to hi.

        Hits are gathered HITS at a time and at once reduced to one row a diagonal.
        """
        best = np.zeros((0, 5), np.int64)
        for mask, (row, hit, low, n) in hits.items():
            _, text, at, _ = self.masks[mask]
            a, b = np.searchsorted(row, (lo, hi))
            until = np.cumsum(n[a:b])
            for k in range(0, int(until[-1]) if len(until) else 0, HITS):
                each = np.arange(k, min(k + HITS, int(until[-1])))
                of = np.searchsorted(until, each, side="right")
                which = low[a:b][of] + each - (until - n[a:b])[of]
                place = hit[a:b][of]
                best = reduced(np.concatenate([best, np.stack([row[a:b][of], text[which], place - at[which], at[which], at[which] + len(mask)], 1)]))
        return best[best[:, 4] - best[:, 3] >= self.extent[best[:, 1]]]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, first word in the text, first word in the item, words, equal words) of each verified stretch."""
        if not self.words:
            return []
        starts, h = word_hashes(texts)
        hits = self.hits(starts, h)
        total = np.cumsum(sum(np.bincount(row, n, len(starts) - 1) for row, _, _, n in hits.values()))
        out: list[tuple[int, int, int, int, int, int]] = []
        at = 0
        while at < len(total) and (total[at - 1] if at else 0) < total[-1]:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, side="right")))
            r, i, start = self.diagonals(hits, at, end).T[:3]
            lo, hi = np.maximum(start, starts[r]), np.minimum(start + self.length[i], starts[r + 1])
            words = np.cumsum(hi - lo)
            k = 0
            while k < len(r):
                m = max(k + 1, int(np.searchsorted(words, (words[k - 1] if k else 0) + COMPARED, side="right")))
                out += self.verified(h, starts, r[k:m], i[k:m], start[k:m], lo[k:m], (hi - lo)[k:m])
                k = m
            at = end
        return sorted(out)

    def verified(self, h: np.ndarray, starts: np.ndarray, r: np.ndarray, i: np.ndarray, start: np.ndarray, lo: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """The best stretch of each diagonal, where it counts."""
        ahead = np.cumsum(size) - size
        step = np.arange(size.sum())
        same = h[step + np.repeat(lo - ahead, size)] == self.every[step + np.repeat(self.begin[i] + lo - start - ahead, size)]
        equal = np.add.reduceat(same, ahead, dtype=np.int64)
        for j in np.flatnonzero(equal >= self.least[i]).tolist():
            a, b, words = stretch(same[ahead[j] : ahead[j] + size[j]])
            if words >= self.least[i[j]]:
                yield int(r[j]), self.ids[i[j]], int(lo[j] + a - starts[r[j]]), int(lo[j] + a - start[j]), b - a, words


def reduced(rows: np.ndarray) -> np.ndarray:
    """One row for each (row, text, start): the first and last word that its hits cover."""
    rows = rows[np.lexsort(rows.T[2::-1])]
    new = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1)))[: len(rows)]
    return np.column_stack([rows[new, :3], np.minimum.reduceat(rows[:, 3], new), np.maximum.reduceat(rows[:, 4], new)]) if len(rows) else rows


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch with the most equal words among those with at most one changed word for
    FOR_ONE equal ones: the first such, from an equal word to an equal word."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -FOR_ONE))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # a stretch may begin at a new minimum of the totals only, and it is longest from the first that is low enough
    lows = np.flatnonzero(np.append(True, total[1:] < np.minimum.accumulate(total)[:-1]))
    begin = lows[np.searchsorted(-total[lows], -total, side="left")]
    best = int(np.argmax(equal - equal[begin]))
    a, b = int(begin[best]), best
    inside = np.flatnonzero(same[a:b])
    return (a + int(inside[0]), a + int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def parts_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of at most about INDEX_ROWS windows each, built one after the other."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-int(total) // INDEX_ROWS))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in part])


FOUND = "doc_id bigint, item_id bigint, doc_word int, item_word int, words int, equal_words int"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, doc_word, item_word, words, equal_words of each stretch that a document shares with an item.

    Null and empty texts and items have none; items of fewer than five words are too common to count. Benchmark items of equal words are all reported; repeated documents each for itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in parts_of(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    got = shared.value.matches(part.column("text"))
                    cols = [part.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))]
                    cols += [pa.array([g[k] for g in got], pa.int64() if k == 1 else pa.int32()) for k in range(1, 6)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "doc_word", "item_word", "words", "equal_words"])

        found = rows.mapInArrow(tidy(run), FOUND)
        if len(index.same) > len(index.ids):  # items of equal words: no more rows than the part has items
            same = spark.createDataFrame(index.same, "item_id bigint, other bigint")
            found = found.join(F.broadcast(same), "item_id").select("doc_id", F.col("other").alias("item_id"), "doc_word", "item_word", "words", "equal_words")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that share no stretch with the benchmark, as they are: decided where the text is read, without a shuffle.

    Between the parts of a large benchmark the documents are written, so that a task holds one index.
    """
    out, shared = docs, None
    schema: StructType = docs.schema
    kinds = arrow_schema(schema)
    for index in parts_of(benchmark, "item_id", "text"):
        if shared is not None:
            out = staged(out, "clean-part")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    hit = np.zeros(part.num_rows, bool)
                    hit[[g[0] for g in shared.value.matches(part.column(text_col))]] = True
                    keep = part.filter(pa.array(~hit))
                    yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(keep.columns, kinds, strict=True)], names=kinds.names)

        out = out.mapInArrow(tidy(run), schema)
    return out


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)
