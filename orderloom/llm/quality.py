"""Quality: supervised subword embeddings.

A document is the average of the learned vectors of its features: each word by itself, the byte n-grams of the word between
boundary marks, and for each word that repeats the word before it one common feature. All are hashed into one table. A
softmax over the two labels reads the average; table and output are trained by stochastic gradient descent in numpy, one document a step, with a
rate that falls to zero. A part of the sample is kept to place the threshold, and scores are shifted so that it is at 0.7.

As the output is linear in the average, what a trained feature adds to the difference of the two outputs is one number. Scoring a
text sums these numbers over its words, worked out once for each distinct word of a batch. Labels, language, source and
id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import mix, slices, staged, tidy, words_of

BUCKETS, DIM, GRAMS = 1 << 17, 8, (2, 3, 4)
#: Bounds of the training sample: rows of each label, and the bytes of a text.
LABEL_ROWS, SAMPLE_TEXT_BYTES = 2500, 16 << 10
THRESHOLD = 0.7
#: The bucket of "this word repeats the one before it"; hashed features start behind it.
REPEAT = 0


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and flat buckets of the features of each word: itself and its n-grams, one byte of boundary at both ends."""
    words = words.cast(pa.large_string())
    n = len(words)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends) + 2
    begin = np.cumsum(size) - size
    data = np.full(int(size.sum()), 32, np.uint64)
    data[np.arange(len(raw)) + np.repeat(begin + 1 - (ends[:-1] - ends[0]), size - 2)] = raw
    with np.errstate(over="ignore"):
        place = (np.arange(len(data)) - np.repeat(begin, size)).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(data + (place << np.uint64(8))), dtype=np.uint64)])
        parts = [(np.arange(n), mix(sums[begin + size] - sums[begin]))]
        row, left = np.repeat(np.arange(n), size), np.repeat(begin + size, size) - np.arange(len(data))
        for g in GRAMS:
            at = np.flatnonzero(left >= g)
            code = np.full(len(at), g, np.uint64)
            for k in range(g):
                code = (code << np.uint64(8)) | data[at + k]
            parts.append((row[at], mix(code)))
    rows, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n + 1)), (hashes[order] % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


@dataclass
class Texts:
    """Ragged word codes of a batch of texts, the features of the distinct words, and each text's repeats of a word."""

    offsets: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        offsets, flat = words_of(texts, lower=False)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        again = np.zeros(len(codes) + 1, np.int64)
        again[1:-1] = codes[1:] == codes[:-1]
        again[offsets[:-1]] = 0  # a text's first word repeats nothing
        total = np.concatenate([[0], np.cumsum(again[: len(codes)])])
        return cls(offsets, codes, *word_features(coded.dictionary), total[offsets[1:]] - total[offsets[:-1]])

    def features(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text i and their share of its features."""
        own = self.codes[self.offsets[i] : self.offsets[i + 1]]
        flat = np.concatenate([self.buckets[self.starts[c] : self.starts[c + 1]] for c in own.tolist()] + [np.full(self.repeats[i], REPEAT, np.int64)])
        bucket, count = np.unique(flat, return_counts=True)
        return bucket.astype(np.int32), (count / max(1, len(flat))).astype(np.float32)


@dataclass
class Model:
    """What each feature adds to the difference of the outputs, the outputs' own difference, and the place of the threshold."""

    gain: np.ndarray
    bias: float
    shift: float = 0.0

    def margin(self, t: Texts) -> np.ndarray:
        """Of each text the mean gain of its features. Sums go word by word in the order of the text, so copies score alike."""
        word = np.add.reduceat(self.gain[t.buckets], t.starts[:-1]) if len(t.buckets) else np.zeros(0)
        row = np.repeat(np.arange(len(t.repeats)), np.diff(t.offsets))
        total = np.bincount(row, word[t.codes], len(t.repeats)) + t.repeats * self.gain[REPEAT]
        count = np.bincount(row, np.diff(t.starts)[t.codes], len(t.repeats)) + t.repeats
        return self.bias + total / np.maximum(count, 1)

    def score(self, t: Texts) -> np.ndarray:
        z = self.margin(t) - self.shift + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def descend(table: np.ndarray, out: np.ndarray, bias: np.ndarray, bucket: np.ndarray, share: np.ndarray, y: int, rate: float) -> float:
    """One step of stochastic gradient descent on one document; its loss before the step."""
    rows = table[bucket]
    h = share @ rows
    p = softmax(out @ h + bias)
    d = p.copy()
    d[y] -= 1
    down = d @ out
    out -= rate * np.outer(d, h)
    bias -= rate * d
    table[bucket] = rows - rate * share[:, None] * down
    return -float(np.log(max(p[y], 1e-12)))


def train(texts: list[str], labels: np.ndarray, steps: int = 30_000, rate: float = 4.0, seed: int = 5) -> Model:
    """About `steps` steps (5 to 40 rounds over the sample), one row in five kept to place the threshold."""
    if len(set(labels.tolist())) < 2:  # nothing to tell apart
        return Model(np.zeros(BUCKETS), 4.0 if len(labels) and labels[0] else -4.0)
    rng = np.random.default_rng(seed)
    table, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    fit, rest = np.flatnonzero(np.arange(len(texts)) % 5 != 4), np.flatnonzero(np.arange(len(texts)) % 5 == 4)
    rows = [Texts.of(pa.array([texts[i]], pa.large_string())).features(0) for i in fit]
    seen = np.zeros(BUCKETS, bool)
    for bucket, _ in rows:
        seen[bucket] = True
    table[~seen] = 0  # features of no training text say nothing
    rounds = int(np.clip(steps // len(fit), 5, 40))
    for r in range(rounds):
        for k, i in enumerate(rng.permutation(len(fit)).tolist()):
            descend(table, out, bias, *rows[i], int(labels[fit[i]]), rate * (1 - (r + k / len(fit)) / rounds))
    model = Model(table.astype(np.float64) @ (out[1] - out[0]).astype(np.float64), float(bias[1] - bias[0]))
    model.shift = threshold(model.margin(Texts.of(pa.array([texts[i] for i in rest], pa.large_string()))), labels[rest])
    return model


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest stretch of margins with the smallest sum of both labels' shares of errors."""
    if len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    below, above = np.concatenate([[0], np.cumsum(y)]) / y.sum(), np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    errors = np.round(below + 1 - above, 9)
    edge = np.concatenate([[z[0]], z, [z[-1]]])
    best = np.flatnonzero(errors == errors.min())
    i = best[np.argmax((edge[1:] - edge[:-1])[best])]
    return float((edge[i] + edge[i + 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The training sample: of each label the labelled rows with the smallest hashes of their ids, at most label_rows.

    Texts of over `text_bytes` are not in it, so that the sample's bytes are bounded as well. An id with both labels counts
    as 0; of an id's different texts the first in order is taken. Null ids and labels other than 0 and 1 are left out.
    """
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    some = lambda y: marks.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(label_rows)
    drawn = staged(some(0).union(some(1)), "quality-sample")  # bounded: 2 * label_rows rows
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= text_bytes)
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    order = np.random.default_rng(3).permutation(len(rows))
    return [rows["text"].iloc[i] for i in order], rows["y"].to_numpy(np.int64)[order]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score. Null and empty texts get the score of no words; repeated rows repeat; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(Texts.of(part.column("text"))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op13_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(*sample(docs, labels.where(~held_out())))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
