"""Toxicity: a convolutional text classifier, trained on all labelled rows by shards whose models are averaged.

A word's vector is the scaled sum of hashed embeddings of the word, its head and its byte 4-grams (so that inflected forms
share what they have in common). Filters of several widths run over the words, each filter keeps its maximum over the whole
text, and a logistic unit reads the maxima. As a filter is linear, each distinct word of a batch is projected once for each
place in the filter; a text then only adds rows of those tables.

Thresholds are calibrated by language, guessed from the text itself; the score is shifted so that each language's threshold
is at 0.7. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import arrow_schema, mix, slices, staged, tidy, words_of

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 10
#: Rows and characters of a shard of the training rows: what one task holds.
SHARD_ROWS, SHARD_CHARS = 6000, 32 << 20
#: Texts that training goes over in a shard (6 to 60 rounds if there is one), and the rounds after each of which shards are averaged.
SEEN, ROUNDS = 24000, 4
#: Least sum of squares of Adagrad; parts of one that moves are counted in; steps of one that margins are counted in.
EPS, UNIT, MARGIN_STEPS = 1e-4, float(1 << 32), 1024
THRESHOLD = 0.7
#: Training texts in which a feature must occur to get an embedding.
LEAST_TEXTS = 3
#: Standard deviations by which a feature must be more frequent in toxic texts than by chance to get one.
LEAST_EXCESS = 3.0
#: Frequent function words by language, for the guess of a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are with as be by this".split(),
    "de": "der die und das den von zu mit ist des im für nicht ein eine auf dem".split(),
    "fr": "le la les et des du un une dans est que qui pour par au en sur".split(),
    "es": "el los las y del un una en es que por con para se lo al su".split(),
}
TRIM = " \t.,;:!?\"'()[]{}|<>-_*#"


def word_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and flat buckets of the features of each word: itself, its first five bytes, its byte 4-grams."""
    words = words.cast(pa.large_string())
    n = len(words)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
    size = np.diff(ends)
    data = data[ends[0] : ends[-1]].astype(np.uint64)
    begin = ends[:-1] - ends[0]
    power = np.uint64(0x100000001B3)
    place = np.arange(len(data)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        salted = mix(data + (place.astype(np.uint64) << np.uint64(8)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(salted, dtype=np.uint64)])
        whole = mix(sums[begin + size] - sums[begin] + size.astype(np.uint64) * power)
        head = mix(sums[begin + np.minimum(size, 5)] - sums[begin] + np.uint64(7))
        grams = data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16) | data[3:] << np.uint64(24) if len(data) > 3 else np.zeros(0, np.uint64)
        grams = mix(grams + np.uint64(0x51))
    count = np.maximum(size - 3, 0)
    starts = np.concatenate([[0], np.cumsum(count + 2)])
    out = np.empty(starts[-1], np.uint64)
    out[starts[:-1]], out[starts[:-1] + 1] = whole, head
    row = np.repeat(np.arange(n), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    out[starts[row] + 2 + step] = grams[begin[row] + step]
    return starts, (out % np.uint64(BUCKETS)).astype(np.int64)


def spread(n: np.ndarray) -> np.ndarray:
    """The factor on the sum of n feature embeddings: as 1 / sqrt(n) up to 8 features, then as their mean, so that no long word stands out by its length."""
    return (np.sqrt(np.minimum(n, 8)) / n).astype(np.float32)


@dataclass
class Texts:
    """Ragged word codes of a batch (two pads, code 0, after each text) and the features of the distinct words."""

    starts: np.ndarray
    codes: np.ndarray
    features: np.ndarray
    buckets: np.ndarray
    language: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        offsets, flat = words_of(texts)
        coded = flat.dictionary_encode()
        bare = pc.utf8_lower(pc.utf8_trim(coded.dictionary, TRIM)).dictionary_encode()
        again = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = again[coded.indices.to_numpy(zero_copy_only=False)] + 1 if len(flat) else np.zeros(0, np.int64)
        size = np.diff(offsets)
        tongues = np.zeros((len(FUNCTION_WORDS), len(bare.dictionary) + 1), np.int32)
        for i, known in enumerate(FUNCTION_WORDS.values()):
            tongues[i, 1:] = pc.is_in(bare.dictionary, pa.array(known, bare.dictionary.type)).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        votes = np.stack([np.bincount(row, t[codes], len(size)) for t in tongues])
        language = np.where(votes.max(0) > 0, votes.argmax(0), len(FUNCTION_WORDS))
        padded = np.zeros(len(codes) + 2 * len(size), np.int64)
        padded[np.arange(len(codes)) + 2 * row] = codes
        starts, buckets = word_buckets(bare.dictionary)
        return cls(offsets[:-1] + 2 * np.arange(len(size)), padded, np.concatenate([[0], starts]), buckets, language)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """Word vectors; row 0, the pad, is zero."""
        n = np.diff(self.features)
        out = np.zeros((len(n), table.shape[1]), np.float32)
        if len(self.buckets):
            at = np.flatnonzero(n)
            out[at] = np.add.reduceat(table[self.buckets], self.features[at], axis=0) * spread(n[at])[:, None]
        return out


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    scale: float = 1.0

    def pooled(self, t: Texts, x: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maxima (text, filter) and, for training, the filters' outputs."""
        x = t.vectors(self.table) if x is None else x
        every, outs = [], []
        for f in self.filters:
            w = f.shape[0]
            out = (x @ f[0])[t.codes]
            for k in range(1, w):
                out[:-k] += (x @ f[k])[t.codes[k:]]
            out[t.codes == 0] = 0  # windows that begin at a pad would reach into the next text
            outs.append(out)
            every.append(np.maximum.reduceat(out, t.starts, axis=0) if len(t.starts) else np.zeros((0, f.shape[2]), np.float32))
        return np.maximum(np.concatenate(every, 1), 0), outs

    def margin(self, t: Texts) -> np.ndarray:
        return self.pooled(t)[0] @ self.weights + self.bias

    def score(self, t: Texts) -> np.ndarray:
        z = self.scale * (self.margin(t).astype(np.float64) - self.shift[t.language]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def blank(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    return Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)


def sized(texts: list[str], order: np.ndarray, rows: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The order in pieces of at most so many rows and characters (one row at least)."""
    begin = held = 0
    for i, j in enumerate(order):
        n = len(texts[j])
        if i > begin and (i - begin == rows or held + n > most):
            yield order[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(order):
        yield order[begin:]


def occurrences(t: Texts, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature the texts and the toxic texts of a batch that hold it."""
    n = len(t.features) - 1
    ends = np.append(t.starts[1:], len(t.codes))
    row = np.repeat(np.arange(len(t.starts)), ends - t.starts)
    once = np.unique(row * n + t.codes)
    row, code = once // n, once % n
    size = np.diff(t.features)[code]
    spots = np.repeat(t.features[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    own = np.unique(np.repeat(row, size) * BUCKETS + t.buckets[spots])
    return np.bincount(own % BUCKETS, minlength=BUCKETS), np.bincount(own % BUCKETS, labels[own // BUCKETS], BUCKETS).astype(np.int64)


def descend(m: Model, g: list[np.ndarray], texts: list[str], labels: np.ndarray, told: np.ndarray, rounds: int, rng: np.random.Generator, batch: int = 64, rate: float = 0.05) -> None:
    """Rounds of Adagrad on the logistic loss over the texts, in place; g: sums of squares of the table's rows, each filter, weights and bias."""
    g_table, *g_filters, g_weights, g_bias = g
    for _ in range(rounds):
        for at in sized(texts, rng.permutation(len(texts)), batch):
            t = Texts.of(pa.array([texts[j] for j in at], pa.large_string()))
            x = t.vectors(m.table)
            p, outs = m.pooled(t, x)
            d = (1 / (1 + np.exp(-np.clip(p @ m.weights + m.bias, -30, 30))) - labels[at]).astype(np.float32) / len(at)
            d_pool = d[:, None] * m.weights * (p > 0)
            d_weights, d_bias = p.T @ d, float(d.sum())
            d_x, c = np.zeros_like(x), 0
            for f, out, gf in zip(m.filters, outs, g_filters, strict=True):
                part = d_pool[:, c : c + FILTERS]
                best = np.concatenate([out, np.full((1, FILTERS), -np.inf, np.float32)])
                ends = np.append(t.starts[1:], len(out))
                where = np.stack([s + best[s:e].argmax(0) for s, e in zip(t.starts, ends, strict=True)])
                d_f = np.zeros_like(f)
                for k in range(f.shape[0]):
                    words = np.where(where + k < len(t.codes), t.codes[np.minimum(where + k, len(t.codes) - 1)], 0)
                    d_f[k] = np.einsum("bfd,bf->df", x[words], part)
                    np.add.at(d_x, words.ravel(), (part[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                gf += d_f**2
                f -= rate * d_f / np.sqrt(gf)
                c += FILTERS
            d_x[0] = 0
            hit = np.flatnonzero(np.abs(d_x).sum(1))
            n = np.diff(t.features)[hit]
            spots = np.repeat(t.features[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows, grads = t.buckets[spots], np.repeat(d_x[hit] * spread(n)[:, None], n, axis=0)
            rows, grads = rows[keep := told[rows]], grads[keep]
            np.add.at(g_table, rows, (grads**2).mean(1))
            np.add.at(m.table, rows, -rate * grads / np.sqrt(g_table[rows, None]))
            g_weights += d_weights**2
            m.weights -= rate * d_weights / np.sqrt(g_weights)
            g_bias += d_bias**2
            m.bias -= float(rate * d_bias / np.sqrt(g_bias[0]))


def flat(m: Model, g: list[np.ndarray], told: np.ndarray) -> np.ndarray:
    """All parameters that training moves and their sums of squares, as one array."""
    return np.concatenate([m.table[told].ravel(), *(f.ravel() for f in m.filters), m.weights, [m.bias], g[0][told], *(x.ravel() for x in g[1:])]).astype(np.float64)


def restored(v: np.ndarray, m: Model, g: list[np.ndarray], told: np.ndarray) -> None:
    """The reverse of `flat`, in place."""
    n, at = int(told.sum()), 0

    def take(k: int) -> np.ndarray:
        nonlocal at
        at += k
        return v[at - k : at].astype(np.float32)

    m.table[told] = take(n * DIM).reshape(n, DIM)
    for f in m.filters:
        f[:] = take(f.size).reshape(f.shape)
    m.weights[:] = take(len(m.weights))
    m.bias = float(take(1)[0])
    g[0][told] = take(n)
    for x in g[1:]:
        x[:] = take(x.size).reshape(x.shape)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """shard, texts and labels of each shard of rows that come sorted by it."""
    now, texts, labels = None, [], []
    for batch in batches:
        for shard, text, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "text", "y")), strict=True):
            if shard != now and texts:
                yield now, texts, np.array(labels)
                texts, labels = [], []
            now = shard
            texts.append(text)
            labels.append(y)
    if texts:
        yield now, texts, np.array(labels)


def train(rows: DataFrame, seed: int = 7) -> Model:
    """The model of all rows (id, text, y).

    One row in five is kept for calibration. The others are dealt by a hash to shards of bounded size; in each round every shard
    goes on from the shared model over its own rows, and each parameter moves on by the mean move of the shards that moved it. Moves
    are added as whole numbers of 2^-32, so that no order of sums shows. One shard does all its rounds at once.
    """
    m, kept = blank(seed), F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 4
    sizes = rows.groupBy("y", kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # four rows at most
    fit_sizes = [r for r in sizes if not r.kept]
    if len({r.y for r in fit_sizes}) < 2:  # nothing to tell apart
        m.weights[:] = 0
        m.bias = 4.0 if sizes and max(sizes, key=lambda r: r.n).y else -4.0
        return m
    n, chars = sum(r.n for r in fit_sizes), sum(r.chars or 0 for r in fit_sizes)
    share = sum(r.n for r in fit_sizes if r.y) / n
    shards = max(-(-n // SHARD_ROWS), -(-chars // SHARD_CHARS), 1)
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards))
    rest = rows.where(kept)
    fit_rows = staged(rows.where(~kept).select(shard.alias("shard"), "id", "text", "y").repartition(int(shards), "shard").sortWithinPartitions("shard", "id", "text"), "toxic-shards").select("shard", "text", "y")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, marked = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                c, k = occurrences(Texts.of(part.column("text")), part.column("y").to_numpy())
                common, marked = common + c, marked + k
        at = np.flatnonzero(common)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(common[at]), pa.array(marked[at])], ["at", "common", "marked"])

    counts = fit_rows.mapInArrow(tidy(held), "at bigint, common bigint, marked bigint").groupBy("at").agg(F.sum("common"), F.sum("marked")).toPandas().to_numpy(np.int64)  # BUCKETS rows at most
    common, marked = np.zeros(BUCKETS), np.zeros(BUCKETS)
    common[counts[:, 0]], marked[counts[:, 0]] = counts[:, 1], counts[:, 2]
    # features of few texts, or not more frequent in toxic texts than by chance, say nothing: their embedding is and stays zero
    excess = (marked - common * share) / np.sqrt(np.maximum(common, 1) * max(share * (1 - share), 1e-9))
    told = (common >= LEAST_TEXTS) & (excess >= LEAST_EXCESS)
    m.table[~told] = 0
    g = [np.full(BUCKETS, EPS, np.float32), *(np.full_like(f, EPS) for f in m.filters), np.full_like(m.weights, EPS), np.full(1, EPS, np.float32)]
    rounds, each = (1, int(np.clip(SEEN // n, 6, 60))) if shards == 1 else (ROUNDS, max(1, round(SEEN * shards / (ROUNDS * n))))
    for r in range(rounds):
        start = flat(m, g, told)
        shared = rows.sparkSession.sparkContext.broadcast((m, g, told))

        def moved(batches: Iterator[pa.RecordBatch], shared=shared, start=start, r=r) -> Iterator[pa.RecordBatch]:
            total, times = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            for shard, texts, labels in shards_of(batches):
                own, own_g = copy.deepcopy(shared.value[:2])
                descend(own, own_g, texts, labels, shared.value[2], each, np.random.default_rng([seed, r, shard]))
                move = np.rint((flat(own, own_g, shared.value[2]) - start) * UNIT).astype(np.int64)
                total, times = total + move, times + (move != 0)
            at = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(times[at])], ["at", "move", "times"])

        moves = fit_rows.mapInArrow(tidy(moved), "at bigint, move bigint, times bigint").groupBy("at").agg(F.sum("move"), F.sum("times")).toPandas().to_numpy(np.int64)  # a row a parameter
        start[moves[:, 0]] += moves[:, 1] / UNIT / moves[:, 2]
        restored(start, m, g, told)
    calibrate(m, margins(rest, m))
    return m


def margins(rows: DataFrame, m: Model) -> np.ndarray:
    """(language, margin, clean rows, toxic rows) of all rows, counted by margins in steps of 1 / MARGIN_STEPS within +-20: bounded in number."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                t = Texts.of(part.column("text"))
                step = np.rint(np.clip(shared.value.margin(t), -20, 20) * MARGIN_STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t.language.astype(np.int64)), pa.array(step), part.column("y")], ["language", "step", "y"])

    x = rows.select("text", "y").mapInArrow(tidy(run), "language bigint, step bigint, y bigint")
    found = x.groupBy("language", "step").agg(F.sum(1 - F.col("y")), F.sum("y")).toPandas().to_numpy(np.float64).reshape(-1, 4)
    found[:, 1] /= MARGIN_STEPS
    return found


def threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest stretch of margins with the fewest errors; clean and toxic: rows of each margin."""
    z, which = np.unique(z, return_inverse=True)
    clean, toxic = np.bincount(which, clean), np.bincount(which, toxic)
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.sum(clean) - np.concatenate([[0], np.cumsum(clean)])
    edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    low, high = edge[:-1], edge[1:]
    best = np.flatnonzero(errors == errors.min())
    i = best[np.argmax((high - low)[best])]
    return float((low[i] + high[i]) / 2)


def calibrate(m: Model, found: np.ndarray, least: int = 15) -> None:
    """A threshold for each language with enough rows of both labels; the others take the common one. found: as `margins` gives it."""
    language, z, clean, toxic = found.T
    if clean.sum() and toxic.sum():
        m.shift[:] = threshold(z, clean, toxic)
    for i in range(len(m.shift)):
        own = language == i
        if min(clean[own].sum(), toxic[own].sum()) >= least:
            m.shift[i] = threshold(z[own], clean[own], toxic[own])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, y: every labelled row, its whole text. An id that is labelled twice counts as toxic if one of its labels says so."""
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col("toxic").cast("bigint").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a shuffle at any size: a broadcast of the labels would stop at some size and grow until then
    return staged(texts.join(marks.hint("merge"), "id"), "toxic-labelled")


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, language (as guessed). Null and empty texts get the score of no words; repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS * DIM floats
    names = [*FUNCTION_WORDS, "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                t = Texts.of(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(t)), pa.array([names[i] for i in t.language])], ["doc_id", "score", "language"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, score double, language string")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, as they are: decided where the text is read, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                keep = part.filter(pa.array(shared.value.score(Texts.of(part.column(text_col))) < THRESHOLD))
                yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(keep.columns, kinds, strict=True)], names=kinds.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on all labelled rows that are not held out."""
    return train(labelled(docs, labels.where(~held_out())))


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
