"""Language-model scoring: an interpolated bigram model in Elias-Fano tries, dealt over the cluster.

p(w | v) = max(c(v, w) - D, 0) / c(v) + D * T(v) / c(v) * p(w), T(v): distinct words after v, p(w): the smoothed word
probability of the base score; p(w) alone where v is new. It sums to 1 over the words and one unknown word.

The trie stores the first term and the weight D * T(v) / c(v) as quantised probabilities.

1. Texts become chunks of word codes with the chunk's distinct word hashes, written once to the shared folder.
2. Chunks send their distinct words with the counts of the training texts to shards by ranges of hashes; these answer with
   the counts in all texts, and tell which words occur so often that what follows them is too much for one shard: over
   `busy` times, a fourth of a shard's tokens or a millionth of all, so a million words at most.
3. Chunks send their distinct pairs to shards by context; pairs of a busy context are dealt further by their words, to as
   many parts as its count asks for. A shard builds its trie from the counts and answers each chunk about what it holds.
4. A chunk with its answers scores its documents.
What moves is at most an entry for each distinct pair of a chunk; nothing of the model passes through the driver but the
totals and the busy contexts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import hash_words, mix, release, slices, staged, tidy, words_of
from orderloom.llm.ngram_trie import NgramTrie, probability

DISCOUNT = 0.75
CHUNK_BYTES, SHARD_TOKENS, BUSY_AT_MOST = 8 << 20, 1 << 21, 1_000_000
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)

CHUNKS = "chunk bigint, n bigint, docs binary, train binary, sizes binary, tokens binary, words binary"
ASKED = "shard int, chunk bigint, a binary, b binary, c binary, d binary"
ANSWERED = "level int, shard int, chunk bigint, x binary, y binary"


def pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def narrow(x: np.ndarray, kind: str = "<u4") -> np.ndarray:
    """Low, middle and high bytes apart, so that they compress."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)


def wide(raw: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(unpack(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def chunked(rows: DataFrame) -> DataFrame:
    """One row for each chunk of texts. Word codes are ranks among the chunk's ascending word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                starts, flat = words_of(part.column("text"))
                coded = flat.dictionary_encode()
                words, place = np.unique(np.append(hash_words(coded.dictionary), END), return_inverse=True)
                n = np.diff(starts)
                tokens = np.full(len(flat) + len(n), place[-1], np.uint32)
                if len(flat):
                    tokens[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = place[coded.indices.to_numpy(zero_copy_only=False)]
                ids = part.column("doc_id")
                docs = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)])
                train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
                blobs = [docs.tobytes(), train.tobytes(), (n + 1).astype("<u4").tobytes(), pack(narrow(tokens)), words.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([len(tokens)], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]], ["chunk", "n", "docs", "train", "sizes", "tokens", "words"])

    return rows.mapInArrow(tidy(run), CHUNKS)


class Busy(NamedTuple):
    """Contexts whose successors are dealt over several shards: their ascending hashes, counts and numbers of parts."""

    hashes: np.ndarray
    counts: np.ndarray
    parts: np.ndarray

    def of(self, values: np.ndarray, hashes: np.ndarray, otherwise: float) -> np.ndarray:
        """The value of each hash, `otherwise` where it is not busy."""
        if not len(self.hashes):
            return np.full(len(hashes), otherwise)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, values[at], otherwise)


class Chunk:
    """Tokens of a chunk, and its distinct pairs in the order in which shards are asked about them."""

    def __init__(self, train: bytes, sizes: bytes, tokens: bytes, words: bytes):
        self.words = np.frombuffer(words, np.uint64)
        self.tokens = wide(tokens).astype(np.int64)
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.train = np.frombuffer(train, np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(self.train, self.sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.learn > 0], minlength=len(self.words)).astype(np.uint32)

    def pairs(self, shards: int, busy: Busy) -> None:
        """order, bounds: tokens by pair; and of the distinct pairs, by (shard, context, word): shard, context and word codes, the sorting `by`."""
        n = len(self.words)
        self.hashes = np.append(self.words, START)  # of contexts: the start is the last code
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.begin] = n
        key = context * n + self.tokens
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        v, w = key[self.bounds] // n, key[self.bounds] % n
        part = mix(self.words[w] + np.uint64(3)) % busy.of(busy.parts, self.hashes, 1).astype(np.uint64)[v]
        with np.errstate(over="ignore"):
            home = mix(self.hashes[v] + part * np.uint64(0x9E3779B97F4A7C15))
        shard = ((home >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        self.by = np.argsort(shard, kind="stable")
        self.shard, self.v, self.w = shard[self.by], v[self.by], w[self.by]
        #: The first pair of each (shard, context).
        self.heads = np.flatnonzero(np.append(True, (self.shard[1:] != self.shard[:-1]) | (self.v[1:] != self.v[:-1]))) if len(v) else np.zeros(0, np.int64)


def _asked(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["shard", "chunk", "a", "b", "c", "d"])


def _answered(out: list[tuple]) -> pa.Table:
    kinds = (("level", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("x", pa.binary()), ("y", pa.binary()))
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(kinds)})


def asked_words(chunks: DataFrame, shards: int) -> DataFrame:
    """The distinct words of each chunk for each shard, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["train"], r["sizes"], r["tokens"], r["words"])
                counts = c.word_counts()
                cut = np.searchsorted((c.words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
                at = [(int(s), slice(cut[s], cut[s + 1])) for s in np.flatnonzero(np.diff(cut))]
                yield _asked([(s, r["chunk"], c.words[x].tobytes(), pack(narrow(counts[x])), b"", b"") for s, x in at])

    return chunks.select("chunk", "train", "sizes", "tokens", "words").mapInArrow(tidy(run), ASKED)


def asked_pairs(chunks: DataFrame, shards: int, busy: Busy) -> DataFrame:
    """The contexts of each chunk for each shard, the words after each, and the training counts of these pairs."""
    shared = chunks.sparkSession.sparkContext.broadcast(busy)  # a million contexts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["train"], r["sizes"], r["tokens"], r["words"])
                c.pairs(shards, shared.value)
                if not len(c.bounds):
                    continue
                out: list[tuple] = []
                learnt = np.add.reduceat(c.learn[c.order].astype(np.int64), c.bounds)[c.by]
                cut, top = np.searchsorted(c.shard, np.arange(shards + 1)), np.searchsorted(c.shard[c.heads], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cut)):
                    heads = c.heads[top[s] : top[s + 1]]
                    sizes = np.diff(np.append(heads, cut[s + 1]))
                    at = slice(cut[s], cut[s + 1])
                    out.append((int(s), r["chunk"], c.hashes[c.v[heads]].tobytes(), pack(narrow(sizes)), c.words[c.w[at]].tobytes(), pack(narrow(learnt[at]))))
                yield _asked(out)

    return chunks.select("chunk", "train", "sizes", "tokens", "words").mapInArrow(tidy(run), ASKED)


def answer_words(often: int):
    """Level 1: the counts of a chunk's words; level 0: totals; level -2: words that occur over `often` times."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "a", "b")), strict=True))
        asked = [np.frombuffer(r[1], np.uint64) for r in rows]
        words, counts = np.concatenate(asked), np.concatenate([wide(r[2]) for r in rows])
        seen = counts > 0
        known, place = np.unique(words[seen], return_inverse=True)
        total = np.bincount(place, counts[seen], len(known)).astype(np.int64)
        much = total > often
        out = [(0, shard, 0, int(total.sum()).to_bytes(8, "little"), len(known).to_bytes(8, "little")), (-2, shard, 0, known[much].tobytes(), total[much].tobytes())]
        for r, w in zip(rows, asked, strict=True):
            at = np.minimum(np.searchsorted(known, w), max(len(known) - 1, 0))
            got = np.where(known[at] == w, total[at], 0) if len(known) else np.zeros(len(w), np.int64)
            out.append((1, shard, r[0], pack(narrow(got, "<i8")), b""))
        release()
        return _answered(out)

    return run


def answer_pairs(busy, discount: float):
    """Level 2: the codes of a chunk's pairs and of its contexts' weights; level -1: the successors here of busy contexts."""

    def run(table: pa.Table) -> pa.Table:
        hashes, counts, _ = busy.value
        shard = table.column("shard")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "a", "b", "c", "d")), strict=True))
        asked, sizes, words = [np.frombuffer(r[1], np.uint64) for r in rows], [wide(r[2]).astype(np.int64) for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows]
        learnt = np.concatenate([wide(r[4]) for r in rows])
        seen = learnt > 0
        contexts = np.repeat(np.concatenate(asked), np.concatenate(sizes))
        out: list[tuple] = []
        with NgramTrie(contexts[seen], np.concatenate(words)[seen], learnt[seen], discount, (hashes, counts)) as trie:
            mine = hashes[np.isin(hashes, contexts[seen])]
            del contexts, learnt, seen
            for r, v, n, w in zip(rows, asked, sizes, words, strict=True):
                codes, weights = trie.query(v, n, w)
                out.append((2, shard, r[0], pack(codes), pack(weights)))
            out.append((-1, shard, 0, mine.tobytes(), trie.successors_of(mine).tobytes()))
        release()
        return _answered(out)

    return run


SCORED = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def scorer(total: int, distinct: int, shared, shards: int, discount: float):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        busy, spread = shared.value
        r = chunk.to_pylist()[0]
        c = Chunk(r["train"], r["sizes"], r["tokens"], r["words"])
        got = sorted(zip(*(answers.column(k).to_pylist() for k in ("level", "shard", "x", "y")), strict=True), key=lambda x: x[:2])
        counts = np.concatenate([wide(x, "<i8") for lv, _, x, _ in got if lv == 1]).astype(np.float64)
        share = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        own = probability(np.concatenate([unpack(x, np.uint16) for lv, _, x, _ in got if lv == 2]))
        weight = probability(np.concatenate([unpack(y, np.uint16) for lv, _, _, y in got if lv == 2]))
        c.pairs(shards, busy)
        left = np.repeat(weight, np.diff(np.append(c.heads, len(c.v))))  # 0: the context is new
        whole = busy.of(discount * spread / np.maximum(busy.counts, 1), c.hashes[c.v], -1.0)
        left = np.where(whole < 0, left, whole)
        p = np.where(left > 0, own + left * share[c.w], share[c.w])
        pair = np.empty(len(p))
        pair[c.by] = np.log10(p)
        token = np.empty(len(c.tokens))
        token[c.order] = np.repeat(pair, np.diff(np.append(c.bounds, len(c.tokens))))
        known = (counts > 0)[c.tokens].astype(np.int64)
        sums = lambda x: pa.array(np.add.reduceat(x, c.begin))
        ids, valid = np.frombuffer(r["docs"], np.int64).reshape(2, -1)
        cols = [pa.array(ids, mask=valid == 0), pa.array(c.train > 0), pa.array(c.sizes), sums(known), sums(np.log10(share)[c.tokens]), sums(token)]
        return pa.table(cols, names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_corpus(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT) -> tuple[DataFrame, int]:
    """doc_id, train, n_tokens, n_known, base_score, score of each document, and the number of training tokens.

    train: a condition on `docs` that marks the texts to learn from (null: they are learnt from). Null and empty texts are
    one token, the end. Repeated rows count and are scored each for itself. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-int(size) // (6 * SHARD_TOKENS)))
    chunks = staged(chunked(rows), "lm-chunks")
    often = max(SHARD_TOKENS // 4, int(chunks.agg(F.sum("n")).first()[0] or 0) // BUSY_AT_MOST)
    words = staged(asked_words(chunks, shards).groupBy("shard").applyInArrow(answer_words(often), ANSWERED), "lm-words")
    sums = words.where("level = 0").select("x", "y").mapInArrow(_totals, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    found = {r.w: r.t for r in words.where("level = -2").select("x", "y").mapInArrow(_numbers, "w bigint, t bigint").collect()}
    if END.view(np.int64) in found:  # as often as texts end, they begin
        found[int(START.view(np.int64))] = found.pop(int(END.view(np.int64)))
    hashes = np.sort(np.array(list(found), np.int64).view(np.uint64))
    counts = np.array([found[int(h)] for h in hashes.view(np.int64)], np.int64)
    busy = Busy(hashes, counts, -(-counts // often))
    shared = docs.sparkSession.sparkContext.broadcast(busy)
    pairs = staged(asked_pairs(chunks, shards, busy).groupBy("shard").applyInArrow(answer_pairs(shared, discount), ANSWERED), "lm-pairs")
    fans = {r.w: r.t for r in pairs.where("level = -1").select("x", "y").mapInArrow(_numbers, "w bigint, t bigint").groupBy("w").agg(F.sum("t").alias("t")).collect()}
    spread = np.array([fans.get(int(h), 0) for h in hashes.view(np.int64)], np.float64)
    run = scorer(total, distinct, docs.sparkSession.sparkContext.broadcast((busy, spread)), shards, discount)
    out = chunks.groupBy("chunk").cogroup(words.union(pairs).where("level > 0").groupBy("chunk")).applyInArrow(run, SCORED)
    return out, total


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [pa.array([int.from_bytes(x, "little") for x in b.column(c).to_pylist()], pa.int64()) for c in ("x", "y")]
        yield pa.RecordBatch.from_arrays(cols, ["n", "v"])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [pa.array(np.frombuffer(b"".join(b.column(c).to_pylist()), np.int64)) for c in ("x", "y")]
        yield pa.RecordBatch.from_arrays(cols, ["w", "t"])


def op5_lm_scoring(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) mod 5 is not 1 and scores all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out, total = score_corpus(docs, ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
