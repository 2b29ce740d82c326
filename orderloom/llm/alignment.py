"""Alignment of two tokenizers over exact-text classes.

Spark shuffles the documents by their full text, so each distinct text is tokenised and aligned once, with its number of copies. Pair
counts are summed in tasks, weighted by copies, then by Spark; the measures of a text are joined back to its doc_ids by the
SHA-256 of the text. Token lists never leave a task: a text's links go to the next step as packed pairs.

Within a text both tokenizers cut before a single space between two characters that are not white space: the first
tokenizer's pattern starts a new pre-token there, and no piece of the second has a space behind another character (this is
asserted of the vocabulary; otherwise texts stay whole). A text is so the sequence of its words, each encoded and aligned once
for many texts, and a very long text needs no more memory than its words.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import slices, staged, tidy
from orderloom.llm.token_counts import byte_symbols, vocabulary

#: Distinct words kept aligned within a partition; beyond it starts afresh.
KEPT = 300_000
#: Characters of new words that go to the libraries at once.
AT_ONCE = 1 << 18
#: Distinct pairs that go to all tasks as a broadcast (20 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1 << 21
#: What is known of a text before the pairs are counted.
TEXT_COLUMNS = ("key", "n_a", "n_b", "groups_sha256")

_GRAPHIC = np.array([0x21 <= b <= 0x7E for b in range(256)])
#: Bytes that may follow a cut: they begin no white-space character (those of two or three bytes begin with C2, E1, E2, E3).
_BEGINS = _GRAPHIC | np.array([0xC3 <= b <= 0xF4 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])
#: First bytes of two-byte characters that are no white space.
_TWO = np.array([0xC3 <= b <= 0xDF for b in range(256)])


def words_between_single_spaces(texts: pa.Array, cut: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Row offsets and flat words: texts cut at single spaces between characters that are not white space. "" has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    at = np.flatnonzero(data == 32) if cut else np.zeros(0, np.int64)
    row = np.searchsorted(ends, at, side="right") - 1
    at = at[(at > ends[row]) & (at < ends[row + 1] - 1)] if len(at) else at
    before = data[at - 1]
    row = np.searchsorted(ends, at, side="right") - 1
    two = (before >= 0x80) & (at - 2 >= ends[row]) & _TWO[data[at - 2]] if len(at) else np.zeros(0, bool)
    at = at[(_GRAPHIC[before] | two) & _BEGINS[data[at + 1]]] if len(at) else at
    keep = np.ones(len(data), bool)
    keep[at] = False
    starts = np.sort(np.concatenate([ends[:-1][np.diff(ends) > 0], at + 1]))
    offsets = np.append(starts - np.searchsorted(at, starts), len(data) - len(at)).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))
    return np.searchsorted(starts, ends), flat


def align(a: list[int], b: list[int], bytes_a: list[int], bytes_b: list[int], width: int) -> tuple[list[int], str]:
    """Links (id of A times width plus id of B) and the groups in writing. Both lists cover the same bytes, no token is empty.

    Tokens of one list end at different offsets, so each common end is one link and closes one group.
    """
    links, groups = [], []
    i = j = i0 = j0 = 0
    x, y = bytes_a[a[0]], bytes_b[b[0]]
    while True:
        if x < y:
            i += 1
            x += bytes_a[a[i]]
        elif y < x:
            j += 1
            y += bytes_b[b[j]]
        else:
            links.append(a[i] * width + b[j])
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            if i == len(a):
                return links, ";".join(groups)
            i0, j0 = i, j
            x, y = x + bytes_a[a[i]], y + bytes_b[b[j]]


class Aligner:
    """Both tokenizers, and the aligned words of a partition: a word is a number into arrays."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        words = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width = len(pieces)
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # what a token is written as, with what follows it within a group and at its end
        self.inner = [np.array([f"{i}," for i in range(n)], object) for n in (len(self.bytes_a), self.width)]
        self.outer = [np.array([f"{i}{c}" for i in range(n)], object) for n, c in ((len(self.bytes_a), "|"), (self.width, ";"))]
        self.digits = [np.array([len(x) for x in own], np.int64) for own in self.inner]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.written: list[str] = []
        self.n_a, self.n_b, self.n_links, self.begin, self.pool = (np.zeros(0, np.int64) for _ in range(5))

    def learn(self, words: list[str]) -> None:
        part, size = [], 0
        for w in words:
            if "▁" in w:  # never given back as it is
                self._add([w], [""], np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
                continue
            part.append(w)
            size += len(w)
            if size >= AT_ONCE:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _add(self, words: list[str], written: list[str], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, links: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.written), len(self.written) + len(words)), strict=True))
        self.written += written
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(n_links) - n_links])
        self.n_a, self.n_b, self.n_links, self.pool = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links), (self.pool, links)))

    def _learn(self, words: list[str]) -> None:
        """Words without U+2581, encoded as one text that is cut between them. Where a word isn't given back, each by itself."""
        text = " ".join(words)
        whole = f" {text}".encode()
        a = np.array(self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text, num_threads=1), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        bounds = np.cumsum([len(w.encode()) + 1 for w in words])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not (b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == whole and np.isin(bounds, common).all()):
            for w in words:
                self._alone(w)
            return
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = ends_a == common[group_a], ends_b == common[group_b]
        pieces, sizes = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        for at, ids, last, k in ((at_a, a, last_a, 0), (at_b, b, last_b, 1)):
            pieces[at], sizes[at] = np.where(last, self.outer[k][ids], self.inner[k][ids]), self.digits[k][ids]
        n = len(words)
        n_a, n_b, n_links = (np.bincount(np.searchsorted(bounds, ends), minlength=n) for ends in (ends_a, ends_b, common))
        line, stops = "".join(pieces.tolist()), np.cumsum(sizes)[np.cumsum(n_a + n_b) - 1].tolist()
        written = [line[s : e - 1] for s, e in zip([0, *stops[:-1]], stops, strict=True)]
        self._add(words, written, n_a, n_b, n_links, a[last_a] * self.width + b[last_b])

    def _alone(self, word: str) -> None:
        a, b, whole = self.a.encode(f" {word}", add_special_tokens=False).ids, self.b.encode(word), f" {word}".encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        links, written = align(a, b, self.size_a, self.size_b, self.width) if same else ([], "")
        one = lambda x: np.array([x if same else 0], np.int64)
        self._add([word], [written], one(len(a)), one(len(b)), one(len(links)), np.array(links, np.int64))

    def measure(self, texts: pa.Array) -> list[tuple[int, int, str, bytes]]:
        """Of each text: tokens of A and B, SHA-256 of the groups, links as packed 64-bit pairs. Without tokens: 0, 0, '', b''."""
        offsets, flat = words_between_single_spaces(texts, self.cuts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > KEPT:
            self.clear()
        self.learn([w for w in words if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        out = []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = codes[s:e]
            n = self.n_links[own]
            if s == e or not n.all():  # no words, or one that isn't given back
                out.append((0, 0, "", b""))
                continue
            place = np.repeat(self.begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            groups = hashlib.sha256(";".join(map(self.written.__getitem__, own.tolist())).encode()).hexdigest()
            out.append((int(self.n_a[own].sum()), int(self.n_b[own].sum()), groups, self.pool[place].astype("<i8").tobytes()))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(vocab_a: str, vocab_b: str) -> Aligner:
    """One for each worker: reading the files costs a second."""
    key = tuple(v if v.startswith("/") else vocabulary(v) for v in (vocab_a, vocab_b))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def aligned_texts(texts: DataFrame, vocab_a: str, vocab_b: str) -> DataFrame:
    """Of each row (key, text, copies): key, copies, n_a, n_b, groups_sha256, links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(vocab_a, vocab_b)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n_a, n_b, groups, links = zip(*both.measure(part.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("copies"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups), pa.array(links, pa.binary())],
                    ["key", "copies", "n_a", "n_b", "groups_sha256", "links"],
                )
        both.clear()

    return texts.mapInArrow(tidy(run), "key binary, copies bigint, n_a bigint, n_b bigint, groups_sha256 string, links binary")


def pair_counts(aligned: DataFrame, most: int = 1 << 20) -> DataFrame:
    """pair, n: in how many links of the corpus a pair stands. Summed within tasks over at most about `most` pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            for part, c in packed_parts(batch.column("links"), copies):
                new, at = np.unique(np.concatenate([pairs, part]), return_inverse=True)
                total = np.zeros(len(new), np.int64)
                np.add.at(total, at, np.concatenate([n, c]))
                pairs, n = new, total
                if len(pairs) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                    pairs, n = pairs[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return aligned.select("links", "copies").mapInArrow(tidy(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def packed_parts(links: pa.Array, copies: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Flat pairs and, for each, its text's number of copies, in parts of about `most` pairs."""
    flat, each, size = [], [], 0
    for raw, c in zip(links, copies, strict=True):
        own = np.frombuffer(raw.as_buffer(), "<i8")
        flat.append(own)
        each.append(np.full(len(own), c, np.int64))
        size += len(own)
        if size >= most:
            yield np.concatenate(flat), np.concatenate(each)
            flat, each, size = [], [], 0
    if flat:
        yield np.concatenate(flat), np.concatenate(each)


def by_broadcast(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Measures of each text, with the counts of all pairs in each task: for at most BROADCAST_PAIRS of them."""
    known = pairs.toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast((known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            total, top, size = [], [], []
            for raw in batch.column("links"):
                at = np.searchsorted(pair, np.frombuffer(raw.as_buffer(), "<i8"))
                total.append(int(n[at].sum()))
                top.append(int(best[at].sum()))
                size.append(len(at))
            sums = [pa.array(x, pa.int64()) for x in (size, top, total)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in TEXT_COLUMNS] + sums, [*TEXT_COLUMNS, "n_links", "n_best", "count_sum"])

    return aligned.select(*TEXT_COLUMNS, "links").mapInArrow(tidy(run), "key binary, n_a bigint, n_b bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint")


def by_shuffle(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for any number of pairs: each text's distinct pairs with their number meet the counts by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("key"), batch.column("links"), strict=True):
                own, times = np.unique(np.frombuffer(raw.as_buffer(), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), pa.binary()), pa.array(own), pa.array(times)], ["key", "pair", "times"])

    flat = aligned.select("key", "links").mapInArrow(tidy(run), "key binary, pair bigint, times bigint")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)))
    sums = flat.join(pairs, "pair").groupBy("key").agg(F.sum("times").alias("n_links"), best.alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return aligned.select(*TEXT_COLUMNS).join(sums, "key", "left")


def alignment(
    docs: DataFrame, vocab_a: str = "byte_bpe_50k.json", vocab_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """doc_id, the measures and groups_sha256 of each row of docs.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have zeros and ''. Repeated
    rows repeat and count as often as they stand; rows of one doc_id with different texts have a row each. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    there, own = F.octet_length("text") > 0, F.unhex(F.sha2("text", 256))
    texts = docs.where(there).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    aligned = staged(aligned_texts(texts.select(own.alias("key"), "text", "copies"), vocab_a, vocab_b), "alignment-texts")
    sums = staged(pair_counts(aligned), "alignment-pairs")
    width = aligner(vocab_a, vocab_b).width
    pairs = sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % width)))
    measured = by_broadcast(aligned, pairs) if sums.count() <= broadcast_pairs else by_shuffle(aligned, pairs)
    # tokens are never empty, so each common end is one link and one group; texts without a key meet nothing, each at a place of its own
    nothing = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    keyed = docs.select("doc_id", F.when(there, own).otherwise(nothing).alias("key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return keyed.join(staged(measured, "alignment-measures"), "key", "left").select(
        "doc_id", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), zero("n_links").alias("n_groups"), zero("n_links").alias("n_links"),
        zero("n_best").alias("n_best"), zero("count_sum").alias("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def op12_alignment(docs: DataFrame) -> DataFrame:
    return alignment(docs)
