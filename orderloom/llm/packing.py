"""Best-fit packing of token sequences, bounded-space and online.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Pieces are dealt over shards by a
hash (so copies and hot sources spread), and each shard packs its pieces, longest first, with a fixed number of open
bins. A bitset has bit f set when an open bin has f tokens free: the lowest set bit from the piece's length on is the
fullest bin that fits. When a new bin would exceed the number of open ones, the fullest closes. Places are known when a
piece is placed, so a task holds the open bins only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import slices, staged, tidy, words_of
from orderloom.llm.token_counts import vocabulary

CAPACITY, OPEN_BINS, SHARD_TOKENS = 2048, 4096, 1 << 24


class OpenBins:
    """The open bins of one shard: `place` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            at = self._take(f)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            f, at = self.capacity, self.made
            self.made += 1
        left = f - length
        if left:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - f

    def _take(self, f: int) -> int:
        at = self.free[f].pop()
        self.open -= 1
        if not self.free[f]:
            self.bits ^= 1 << f
        return at


class PartIds:
    """The ids of parts of words, kept between the batches of a partition in two arrays. Beyond KEPT parts it starts afresh.

    The vocabulary lowers case and cuts words into letters, digits and runs of other characters before it merges. A word
    of Latin letters with plain marks behind it so has the ids of its letters, then those of its marks; other words are a
    part as they are. Letters not met before go to the library many at once, told apart by the tokens that end words;
    lowered ASCII letters without the steps that leave them as they are (normalising, cutting). U+0130 is no such letter: its
    lower case ends in a combining mark, which goes with the marks behind it.
    """

    KEPT, AT_ONCE = 500_000, 500
    WORD = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)(?P<marks>[.,;:!?]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.bounds, self.pool = np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def _add(self, parts: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.known), int(self.bounds[len(self.known)])
        while n + len(parts) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while m + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.bounds[n + 1 : n + 1 + len(parts)] = m + np.cumsum(sizes)
        self.pool[m : m + len(ids)] = ids
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _alone(self, parts: list[str]) -> None:
        got = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        self._add(parts, np.fromiter(map(len, got), np.int64, len(got)), np.array([i for g in got for i in g], np.uint32))

    def places(self, coded: pa.Array, letters: bool) -> np.ndarray:
        """The number of each of the distinct parts; letters: they are letters alone, the ASCII ones lowered."""
        parts = coded.to_numpy(zero_copy_only=False).tolist()
        new = [x for x in parts if x not in self.known]
        if not letters:
            self._alone(new)
            new = []
        ascii_only, wide = [x for x in new if x.isascii()], [x for x in new if not x.isascii()]
        for library, some in ((lib, of[k : k + self.AT_ONCE]) for lib, of in ((self.bare, ascii_only), (self.library, wide)) for k in range(0, len(of), self.AT_ONCE)):
            ids = np.array(library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                self._add(some, np.diff(cut, prepend=0), ids)
            else:
                self._alone(some)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def words(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each of the distinct words."""
        if len(self.known) > self.KEPT:
            self.clear()
        found = pc.extract_regex(words, self.WORD)
        plain = found.is_valid()
        at = np.zeros((len(words), 2), np.int64)
        here = plain.to_numpy(zero_copy_only=False)
        letters = pc.struct_field(found, "letters").filter(plain)
        letters = pc.if_else(pc.string_is_ascii(letters), pc.ascii_lower(letters), letters).dictionary_encode()
        marks = pc.struct_field(found, "marks").filter(plain).dictionary_encode()
        for k, (coded, kind) in enumerate(((letters, True), (marks, False))):
            at[here, k] = self.places(coded.dictionary, kind)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else 0
        at[~here, 0] = self.places(words.filter(pc.invert(plain)), False)
        n = len(self.known)
        parts = pa.LargeListArray.from_arrays(pa.array(self.bounds[: n + 1]), pa.array(self.pool[: self.bounds[n]]))
        both = parts.take(pa.array(at.ravel()))
        return pa.LargeListArray.from_arrays(both.offsets.take(pa.array(np.arange(0, 2 * len(words) + 1, 2))), both.values)


_PART_IDS: dict[str, PartIds] = {}


def part_ids(path: str) -> PartIds:
    """One for each worker and vocabulary."""
    if path not in _PART_IDS:
        _PART_IDS[path] = PartIds(path)
    return _PART_IDS[path]


def encode(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and flat ids (each document's end id included).

    The vocabulary drops white space and joins nothing across it, so each distinct word is encoded once.
    """
    starts, flat = words_of(texts, lower=False)
    coded = flat.dictionary_encode()
    words = part_ids(path).words(coded.dictionary)
    end = len(words)
    words = pa.LargeListArray.from_arrays(
        pa.array(np.append(words.offsets.to_numpy(), len(words.values) + 1)), pa.concat_arrays([words.values, pa.array([end_id], pa.uint32())])
    )
    closes = starts[1:] + np.arange(len(starts) - 1)  # a document's end stands behind its words, and behind the ends before it
    codes = np.empty(len(coded) + len(closes), np.int32)
    inner = np.ones(len(codes), bool)
    inner[closes] = False
    codes[closes], codes[inner] = end, coded.indices.to_numpy(zero_copy_only=False)
    out = words.take(pa.array(codes))
    return out.offsets.to_numpy()[np.append(0, closes + 1)], out.values.to_numpy()


def pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocab if vocab.startswith("/") else vocabulary(vocab)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                offsets, ids = encode(path, part.column("text"), end_id)
                size = np.diff(offsets)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                begin = offsets[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, offsets[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        part_ids(path).clear()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and a length of 1 to capacity; other columns stay.

    The number of shards follows the tokens in all, so a shard is of one size at any scale. The last bins of a shard may
    stay partly empty: about one sequence in `shard_tokens / capacity`.
    """
    total = cut.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    rest = [c for c in cut.columns if c != "length"]
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    ordered = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", F.col("length").desc(), "doc_id", "piece", *[c for c in rest if c == "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, None
        for batch in batches:
            at, offset = [], []
            for s, n in zip(batch.column("_shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != shard:
                    shard, bins = s, OpenBins(capacity, open_bins)
                a, o = bins.place(n)
                at.append((s << 40) | a)
                offset.append(o)
            keep = [i for i, c in enumerate(batch.schema.names) if c != "_shard"]
            cols = [batch.column(i) for i in keep] + [pa.array(at, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return ordered.mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset: a row for each piece of each document.

    Null and empty texts hold the end id only; repeated rows are packed each for itself; other columns are not read.
    The pieces are written to the shared folder once, as their total decides the number of shards.
    """
    return pack(staged(pieces(docs, vocab, capacity, end_id, with_ids, id_col, text_col), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and tokens of each packed sequence, from pack_documents(with_ids=True)."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("tokens"))


def op1_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
