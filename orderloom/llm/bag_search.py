"""Ranked lexical search with one score for each class of equal bags.

Documents are cut down to the items' vocabulary: a bag holds the term frequencies of the terms that some item asks for.
Documents with the same bag and the same length measure m score alike for every item, so they form a class: Spark groups by
(m, bag), told apart by hash and verified by the bytes of the bag. Each class is scored once against all items; the best ten classes of
an item, in the order of score and smallest doc_id, hold its best ten documents. Only those classes are expanded, by
ascending doc_id, at most ten members of each. No class is ever collected: its members meet in a ranking that each task
cuts to ten before the shuffle.

Items are taken in blocks of bounded bytes, so what a task holds of them is bounded; a block costs a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import slices, staged, tidy, words_of

#: Bytes that terms are made of: digits, ASCII letters, everything above 127.
TERM_BYTE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: Bytes of item texts in one block: what is collected and broadcast at once.
BLOCK_BYTES = 8 << 20
#: Distinct hashes of classes that go to all tasks as a broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_HASHES = 1 << 20
#: Scores in one dense block of classes and items.
SCORES = 1 << 21


class Items:
    """A block of items: their distinct terms, and for each term the items that hold it. An item is a place in `rows`."""

    def __init__(self, texts: list[str | None]):
        offsets, flat = words_of(pa.array(texts, pa.large_string()), word_byte=TERM_BYTE)
        coded = flat.dictionary_encode()
        self.size = len(texts)
        self.terms = coded.dictionary.cast(pa.large_string())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(codes * max(self.size, 1) + np.repeat(np.arange(self.size), np.diff(offsets)))
        self.items = pairs % max(self.size, 1)
        self.starts = np.searchsorted(pairs // max(self.size, 1), np.arange(len(self.terms) + 1))

    def bags(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """For each text its number of terms, and its bag: sorted 64-bit words, term above, frequency below."""
        offsets, flat = words_of(texts, word_byte=TERM_BYTE)
        n = np.diff(offsets)
        coded = flat.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.large_string()), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        row, v = np.repeat(np.arange(len(n)), n), max(len(self.terms), 1)
        keep = ids >= 0
        key, tf = np.unique(row[keep] * v + ids[keep], return_counts=True)
        packed = ((key % v) << 32 | tf).astype("<i8").tobytes()
        ends = np.searchsorted(key, np.arange(len(n) + 1) * v) * 8
        return n, [packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Best:
    """The k best (score, smallest doc_id, row) of each item over the classes of a partition."""

    def __init__(self, size: int, k: int):
        self.k, self.least = k, np.ones(size, np.int64)  # a score must be above 0
        self.item, self.score, self.first, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, first: np.ndarray, rows: np.ndarray) -> None:
        """scores: (class, item). What can't be among an item's k best is left out before anything is ordered."""
        if len(scores) > self.k:
            self.least = np.maximum(self.least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        c, item = np.nonzero(scores >= self.least)
        new = (item, scores[c, item], first[c], rows[c])
        item, score, first, row = (np.concatenate(p) for p in zip((self.item, self.score, self.first, self.row), new, strict=True))
        order = np.lexsort((first, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.k]
        self.item, self.score, self.first, self.row = item[order], score[order], first[order], row[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.item[full]] = np.maximum(self.least[self.item[full]], self.score[full])


def with_measure(bags: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """m = 100 - 90 + (90 n N) div L, and the hash of (m, bag)."""
    return bags.withColumn("m", F.expr(f"100L - 90L + (90L * n * {n_docs}L) div {n_terms}L")).withColumn("h", F.xxhash64("m", "bag"))


def document_frequencies(classes: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: counted once a class and weighted by its members, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            bags = batch.column("bag").to_pylist()
            terms = np.frombuffer(b"".join(bags), "<i8") >> 32
            np.add.at(df, terms, np.repeat(batch.column("members").to_numpy(zero_copy_only=False), [len(b) // 8 for b in bags]))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in classes.select("bag", "members").mapInArrow(tidy(run), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[term] = df
    return out


def best_classes(classes: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """The k best classes of each item: item, score, m, h, bag, first (smallest doc_id)."""
    shared = classes.sparkSession.sparkContext.broadcast((items, weights))  # bounded by BLOCK_BYTES
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best, kept = Best(items.size, k), {}
        held = np.diff(items.starts)
        step, seen = max(1, SCORES // max(items.size, 1)), 0
        for batch in batches:
            bags, m = batch.column("bag").to_pylist(), batch.column("m").to_numpy(zero_copy_only=False)
            first = pc.fill_null(batch.column("first"), last).to_numpy(zero_copy_only=False)
            for at in range(0, len(bags), step):
                part = bags[at : at + step]
                flat = np.frombuffer(b"".join(part), "<i8")
                row = np.repeat(np.arange(len(part)), [len(b) // 8 for b in part])
                term, tf = flat >> 32, flat & 0xFFFFFFFF
                gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at : at + step][row]))
                scores = np.zeros(len(part) * items.size, np.int64)
                for a in range(0, len(term), 1 << 16):  # bounds what the postings of a block of terms expand to
                    t, r, g = term[a : a + (1 << 16)], row[a : a + (1 << 16)], gain[a : a + (1 << 16)]
                    n = held[t]
                    place = np.repeat(items.starts[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    np.add.at(scores, np.repeat(r, n) * items.size + items.items[place], np.repeat(g, n))
                best.add(scores.reshape(len(part), items.size), first[at : at + step], seen + np.arange(len(part)))
                alive = set(best.row.tolist())
                kept = {r: v for r, v in kept.items() if r in alive} | {seen + i: (part[i], int(m[at + i]), int(first[at + i])) for i in range(len(part)) if seen + i in alive}
                seen += len(part)
        rows = [kept[r] for r in best.row.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.score), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([None if r[2] == last else r[2] for r in rows], pa.int64())],
            ["item", "score", "m", "bag", "first"],
        )

    found = classes.select("m", "bag", "first").mapInArrow(tidy(run), "item bigint, score bigint, m bigint, bag binary, first bigint")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    return found.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= k).withColumn("h", F.xxhash64("m", "bag")).drop("place")


def expand(bags: DataFrame, winners: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score of the winners' members, the first k by doc_id of each class."""
    hashes = winners.select("h").distinct()
    few = winners.count() <= BROADCAST_HASHES
    near = bags.select("doc_id", "m", "h", "bag").join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
    by_id = Window.partitionBy("m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = near.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k)
    return winners.select("item", "score", "m", "h", "bag").join(members.drop("place"), ["h", "m", "bag"]).select("item", "doc_id", "score")


def search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame | None:
    """item (place in texts), rank, doc_id, score; None if nothing can score."""
    items = Items(texts)
    if not len(items.terms):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, bags = shared.value.bags(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    bags = staged(docs.mapInArrow(tidy(run), "doc_id bigint, n bigint, bag binary").where("n > 0"), "bag-search-bags")
    n_docs, n_terms = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    bags = with_measure(bags, n_docs, n_terms).where(F.octet_length("bag") > 0)
    classes = staged(bags.groupBy("m", "bag").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")), "bag-search-classes")
    df = document_frequencies(classes, len(items.terms))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    winners = staged(best_classes(classes, items, weights, k), "bag-search-winners")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return expand(bags, winners, k).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Each row of docs is a document of its own, repeated rows too; a null doc_id comes after all others. Null and empty texts
    have no terms and count nowhere. Equal rows of items are one item; rows of one item_id with different texts are ranked
    each by itself. Items without terms, or whose terms no document holds, have no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks, found = -(-total // block_bytes), []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        out = search_block(docs, [r.text for r in rows], k)
        if out is not None:
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item bigint, item_id {kind}")
            found.append(out.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def op11_bag_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
i AS (
  SELECT row_number() OVER () AS i, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (SELECT i, item_id, unnest(terms) AS term FROM i),
flat AS (SELECT r, doc_id, n, unnest(terms) AS term FROM sized),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM corpus) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN asked USING (term) CROSS JOIN corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
