"""N-gram Jaccard self-join by prefix trees, with components instead of all pairs.

1. One pass over the texts: a document's set is its distinct five-word shingles, as hashes. Equal sets fall together by a
   64-bit signature; from here on a node is a distinct set. The pass deals hashes into ranges ("buckets"), as packed
   arrays of each range's hashes by node, so a shuffle row holds thousands of them.
2. Each bucket counts in how many sets its hashes occur and keeps those in two or more. A set with fewer shared hashes
   than a link needs is done. For the others, hashes in global order (rarest first) give the prefix of which linked sets
   must share a hash. The sets of two neighbouring bands of size that hold a hash in their prefix are a candidate group, so
   a long text that quotes many short ones meets none of them; groups of the same first set and band are one, so that the many
   hashes of one passage give one group. All links lie inside a group; groups do not merge into chains.
3. Groups are dealt into blocks of bounded numbers of sets and hashes. A block's sets go into a trie in global order; each set walks it from the
   root, so the overlap with a common beginning is counted once, and leaves a subtree when what remains of both can no
   longer reach the overlap that its set sizes ask for, or when all sets below are in the walker's component already.
4. A group of more than one block is finished exactly by walks across blocks: one set of each component against every
   block, then whatever is not yet in the group's main component against every block. A group of copies of one text thus
   costs about one walk a set, not one for each pair.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import hash_words, mix, release, settings, slices, staged, tidy, words_of
from orderloom.llm.components import components

WORDS, PERCENT = 5, 75
BUCKET_HASHES = 1 << 21
#: Bounds of a block of a group (sets and their hashes), and the hashes that one task of blocks holds on average.
BLOCK_SETS, BLOCK_HASHES, SHARD_HASHES = 256, 1 << 19, 1 << 20
#: Bytes of text that a batch holds on its way to Python, and that are hashed at once.
BATCH, PIECE = "4m", 1 << 20
#: Hashes of a set in one row.
ROW_HASHES = 2048
#: Ratio of the sizes at a band's ends: a little more than 100 / PERCENT, so that linked sets are in one band or in two neighbours.
BAND = 1.34


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the ascending distinct shingle hashes of each text; a text of fewer words has one shingle, without words none."""
    starts, flat = words_of(texts)
    h = hash_words(flat)
    n = np.diff(starts)
    at = np.arange(words, dtype=np.uint64)
    factor = mix(at + np.uint64(0xABC)) | np.uint64(1)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            full += h[k : len(h) - words + 1 + k] * factor[k]
        short = np.flatnonzero((n > 0) & (n < words))
        whole = np.array([sum(int(h[starts[i] + k]) * int(factor[k]) for k in range(n[i])) + int(n[i]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for i in short], np.uint64)
    count = np.maximum(n - words + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    got = full[np.repeat(starts[:-1] - first, count) + np.arange(len(row))] if len(row) else np.zeros(0, np.uint64)
    row, got = np.concatenate([row, short]), mix(np.concatenate([got, whole]))
    order = np.lexsort((got, row))
    row, got = row[order], got[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (got[1:] != got[:-1])
    row, got = row[new], got[new]
    return np.searchsorted(row, np.arange(len(n) + 1)), got


def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_sets` of a batch, a piece of its texts at a time."""
    parts = [shingle_sets(piece.column("text")) for piece in slices(batch, "text", PIECE)]
    sizes = np.concatenate([np.diff(starts) for starts, _ in parts])
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([hashes for _, hashes in parts])


def signatures(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each set, as int64. Empty sets have that of nothing."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
        return mix((sums[starts[1:]] - sums[starts[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + np.diff(starts).astype(np.uint64)).view(np.int64)


PASS = "bucket int, kind int, a binary, b binary, c binary"
FOUND = "kind int, doc_id bigint, sig bigint, n bigint, token bigint, df int"


def bucketed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of packed arrays. kind 0: doc_id, sig, n; kind 1: sig and count of hashes of each set, and the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                starts, hashes = sets_of(part)
                sig, n = signatures(starts, hashes), np.diff(starts)
                ids = part.column("doc_id")
                rows: list[tuple] = []
                home = (mix(np.arange(part.num_rows, dtype=np.uint64) + mix(sig.view(np.uint64))) % np.uint64(n_buckets)).astype(np.int64)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                value = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for b in np.unique(home[known]):
                    at = known & (home == b)
                    rows.append((int(b), 0, value[at].tobytes(), sig[at].tobytes(), n[at].astype(np.int64).tobytes()))
                _, only = np.unique(sig, return_index=True)  # equal sets of this batch go out once
                keep = np.zeros(len(sig), bool)
                keep[only] = True
                keep &= known
                row = np.repeat(np.arange(len(n)), n)
                held = keep[row]
                row, h = row[held], hashes[held]
                bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                row, h, bucket = row[order], h[order], bucket[order]
                there, edges = np.unique(bucket, return_index=True)
                for b, lo, hi in zip(there.tolist(), edges, np.append(edges[1:], len(bucket)), strict=True):
                    r = row[lo:hi]
                    new = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    rows.append((b, 1, sig[r[new]].tobytes(), np.diff(np.append(new, len(r))).astype(np.uint32).tobytes(), h[lo:hi].astype("<u8").tobytes()))
                del hashes, held, row, h, bucket, order
                packed = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "kind", "a", "b", "c"])
                del rows
                yield packed

    return docs.mapInArrow(tidy(run), PASS)


def shared(table: pa.Table) -> pa.Table:
    """One bucket: its documents (kind 0) and the (sig, token, df) of hashes that two sets or more hold (kind 1)."""
    join = lambda rows, i, t: np.frombuffer(b"".join(r[i] for r in rows), t)
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True))
    docs, sets = [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] == 1]
    ids, sig, n = (join(docs, i, np.int64) for i in range(3))
    low = join(sets, 2, "<u8")
    owner = np.repeat(join(sets, 0, np.int64), join(sets, 1, np.uint32))
    ranked = np.sort(low)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(twice):
        twice = twice[np.append(True, twice[1:] != twice[:-1])]
        held = twice[np.minimum(np.searchsorted(twice, low), len(twice) - 1)] == low
        low, owner = low[held], owner[held]
        order = np.lexsort((owner, low))
        low, owner = low[order], owner[order]
        new = np.append(True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))  # equal sets of different batches
        low, owner = low[new], owner[new]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        df = np.repeat(np.diff(np.append(first, len(low))), np.diff(np.append(first, len(low))))
        low, owner, df = low[df > 1], owner[df > 1], df[df > 1]
        token = low.view(np.int64)
    else:
        owner = token = df = np.zeros(0, np.int64)
    k, m = len(ids), len(owner)
    del rows, docs, sets, ranked, twice
    release()
    zero = lambda x: np.zeros(x, np.int64)
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [k, m]).astype(np.int32)), "doc_id": pa.array(np.concatenate([ids, zero(m)])), "sig": pa.array(np.concatenate([sig, owner])),
        "n": pa.array(np.concatenate([n, zero(m)])), "token": pa.array(np.concatenate([zero(k), token])), "df": pa.array(np.concatenate([zero(k), df]).astype(np.int32)),
    })


class Node:
    __slots__ = ("run", "kids", "ends", "low", "high", "deep", "sample", "mixed")

    def __init__(self, run: list[int]):
        self.run, self.kids, self.ends = run, {}, []
        self.low, self.high, self.deep, self.sample, self.mixed = 1 << 60, 0, 0, -1, False


class Trie:
    """Sets (ascending tokens) with their full sizes; walks find the linked sets of other components and unite them."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.root = percent, Node([])
        self.sizes: list[int] = []
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, size: int, same: int | None = None) -> int:
        """A new member, in the component of `same` if given."""
        self.sizes.append(size)
        self.parent.append(len(self.parent) if same is None else self.find(same))
        return len(self.parent) - 1

    def insert(self, x: int, tokens: list[int]) -> None:
        node, at, own = self.root, 0, self.find(x)
        while True:
            self._pass(node, x, own, len(tokens) - at)
            if at == len(tokens):
                node.ends.append(x)
                return
            kid = node.kids.get(tokens[at])
            if kid is None:
                kid = node.kids[tokens[at]] = Node(tokens[at:])
                self._pass(kid, x, own, 0)
                kid.ends.append(x)
                return
            run, k = kid.run, 0
            while k < len(run) and at + k < len(tokens) and run[k] == tokens[at + k]:
                k += 1
            if k < len(run):  # the run parts here
                head = Node(run[:k])
                head.low, head.high, head.sample, head.mixed, head.deep = kid.low, kid.high, kid.sample, kid.mixed, kid.deep + len(run) - k
                kid.run = run[k:]
                head.kids[kid.run[0]] = kid
                node.kids[tokens[at]] = kid = head
            node, at = kid, at + k

    def _pass(self, node: Node, x: int, own: int, below: int) -> None:
        size = self.sizes[x]
        node.low, node.high, node.deep = min(node.low, size), max(node.high, size), max(node.deep, below)
        if node.sample < 0:
            node.sample = x
        elif not node.mixed and self.find(node.sample) != own:
            node.mixed = True

    def walk(self, x: int, tokens: list[int]) -> None:
        """Unites x with every set that links to it, except where both are in one component already."""
        size, percent, mine = self.sizes[x], self.percent, set(tokens)
        stack = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if node.sample < 0 or node.high * 100 < percent * size or size * 100 < percent * node.low:
                continue
            if not node.mixed and self.find(node.sample) == self.find(x):
                continue
            left = len(tokens)
            if node.run:
                common += len(mine.intersection(node.run))
                left -= bisect_right(tokens, node.run[-1])
            if (common + min(left, node.deep)) * (100 + percent) < percent * (size + max(node.low, -(-percent * size // 100))):
                continue
            for y in node.ends:
                if 100 * common >= percent * (size + self.sizes[y] - common) and self.find(x) != self.find(y):
                    self.parent[self.find(y)] = self.find(x)
                    self.links.append((x, y))
            stack += [(kid, common) for kid in node.kids.values()]


def whole_sets(table: pa.Table, *keys: str) -> Iterator[tuple[tuple, list[int]]]:
    """The rows of each set put together: its key columns, and its hashes in ascending order."""
    parts: dict[tuple, list] = {}
    for *key, tokens in zip(*(table.column(c).to_pylist() for c in keys), table.column("tokens"), strict=True):
        parts.setdefault(tuple(key), []).append(tokens.values.to_numpy(zero_copy_only=False))
    for key, tokens in parts.items():
        yield key, np.sort(np.concatenate(tokens)).tolist()


def self_links(table: pa.Table) -> pa.Table:
    """Links inside each (component, block) of the table; enough of them to join what is linked."""
    out: list[tuple[int, int]] = []
    groups: dict[tuple, list] = {}
    for (component, block, sig, n), tokens in whole_sets(table, "component", "block", "sig", "n"):
        groups.setdefault((component, block), []).append((n, sig, tokens))
    for members in groups.values():
        members.sort(key=lambda m: m[:2])
        trie = Trie()
        for n, _, tokens in members:
            x = trie.add(n)
            trie.walk(x, tokens)
            trie.insert(x, tokens)
        out += [(members[a][1], members[b][1]) for a, b in trie.links]
    return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})


def cross_links(block: pa.Table, walkers: pa.Table) -> pa.Table:
    """Links of the walkers to the block's sets, known components (label) left out."""
    out: list[tuple[int, int]] = []
    if block.num_rows and walkers.num_rows:
        trie, sigs, seen = Trie(), [], {}
        for rows, step in ((block, trie.insert), (walkers, trie.walk)):
            added = []
            for (sig, n, label), tokens in whole_sets(rows, "sig", "n", "label"):
                x = trie.add(n, seen.get(label))
                seen.setdefault(label, x)
                sigs.append(sig)
                added.append((x, tokens))
            for x, tokens in added:
                step(x, tokens)
        out = [(sigs[a], sigs[b]) for a, b in trie.links]
    return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})


EDGE = "a bigint, b bigint"


SET = ["component", "block", "sig", "n", "c", "tokens"]


def portions(size: Column | str = "tokens") -> Column:
    """How many blocks or parts a group of rows needs: by its sets (a set's first row has c = 0) and by its hashes."""
    sets, hashes = F.sum(F.when(F.col("c") == 0, 1).otherwise(0)), F.sum(F.size(size) if isinstance(size, str) else size)
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(hashes / BLOCK_HASHES)).cast("int")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("sig"), F.col("component").alias("label_"))
    return members.join(found, "sig", "left").select(*SET, F.coalesce("label_", "sig").alias("label"))


def across(members: DataFrame, walkers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each walker against every block of its group, in parts as large as blocks."""
    parts = walkers.groupBy("component").agg(portions().alias("parts"))
    dealt = walkers.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("sig", F.lit("walk")), F.col("parts")).cast("int"))
    each = dealt.drop("block").join(blocks, "component").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = members.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols, key = [*SET, "part", "label"], ["component", "block", "part"]
    return held.select(*cols).groupBy(*key).cogroup(each.select(*[F.col(c).alias(c) for c in cols]).groupBy(*key)).applyInArrow(cross_links, EDGE)


def links_of(sets: DataFrame, prefixes: DataFrame) -> DataFrame:
    """a, b: links between sets, enough to join what is linked. sets: sig, n, c, tokens, a row for each ROW_HASHES of a set's hashes;
    prefixes: sig, n, size (hashes in all rows), token."""
    band = F.floor(F.log("n") / F.lit(math.log(BAND))).cast("int")
    near = prefixes.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    heads = near.groupBy("token", "band").agg(F.min("sig").alias("head"), F.count(F.lit(1)).alias("m"), F.max(F.col("own") == F.col("band")).alias("home"))
    heads = heads.where("m > 1 and home").select("token", "band", F.xxhash64("head", "band").alias("component"))
    groups = staged(near.join(heads, ["token", "band"]).select("sig", "size", "component").distinct(), "jaccard-groups")
    blocks = groups.withColumn("c", F.lit(0)).groupBy("component").agg(portions(F.col("size")).alias("blocks"))
    dealt = groups.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    members = staged(sets.join(dealt, "sig").select(*SET, "blocks"), "jaccard-members")
    shards = max(1, -(-(members.agg(F.sum(F.size("tokens"))).first()[0] or 0) // SHARD_HASHES))
    own = members.groupBy(F.pmod(F.xxhash64("component", "block"), F.lit(shards)).alias("shard")).applyInArrow(self_links, EDGE)
    links = staged(own, "jaccard-links")
    large = members.where("blocks > 1")
    blocks = staged(large.select("component", "blocks").distinct(), "jaccard-blocks")
    if blocks.isEmpty():
        return links
    now = staged(labelled(large, links), "jaccard-labels")
    heads = now.groupBy("component", "label").agg(F.min("sig").alias("sig"))
    walkers = now.join(heads.select("component", "sig"), ["component", "sig"], "left_semi")
    links = staged(links.union(across(now, walkers, blocks)), "jaccard-links")
    then = staged(labelled(large, links), "jaccard-labels")
    sizes = then.where("c = 0").groupBy("component", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.col("size").cast("double") + F.pmod("label", F.lit(1 << 20)) / F.lit(float(1 << 21))).alias("main"))
    rest = then.join(main, "component").where("label <> main").join(heads.select("component", "sig"), ["component", "sig"], "left_anti")
    rest = staged(rest.select(*SET, "label"), "jaccard-rest")
    if rest.isEmpty():
        return links
    return staged(links.union(across(then, rest, blocks)), "jaccard-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of each document.

    Null texts and texts without words have no shingles and no links. Rows that repeat a doc_id are given each; rows
    without doc_id are left out. Sets are compared by 64-bit hashes; two different sets share a signature with a
    probability of about (number of sets)^2 / 2^65.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_buckets = max(1, -(-int(size) // (6 * BUCKET_HASHES)))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=BATCH):
        found = staged(bucketed(rows, n_buckets).groupBy("bucket").applyInArrow(shared, FOUND), "jaccard-shared")
    texts = found.where("kind = 0").select("doc_id", "sig", "n")
    nodes = staged(texts.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n")), "jaccard-nodes")
    held = found.where("kind = 1").groupBy("sig").agg(F.collect_list(F.struct("df", "token")).alias("t")).join(nodes.select("sig", "n"), "sig")
    need = F.ceil(F.col("n") * PERCENT / 100)
    held = held.where(F.size("t") >= need).select("sig", "n", F.sort_array("t").alias("t"), (F.size("t") - need + 1).cast("int").alias("p"))
    t, p = F.transform("t", lambda x: x["token"]), F.col("p")
    rows = F.transform(F.sequence(F.lit(0), ((F.size("t") - 1) / ROW_HASHES).cast("int")), lambda i: F.slice(t, i * ROW_HASHES + 1, F.lit(ROW_HASHES)))
    held = staged(held.select("sig", "n", F.size("t").alias("size"), p, F.posexplode(rows).alias("c", "tokens")), "jaccard-held")
    first = F.col("p") - F.col("c") * ROW_HASHES  # of this row's hashes so many belong to the prefix
    prefixes = held.where(first > 0).select("sig", "n", "size", F.explode(F.slice("tokens", F.lit(1), first)).alias("token"))
    links = links_of(held.select("sig", "n", "c", "tokens"), prefixes)
    reach = components(links).select(F.col("node").alias("sig"), "component")
    known = nodes.join(reach, "sig", "left").select("sig", "first_id", F.coalesce("component", "sig").alias("component"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = known.join(least, "component").select("sig", "component_id")
    out = texts.join(ids, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
