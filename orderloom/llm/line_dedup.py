"""Fuzzy line deduplication, in DataFrame operations only.

1. Lines are lower-cased and their white space is squeezed; equal lines fall together by a 128-bit hash.
2. A line's shingles are the 12 characters from each word's start, and from every character of longer words up to their
   last 12 (so in text without spaces from every character). They leave no character out. The signature holds the four smallest shingle hashes; each two of them are a band, and so is the only
   one of a line of one shingle. Lines of Jaccard similarity s share a band with probability 1 - (1-s)^4 - 4s(1-s)^3 at
   least: 0.87 at 0.65, 0.95 at 0.75, 0.996 at 0.9.
3. In each band's bucket every line is compared with the bucket's pivot, its most frequent line; a bucket of any size
   costs one comparison a line. What is then still outside of its bucket's pivot's component is compared with all lines of
   the bucket from other components, in blocks, each pair once: no pair that banding proposes and that could join two
   components goes unseen. Comparisons are exact, on whole shingle sets; bits of the shingles rule out most unlike pairs first.
4. Components by distributed union-find; of each the earliest line (by doc_id, then line number) stays.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import dropped, staged
from orderloom.llm.components import components

SHINGLE, SIMILARITY, SIGNATURE = 12, 0.65, 4
ORDER_STEP = 1 << 31
#: Lines of a bucket that one task compares with the whole bucket, about; a component over one of so many parts of the lines is large.
BLOCK, LARGE_SHARE = 512, 10_000
#: Cells of 512 bits in a table that sieves texts (about 25 MB), and passes over the texts in which the sets are made, at most.
CELLS, PASSES = 1 << 18, 4


def squeezed(line: Column) -> Column:
    """Lower case, each stretch of white space one space, none at the ends. The pattern runs on lines that need it only."""
    odd = line.contains("  ")
    for c in "\t\r\x0b\x0c":
        odd = odd | line.contains(c)
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


#: Steps over a word, or over one character of a word longer than a shingle; group 1 is the shingle.
STEP = f"(?s)(?=(.{{1,{SHINGLE}}}))(?:[^ ]{{1,{SHINGLE}}}+(?: |\\z)|[^ ])"


def shingles(line: Column) -> Column:
    """Distinct hashes of a squeezed line's shingles."""
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(STEP), F.lit(1)), lambda g: F.xxhash64(g)))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no, line (squeezed), h1, h2 of each line that is not blank; rows without id are left out."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    # blank by the text itself: a filter on the squeezed line would squeeze each line twice
    rows = rows.where("doc_id is not null").where(F.col("line").rlike(r"\S")).withColumn("line", squeezed(F.col("line")))
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit("second")))


def place() -> Column:
    """doc_id and line number as one number of the same order."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(ORDER_STEP).cast("decimal(11,0)") + F.col("line_no").cast("decimal(11,0)")


def signed_rows(rows: DataFrame) -> DataFrame:
    """h1, h2, doc_id, line_no, line, m (shingles) and the signature s0 to s3 (null where the line has fewer)."""
    found = rows.select("h1", "h2", "doc_id", "line_no", "line", F.sort_array(shingles(F.col("line"))).alias("s"))
    return found.select("h1", "h2", "doc_id", "line_no", "line", F.size("s").alias("m"), *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(SIGNATURE)])


def distinct_lines(signed: DataFrame) -> DataFrame:
    """A row for each distinct line: h1, h2, n, first (its earliest place), m and the signature."""
    return signed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first"), F.min("m").alias("m"), *[F.min(f"s{i}").alias(f"s{i}") for i in range(SIGNATURE)])


def band_keys() -> Column:
    """The bands of a line: a key for each two of the signature's values, null where a value is missing.

    A line that has one shingle has a band of this one.
    """
    keys = [F.when(F.col(b).isNotNull(), F.xxhash64(a, b)) for a, b in combinations([f"s{i}" for i in range(SIGNATURE)], 2)]
    keys[0] = F.coalesce(keys[0], F.when(F.col("s0").isNotNull(), F.xxhash64("s0", F.lit("single"))))
    return F.array(*keys)


def buckets(lines: DataFrame) -> DataFrame:
    """key, h1, m, pivot, pivot_m: the members of buckets of two lines or more, and their number of shingles."""
    rows = lines.select("h1", "m", "n", F.explode(band_keys()).alias("key")).where("key is not null")
    weight = F.col("n").cast("double") + F.pmod("h1", F.lit(1 << 20)) / F.lit(float(1 << 21))
    heads = rows.groupBy("key").agg(F.max_by("h1", weight).alias("pivot"), F.max_by("m", weight).alias("pivot_m"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # written first: a join with the aggregate itself could not split a hot bucket
    heads = staged(heads.select("key", "pivot", "pivot_m"), "line-pivots")
    return rows.join(heads, "key").select("key", "h1", "m", "pivot", "pivot_m")


def can_reach(m: str, other: str) -> Column:
    """Sets of so many shingles can be as similar as asked."""
    return F.least(m, other) >= SIMILARITY * F.greatest(m, other)


def sieved(rows: DataFrame, near: DataFrame, count: int) -> DataFrame:
    """The rows whose place (h1, doc_id, line_no) may be one of the `count` of `near`: one bit of a broadcast table stands for each.

    A table has a cell of eight words for each 32 places, CELLS at most; it lets all of `near` pass and about a sixteenth of the others.
    """
    r = F.xxhash64("h1", "doc_id", "line_no")
    word = F.shiftrightunsigned(r, 61)
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(r, 55).bitwiseAND(F.lit(63)).cast("int"))
    cell = F.pmod(r, F.lit(min(CELLS, count // 32 + 1))).alias("cell")
    cells = near.select(cell, word.alias("word"), mark.alias("mark")).groupBy("cell").agg(*[F.bit_or(F.when(F.col("word") == k, F.col("mark"))).alias(f"b{k}") for k in range(8)])
    found = rows.select("*", cell).join(F.broadcast(cells), "cell")
    own = F.coalesce(*[F.when(word == k, F.col(f"b{k}")) for k in range(8)], F.lit(0))
    return found.where(own.bitwiseAND(mark) != 0).select(*rows.columns)


def shingle_sets(signed: DataFrame, lines: DataFrame, members: DataFrame) -> list[DataFrame]:
    """h1, s (sorted) of each line in a bucket, in written tables. Its text comes from its earliest place, so copies are not one task's rows.

    Texts of other lines are sieved out before the shuffle. A table serves 64 * CELLS lines; more take up to PASSES
    passes, of which each has only its share of the texts in shuffle files, however many pass the sieve.
    """
    step = F.lit(ORDER_STEP).cast("decimal(11,0)")
    near = lines.join(members.select("h1").distinct(), "h1", "left_semi").withColumn("line_no", F.pmod("first", step).cast("int"))
    near = staged(near.select("h1", F.call_function("div", F.col("first") - F.col("line_no"), step).alias("doc_id"), "line_no"), "line-near")
    count = near.count()
    passes = max(1, min(PASSES, -(-count // (64 * CELLS))))
    sets = []
    for k in range(passes):
        share = F.pmod("h1", F.lit(passes)) == k
        own = near.where(share)
        found = sieved(signed.select("h1", "doc_id", "line_no", "line").where(share), own, count // passes)
        found = found.join(own.hint("shuffle_hash"), ["h1", "doc_id", "line_no"])
        found = found.groupBy("h1", "doc_id", "line_no").agg(F.first("line").alias("line"))  # rows may repeat a doc_id
        sets.append(staged(found.select("h1", F.sort_array(shingles(F.col("line"))).alias("s")), "line-sets"))
    dropped(near)
    return sets


def reaches(common: Column, sizes: Column) -> Column:
    """So many common shingles of sets with so many in all are as similar as asked: common >= SIMILARITY * (sizes - common)."""
    return common * (1 + SIMILARITY) >= SIMILARITY * sizes - 1e-9


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    of = lambda side: sets.select(F.col("h1").alias(side), F.col("s").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(reaches(F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b"))).select("a", "b")


#: Words of 64 bits that a line's shingles are marked in.
WORDS = 4


def bits(k: int) -> Column:
    """Word k of the marks of the set `s`: a bit by each shingle's hash."""
    place = lambda x: F.call_function("shiftright", x, F.lit(2)).bitwiseAND(F.lit(63)).cast("int")
    mark = lambda x: F.when(x.bitwiseAND(F.lit(3)) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), place(x))).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate("s", F.lit(0).cast("bigint"), lambda w, x: w.bitwiseOR(mark(x)))


def most_common(m: str, other_m: str, own: str, other: str) -> Column:
    """As many shingles as two sets can have in common at most: a bit of one that the other lacks is a shingle it lacks."""
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in range(1, WORDS)), F.bit_count(F.col(f"{x}0").bitwiseAND(F.bitwise_not(F.col(f"{y}0")))))
    return F.least(F.col(m) - lacks(own, other), F.col(other_m) - lacks(other, own))


def passed_over(u: bool) -> Column:
    """The smaller signature values that the band of `key` leaves out, two at most: the first, or else the second of them."""
    s = [F.get("s", F.lit(i)) for i in range(SIGNATURE)]
    out = None
    for i, j in combinations(range(SIGNATURE), 2):
        left = [s[k] for k in range(j) if k != i]
        if len(left) > (0 if u else 1):
            hit, value = F.col("key") == F.xxhash64(s[i], s[j]), left[0 if u else 1]
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def rest_links(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The components (a, b) of similar pairs that share a bucket and lie in different ones of `labels` (node, component); a line without one is its own.

    At least one line of such a pair is outside of the component of their bucket's pivot. These lines meet all others of
    the bucket, in blocks of about BLOCK lines. A pair is compared where it is made, and only in the bucket of the two smallest
    values that its signatures share.
    """
    own = labels.select(F.col("node").alias("h1"), F.col("component").alias("c"))
    head = labels.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    placed = members.join(own, "h1", "left").join(head, "pivot", "left").select("key", "h1", "m", "pivot", F.coalesce("c", "h1").alias("c"), F.coalesce("pc", "pivot").alias("pc"))
    placed = staged(placed, "line-placed")
    blocks = placed.groupBy("key").agg(F.count_if(F.col("c") != F.col("pc")).alias("outside"), F.count(F.lit(1)).alias("members"))
    # of two lines one is the pivot: they have been compared
    deal = lambda n, of, out: F.ceil(F.col(n) / of).cast("int").alias(out)
    blocks = blocks.where("outside > 0 and members > 2").select("key", deal("outside", BLOCK, "blocks"), deal("members", 2 * BLOCK, "parts"))
    blocks = staged(blocks, "line-blocks")
    rows = placed.where("h1 <> pivot").join(blocks, "key").join(sets, "h1")
    rows = staged(rows.select("*", passed_over(True).alias("u"), passed_over(False).alias("v"), *[bits(k).alias(f"w{k}") for k in range(WORDS)]), "line-rest")

    def side(x: DataFrame, n: str) -> DataFrame:
        x = x.repartition("key", "block", "part")
        return x.select("key", "block", "part", F.col("h1").alias(n), F.col("c").alias(f"c{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("m", "s", "u", "v")], *[F.col(f"w{k}").alias(f"w_{n}{k}") for k in range(WORDS)], *(["pc"] if n == "b" else []))

    outside = rows.where("c <> pc").withColumn("block", F.pmod(F.xxhash64("h1"), "blocks").cast("int"))
    outside = side(outside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "a")
    others = rows.withColumn("part", F.pmod(F.xxhash64("h1"), "parts").cast("int"))
    others = side(others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "b")
    pairs = outside.join(others, ["key", "block", "part"]).where("ca <> cb and (cb = pc or b < a)").where(can_reach("m_a", "m_b"))
    sizes = F.col("m_a") + F.col("m_b")
    can = ~F.coalesce(F.expr("u_a = u_b or u_a = v_b or v_a = u_b or v_a = v_b"), F.lit(False)) & reaches(most_common("m_a", "m_b", "w_a", "w_b"), sizes)
    pairs = pairs.where(F.when(can, reaches(F.size(F.array_intersect("s_a", "s_b")), sizes)).otherwise(F.lit(False)))
    links = staged(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "line-links")
    dropped(placed, rows, blocks)
    return links


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component where links (a, b) hold components of `labels` together, or lines that had none."""
    over = staged(components(links), "line-over")
    moved = labels.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(over.join(labels, "node", "left_anti"))


def decisions(signed: DataFrame) -> DataFrame:
    """h1, h2, class_id, keep: for each line that has copies or near copies, the place of the one line that stays.

    class_id is the h1 of the line of the class with the earliest place; keep is null for the other lines of the class.
    """
    lines = staged(distinct_lines(signed), "lines")
    members = staged(buckets(lines), "line-buckets")
    parts = shingle_sets(signed, lines, members)
    sets = reduce(DataFrame.unionByName, parts)
    pairs = members.where("h1 <> pivot").where(can_reach("m", "pivot_m")).select(F.col("pivot").alias("a"), F.col("h1").alias("b")).distinct()
    links = staged(similar(pairs, sets), "line-links")
    labels = staged(components(links), "line-labels")
    rest = rest_links(members, sets, labels)
    if not rest.isEmpty():
        labels = staged(joined(labels, rest), "line-labels")
    dropped(members, links, rest, *parts)
    nodes = labels.select(F.col("node").alias("h1"), "component")
    known = lines.join(nodes, "h1", "left").where("component is not null or n > 1").select("h1", "h2", "first", F.coalesce("component", "h1").alias("component"))
    known = staged(known, "line-known")
    heads = staged(known.groupBy("component").agg(F.min("first").alias("keep"), F.min_by("h1", "first").alias("class_id"), F.count(F.lit(1)).alias("size")), "line-heads")
    # components of over a ten-thousandth of the lines, ten thousand at most, are broadcast: no task gets a hot one whole
    large = heads.where(F.col("size") * LARGE_SHARE > known.count())
    seen = known.join(F.broadcast(large), "component").unionByName(known.join(F.broadcast(large.select("component")), "component", "left_anti").join(heads, "component"))
    out = staged(seen.select("h1", "h2", "class_id", F.when(F.col("first") == F.col("keep"), F.col("keep")).alias("keep")), "line-decisions")
    dropped(lines, labels, known, heads)
    return out


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), class_id, kept for every line that is not blank.

    Lines of one class are copies or linked near copies; one of each class is kept. Null and empty texts and blank lines
    give no rows. Rows that repeat a doc_id are one document, whatever their texts: each of their lines is judged by itself,
    and of copies in the same place all stay. Rows without doc_id take no part.
    """
    signed = staged(signed_rows(line_rows(docs, id_col, text_col)), "line-rows")
    found = signed.select("doc_id", "line_no", "h1", "h2").join(decisions(signed), ["h1", "h2"], "left")
    return found.select("doc_id", "line_no", F.coalesce("class_id", "h1").alias("class_id"), (F.col("class_id").isNull() | F.coalesce(place() == F.col("keep"), F.lit(False))).alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that are not kept, other columns unchanged; texts that lose no line are untouched.

    A document all of whose lines go becomes an empty text. Where rows share a doc_id, a line goes if all lines of its
    number in them go: nothing of which no copy is kept is lost.
    """
    gone = line_classes(docs, id_col, text_col).groupBy("doc_id", "line_no").agg(F.bool_or("kept").alias("kept")).where("not kept")
    gone = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_id")
    joined = docs.join(gone, F.col(id_col).cast("bigint") == F.col("_id"), "left")
    lines = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    joined = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines))
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    return line_classes(docs)
