import random
import re

import pytest

from orderloom.llm import line_dedup
from orderloom.llm.components import components

SCHEMA = "doc_id bigint, text string, n int, h1 string, kept int"


def brute(rows):
    """All lines against all, with the same sets."""
    lines = {}
    for i, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            line = re.sub(r"\s+", " ", line).strip(" ").lower()
            if line and i is not None:
                lines.setdefault(line, []).append((i, n))
    names = list(lines)
    s = [shingle_set(x) for x in names]
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            c = len(s[i] & s[j])
            if c >= 0.65 * (len(s[i]) + len(s[j]) - c):
                parent[find(i)] = find(j)
    classes = {}
    for i, x in enumerate(names):
        classes.setdefault(find(i), []).extend(lines[x])
    return sorted(sorted(set(c)) for c in classes.values())


def got(df):
    classes, kept = {}, {}
    for r in df.collect():
        classes.setdefault(r.class_id, set()).add((r.doc_id, r.line_no))
        if r.kept:
            kept.setdefault(r.class_id, set()).add((r.doc_id, r.line_no))
    assert all(kept[c] == {min(m)} for c, m in classes.items())
    return sorted(sorted(c) for c in classes.values())


def test_against_all_pairs(spark):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    base = [rnd.choices(vocab, k=rnd.randint(25, 45)) for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(3):
            w = list(rnd.choice(base)) if rnd.random() < 0.7 else rnd.choices(vocab, k=20)
            if rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = "changed" + str(rnd.randint(0, 9))
            text.append("  ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(text), 1, "clash", 2))
    rows += [(200, "", 1, "", 2), (201, None, 1, "", 2), (202, " \n\t\n", 1, "", 2), (203, "x" * 50000 + "\nshort\nshort", 1, "", 2), (204, "short", 1, "", 2), (None, "short", 1, "", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(line_dedup.op7_line_dedup(df)) == brute(rows)
    clean = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df).collect()}
    assert clean[204] == "" and clean[201] is None and clean[203] == "x" * 50000 + "\nshort" and clean[None] == "short"


def test_empty_table_and_repeated_row(spark):
    assert line_dedup.op7_line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(1, "a b c\nd", 1, "", 1)] * 2, SCHEMA)
    assert [r.kept for r in line_dedup.op7_line_dedup(twice).collect()] == [True] * 4


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rnd = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(200)], "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)], "none": []}[kind]
    rnd.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {x: c for x, c in label.items() if sum(v == c for v in label.values()) > 1}


def shingle_set(line):
    """From each word, and in words of over 12 characters from each character up to the last 12."""
    out, at = set(), 0
    for word in line.split(" "):
        out |= {line[at + k : at + k + 12] for k in range(max(1, len(word) - 11))}
        at += len(word) + 1
    return out


def brute_banded(lines):
    """Components of the distinct lines by all pairs that share two of their four smallest hashes and are similar."""
    xxhash = pytest.importorskip("xxhash")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    sets = [{signed(xxhash.xxh64_intdigest(g.encode() if isinstance(g, str) else g, seed=42)) for g in shingle_set(x)} for x in lines]
    low = [set(sorted(s)[:4]) for s in sets]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if len(low[i] & low[j]) >= min(2, len(sets[i]), len(sets[j])) and c >= 0.65 * (len(sets[i]) + len(sets[j]) - c) and label[i] != label[j]:
                label = [label[i] if x == label[j] else x for x in label]
    classes = {}
    for i, x in enumerate(label):
        classes.setdefault(x, []).append((i, 0))
    return sorted(classes.values())


@pytest.mark.parametrize("block", [512, 3])
def test_copies_behind_a_common_template(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8)))
    lines = []
    for _ in range(6):
        template = [word() for _ in range(16)]
        lines.append(" ".join(template))
        for _ in range(30):
            tail = [word() for _ in range(rnd.choice([2, 11, 14]))]
            lines.append(" ".join(template + tail))
            lines.append(" ".join(template + tail[:-1] + [word()]))
    often = [(1000 + i, "\n".join(lines[k * 61] for k in range(6)), 1, "", 1) for i in range(20)]
    df = spark.createDataFrame([(i, x, 1, "", 1) for i, x in enumerate(lines)] + often, SCHEMA)
    found = sorted(sorted(m for m in c if m[0] < 1000) for c in got(line_dedup.op7_line_dedup(df)))
    assert found == brute_banded(lines)


def test_short_unspaced_and_long_token_lines(spark):
    rnd = random.Random(5)
    chinese = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(90))
    address = "https://example.com/" + "".join(rnd.choices("abcdefghijklmnop/-", k=120))
    lines = ["see https://example.com/news/2024/storm-hits-coast", "see https://example.com/recipes/apple-pie"]
    lines += [chinese, chinese[:45] + chr(0x3042) + chinese[46:], chinese[:89], address, address[:70] + "#" + address[71:], address[::-1]]
    lines += ["-" * 12, "-" * 40, "stauer bla", "stauer bla.", "ab", "abc", "a", "\U0001f600" * 9, "\U0001f600" * 30]
    df = spark.createDataFrame([(i, x, 1, "", 1) for i, x in enumerate(lines)], SCHEMA)
    found = got(line_dedup.op7_line_dedup(df))
    assert found == brute_banded(lines)
    assert [[i for i, _ in c] for c in found] == [[0], [1], [2, 3, 4], [5, 6], [7], [8, 9], [10], [11], [12], [13], [14], [15], [16]]


def test_one_id_on_two_texts(spark):
    near = " ".join(f"word{i}" for i in range(30))
    rows = [(1, near + " x\nalone in b", 1, "", 1), (1, near + " y\nalone in a\nthird", 1, "", 1), (2, near + " z", 1, "", 1), (4, near + " w\nthird", 1, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = line_dedup.op7_line_dedup(df).collect()
    assert len(out) == 8 and len({r.class_id for r in out if r.line_no == 0}) == 1
    clean = sorted((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(df).collect())
    kept = [r for r in out if r.line_no == 0 and r.kept]
    # both lines 0 of document 1 are in the earliest place and stay; those of the other documents go
    assert {r.doc_id for r in kept} == {1} and len(kept) == 2
    assert clean == [(1, near + " x\nalone in b"), (1, near + " y\nalone in a\nthird"), (2, ""), (4, "")]


def test_texts_are_split_and_squeezed_once(spark, monkeypatch):
    calls, real = [], line_dedup.line_rows
    monkeypatch.setattr(line_dedup, "line_rows", lambda *a: calls.append(1) or real(*a))
    near = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(i, f"{near} {i}\n \t\x0b\nalone {i * 7919} row", 1, "", 1) for i in range(6)], SCHEMA)
    assert len({r.class_id for r in line_dedup.op7_line_dedup(df).collect() if r.line_no == 0}) == 1
    assert len(calls) == 1
    plan = real(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_bits_never_rule_out_a_similar_pair(spark):
    rnd = random.Random(8)
    rows = []
    for _ in range(400):
        pool = [rnd.getrandbits(64) - (1 << 63) for _ in range(rnd.choice([1, 3, 12, 50, 400]))]
        part = rnd.random()
        rows.append(tuple(sorted(x for x in pool if rnd.random() < part) or pool[:1] for _ in range(2)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for n in "ab":
        df = df.withColumn("s", df[n]).select(*df.columns, *[line_dedup.bits(k).alias(f"w_{n}{k}") for k in range(line_dedup.WORDS)]).selectExpr("*", f"size({n}) AS m_{n}")
    found = df.select("a", "b", line_dedup.most_common("m_a", "m_b", "w_a", "w_b").alias("most")).collect()
    assert all(r.most >= len(set(r.a) & set(r.b)) for r in found)
    apart = [r for r in found if 10 < len(r.a) < 60 and 10 < len(r.b) < 60 and not set(r.a) & set(r.b)]
    assert all(2 * r.most < len(r.a) + len(r.b) for r in apart)


@pytest.mark.parametrize("cells", [line_dedup.CELLS, 1])
def test_texts_are_not_in_shuffle_files_all_at_once(spark, monkeypatch, cells):
    """The largest stage writes far less than the texts, and each line has its class from the passes, whatever the sign of its doc_id."""
    monkeypatch.setattr(line_dedup, "CELLS", cells)  # with one cell of 512 bits: passes
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9))
    lines = [[word() for _ in range(200)] for _ in range(300)]
    lines += [[*x[:-1], word()] for x in lines[:60]]
    rows = [(i - 30, " ".join(x), 1, "", 1) for i, x in enumerate(lines)]
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    before = tracker()
    found = got(line_dedup.op7_line_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert found == sorted([sorted([(i - 30, 0), (i + 270, 0)]) for i in range(60)] + [[(i - 30, 0)] for i in range(60, 300)])
    written = []
    for stage in range(before, tracker()):
        try:
            written.append(store.lastStageAttempt(stage).shuffleWriteBytes())
        except Exception:  # noqa: BLE001 - skipped stages have no attempt
            continue
    assert 0 < max(written) < 0.5 * sum(len(r[1]) for r in rows)
