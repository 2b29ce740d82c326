import random
import re

import pytest

from orderloom.llm import shingle_join as sj

SCHEMA = "doc_id bigint, text string, n int, sig string, component_id int"


def brute(rows):
    sets = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 0.75 * max(len(a), len(b)) <= min(len(a), len(b)) and find(i) != find(j):
                if 100 * len(a & b) >= 75 * len(a | b):
                    label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def corpus(n, seed, edits):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdé", k=rnd.randint(2, 6))) for _ in range(400)]
    bases = [rnd.choices(vocab, k=rnd.choice([40, 90, 200])) for _ in range(6)]
    passage = rnd.choices(vocab, k=60)
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.7 else rnd.choices(vocab, k=rnd.randint(1, 120))
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            w += passage
        rows.append((i * 7 % 1009, " ".join(w), 0, "clash", 1))
    return rows


@pytest.mark.parametrize("block,bucket,edits,hashes,row", [(256, 1 << 22, 5, 1 << 19, 2048), (8, 300, 4, 1 << 19, 7), (5, 2000, 9, 1 << 19, 40), (256, 1 << 22, 5, 900, 30)])
def test_against_all_pairs(spark, monkeypatch, block, bucket, edits, hashes, row):
    monkeypatch.setattr(sj, "BLOCK_SETS", block)
    monkeypatch.setattr(sj, "BLOCK_HASHES", hashes)
    monkeypatch.setattr(sj, "ROW_HASHES", row)
    monkeypatch.setattr(sj, "BUCKET_HASHES", bucket)
    rows = corpus(260, block, edits)
    rows += [(2000, "", 0, "", 1), (2001, None, 0, "", 1), (2002, " \n ", 0, "", 1), (2003, "One two", 0, "", 1), (2004, "one  TWO", 0, "", 1), (2005, "one", 0, "", 1), (2006, "x " * 30000, 0, "", 1), rows[0], rows[0]]
    got = sj.op3_jaccard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_text_of_many_distinct_words(spark):
    long = " ".join(f"w{i}" for i in range(200000))
    rows = [(7, long, 0, "", 1), (3, "one two three four five six", 0, "", 1), (2, "One two three four five six", 0, "", 1), (9, long + " more", 0, "", 1)]
    got = sj.op3_jaccard(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(2, 2, 2), (3, 2, 2), (7, 199996, 7), (9, 199997, 7)]


def test_one_text_that_quotes_thousands(spark):
    """It is near none of those it quotes, so it must not be carried into their groups."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(3000)]
    short = [" ".join(rnd.choices(vocab, k=30)) for _ in range(3000)]
    near = [s + " tail" for s in short[:50]]
    rows = [(i, t, 0, "", 1) for i, t in enumerate([*short, *near, " ".join(short), " ".join(short) + " end"])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in sj.op3_jaccard(df).collect()}
    assert got == {i: i for i in range(3000)} | {3000 + i: i for i in range(50)} | {3050: 3050, 3051: 3050}
    sets, hashes = links_input(sj, df)
    assert sets <= 102 and hashes < 200_000  # the two long texts once each, and the pairs of short ones


def links_input(module, df):
    """Sets and hashes that reach the groups' members for these documents."""
    seen, real = {}, module.staged

    def counted(frame, name):
        out = real(frame, name)
        if name == "jaccard-members":
            seen["n"] = (out.select("sig").distinct().count(), out.selectExpr("sum(size(tokens))").first()[0])
        return out

    module.staged = counted
    try:
        module.op3_jaccard(df).count()
    finally:
        module.staged = real
    return seen["n"]


def test_empty_table(spark):
    assert sj.op3_jaccard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trie_links_equal_all_pairs():
    rnd = random.Random(8)
    for _ in range(40):
        sets = []
        for _ in range(60):
            base = set(range(rnd.randint(0, 3) * 10, 40))
            for _ in range(rnd.randint(0, 12)):
                base ^= {rnd.randrange(60)}
            sets.append(sorted(base))
        trie = sj.Trie()
        for s in sets:
            x = trie.add(len(s))
            trie.walk(x, s)
            trie.insert(x, s)
        label = list(range(60))
        for _ in range(60):
            for i in range(60):
                for j in range(60):
                    a, b = set(sets[i]), set(sets[j])
                    if (a or b) and 100 * len(a & b) >= 75 * len(a | b):
                        label[i] = label[j] = min(label[i], label[j])
        first = {}
        assert [first.setdefault(trie.find(i), i) for i in range(60)] == label


def test_a_batch_is_hashed_a_piece_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = [" ".join(f"w{i * j % 37}" for j in range(i % 60)) for i in range(120)] + [None, "", "x " * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    starts, hashes = sj.shingle_sets(batch.column("text"))
    seen, whole = [], sj.shingle_sets
    monkeypatch.setattr(sj, "PIECE", 2000)
    monkeypatch.setattr(sj, "shingle_sets", lambda t: seen.append(sum(len(x or "") for x in t.to_pylist())) or whole(t))
    got = sj.sets_of(batch)
    assert got[0].tolist() == starts.tolist() and got[1].tolist() == hashes.tolist()
    assert len(seen) > 5 and sorted(seen)[-2] <= 2000  # but for a text that is longer by itself
