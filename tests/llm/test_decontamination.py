import random

import pytest

from orderloom.llm import decontamination as dc

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id int"


def corpus():
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(5000)]
    items = [(i, rnd.choices(vocab, k=rnd.choice([6, 14, 30, 45]))) for i in range(40)]
    docs, leaks = [], set()
    for d in range(300):
        w = rnd.choices(vocab, k=rnd.randint(1, 200))
        if d % 3 == 0:
            i, item = rnd.choice(items)
            part = list(item)
            if len(item) >= 14:
                for _ in range(len(item) // 14):
                    part[rnd.randrange(len(part))] = "changed"
            if len(item) >= 30 and rnd.random() < 0.3:
                part = part[: len(item) // 2 + 6]
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() + "," if rnd.random() < 0.2 else x for x in part]
            leaks.add((d, i))
        docs.append((d, " ".join(w), "clash"))
    return docs, [(i, " ".join(w), 0) for i, w in items], leaks


@pytest.mark.parametrize("rows", [1 << 20, 600])
def test_planted_leaks_and_clean_documents(spark, monkeypatch, rows):
    monkeypatch.setattr(dc, "INDEX_ROWS", rows)
    docs, items, leaks = corpus()
    extra = [(900, "", ""), (901, None, ""), (902, "x " * 40000, ""), (None, items[2][1], "")]
    more = [(70, items[2][1].upper(), 0), (71, "of the", 0), (72, None, 0), (None, "a b c d e f g", 0), (73, "", 0)]
    d, b = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(items + more, ITEMS)
    got = {(r.doc_id, r.item_id) for r in dc.op4_decontamination(d, b).collect()}
    want = leaks | {(None, 2)}
    want |= {(x, 70) for x, i in want if i == 2}
    assert got == want
    kept = {r.doc_id for r in dc.clean(d, b).collect()}
    assert kept == {x[0] for x in docs + extra} - {x for x, _ in want}


def test_positions(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = "start " + item.replace("six", "SIX,").replace("nine", "changed") + " end"
    r = dc.op4_decontamination(spark.createDataFrame([(1, text, "")], DOCS), spark.createDataFrame([(5, item, 0)], ITEMS)).collect()
    assert [tuple(x) for x in r] == [(1, 5, 1, 0, 14, 13)]


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b c d e f", "")], DOCS)
    assert dc.op4_decontamination(none_d, none_b).collect() == [] and dc.op4_decontamination(one, none_b).collect() == []
    assert dc.clean(one, none_b).count() == 1


def brute_stretch(same):
    """The most equal words of any stretch with a changed word for three equal ones at most."""
    best = 0
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            equal = sum(same[a:b])
            if 3 * (b - a - equal) <= equal:
                best = max(best, equal)
    return best


@pytest.mark.parametrize("n", [5, 6, 8, 9, 10, 11, 12, 14, 16, 20, 25, 30, 45])
def test_no_stretch_that_counts_lacks_a_seed(n):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(n)
    item = [f"i{k}" for k in range(n)]
    index = dc.Index([(3, " ".join(item))])
    for _ in range(250):
        changed = set(rnd.sample(range(n), rnd.randint(0, max(1, n * 3 // 8))))
        text = ["before"] * 5 + [f"c{k}" if k in changed else w for k, w in enumerate(item)] + ["after"] * 5
        same = np.array([k not in changed for k in range(n)])
        most = brute_stretch(same.tolist())
        assert dc.stretch(same)[2] == most
        got = index.matches(pa.array([" ".join(text)]))
        if most >= dc.least_equal(n):
            (row, item_id, doc_word, item_word, words, equal), = got
            assert (row, item_id, doc_word, equal) == (0, 3, 5 + item_word, most) and 4 * equal >= 3 * words
        else:
            assert got == []


def test_masks_meet_every_pattern():
    """Every pattern of up to 19 words that counts, of equal and changed words, holds a mask."""
    masks = [[k for k, x in enumerate(m) if x == "1"] for m in dc.MASKS]
    for n in range(5, 20):
        for x in range(1 << (n - 2)):
            word = (1 << (n - 1)) | (x << 1) | 1
            equal = word.bit_count()
            if 4 * equal < 3 * n or equal < (7 if n < 12 else 10) and equal < n:
                continue
            assert any(all(word >> (at + k) & 1 for k in m) for m, span in zip(masks, map(len, dc.MASKS)) for at in range(n - span + 1)), bin(word)


def test_all_pairs_against_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    items = [rnd.choices(vocab, k=rnd.choice([3, 5, 7, 8, 11, 14, 22])) for _ in range(25)]
    docs = []
    for d in range(120):
        w = rnd.choices(vocab, k=rnd.randint(0, 30))
        part = [rnd.choice(vocab) if rnd.random() < 0.15 else x for x in rnd.choice(items)]
        docs.append(w + part + rnd.choices(vocab, k=rnd.randint(0, 10)))
    docs += [docs[0], [], ["w1"] * 300]  # repeated rows, ties
    want = set()
    for d, w in enumerate(docs):
        for i, item in enumerate(items):
            if len(item) >= dc.LEAST_ITEM:
                for start in range(1 - len(item), len(w)):
                    lo, hi = max(start, 0), min(start + len(item), len(w))
                    if brute_stretch([w[k] == item[k - start] for k in range(lo, hi)]) >= dc.least_equal(len(item)):
                        want.add((d, i))
    frame = spark.createDataFrame([(d, " ".join(w), "") for d, w in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate(items)], ITEMS)
    assert {(r.doc_id, r.item_id) for r in dc.op4_decontamination(frame, bench).collect()} == want
    assert {r.doc_id for r in dc.clean(frame, bench).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_seeds_of_ten_equal_words_reach_over_the_extent():
    """Over all patterns of ten equal words or more that count: the words from the first seed to the end of the last one."""
    masks = [[k for k, x in enumerate(reversed(m)) if x == "1"] for m in dc.MASKS]
    spans = [len(m) for m in dc.MASKS]
    states, least = {(0, 0, 0, 0, None, None)}, 99  # the last five words, words, equal, changed, words since the first seed began and the last one ended
    for n in range(1, 26):
        after = set()
        for bits, long, equal, changed, first, last in states:
            for bit in (0, 1) if n > 1 else (1,):
                e, c = equal + bit, changed + 1 - bit
                if e > 19 or c > 6:
                    continue
                b, m = (bits << 1 | bit) & 31, min(5, long + 1)
                f, q = (None, None) if first is None else (first + 1, last + 1)
                for own, span in zip(masks, spans, strict=True):
                    if m >= span and all(b >> k & 1 for k in own):
                        f, q = max(f or 0, span), 0
                if f is None or f - q < 12:
                    after.add((b, m, e, c, f, q))
        states = after
        least = min([least, *(0 if f is None else f - q for b, _, e, c, f, q in states if e >= 10 and 3 * c <= e and b & 1)])
    assert least == dc.EXTENT


@pytest.mark.parametrize("frequent,hits", [(2, 1 << 20), (2, 50), (64, 7)])
def test_common_phrases_against_brute_force(monkeypatch, frequent, hits):
    import pyarrow as pa

    monkeypatch.setattr(dc, "FREQUENT", frequent)
    monkeypatch.setattr(dc, "HITS", hits)
    monkeypatch.setattr(dc, "COMPARED", hits)
    rnd = random.Random(frequent + hits)
    vocab = [f"w{k}" for k in range(80)]
    opening, end = "which of the following is", "none of these"
    items = [[*opening.split(), *rnd.choices(vocab, k=rnd.choice([2, 8, 14])), *(end.split() if rnd.random() < 0.5 else [])] for _ in range(40)]
    index = dc.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = []
    for _ in range(150):
        part = [rnd.choice(vocab) if rnd.random() < 0.2 else x for x in rnd.choice(items)]
        texts.append(rnd.choices(vocab, k=rnd.randint(0, 9)) + rnd.choice([[], opening.split()]) + part)
    want = set()
    for d, w in enumerate(texts):
        for i, item in enumerate(items):
            for start in range(1 - len(item), len(w)):
                lo, hi = max(start, 0), min(start + len(item), len(w))
                if brute_stretch([w[k] == item[k - start] for k in range(lo, hi)]) >= dc.least_equal(len(item)):
                    want.add((d, i))
    assert {m[:2] for m in index.matches(pa.array([" ".join(w) for w in texts]))} == want


def test_a_common_opening_costs_nothing():
    import time

    import pyarrow as pa

    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(30_000)]
    index = dc.Index([(i, "what is the name of " + " ".join(rnd.choices(vocab, k=20))) for i in range(20_000)])
    texts = pa.array([" ".join(rnd.choices(vocab, k=100)) + " what is the name of " + " ".join(rnd.choices(vocab, k=100)) for _ in range(50)])
    began = time.process_time()
    assert index.matches(texts) == []
    assert time.process_time() - began < 0.2
