import math
import random
import re
from collections import Counter

import pytest

from orderloom.llm import bag_search

DOCS, ITEMS = "doc_id bigint, text string, score double, rank int", "item_id string, text string, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d[0], Counter(terms(d[1]))) for d in docs]
    sized = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(sized), sum(n for *_, n in sized)
    df = Counter(t for _, b, _ in sized for t in b)
    out = []
    for item, text in {(i[0], i[1]) for i in items}:
        own, found = set(terms(text)), []
        for doc, b, n in sized:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in own & set(b))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    words = ["the", "of", "Stein", "naïve", "été", "x1", "日本", "foo_bar", "it's", "a", "b-c", "ÀB", "0.5", "qux", "rare"]
    docs = [(i * 13 % 1009, " ".join(rnd.choices(words, weights=range(15, 0, -1), k=rnd.randint(1, 12))), 0.0, 1) for i in range(n)]
    docs += [(5000 + i, docs[3][1], 0.0, 1) for i in range(60)]  # one large class, ties beyond the tenth place
    docs += [docs[0], docs[0], (None, docs[1][1], 0.0, 1), (9001, None, 0.0, 1), (9002, "", 0.0, 1), (9003, "...", 0.0, 1), (9004, "the " * 30000, 0.0, 1)]
    items = [(f"i{j}", " ".join(rnd.choices(words, k=rnd.randint(1, 9))), 1) for j in range(30)]
    items += [items[0], ("none", "absent", 1), ("empty", "", 1), ("null", None, 1), (None, "rare qux", 1)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_against_brute_force(spark, block):
    docs, items = corpus()
    got = bag_search.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == brute(docs, items)


def test_small_blocks_of_scores_and_shuffled_members(spark, monkeypatch):
    monkeypatch.setattr(bag_search, "BROADCAST_HASHES", 0)
    docs, items = corpus(2, 150)
    got = bag_search.op11_bag_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(3, 5)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert bag_search.op11_bag_search(none_d, spark.createDataFrame(items, ITEMS)).collect() == []
    assert bag_search.op11_bag_search(spark.createDataFrame(docs, DOCS), none_i).collect() == []
    assert bag_search.op11_bag_search(spark.createDataFrame([(1, "...", 0.0, 1)], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []


def test_running_best_keeps_ties_in_order():
    import numpy as np

    rnd = np.random.default_rng(0)
    scores, first = rnd.integers(0, 4, (300, 3)), rnd.permutation(300)
    best = bag_search.Best(3, 5)
    for at in range(0, 300, 37):
        best.add(scores[at : at + 37], first[at : at + 37], np.arange(300)[at : at + 37])
    for item in range(3):
        own = best.item == item
        want = sorted((-s, f) for s, f in zip(scores[:, item].tolist(), first.tolist(), strict=True) if s > 0)[:5]
        assert list(zip((-best.score[own]).tolist(), best.first[own].tolist(), strict=True)) == want
