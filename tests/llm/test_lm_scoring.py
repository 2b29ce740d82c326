import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orderloom.llm import lm_scoring as lm
from orderloom.llm.ngram_trie import NONE, EliasFano, NgramTrie, probability, quantised

SCHEMA = "doc_id bigint, text string, train int, score string"


def brute(rows, d=0.75):
    docs = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        docs.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*w, None]))
    c, pairs = Counter(), defaultdict(Counter)
    for _, held, toks in docs:
        if not held:
            c.update(toks)
            for v, w in zip(["<s> "] + toks, toks, strict=False):
                pairs[v][w] += 1
    n, v_ = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v_ + 1))
    out = []
    for i, held, toks in docs:
        base = sum(math.log10(p(w)) for w in toks)
        score = 0.0
        for v, w in zip(["<s> "] + toks, toks, strict=False):
            f = pairs.get(v)
            q = p(w)
            if f:
                t = sum(f.values())
                q = max(f[w] - d, 0) / t + d * len(f) / t * q
            score += math.log10(q)
        out.append((i, held, len(toks), sum(c[w] > 0 for w in toks), n, base, score))
    return out


def corpus():
    rnd = random.Random(3)
    words = ["the", "of", "Cat", "dog,", "à", "Å", "house", "tree"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choices(words, weights=[60, 30, 9, 9, 5, 5, 5, 5] + [1] * 200, k=rnd.randint(0, 60))), 0, "clash") for i in range(400)]
    return rows + [(500, "", 0, ""), (501, None, 0, ""), (502, "x " * 30000, 0, ""), (None, "the end", 0, ""), rows[3], rows[3]]


@pytest.mark.parametrize("chunk,shard", [(16 << 20, 1 << 22), (2000, 500)])
def test_against_plain_counts(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    rows = corpus()
    got = lm.op5_lm_scoring(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=3e-4)  # the step of the codes


def test_empty_table(spark):
    assert lm.op5_lm_scoring(spark.createDataFrame([], SCHEMA)).collect() == []


def test_elias_fano_levels(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 1 << 63), (1000, 1000), (5000, 1 << 50), (3000, (1 << 64) - 1)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        EliasFano.write(str(tmp_path), "x", values)
        ef = EliasFano(str(tmp_path), "x")
        assert (ef.access(np.arange(len(values))) == values).all()
        other = rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)
        want = [int(np.searchsorted(values, k)) if k in set(values.tolist()) else -1 for k in other.tolist()]
        assert ef.find(other).tolist() == want and (ef.find(values) == np.arange(len(values))).all()


def test_trie_and_codes():
    rng = np.random.default_rng(2)
    v, w, c = rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(40), rng.integers(0, 90, 3000).astype(np.uint64), rng.integers(1, 9, 3000)
    plain, total = Counter(), Counter()
    for a, b, k in zip(v.tolist(), w.tolist(), c.tolist(), strict=True):
        plain[a, b] += k
        total[a] += k
    part = v[:1]  # a context that is held elsewhere as well
    total[int(part[0])] = 10**6
    with NgramTrie(v, w, c, 0.75, (part, np.array([10**6]))) as trie:
        ask = np.arange(45, dtype=np.uint64) << np.uint64(40)
        codes, weights = trie.query(ask, np.full(45, 100), np.tile(np.arange(100, dtype=np.uint64), 45))
        fan = [len({b for x, b in plain if x == a}) for a in ask.tolist()]
        assert trie.successors_of(ask).tolist() == fan
        for (a, b), code in zip([(a, b) for a in ask.tolist() for b in range(100)], codes.tolist(), strict=True):
            assert (code == NONE) == ((a, b) not in plain)
            if code != NONE:
                assert math.log(probability(np.array(code))) == pytest.approx(math.log((plain[a, b] - 0.75) / total[a]), rel=1.3e-4, abs=1e-8)
        for a, n, code in zip(ask.tolist(), fan, weights.tolist(), strict=True):
            assert (code == NONE) == (n == 0)
            assert n == 0 or math.log(probability(np.array(code))) == pytest.approx(math.log(0.75 * n / total[a]), rel=1.3e-4)
    p = np.array([1 - 1e-9, 1 - 1e-6, 0.5, 1e-3, 1e-13])
    assert (np.abs(np.log(probability(quantised(p))) - np.log(p)) < 1.3e-4 * np.abs(np.log(p)) + 2e-9).all()


def test_busy_contexts_are_dealt_by_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 400)
    rnd = random.Random(4)
    rows = [(i, " ".join(x for k in range(20) for x in ("the", f"w{rnd.randrange(500)}")), 0, "") for i in range(200)]
    got = sorted(tuple(r) for r in lm.op5_lm_scoring(spark.createDataFrame(rows, SCHEMA)).collect())
    for g, w in zip(got, sorted(brute(rows)), strict=True):
        assert g[:5] == w[:5] and g[6] == pytest.approx(w[6], rel=3e-4)


def test_text_of_many_distinct_words(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(150_000)), 0, ""), (2, "w1 w2", 0, "")]
    for g, w in zip(sorted(tuple(r) for r in lm.op5_lm_scoring(spark.createDataFrame(rows, SCHEMA)).collect()), sorted(brute(rows)), strict=True):
        assert g[:5] == w[:5] and g[6] == pytest.approx(w[6], rel=3e-4)
