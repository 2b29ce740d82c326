import math
import random

import numpy as np
import pytest

from orderloom.llm import maxscore

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, k=5):
    v = {}
    for i, e, *_ in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in e])
    out = []
    for q in [i for i in v if i % 50 == 0]:
        for a in v[q]:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i in v if i != q for b in v[i])
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shift,shards", [(0.0, 16384), (0.0, 40), (-3.0, 40), (2.0, 33)])
def test_against_brute_force(spark, shift, shards, monkeypatch):
    rnd = random.Random(3)
    base = [[rnd.gauss(shift, 1) for _ in range(6)] for _ in range(150)]
    rows = [(i, b, 0, "clash") for i, b in enumerate(base)] + [(300 + i, base[0], 0, "") for i in range(20)]
    rows += [(1000, None, 0, ""), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, ""), (1100, [float("nan")] * 6, 0, ""), (1150, [float("inf")] * 6, 0, ""), (1200, [0.0] * 6, 0, "")]
    monkeypatch.setattr(maxscore.top_k, "__defaults__", (5, shards, 2))
    got = maxscore.op2_top_k(spark.createDataFrame(rows, SCHEMA)).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_and_alone(spark):
    assert maxscore.op2_top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert maxscore.op2_top_k(spark.createDataFrame([(0, [1.0], 0, "")], SCHEMA)).collect() == []
    assert len(maxscore.op2_top_k(spark.createDataFrame([(0, [1.0], 0, ""), (7, [], 0, "")], SCHEMA)).collect()) == 1


@pytest.mark.parametrize("shards", [16384, 300])
def test_every_row_as_a_query(spark, shards):
    """A query is its own best candidate here as a rule: its own row must neither come out nor raise the threshold."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(2000, 64))).astype(np.int64)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id bigint, v array<bigint>")
    got = {}
    for r in maxscore.top_k(rows, rows, 5, shards, 700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    score = v @ v.T
    for q in range(2000):
        order = np.lexsort((np.arange(2000), -score[q]))
        order = order[order != q][:5]
        assert sorted(got[q]) == [(r + 1, int(i), int(score[q, i])) for r, i in enumerate(order)]
