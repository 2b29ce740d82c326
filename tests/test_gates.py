"""The causal quantile against numpy over each prefix."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from orderloom.operators import gates as G

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("seconds,ranges", [(86400 * 7, 64), (3600 * 5, 8), (3600, 3), (10**9, 64)])
def test_expanding_quantile(spark, seconds, ranges):
    rnd = np.random.default_rng(seconds % 97)
    rows = []
    for s, n in (("A", 220), ("B", 1), ("C", 60)):
        v = np.round(rnd.normal(size=n), 2)
        v[rnd.random(n) < 0.35] = 0.0  # one value holds a third of the rows
        q = rnd.choice([0.0, 0.3, 0.75, 0.9, 1.0], n)
        rows += [(s, T0 + timedelta(hours=i), float(a), None if i % 9 == 5 else float(b), "x") for i, (a, b) in enumerate(zip(v, q, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, v double, q double, note string").repartition(3)
    got = {(r.symbol, r.ts_event): r.t for r in G.expanding_quantile(df, "v", "q", "t", ranges, seconds).collect()}
    assert len(got) == len(rows)
    for s in "ABC":
        own = [r for r in rows if r[0] == s]
        for i, (_, t, _, q, _) in enumerate(own):
            want = float(np.quantile([r[2] for r in own[:i]], q)) if i and q is not None else None
            assert (got[s, t] is None) == (want is None) and (want is None or abs(got[s, t] - want) < 1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "symbol string, ts_event timestamp_ntz, v double, q double")
    assert G.expanding_quantile(df, "v", "q", "t").collect() == []
