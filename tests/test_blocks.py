"""Windows over blocks of rows against plain loops."""

import datetime as dt
import random

import numpy as np

from orderloom.functions import scan
from orderloom.operators import more


def test_causal_normalise_equals_a_plain_loop_without_wide_windows(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 64)
    rnd = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [("S", start + dt.timedelta(minutes=20 * i), i, level, rnd.choice([0.0, rnd.random(), 3.0 * level])) for i in range(400) for level in (0, 1)]
    rows[37] = (*rows[37][:4], None)
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp, seq bigint, level int, v double")
    out = more.causal_normalise(df, "v", n=40, least=10)
    assert "stddev_pop" not in out._jdf.queryExecution().executedPlan().toString()  # no frame of n rows that is added up anew for each row by Spark
    got = {(r.seq, r.level): r.v_norm for r in out.collect()}
    assert len(got) == len(rows)
    for level in (0, 1):
        x = [r[4] for r in rows if r[3] == level]
        for i, v in enumerate(x):
            w = np.array([y for y in x[max(0, i - 40) : i] if y], float)
            if v is None:
                assert got[i, level] is None
            elif v == 0 or len(w) < 10:
                assert got[i, level] == v
            else:
                assert abs(got[i, level] - min(max((v - w.mean()) / (w.std() + 1e-6), -6), 6)) < 1e-9


def test_tick_job_costs_the_same_a_row_however_dense(spark):
    from orderloom.operators import ticks, turns

    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1, 23, 50)
    at = sorted(start + dt.timedelta(seconds=rnd.randrange(2400)) for _ in range(300))
    rows = [("S", t, i, "T", rnd.choice("AB"), 100 + rnd.randrange(50) / 100, float(rnd.randrange(1, 9))) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, seq bigint, action string, side string, price double, size double")
    speed = ticks.tape_speed(df, 60)
    assert "-60000000" not in speed._jdf.queryExecution().optimizedPlan().toString()  # no frame that is counted anew for each row
    got = {r.seq: r.tape_speed for r in speed.collect()}
    assert got == {i: sum(u.date() == t.date() and t - dt.timedelta(seconds=60) <= u <= t for u in at) for i, t in enumerate(at)}
    plan = turns.tick_feature_job(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one scan for both recurrences
    absorbed = {r.seq: r.absorption for r in ticks.absorption_intensity(df, 5, window=20).collect()}
    ratio = []
    for i, r in enumerate(rows):
        day = [k for k in range(i + 1) if at[k].date() == at[i].date()]
        flow = sum(rows[k][6] * (1 if rows[k][4] == "A" else -1) for k in day[-5:])
        ratio.append(abs(flow) / max(abs(r[5] - rows[day[-5]][5]), 0.01) if len(day) >= 5 else abs(flow) / 0.01)
        m = float(np.median([ratio[k] for k in day[-20:]]))
        assert abs(absorbed[i] - min(ratio[i] / max(m, 1e-9), 25.0)) < 1e-9


def test_thirteen_channels_keep_snapshots_whole(spark, monkeypatch):
    from orderloom.operators import studies

    monkeypatch.setattr(scan, "BLOCK_ROWS", 16)
    rnd = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [("S", start + dt.timedelta(minutes=40 * i), i, [float(rnd.choice([0, 2, 4, 5, 9, 60])) for _ in range(10)], [1.0] * 10) for i in range(90)]
    rows += [("S", start + dt.timedelta(minutes=5), 1000, None, None), ("S", start + dt.timedelta(minutes=5), 1001, [], [])]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, seq bigint, bid_sz array<double>, ask_sz array<double>")
    out = studies.thirteen_channels(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Window ")  # levels are made after the last window: no shuffle holds a row a level
    got = {(r.seq, r.level): r for r in out.collect()}
    assert len(got) == 900
    for (i, k), r in got.items():
        z = rows[i][3]
        m = max(float(np.median(z)), 1.0)
        thin = [j for j, v in enumerate(z) if v < 5]
        assert r.wall_tier == sum(z[k] >= f * m for f in (3, 5, 10)) and r.thin == (z[k] < 5)
        assert r.gap_distance == (min(abs(j - k) for j in thin) if thin else None)
        assert (r.gradient is None) if i < 5 else abs(r.gradient - (np.log1p(z[k]) - np.log1p(rows[i - 5][3][k])) / 5) < 1e-12
