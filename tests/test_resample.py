"""Repetitions against numpy over all rows at once, and independence of partitions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import resample as R

T0 = datetime(2024, 1, 1)


def frame(spark, n=900, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [("AB"[i % 2], T0 + timedelta(hours=i), "fg"[i % 3 % 2], float(rnd.normal()), float(rnd.normal(0.05, 1)), int(rnd.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, feature string, x double, y double, label int")


def test_permutation_null(spark):
    df = frame(spark)
    got = {r.feature: (r.observed, r.p) for r in R.permutation_null(df, reps=150, seed=3).collect()}
    again = {r.feature: (r.observed, r.p) for r in R.permutation_null(df.repartition(7), reps=150, seed=3).collect()}
    rows = df.withColumn("_k", R.row_hash("symbol", "ts_event")).toPandas()
    for f, own in rows.groupby("feature"):
        s = np.sign(own["x"].to_numpy()) * own["y"].to_numpy()
        drawn = s @ R.signs(own["_k"].to_numpy(), 150, 3)
        want = (s.mean(), ((np.abs(drawn) >= abs(s.sum()) * (1 - 1e-12)).sum() + 1) / 151)
        assert got[f] == pytest.approx(want) and again[f] == pytest.approx(want)


def test_draws_are_spread():
    keys = np.arange(20_000, dtype=np.int64)
    s = R.signs(keys, 130, 1)
    assert set(np.unique(s)) == {-1.0, 1.0} and np.abs(s.mean(0)).max() < 0.04 and np.abs(np.corrcoef(s[:, :40].T) - np.eye(40)).max() < 0.04
    w = R.poisson_one(keys, 5, 1)
    assert np.allclose(w.mean(0), 1, atol=0.03) and np.allclose(w.var(0), 1, atol=0.06)
    for c in (0, 3, 40, 500):
        d = R.poisson(np.full(4000, c), keys[:4000], 5, 2)
        assert np.allclose(d.mean(), c, rtol=0.02) and (c == 0 or np.allclose(d.var(), c, rtol=0.06))


def test_bootstrap_of_means_and_sharpe_ratios(spark):
    df = frame(spark)
    rows = df.withColumn("_k", R.row_hash("symbol", "ts_event")).toPandas()
    got = {r.symbol: (r.low, r.high) for r in R.bootstrap_mean(df, "y", "symbol", reps=120, ci=0.8).collect()}
    for s, own in rows.groupby("symbol"):
        w, v = R.poisson_one(own["_k"].to_numpy(), 120, 7), own["y"].to_numpy()
        assert got[s] == pytest.approx(tuple(np.quantile((v @ w) / w.sum(0), [0.1, 0.9])))
        assert got[s][0] < v.mean() < got[s][1]
    days = df.groupBy("symbol", F.to_date("ts_event").alias("_d")).agg(F.avg("y").alias("m")).withColumn("_k", R.row_hash("symbol", "_d")).toPandas()
    got = {r.symbol: (r.low, r.high) for r in R.bootstrap_sharpe(df.repartition(5), "y", "symbol", reps=120, ci=0.8).collect()}
    for s, own in days.groupby("symbol"):
        w, v = R.poisson_one(own["_k"].to_numpy(), 120, 7), own["m"].to_numpy()
        ratio = [m / sd * np.sqrt(252) for i in range(120) for rep in [np.repeat(v, w[:, i].astype(int))] for m, sd in [(rep.mean(), rep.std(ddof=1))]]
        assert got[s] == pytest.approx(tuple(np.quantile(ratio, [0.1, 0.9])), rel=1e-6)


def test_bootstrap_of_the_area_under_the_curve(spark):
    df = frame(spark).withColumn("score", F.round(F.col("label") * 0.8 + F.col("x"), 1))
    (r,) = R.bootstrap_auc(df, "score", "label", reps=60, ci=0.8).collect()
    (again,) = R.bootstrap_auc(df.repartition(9), "score", "label", reps=60, ci=0.8, buckets=5).collect()
    assert tuple(r) == pytest.approx(tuple(again))
    p = df.toPandas()
    pos, neg = p[p.label == 1].score.to_numpy(), p[p.label == 0].score.to_numpy()
    area = lambda a, b: ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))
    assert r.auc == pytest.approx(area(pos, neg)) and r.low < r.auc < r.high
    n = df.groupBy(F.col("score").alias("v")).agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.sum((1 - F.col("label")).cast("bigint")).alias("q")).withColumn("_k", F.xxhash64("v")).toPandas()
    wp, wq = (R.poisson(n[c].to_numpy(), n["_k"].to_numpy(), 60, 14 + i) for i, c in enumerate("pq"))
    drawn = [area(np.repeat(n.v.to_numpy(), wp[:, i].astype(int)), np.repeat(n.v.to_numpy(), wq[:, i].astype(int))) for i in range(60)]
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(drawn, [0.1, 0.9])))
    assert R.bootstrap_auc(df.where("label = 2"), "score", "label").collect() == []


def test_grid_of_edges(spark):
    rnd = np.random.default_rng(5)
    n = 4000
    rows = []
    close = 100.0
    for i in range(n):
        rise = rnd.normal(0, 0.001) + (0.002 if i % 5 == 1 else 0.0)  # the bar after an event rises
        close *= 1 + rise
        rows.append(("A", T0 + timedelta(hours=i), close, i % 5 == 0, "z1" if i % 24 < 12 else "z2"))
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, close double, e boolean, zone string")
    t = R.grid_trades(df, "zone", {"real": F.col("e"), "rest": ~F.col("e")}, {"long": (F.lit(True), 1), "short": (F.lit(True), -1)}, [1])
    found = {(r.zone, r.event, r["filter"]): r for r in R.edge_grid(t, reps=99).collect()}
    for zone in ("z1", "z2"):
        assert found[zone, "real", "long"].stage == "holdout" and found[zone, "real", "long"].p_family == 0.01
        assert found[zone, "rest", "long"].p_family > 0.01
    keyed = t.where("split = 'train'").withColumn("_k", R.row_hash("symbol", "ts_event")).toPandas()
    z, drawn = {}, {}
    for cell, own in keyed.groupby(["zone", "event", "filter"]):
        root = np.sqrt((own.ret**2).sum())
        z[cell], drawn[cell] = abs(own.ret.sum()) / root, np.abs(own.ret.to_numpy() @ R.signs(own["_k"].to_numpy(), 99, 7)) / root
    most = np.max([drawn[c] for c in drawn], axis=0)
    for cell, r in found.items():
        assert r.p_permutation == pytest.approx(((drawn[cell] >= z[cell] * (1 - 1e-12)).sum() + 1) / 100)
        assert r.p_family == pytest.approx(((most >= z[cell] * (1 - 1e-12)).sum() + 1) / 100)
    order = {s: (min(x), max(x)) for s in ("train", "validation", "holdout") for x in [[r.ts_event for r in t.where(f"split = '{s}'").select("ts_event").collect()]]}
    assert order["train"][1] < order["validation"][0] and order["validation"][1] < order["holdout"][0]
