"""Literal frames, causality and independence of partitioning."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderloom.functions.scan import ewm
from orderloom.operators import bars as B
from orderloom.operators import clean, joins, labels, rolls, splits, stats, structure, trades
from orderloom.operators import windows as W
from orderloom.plans import base
from orderloom.sources import market

T0 = datetime(2024, 1, 2, 9)
BARS = "symbol string, ts_event timestamp_ntz, open double, high double, low double, close double, volume double, atr double"


def bars_of(spark, rows, atr=1.0):
    return spark.createDataFrame([("A", T0 + timedelta(hours=i), o, h, lo, c, v, atr) for i, (o, h, lo, c, v) in enumerate(rows)], BARS)


TICKS = "symbol string, ts_event timestamp_ntz, seq bigint, order_id bigint, action string, side string, price double, size double"


def test_sanitize_drops_bad_and_keeps_the_last(spark):
    rows = [("A", T0, 1, 7, "T", "A", 10.0, 1.0), ("A", T0, 2, 7, "T", "A", 11.0, 2.0), ("A", T0, 2, 7, "T", "A", 11.0, 2.0), ("A", T0, 2, 6, "T", "A", 12.0, 2.0)]
    rows += [("A", None, 3, 7, "T", "A", 9.0, 1.0), ("A", T0, 4, 8, "T", "A", -1.0, 1.0), ("A", T0, 5, 9, "T", "A", float("nan"), 1.0)]
    t = spark.createDataFrame(rows, TICKS)
    # rows that differ in the sequence alone all stay
    assert sorted((r.seq, r.order_id) for r in clean.sanitize_ticks(t).collect()) == [(1, 7), (2, 7)]
    assert sorted(r.price for r in clean.sanitize_ticks(t.withColumn("ingest", F.col("price")), "ingest").collect()) == [10.0, 12.0]
    assert sorted(r.order_id for r in clean.sanitize_ticks(t.drop("seq")).collect()) == [6, 7]
    assert clean.sanitize_ticks(t.drop("seq", "order_id")).count() == 3


def test_each_rule_of_the_audited_cleaning(spark):
    later = T0 + timedelta(hours=2)
    rows = [
        ("A", T0, 1, 7, "T", "A", 10.0, 1.0), ("A", T0, 2, 7, "T", "A", 11.0, 2.0), ("A", later, 3, 7, " c", "n", 10.0, 0.0), ("A", later, 4, 8, "X", "", 10.0, 0.0),
        ("A", None, 5, 7, "T", "A", 9.0, 1.0), ("A", T0, 6, 8, "T", "A", 1000.0, 1.0), ("A", T0, 7, 9, "Z", "A", 10.0, 1.0), ("A", T0, 8, 9, "T", "S", 10.0, 1.0),
        ("A", T0, 9, 9, "T", "A", 10.0, 0.0), ("B", T0, 10, 9, "T", "A", 10.0, 1.0), ("A", T0, 11, 9, "T", "A", 10.0, None),
    ]
    kept, audit = clean.clean_ticks_audited(spark.createDataFrame(rows, TICKS), 0.0, 100.0)
    assert sorted((r.seq, r.feed_gap) for r in kept.collect()) == [(1, False), (3, True), (4, False)]
    assert {r.rule: r.removed for r in audit.collect()} == {"null_or_inf": 1, "price_range": 1, "action": 1, "side": 1, "size": 2, "symbol": 1, "duplicate": 1}


@pytest.mark.parametrize("path,label", [([(0, 0.5, -0.5, 0, 1), (0, 1.2, 0, 1, 1)], 1), ([(0, 0.5, -0.5, 0, 1), (0, 0.2, -1.2, -1, 1)], -1), ([(0, 0.5, -0.5, 0, 1), (0.5, 1.2, -1.2, 0, 1)], 1), ([(0, 0.5, -0.5, 0, 1), (-0.5, 1.2, -1.2, 0, 1)], -1), ([(0, 0.5, -0.5, 0, 1), (0, 0.2, -0.2, 0, 1)], 0)])
def test_barrier_labels(spark, path, label):
    b = bars_of(spark, [tuple(map(float, p)) for p in path])
    assert labels.triple_barrier(b, horizon=4).orderBy("ts_event").first().label == label


def test_ewm_equals_the_recursion_over_chunks(spark):
    values = [((i * 37) % 101) / 7 for i in range(400)]
    b = bars_of(spark, [(v, v, v, v, 1.0) for v in values])
    got = [r.y for r in ewm(b, "close", 0.1, "y").orderBy("ts_event").collect()]
    y = values[0]
    for g, v in zip(got, values, strict=True):
        y = 0.9 * y + 0.1 * v if v is not values[0] else v
        assert g == pytest.approx(y, rel=1e-9)


def test_asof_takes_the_latest_and_the_tolerance(spark):
    left = spark.createDataFrame([("A", T0 + timedelta(minutes=m), m) for m in (0, 5, 30)], "symbol string, ts_event timestamp_ntz, k int")
    right = spark.createDataFrame([("A", T0 + timedelta(minutes=m), float(m)) for m in (1, 5, 6)], "symbol string, ts_event timestamp_ntz, x double")
    got = {r.k: r.right_x for r in joins.asof_backward_join(left, right, ["x"], 600).collect()}
    assert got == {0: None, 5: 5.0, 30: None}


def test_alignment_assert(spark):
    b = bars_of(spark, [(1.0, 1.0, 1.0, 1.0, 1.0)] * 3)
    joins.alignment_assert(b, b, "same")
    with pytest.raises(ValueError, match="missing"):
        joins.alignment_assert(b, b.limit(2), "missing")


def test_roll_day(spark):
    rows = []
    for d in range(1, 21):
        rows += [("near", datetime(2024, 1, d), 1.30 + 0.0001 * d, max(1.0, 100.0 - 5 * d), d), ("far", datetime(2024, 1, d), 1.32 + 0.0001 * d, 5.0 * d, 100 + d)]
    t = spark.createDataFrame(rows, "contract string, ts_event timestamp_ntz, price double, size double, seq bigint")
    roll = rolls.roll_day_by_volume(t)
    assert str(roll.first().roll_day) == "2024-01-11"
    off = rolls.roll_offset(t, roll, 3).first()
    assert off.add_to_old == pytest.approx(0.02)
    assert rolls.roll_day_by_volume(t.where("contract = 'near'")).first().roll_day is None


def test_purged_rows_do_not_reach_the_test(spark, sf_dir):
    d = splits.purged_split(base.labelled(spark, sf_dir))
    edge = d.where("part = 'test'").groupBy("symbol").agg(F.min("ts_event").alias("t"))
    assert d.where("part = 'train'").join(edge, "symbol").where("label_end >= t").count() == 0


def test_one_trade_at_a_time(spark):
    rows = [("A", T0 + timedelta(hours=a), T0 + timedelta(hours=b), 1, "target", 1.0) for a, b in ((0, 3), (1, 2), (3, 4), (5, 9), (8, 10))]
    t = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, ts_exit timestamp_ntz, side int, exit_reason string, pnl double")
    assert sorted(r.ts_event.hour - 9 for r in trades.one_at_a_time(t).collect()) == [0, 3, 5]


def test_zigzag_confirms_after_the_extreme(spark, sf_dir):
    s = structure.zigzag_swings(base.stage(base.atr_bars(spark, sf_dir)))
    assert s.where("confirmed_at < bar_ts").count() == 0


def test_readers_round_trip(spark, sf_dir, tmp_path):
    t = market.ticks(spark, sf_dir)
    t.withColumnRenamed("size", "qty").write.option("header", True).csv(f"{tmp_path}/csv")
    schema = ", ".join(f"{'qty' if f.name == 'size' else f.name} {f.dataType.simpleString()}" for f in t.schema)
    back = market.tick_source(spark, f"{tmp_path}/csv", "csv", schema)
    assert back.count() == t.count() and "size" in back.columns
    market.csv_to_parquet(spark, f"{tmp_path}/csv", f"{tmp_path}/pq", schema)
    assert spark.read.parquet(f"{tmp_path}/pq").count() == t.count()
    market.parquet_shards(t, f"{tmp_path}/shards", 100)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == t.count()


def test_correlated_columns_fall_together(spark):
    df = spark.range(200).select((F.col("id") % 17).alias("a"), (F.col("id") % 17 * 2 + 1).alias("b"), (F.col("id") * 7 % 13).alias("c"))
    assert stats.correlation_clusters(df, ["a", "b", "c"]) == [["a", "b"], ["c"]]
    assert stats.redundancy_filter(df, ["a", "b", "c"]) == ["a", "c"]


CAUSAL = {
    "atr": lambda b: W.true_range_atr(b.drop("atr")).select("symbol", "ts_event", "atr"),
    "rsi": lambda b: W.rsi(b).select("symbol", "ts_event", "rsi"),
    "macd": lambda b: W.macd_histogram(b).select("symbol", "ts_event", "macd_hist"),
    "levels": lambda b: W.previous_period_levels(b).select("symbol", "ts_event", "prev_day_high", "prev_week_low"),
    "zscore": lambda b: W.rolling_zscore(b, "volume").select("symbol", "ts_event", "volume_z"),
    "rank": lambda b: W.rolling_rank(b, "volume").select("symbol", "ts_event", "volume_rank"),
    "regime": lambda b: labels.regime_rule(b).select("symbol", "ts_event", "regime"),
    "runs": lambda b: W.consecutive_runs(b).select("symbol", "ts_event", "up_run"),
    "level": lambda b: W.local_level_trend(b).select("symbol", "ts_event", "level"),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_past_values_do_not_change_with_the_future(spark, sf_dir, name):
    b = base.stage(base.atr_bars(spark, sf_dir)).cache()
    cut = "ts_event < timestamp_ntz '2024-01-12'"
    key = lambda df: {(r[0], r[1]): round(r[2], 8) if isinstance(r[2], float) else r[2] for r in df.collect()}
    assert key(CAUSAL[name](b).where(cut)) == key(CAUSAL[name](b.where(cut)))


def test_bars_do_not_depend_on_partitioning(spark, sf_dir):
    t = market.ticks(spark, sf_dir)
    one = sorted(map(tuple, B.ohlcv_bars(t.coalesce(1)).collect()))
    assert one == sorted(map(tuple, B.ohlcv_bars(t.repartition(13, "seq")).collect()))


@pytest.mark.parametrize("t,freedom", [(2.0, 10), (0.5, 3), (3.5, 100), (0.0, 5), (1.3, 1)])
def test_students_p(t, freedom):
    import math

    density = lambda x: math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi) * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
    n = 4000  # Simpson's rule from 0 to t
    inner = sum((1 if k in (0, n) else 4 if k % 2 else 2) * density(t * k / n) for k in range(n + 1)) * t / n / 3
    assert stats.student_p(t, freedom) == pytest.approx(1 - 2 * inner, abs=1e-9)


def test_ranks_and_percentiles_are_exact(spark):
    values = [(i * 7919) % 101 / 4 for i in range(500)] + [3.0] * 40
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)], "g string, v double")
    got = {r.v: r.r for r in stats.with_ranks(df, {"v": "r"}, "g").where("g = 'g'").collect()}
    ordered = sorted(values)
    for v, r in got.items():
        at = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert r == sum(at) / len(at)
    p = stats.percentiles(df.where("g = 'g'"), "v", [0.0, 0.25, 0.5, 0.99, 1.0]).first()
    import numpy as np

    assert p.n == len(values)
    assert [p.p0, p.p1, p.p2, p.p3, p.p4] == pytest.approx(np.percentile(values, [0, 25, 50, 99, 100]).tolist())


def test_one_trade_at_a_time_with_cooldown(spark):
    rows = [("A", T0 + timedelta(hours=a), T0 + timedelta(hours=b)) for a, b in ((0, 2), (1, 3), (2, 4), (3, 5), (5, 6))]
    t = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, ts_exit timestamp_ntz")
    hours = lambda df: sorted(r.ts_event.hour - T0.hour for r in df.collect())
    assert hours(trades.one_at_a_time(t)) == [0, 2, 5]
    assert hours(trades.one_at_a_time(t, 3600.0)) == [0, 3]
    assert hours(trades.one_at_a_time(t, 3 * 3600.0)) == [0, 5]


def test_barriers_by_regime_session_and_rescue(spark):
    flat = (0.0, 0.1, -0.1, 0.0, 1.0)
    b = bars_of(spark, [flat, (0.0, 0.9, 0.0, 0.8, 1.0), flat, flat]).withColumn("regime", F.lit("calm")).withColumn("session", F.lit("early"))
    first = lambda **k: labels.triple_barrier(b, horizon=3, **k).orderBy("ts_event").first()
    assert (first().label, first().outcome, first().bars_held) == (0, "timeout", 3)
    assert (first(regimes={"calm": (0.5, 2)}).label, first(regimes={"calm": (0.5, 2)}).outcome) == (1, "up")
    assert first(session_ends={"early": 11}).bars_held == 1
    assert first(session_ends={"early": 10}).bars_held == 0
    assert first(rescue_ratio=2.0, rescue_move=0.5).label == 1 and first(rescue_ratio=2.0, rescue_move=1.0).label == 0


def test_scans_equal_plain_loops_over_any_chunks(spark):
    import numpy as np
    from orderloom.functions.scan import Recurrence, numbered, scan

    rnd = np.random.default_rng(4)
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(minutes=int(m)), float(rnd.normal()), float(rnd.uniform(0.2, 1.1))) for s, n in (("A", 300), ("B", 1), ("C", 40)) for m in np.sort(rnd.choice(5000, n, replace=False))]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, x double, a double").repartition(3)
    both = [Recurrence(["y"], [[F.col("a")]], [F.col("x")], [2.0]), Recurrence(["u", "v"], [[0.5, F.col("a")], [-0.25, 0.75]], [F.col("x"), 0.0], [F.col("x"), 1.0])]
    want = {}
    for s in "ABC":
        y, z = 2.0, None
        for i, (_, t, x, a) in enumerate(r for r in rows if r[0] == s):
            z = np.array([x, 1.0]) if z is None else z
            y, z = a * y + x, np.array([[0.5, a], [-0.25, 0.75]]) @ z + np.array([x, 0.0])
            want[s, t] = (i + 1, y, *z)
    for seconds in (60, 1800, 10**7):
        got = {(r.symbol, r.ts_event): (r.n, r.y, r.u, r.v) for r in scan(numbered(df, "n", seconds), both, seconds).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_trend_filters_equal_the_plain_recursion(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    close = 100 + np.cumsum(rnd.normal(0, 0.5, 400))
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", start + timedelta(hours=i), float(c)) for i, c in enumerate(close)], "symbol string, ts_event timestamp_ntz, close double")
    got = W.local_level_trend(df).orderBy("ts_event").collect()
    y, v = close[0], 1.0
    state, cov, top = np.array([close[0], 0.0]), np.eye(2), 0.0
    move, see = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0])
    for i, (z, r) in enumerate(zip(close, got, strict=True)):
        v = v + (1e-5 if i else 0.0)
        k = v / (v + 1e-3)
        y, v = y + k * (z - y), (1 - k) * v
        state, cov = move @ state, move @ cov @ move.T + np.eye(2) * 1e-4
        gain = cov @ see / (see @ cov @ see + 1e-2)
        state = state + gain * (z - see @ state)
        cov = (np.eye(2) - np.outer(gain, see)) @ cov
        top = max(top, abs(state[1]))
        assert np.allclose([r.level, r.trend_level, r.trend_slope, r.trend_strength], [y, *state, abs(state[1]) / max(top, 1e-10)], atol=1e-9)
        assert r.trend == (0 if abs(state[1]) <= 0.05 * max(top, 1e-10) else int(np.sign(state[1])))


def test_spearman_filter_and_mrmr_equal_pandas(spark):
    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(8)
    y = rnd.normal(size=300)
    p = pd.DataFrame({"a": y + rnd.normal(size=300), "c": rnd.normal(size=300), "e": np.round(rnd.normal(size=300)), "y": y})
    p["b"] = np.exp(p["a"]) + rnd.normal(0, 0.01, 300)
    p["d"] = y**3 + rnd.normal(0, 2, 300)
    cols = ["a", "b", "c", "d", "e"]
    size = p[[*cols, "y"]].corr(method="spearman").abs()
    order = sorted(cols, key=lambda c: (c != "c", -size.loc[c, "y"]))
    kept, gone = [], set()
    for c in order:
        if c in gone and c != "c":
            continue
        kept.append(c)
        gone |= {o for o in cols if o != c and size.loc[c, o] > 0.85}
    df = spark.createDataFrame(p)
    assert stats.redundancy_filter(df, cols, "y", 0.85, ("c",)) == kept and "c" in kept
    chosen = [max(cols, key=lambda c: size.loc[c, "y"])]
    while len(chosen) < 4:
        chosen.append(max((c for c in cols if c not in chosen), key=lambda c: size.loc[c, "y"] - size.loc[c, chosen].mean()))
    assert stats.mrmr(df, cols, "y", 4) == chosen


def test_percentiles_of_columns_equal_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(9)
    x, z = rnd.normal(size=500), np.where(rnd.random(500) < 0.4, 0.0, rnd.normal(size=500))
    df = spark.createDataFrame([(float(a), None if i % 50 == 3 else float(b)) for i, (a, b) in enumerate(zip(x, z, strict=True))], "x double, z double").repartition(5)
    some = z[[i for i in range(500) if i % 50 != 3]]
    (r,) = stats.percentile_row(df, {"x": [0.1, 0.99], "z": [0.5, 0.73]}).collect()
    assert np.allclose([r.x_p0, r.x_p1, r.z_p0, r.z_p1], [*np.quantile(x, [0.1, 0.99]), *np.quantile(some, [0.5, 0.73])]) and (r.x_n, r.z_n) == (500, 490)
    assert stats.percentile_row(df.where("false"), {"x": [0.5]}).first().x_n == 0


def test_event_study_against_its_matched_null(spark):
    import numpy as np
    from orderloom.operators import more as X

    rnd = np.random.default_rng(2)
    rows, close = [], 100.0
    for i in range(600):
        close *= 1 + rnd.normal(0, 0.001) + (0.003 if i % 10 == 1 else 0.0)
        rows.append(("A", T0 + timedelta(hours=i), close, close * 1.001, close * 0.999, close, 1.0, 0.1))
    b = spark.createDataFrame(rows, BARS).withColumn("session", F.lit("x"))
    events = b.where("hour(ts_event) >= 0").withColumn("i", F.expr("timestampdiff(HOUR, timestamp_ntz '2024-01-02 09:00:00', ts_event)")).where("i % 10 = 0").select("symbol", "ts_event", F.lit("l").alias("level"), F.lit(0.0).alias("depth"), F.lit(True).alias("reclaim"))
    outcomes = X.event_outcomes(b, (1,))
    (r,) = X.event_study_null(events, b, outcomes, reps=5).collect()
    o = {x.ts_event: x for x in outcomes.collect()}
    own = [o[x.ts_event] for x in events.collect() if x.ts_event in o]
    assert r.n == len(own) and r.mean_ret == pytest.approx(np.mean([x.r for x in own])) and r.target_first_rate == pytest.approx(np.mean([x.target_first for x in own]))
    assert 250 <= r.null_n <= 300 and r.excess > 0.0015 and r.bounce_rate > r.null_bounce_rate
