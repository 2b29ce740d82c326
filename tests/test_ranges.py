"""The range filter, state by state, and the same decisions for any partitioning."""

from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from orderloom.operators import ranges as N


def bar(signal=0, confidence=0.9, regime="Ranging", price=100.0, **over):
    usual = {"reversal_score": 0.0, "reversal_side": 0, "near_bottom": False, "near_top": False, "in_middle": False, "broke_out": False, "smooth_atr": 1.0, "range_place": 0.5}
    return SimpleNamespace(signal=signal, confidence=confidence, regime=regime, price=price, **(usual | over))


def reasons(state, bars):
    return [state.step(b)[2] for b in bars]


def test_a_range_needs_confirmations_then_locks_and_closes():
    s = N.RangeFilter()
    low = {"near_bottom": True}
    assert reasons(s, [bar(1, **low), bar(0, **low), bar(1, **low)]) == ["gathering", "gathering", "gathering"]
    assert s.confirmed() == 2
    assert s.step(bar(1, **low)) == ("ENTER", 1, "range") and s.confirmed() == 0
    assert reasons(s, [bar(1, **low), bar(-1)]) == ["locked", "locked"]
    assert s.step(bar(0, reversal_score=2.0)) == ("CLOSE", 0, "reversal")
    assert reasons(s, [bar(1, **low), bar(1, **low)]) == ["gathering", "gathering"]  # four bars after the entry the pause is over


def test_a_lock_ends_by_itself():
    s = N.RangeFilter(confirmations=1)
    assert s.step(bar(-1, near_top=True))[0] == "ENTER"
    assert reasons(s, [bar()] * 7) == ["locked"] * 7
    assert s.step(bar(-1, near_top=True)) == ("ENTER", -1, "range")


def test_what_does_not_count_in_a_range():
    s = N.RangeFilter(confirmations=2)
    assert s.step(bar(1, confidence=0.5))[2] == "low_confidence"
    assert s.step(bar(1, in_middle=True))[2] == "middle"
    assert s.step(bar(-1, near_bottom=True))[2] == "against_boundary"
    assert s.step(bar(1, near_bottom=True))[2] == "gathering" and s.confirmed() == 1
    assert s.step(bar(1, in_middle=True))[2] == "middle" and s.confirmed() == 0
    assert s.step(bar(0, confidence=0.1))[2] == "gathering"  # no signal needs no confidence
    for _ in range(8):
        s.step(bar(0))
    assert s.confirmed() == 0


def test_pause_after_an_entry():
    s = N.RangeFilter(confirmations=1, lock=1)
    assert s.step(bar(1, near_bottom=True))[0] == "ENTER"
    assert reasons(s, [bar(1, near_bottom=True)] * 3) == ["pause"] * 3
    assert s.step(bar(1, near_bottom=True))[0] == "ENTER"


def test_trends():
    s = N.RangeFilter()
    t = {"regime": "Trending"}
    assert reasons(s, [bar(0, **t), bar(1, **t)]) == ["no_signal", "gathering"]
    assert s.step(bar(1, reversal_score=2.0, reversal_side=-1, **t))[2] == "trend_reversal" and s.confirmed() == 0
    assert s.step(bar(1, **t))[2] == "gathering"
    assert s.step(bar(1, price=50.0, **t)) == ("ENTER", 1, "trend")
    for _ in range(7):
        assert s.step(bar(0, **t))[2] == "locked"
    assert s.step(bar(1, price=51.0, **t))[2] == "same_place"
    assert s.step(bar(-1, confidence=0.8, reversal_score=1.0, range_place=0.9, **t)) == ("ENTER", -1, "trend_early")
    s = N.RangeFilter()
    assert s.step(bar(-1, confidence=0.8, reversal_score=1.0, range_place=0.5, **t))[2] == "gathering"


def test_market_without_a_known_regime():
    s = N.RangeFilter()
    s.step(bar(1, regime="", near_bottom=True))
    assert s.market == N.RANGE and s.confirmed() == 1
    s.step(bar(0, regime="", broke_out=True))
    assert s.market == N.TREND and s.confirmed() == 0
    s.step(bar(0, regime="", broke_out=True))
    assert s.market == N.TREND


def test_the_same_for_any_partitioning(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=i), float(100 + rnd.normal()), float(rnd.normal()), float(rnd.uniform(-1, 1)), float(rnd.uniform(0.5, 2)), 0.0) for s in "AB" for i in range(150)]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp_ntz, close double, cvd_delta double, ofi double, intensity double, atr double")
    run = lambda d: sorted(map(tuple, N.range_state_filter(d, F.signum("ofi"), 0.6 + F.abs("ofi") / 3, F.lit(None)).select("symbol", "ts_event", "action", "direction", "reason", "market", "confirmations").collect()))
    whole = run(df)
    assert whole == run(df.repartition(7)) and len(whole) == 300 and {"ENTER", "HOLD"} <= {r[2] for r in whole}
    cut = run(df.where("ts_event < timestamp_ntz '2024-01-04'"))
    assert cut == [r for r in whole if r[1] < datetime(2024, 1, 4)]
