"""Parts of a replay: their cuts, the packed rows of the tracked trades, and the parts of the state."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from orderloom.plans import state
from orderloom.streaming import jobs, stateful


def times(spark, values):
    return spark.createDataFrame([(v,) for v in values], "u long").select(F.timestamp_micros("u").cast("timestamp_ntz").alias("ts_event"))


def test_cuts_are_percentiles_that_no_task_holds_the_times_for(spark, monkeypatch):
    rnd = random.Random(5)
    month = [rnd.randrange(30 * 86_400_000_000) + 1_704_067_200_000_000 for _ in range(3000)]
    us = F.unix_micros(F.col("ts_event").cast("timestamp"))
    cases = []
    for values in (month, month[:2500] + month[:1] * 500 + [None], [5], [7] * 9, [7] * 9 + [8] * 3, [-5, 3, 10**15, 10**15 + 1, 10**15 + 3]):
        df = times(spark, values).cache()
        cases += [(df, n, values, df.agg(F.percentile(us, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("c")).first().c) for n in (2, 3, 7)]

    def held(*_):
        raise AssertionError("F.percentile keeps every distinct time in one task")

    monkeypatch.setattr(F, "percentile", held)
    for df, n, values, cuts in cases:
        want = np.bincount(np.searchsorted(cuts, [v for v in values if v is not None]), minlength=n).tolist()
        assert [p.count() for p in state.in_parts(df, n)] == want
    assert len(state.time_cuts(times(spark, []), 3)) == 2


def test_parts_by_rows_are_in_order_whole_and_even(spark, monkeypatch):
    rnd = random.Random(6)
    df = times(spark, [rnd.randrange(1000) ** 3 for _ in range(5000)] + [rnd.randrange(10**12) for _ in range(2500)])
    monkeypatch.setattr(state, "PART_ROWS", 1000)
    spans = [p.agg(F.count("*"), F.min("ts_event"), F.max("ts_event")).first() for p in state.parts_of(df)]
    assert len(spans) == 8 and sum(s[0] for s in spans) == 7500 and max(s[0] for s in spans) < 1300
    assert all(a[2] < b[1] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_packed_rows_come_back_in_order_of_time(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(500), i, rnd.choice([100.5, 99.25, None]), d, 0.5 * d, 0.25 * d) for i in range(3000) for d in (rnd.choice([0, 0, 1, -1]),)]
    rnd.shuffle(rows)
    columns = ["symbol", "us", "seq", "price", "direction", "target", "stop"]
    schema = pa.schema([("symbol", pa.string()), ("us", pa.int64()), ("seq", pa.int64()), ("price", pa.float64()), ("direction", pa.int32()), ("target", pa.float64()), ("stop", pa.float64())])
    batches = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema).to_batches(700)
    found = pa.Table.from_batches(list(stateful.packed(iter(batches)))).to_pandas()
    assert len(found) == 15  # a row a symbol and batch
    whole = pd.DataFrame(rows, columns=columns)
    for symbol in ("a", "b", None):
        mine = lambda x, s=symbol: x[x["symbol"].isna() if s is None else x["symbol"] == s]
        got = stateful.unpacked(iter([part for _, part in mine(found).groupby(mine(found).index)]), 20)
        want = mine(whole).drop(columns="symbol").sort_values(["us", "seq"]).query("us > 20").reset_index(drop=True)
        pd.testing.assert_frame_equal(got[columns[1:]], want, check_dtype=False)


def test_state_of_a_replay_has_few_parts(spark, tmp_path):
    rows = [(f"S{i % 3}", i * 60_000_000 + 10**15, i, 100 + (i * 7 % 13) / 50, i % 2) for i in range(600)]
    book = spark.createDataFrame(rows, "symbol string, u long, seq long, price double, d int").select("symbol", F.timestamp_micros("u").alias("ts_event"), "seq", "price", "d")
    book = book.withColumns({s: F.array(*[F.lit(float(i)) for i in range(10)]) for s in ("bid_sz", "ask_sz")})
    before = spark.conf.get(jobs.SHUFFLE)
    spark.conf.set(jobs.SHUFFLE, "40")
    try:
        out = jobs.replay(state.in_parts(book, 2), lambda b: stateful.tracked_trades(b, F.col("d")), f"file://{tmp_path}", rocksdb=True)
        assert spark.conf.get(jobs.SHUFFLE) == "40"
    finally:
        spark.conf.set(jobs.SHUFFLE, before)
    assert out.count() > 200
    assert len(list(tmp_path.glob("*-checkpoint/state/0/[0-9]*"))) == jobs.STATE_PARTS
