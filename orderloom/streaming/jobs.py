"""Structured Streaming forms of the bar, gate, monitoring and risk operators.

Every job takes a streaming (or batch) DataFrame of ticks or bars and gives a DataFrame; starting the query is the
caller's part. `replay` runs a job over files with available-now triggers into a table, for tests and back-fills.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orderloom.spec import KEY, TS, is_trade, signed_size


def zoned(df: DataFrame) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return df.withColumn(TS, F.col(TS).cast("timestamp"))


def streaming_bars(ticks: DataFrame, freq: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars as ticks arrive; a bar comes out once the watermark has passed its end."""
    order = F.struct(TS, "seq")
    w = zoned(ticks).withWatermark(TS, late).where(is_trade()).groupBy(KEY, F.window(TS, freq).alias("w"))
    return w.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.sum(signed_size()).alias("cvd_delta")).select(KEY, F.col("w.start").alias(TS), "open", "high", "low", "close", "volume", "cvd_delta")


def late_and_duplicate_ticks(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (symbol, seq) once within the watermark; later ones are dropped by it."""
    return zoned(ticks).withWatermark(TS, late).dropDuplicatesWithinWatermark([KEY, "seq"])


def drift_monitor(ticks: DataFrame, baseline: DataFrame, freq: str = "6 hours", slide: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    """Mean trade size of sliding windows against a fixed baseline (symbol, base_mean, base_std)."""
    w = zoned(ticks).withWatermark(TS, late).where(is_trade()).groupBy(KEY, F.window(TS, freq, slide).alias("w")).agg(F.avg("size").alias("mean_size"))
    return w.join(baseline, KEY).select(KEY, F.col("w.start").alias(TS), "mean_size", (F.abs(F.col("mean_size") - F.col("base_mean")) / F.greatest("base_std", F.lit(1e-9))).alias("drift"))


def session_windows(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of a symbol, split by silence."""
    w = zoned(ticks).withWatermark(TS, late).groupBy(KEY, F.session_window(TS, gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n_ticks"), F.sum("size").alias("size")).select(KEY, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_ticks", "size")


GATE = f"{KEY} string, {TS} timestamp, volume double, activity_event int"


def activity_gate(bars: DataFrame, factor: float = 2.0, window: int = 20) -> DataFrame:
    """The volume gate bar by bar, with the last `window` volumes of each symbol as its bounded state. Bars come in order."""

    def run(key: tuple, parts, state: GroupState):
        past = list(state.get[0]) if state.exists else []
        for pdf in parts:
            pdf = pdf.sort_values(TS)
            flags = []
            for v in pdf["volume"]:
                flags.append(int(bool(past) and v > factor * (sum(past) / len(past))))
                past = [*past, float(v)][-window:]
            yield pd.DataFrame({KEY: key[0], TS: pdf[TS], "volume": pdf["volume"], "activity_event": flags})
        state.update((past,))

    return zoned(bars).select(KEY, TS, "volume").groupBy(KEY).applyInPandasWithState(run, GATE, "past array<double>", "append", GroupStateTimeout.NoTimeout)


FLOW = f"{KEY} string, {TS} timestamp, seq bigint, session_cvd double, session_vwap double"


def stateful_flow(ticks: DataFrame) -> DataFrame:
    """Running flow and volume-weighted price of each trade, reset each day; the state is four numbers a symbol."""

    def run(key: tuple, parts, state: GroupState):
        day, cvd, pv, v = state.get if state.exists else ("", 0.0, 0.0, 0.0)
        for pdf in parts:
            pdf = pdf.sort_values([TS, "seq"])
            rows = []
            for t, s, price, size, signed in zip(pdf[TS], pdf["seq"], pdf["price"], pdf["size"], pdf["signed"], strict=True):
                if (d := str(t.date())) != day:
                    day, cvd, pv, v = d, 0.0, 0.0, 0.0
                cvd, pv, v = cvd + signed, pv + price * size, v + size
                rows.append((key[0], t, s, cvd, pv / v))
            yield pd.DataFrame(rows, columns=[KEY, TS, "seq", "session_cvd", "session_vwap"])
        state.update((day, cvd, pv, v))

    t = zoned(ticks).where(is_trade()).select(KEY, TS, "seq", "price", "size", signed_size().alias("signed"))
    return t.groupBy(KEY).applyInPandasWithState(run, FLOW, "day string, cvd double, pv double, v double", "append", GroupStateTimeout.NoTimeout)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLE = "spark.sql.shuffle.partitions"
#: Parts of the state at most in a replay: each is a store of its own in an executor's memory, and a Python worker in each micro-batch, with rows or without.
STATE_PARTS = 16


def replay(batches: list[DataFrame], job, work: str, rocksdb: bool = False) -> DataFrame:
    """Runs job over batches that arrive one after the other, and gives its output as a table.

    Each batch is appended to the source folder and taken by a run with the same checkpoint, so state and watermark go
    through stops and restarts as they would in production. work: a folder that executors share. rocksdb: keep state in that
    store, which the jobs of `stateful` need, in STATE_PARTS parts at most, as symbols are few.
    """
    spark, name = batches[0].sparkSession, uuid.uuid4().hex
    source, out = f"{work}/{name}-in", f"{work}/{name}-out"
    set_here = {STORE: ROCKSDB, SHUFFLE: str(min(STATE_PARTS, int(spark.conf.get(SHUFFLE))))} if rocksdb else {}
    before = {k: spark.conf.get(k, None) for k in set_here}
    for k, v in set_here.items():
        spark.conf.set(k, v)
    try:
        _runs(batches, job, source, out, f"{work}/{name}-checkpoint")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(out)


def _runs(batches: list[DataFrame], job, source: str, out: str, checkpoint: str) -> None:
    spark = batches[0].sparkSession
    for batch in batches:
        batch.write.mode("append").parquet(source)
        stream = job(spark.readStream.schema(batches[0].schema).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
