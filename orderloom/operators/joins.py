"""As-of, range and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.clean import micros
from orderloom.spec import KEY, TS, ahead, bucket, by_time


def asof_backward_join(left: DataFrame, right: DataFrame, columns: list[str], tolerance_seconds: float | None = None, order: list[str] | None = None) -> DataFrame:
    """Each left row with the columns of the latest right row of its symbol at or before it; null beyond the tolerance. Right rows of
    one time go by `order`, columns of theirs.

    One shuffle of the union by (symbol, day) and a running last within the day; the last right row of the days before comes
    from a table of one row a day. No row pairs are made, and no task holds a symbol.
    """
    order = order or []
    rest = [c for c in left.columns if c not in (KEY, TS)]
    day, got = F.to_date(TS), F.struct(TS, *columns)
    a = left.select(KEY, TS, day.alias("_day"), F.lit(1).alias("_side"), F.struct(*rest).alias("_l"), F.lit(None).cast(right.select(got.alias("r")).schema["r"].dataType).alias("_r"))
    ties = [F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)]
    a = a.select("*", *ties)
    b = right.select(KEY, TS, day.alias("_day"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), got.alias("_r"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    w = Window.partitionBy(KEY, "_day").orderBy(TS, "_side", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    m = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    ends = right.groupBy(KEY, day.alias("_day")).agg(F.max_by(got, F.struct(TS, *order)).alias("_end"))
    days = left.select(KEY, day.alias("_day")).distinct().join(ends, [KEY, "_day"], "full_outer")
    before = Window.partitionBy(KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(KEY, "_day", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    m = m.join(carried, [KEY, "_day"], "left").withColumn("_m", F.coalesce("_m", "_carried"))
    old = micros() - micros(f"_m.{TS}") > F.lit((tolerance_seconds or 0) * 1e6)
    ok = ~old if tolerance_seconds is not None else F.lit(True)
    return m.select(KEY, TS, "_l.*", *[F.when(ok, F.col(f"_m.{c}")).alias(f"right_{c}") for c in [TS, *columns]])


def bar_range_join(ticks: DataFrame, bars: DataFrame, freq: str = "1 hour") -> DataFrame:
    """Ticks with the columns of the bar that holds them: an equi join on the bucket."""
    t = ticks.withColumnRenamed(TS, "tick_ts").withColumn(TS, bucket(freq, "tick_ts"))
    return t.join(bars, [KEY, TS])


def map_lookup_join(rows: DataFrame, freq: str = "1 day") -> DataFrame:
    """Each row with its day's high and low."""
    day = rows.groupBy(KEY, F.to_date(TS).alias("day")).agg(F.max("high").alias("day_high"), F.min("low").alias("day_low"))
    return rows.withColumn("day", F.to_date(TS)).join(day, [KEY, "day"], "left")


def bars_aligned_compare(a: DataFrame, b: DataFrame, price_tol: float, volume_tol: float) -> DataFrame:
    """Counts over the outer alignment of two bar tables: rows in one only, prices and volumes apart by more than the tolerance."""
    x = a.select(KEY, TS, F.col("close").alias("ca"), F.col("volume").alias("va"))
    y = b.select(KEY, TS, F.col("close").alias("cb"), F.col("volume").alias("vb"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return x.join(y, [KEY, TS], "full_outer").agg(n(F.col("cb").isNull()).alias("only_a"), n(F.col("ca").isNull()).alias("only_b"), n(F.abs(F.col("ca") - F.col("cb")) > price_tol).alias("price_apart"), n(F.abs(F.col("va") - F.col("vb")) > volume_tol).alias("volume_apart"))


def alignment_assert(a: DataFrame, b: DataFrame, where: str) -> None:
    """Raises if one table has a (symbol, time) that the other lacks."""
    for x, y in ((a, b), (b, a)):
        if not x.select(KEY, TS).join(y.select(KEY, TS), [KEY, TS], "left_anti").limit(1).isEmpty():
            raise ValueError(f"rows do not align: {where}")


def theta_barrier_join(bars: DataFrame, horizon: int, up: float) -> DataFrame:
    """hit_step: the first of the next `horizon` bars whose high is `up` above the close."""
    frame = F.collect_list("high").over(ahead(horizon))
    hit = F.array_position(F.transform(frame, lambda h: (h >= F.col("close") + up).cast("int")), 1)
    return bars.withColumn("hit_step", F.when(hit > 0, hit))


def embedding_attach(bars: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Left join of vectors by key, with a validity flag."""
    return bars.join(vectors.select(key, "embedding", F.lit(True).alias("_ok")), key, "left").withColumn("valid", F.coalesce("_ok", F.lit(False))).drop("_ok")


def null_sample_join(events: DataFrame, pool: DataFrame, session: str, reps: int, seed: int = 7) -> DataFrame:
    """For each event and repetition a bar of the same session, drawn by a hash of (seed, repetition, event).

    The pool's bars are numbered by session in order of time from counts of weeks, so no task holds a session.
    """
    from orderloom.operators.stats import in_time_order

    ranked = in_time_order(pool.select(session, KEY, TS), "_n", session)
    size = pool.groupBy(session).agg(F.count(F.lit(1)).alias("_size"))
    drawn = events.join(size, session).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    drawn = drawn.withColumn("_n", F.pmod(F.xxhash64(F.lit(seed), "rep", KEY, TS), F.col("_size")) + 1)
    other = ranked.select(session, "_n", F.col(KEY).alias("null_symbol"), F.col(TS).alias("null_ts"))
    return drawn.join(other, [session, "_n"]).drop("_n", "_size")


def next_bar(bars: DataFrame) -> DataFrame:
    return bars.withColumn("next_ts", F.lead(TS).over(by_time()))
