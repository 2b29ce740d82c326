"""Figures of a bar from its twelve slices of time: first by (symbol, bar, slice), then over a dense array of the bar's slices, empty ones being 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.spec import KEY, TS, bucket

EPS = 1e-9


def slice_of(minutes: int, slices: int) -> Column:
    """The slice of a row whose bar begins at _b."""
    us = F.unix_micros(F.col(TS).cast("timestamp")) - F.unix_micros(F.col("_b").cast("timestamp"))
    return F.least(F.floor(us * slices / (minutes * 60_000_000)), F.lit(slices - 1)).cast("int")


def dense(rows: DataFrame, columns: list[str], slices: int) -> DataFrame:
    """symbol, time and for each column the array of its values by slice, 0 where there is none."""
    packed = rows.groupBy(KEY, F.col("_b").alias(TS)).agg(F.collect_list(F.struct("_s", *columns)).alias("_x"))  # `slices` rows at most
    value = lambda c: F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.coalesce(F.get(F.filter("_x", lambda x: x["_s"] == i), F.lit(0))[c].cast("double"), F.lit(0.0)))
    return packed.select(KEY, TS, *[value(c).alias(c) for c in columns])


def total(a: str | Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: str | Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: str) -> Column:
    """Population deviation, from differences to the mean."""
    return F.sqrt(total(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))) / F.size(a))


def spread_share(a: str) -> Column:
    """Deviation over the size of the mean, 0 for a mean of nothing."""
    m = F.abs(mean(a))
    return F.when(m < 1e-12, 0.0).otherwise(deviation(a) / (m + 1e-12))


def agreement(a: str) -> Column:
    """Of the values that are not 0 the share with the sign of most (the positive one on a tie)."""
    some = F.filter(F.transform(a, F.signum), lambda x: x != 0)
    side = F.when(total(some) < 0, -1.0).otherwise(1.0)
    return F.when(F.size(some) > 0, F.size(F.filter(some, lambda x: x == side)) / F.size(some)).otherwise(0.0)


def intrabar_tick_slices(ticks: DataFrame, minutes: int = 60, slices: int = 12) -> DataFrame:
    """Eleven figures of a bar. ticks: symbol, time, seq, size, signed (size with its side's sign), and the tick features spoof, cancel and absorption.

    spoof_peak, spoof_burst (the peak is twice the mean or more), cancel_burst; absorption_spread (deviation by mean), absorption_peak, and
    pressure_phase: -1, 0 or 1 for the third of the bar with the largest mean absorption, 0 if thirds are alike; flow_velocity (largest
    move of the running flow within a slice, by second), flow_agreement of signs, flow_early_late; imbalance_peak; size_spread.
    """
    t = ticks.withColumn("_b", bucket(f"{minutes} minutes")).withColumn("_s", slice_of(minutes, slices))
    first = F.min_by("signed", F.struct(TS, "seq"))
    s = t.groupBy(KEY, "_b", "_s").agg(
        F.max("spoof").alias("spoof"), F.max("cancel").alias("cancel"), F.avg("absorption").alias("absorption"), F.max(F.abs(F.signum("signed"))).alias("imbalance"), (F.sum("signed") - first).alias("flow"), F.avg("size").alias("size")
    )
    d = dense(s, ["spoof", "cancel", "absorption", "imbalance", "flow", "size"], slices)
    third = slices // 3
    part = lambda c, i: F.slice(c, i * third + 1, third)
    means = [F.round(mean(part("absorption", i)), 9) for i in range(3)]
    alike = (F.abs(means[1] - means[0]) <= 1e-6 + 1e-5 * F.abs(means[0])) & (F.abs(means[2] - means[0]) <= 1e-6 + 1e-5 * F.abs(means[0]))
    phase = F.when(alike, 0).when((means[0] >= means[1]) & (means[0] >= means[2]), -1).when(means[1] >= means[2], 0).otherwise(1)
    peak, early, late = F.array_max("spoof"), total(part("flow", 0)), total(F.slice("flow", slices - third + 1, third))
    return d.select(
        KEY, TS, peak.alias("spoof_peak"), ((mean("spoof") > EPS) & (peak >= 2 * mean("spoof"))).cast("int").alias("spoof_burst"), F.array_max("cancel").alias("cancel_burst"),
        spread_share("absorption").alias("absorption_spread"), F.array_max("absorption").alias("absorption_peak"), phase.alias("pressure_phase"),
        (F.array_max(F.transform("flow", F.abs)) / (minutes * 60 / slices)).alias("flow_velocity"), agreement("flow").alias("flow_agreement"), ((early - late) / (F.abs(early) + F.abs(late) + EPS)).alias("flow_early_late"),
        F.array_max("imbalance").alias("imbalance_peak"), spread_share("size").alias("size_spread"),
    )


def intrabar_book_slices(book: DataFrame, minutes: int = 60, slices: int = 12) -> DataFrame:
    """Nineteen figures of a bar from its slices' largest spread and depths, mean imbalance and largest distance of the micro-price from the mid.

    imbalance_peak keeps its sign; imbalance_trend is the slope over the slices that have snapshots; depth_change is the last slice less
    the first by the mean; a depth shock is a peak of 1.5 times the mean or more. bid_slope and ask_slope are the mean slopes of depth by
    snapshot within slices, depth_accel the mean of what bids gained within a slice less what asks did.
    """
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    first = lambda c: F.get(c, F.lit(0))
    b = book.select(KEY, TS, "seq", size("bid_sz").alias("bd"), size("ask_sz").alias("ad"), first("bid_px").alias("bp"), first("ask_px").alias("ap"), first("bid_sz").alias("b1"), first("ask_sz").alias("a1"))
    b = b.withColumn("_b", bucket(f"{minutes} minutes")).withColumn("_s", slice_of(minutes, slices))
    mid = (F.col("ap") + F.col("bp")) / 2
    micro = F.when(F.col("b1") + F.col("a1") > 0, (F.col("ap") * F.col("b1") + F.col("bp") * F.col("a1")) / (F.col("b1") + F.col("a1"))).otherwise(mid)
    share = lambda one, all_: F.when(F.col(all_) > 0, F.col(one) / F.col(all_)).otherwise(0.0)
    b = b.withColumn("_i", F.row_number().over(Window.partitionBy(KEY, "_b", "_s").orderBy(TS, "seq")).cast("double"))
    at = F.struct(TS, "seq")
    gain = lambda c: F.max_by(c, at) - F.min_by(c, at)
    slope = lambda c: F.coalesce(F.regr_slope(c, "_i"), F.lit(0.0))
    s = b.groupBy(KEY, "_b", "_s").agg(
        F.max(F.greatest(F.col("ap") - F.col("bp"), F.lit(0.0))).alias("spread"), F.avg(F.when(F.col("bd") + F.col("ad") > 0, (F.col("bd") - F.col("ad")) / (F.col("bd") + F.col("ad"))).otherwise(0.0)).alias("imb"),
        F.max("bd").alias("bid"), F.max("ad").alias("ask"), F.max(F.abs(micro - mid)).alias("micro"), F.max(share("b1", "bd")).alias("bid_share"), F.max(share("a1", "ad")).alias("ask_share"),
        slope("bd").alias("bid_slope"), slope("ad").alias("ask_slope"), (gain("bd") - gain("ad")).alias("accel"), F.lit(1.0).alias("there"),
    )
    d = dense(s, ["spread", "imb", "bid", "ask", "micro", "bid_share", "ask_share", "bid_slope", "ask_slope", "accel", "there"], slices)
    d = d.withColumn("imb", F.transform("imb", lambda x: F.round(x, 9))).withColumn("depth", F.zip_with("bid", "ask", lambda x, y: x + y)).withColumn("_n", F.greatest(total("there"), F.lit(1.0)))
    far = F.array_max(F.transform("imb", F.abs))
    d = d.withColumn("_p", F.coalesce(F.get(F.filter("imb", lambda x: F.abs(x) == far), F.lit(0)), F.lit(0.0)))
    points = F.filter(F.transform("imb", lambda y, i: F.struct(i.cast("double").alias("x"), y.alias("y"), F.get("depth", i).alias("d"))), lambda p: p["d"] > 0)
    d = d.withColumn("_q", points)
    n = F.size("_q")
    sx, sy = total(F.transform("_q", lambda p: p["x"])), total(F.transform("_q", lambda p: p["y"]))
    sxy, sxx = total(F.transform("_q", lambda p: p["x"] * p["y"])), total(F.transform("_q", lambda p: p["x"] * p["x"]))
    ends, peak = F.get("depth", F.lit(slices - 1)) - F.get("depth", F.lit(0)), F.array_max("depth")
    m = mean("depth")
    return d.select(
        KEY, TS, F.array_max("spread").alias("spread_max"), mean("spread").alias("spread_mean"), deviation("spread").alias("spread_std"), F.array_max("bid").alias("bid_depth_max"), F.array_max("ask").alias("ask_depth_max"), peak.alias("depth_max"),
        F.col("_p").alias("imbalance_peak"), agreement("imb").alias("imbalance_agreement"), (F.size(F.filter("imb", lambda x: x > 0)) / slices).alias("imbalance_bid_share"),
        F.when(n >= 2, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(0.0).alias("imbalance_trend"), F.when(m > EPS, ends / m).otherwise(0.0).alias("depth_change"), F.array_max("micro").alias("microprice_distance"),
        F.array_max("bid_share").alias("bid_first_share"), F.array_max("ask_share").alias("ask_first_share"), ((m > EPS) & (peak >= 1.5 * m)).cast("int").alias("depth_shock"), F.greatest(F.when(m > EPS, peak / m).otherwise(0.0) - 1, F.lit(0.0)).alias("depth_shock_size"),
        (total("bid_slope") / F.col("_n")).alias("bid_slope"), (total("ask_slope") / F.col("_n")).alias("ask_slope"), (total("accel") / F.col("_n")).alias("depth_accel"),
    )
