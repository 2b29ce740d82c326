"""Features of single trades, reset for each symbol and day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scan import Recurrence, scan
from orderloom.functions.stage import staged
from orderloom.operators.clean import micros
from orderloom.spec import KEY, TS, exact_mean, is_trade, signed_size

EPS = 1e-9

def order():
    return Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS, "seq")


def last(n: int, back: int = 0):
    return order().rowsBetween(-(n - 1) - back, -back)


def trades(ticks: DataFrame) -> DataFrame:
    return ticks.where(is_trade())


def with_median(df: DataFrame, value, window, out: str) -> DataFrame:
    """Adds the median of the window's values that are not null: a sort of them, as a percentile counts them anew in a map for each row."""
    x = df.withColumn("_o", F.sort_array(F.collect_list(value).over(window)))
    at = lambda k: F.get("_o", F.floor(k).cast("int")) * 0.5
    return x.withColumn(out, at((F.size("_o") - 1) / 2) + at(F.size("_o") / 2)).drop("_o")


def absorption_intensity(ticks: DataFrame, n: int = 50, floor: float = 0.01, window: int = 200, cap: float = 25.0) -> DataFrame:
    """Net flow of the last n trades over the price move they made, against its own trailing median."""
    t = trades(ticks).withColumn("_f", F.sum(signed_size()).over(last(n))).withColumn("_m", F.abs(F.col("price") - F.lag("price", n - 1).over(order())))
    t = t.withColumn("_r", F.abs("_f") / F.greatest("_m", F.lit(floor)))
    t = with_median(t, F.col("_r"), last(window), "_md")
    return t.withColumn("absorption", F.least(F.col("_r") / F.greatest("_md", F.lit(EPS)), F.lit(cap))).drop("_f", "_m", "_r", "_md")


def tape_speed(ticks: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Trades in the last seconds: of the day's trades so far those that are older do not count, so that a row costs the same however dense they are."""
    until = lambda us: F.count(F.lit(1)).over(Window.partitionBy(KEY, F.to_date(TS)).orderBy("_us").rangeBetween(Window.unboundedPreceding, us))
    return trades(ticks).withColumn("_us", micros()).withColumn("tape_speed", until(0) - until(-int(seconds * 1e6) - 1)).drop("_us")


def tape_speed_minutes(ticks: DataFrame) -> DataFrame:
    return tape_speed(ticks, 600)


def micro_range_burst_gap(ticks: DataFrame) -> DataFrame:
    t = trades(ticks).withColumn("_m", F.abs(F.col("price") - F.lag("price").over(order()))).withColumn("_g", micros() - F.lag(micros()).over(order()))
    gap = F.sum("_g").over(last(50)) / (F.count("_g").over(last(50)) * 1000.0)
    burst = F.col("size") / F.greatest(F.avg("size").over(last(500, 1)), F.lit(EPS))
    return t.withColumn("micro_range", exact_mean(F.col("_m"), last(100))).withColumn("burst", burst).withColumn("trade_gap_ms", gap).drop("_m", "_g")


def net_signed_volume(ticks: DataFrame, n: int = 100, large: float = 2.0) -> DataFrame:
    """Signed share of volume; sizes over `large` times the mean weigh double."""
    t = trades(ticks).withColumn("_k", F.when(F.col("size") > large * F.avg("size").over(last(n)), 2.0).otherwise(1.0))
    return t.withColumn("net_signed", F.sum(signed_size() * F.col("_k")).over(last(n)) / F.greatest(F.sum(F.col("size") * F.col("_k")).over(last(n)), F.lit(EPS))).drop("_k")


def session_vwap_z(ticks: DataFrame, n: int = 500) -> DataFrame:
    """Distance from the session's VWAP in deviations of its last n values, and the VWAP's move over 20 trades; running sums, so that a row costs the same for any n."""
    run = order().rowsBetween(Window.unboundedPreceding, 0)
    t = trades(ticks).withColumn("session_vwap", F.sum(F.col("price") * F.col("size")).over(run) / F.sum("size").over(run))
    t = t.withColumn("_d", F.col("price") - F.col("session_vwap"))
    t = t.withColumns({"_s": F.sum("_d").over(run), "_q": F.sum(F.col("_d") * F.col("_d")).over(run), "_n": F.count("_d").over(run)})
    before = lambda c: F.coalesce(F.lag(c, n).over(order()), F.lit(0))
    t = t.withColumns({"_s": F.col("_s") - before("_s"), "_q": F.col("_q") - before("_q"), "_n": F.col("_n") - before("_n")})
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), 2), F.lit(0.0)))
    slope = F.coalesce(F.col("session_vwap") - F.lag("session_vwap", 19).over(order()), F.lit(0.0))
    return t.withColumn("vwap_z", F.round(F.when(sd > 1e-6, F.col("_d") / sd).otherwise(0.0), 4)).withColumn("vwap_slope", slope).drop("_d", "_s", "_q", "_n")


def liquidity_sweep(ticks: DataFrame, n: int = 300, share: float = 0.8, least: int = 50, threshold: float = 0.05) -> DataFrame:
    """Score of a stop run over the last n prices: the newest fifth passes the extreme of the ones before and the price is back
    inside. Five times the overshoot over the earlier range (or two deviations), 1 at most, positive above and negative below.

    A row sees n prices of its symbol and day at most.
    """
    w = last(n)
    t = trades(ticks).withColumns({"_w": F.collect_list("price").over(w), "_sd": F.stddev_pop("price").over(w)})
    t = t.withColumn("_k", F.floor(F.size("_w") * share).cast("int"))
    t = t.withColumns({"_a": F.slice("_w", 1, F.col("_k")), "_b": F.slice("_w", F.col("_k") + 1, F.size("_w") - F.col("_k"))})
    # columns, not expressions: each is used several times and would be worked out as often
    t = t.withColumns({"_t": F.array_max("_a"), "_l": F.array_min("_a"), "_nt": F.array_max("_b"), "_nl": F.array_min("_b"), "_z": F.size("_w")})
    t = t.drop("_w", "_k", "_a", "_b").withColumn("_h", F.greatest(F.col("_t") - F.col("_l"), 2 * F.col("_sd"), F.lit(1e-8)))
    t = t.withColumns({"_up": (F.col("_nt") - F.col("_t")) / F.col("_h"), "_dn": (F.col("_l") - F.col("_nl")) / F.col("_h")})
    top, low, up, down = F.col("_t"), F.col("_l"), F.col("_up"), F.col("_dn")
    over, under = (F.col("price") < top) & (up > threshold), (F.col("price") > low) & (down > threshold)
    score = F.when(over, F.least(5 * up, F.lit(1.0))).when(under, -F.least(5 * down, F.lit(1.0))).otherwise(0.0)
    return t.withColumn("sweep", F.round(F.when(F.col("_z") >= least, score).otherwise(0.0), 4)).drop("_sd", "_t", "_l", "_nt", "_nl", "_z", "_h", "_up", "_dn")


def impact_steps(ticks: DataFrame, n: int = 30, rise: float = 0.18, decay: float = 0.05) -> tuple[DataFrame, Recurrence]:
    """The trades with _m and _z, and the recurrence of `impact` over them."""
    t = trades(ticks).withColumn("_x", F.abs(F.col("price") - F.lag("price").over(order())) / F.greatest("size", F.lit(EPS)))
    t = with_median(t, F.when(F.col("_x") > 0, F.col("_x")), last(n), "_m").withColumn("_m", F.coalesce("_m", F.lit(0.0))).drop("_x")
    share = F.when(F.col("_m") > 0, rise).otherwise(decay)
    smoothed = Recurrence(["impact"], [[F.when(F.col("_z"), 0.0).otherwise(1 - share)]], [share * F.col("_m")], [0.0])
    return t.withColumn("_z", F.row_number().over(order()) == 1), smoothed


def intensity_steps(ticks: DataFrame, beta: float = 0.05, jump: float = 0.175) -> tuple[DataFrame, Recurrence]:
    """The trades with _g, and the recurrence of `intensity` over them."""
    t = trades(ticks).withColumn("_g", F.lag(micros()).over(order()))
    left = F.when(F.col("_g").isNull(), 0.0).otherwise(F.exp(-beta * F.greatest(micros() - F.col("_g"), F.lit(0)) / 60e6))
    return t, Recurrence(["intensity"], [[left]], [F.lit(jump)], [0.0])


def price_impact_lambda(ticks: DataFrame, n: int = 30, rise: float = 0.18, decay: float = 0.05) -> DataFrame:
    """Trailing median of positive |price change| / size, smoothed; the smoothing slows while there is no impact."""
    t, smoothed = impact_steps(ticks, n, rise, decay)
    return scan(t, [smoothed], 86400, ("seq",)).drop("_m", "_z")


def self_exciting_intensity(ticks: DataFrame, beta: float = 0.05, jump: float = 0.175) -> DataFrame:
    """A sum that decays with the time between trades and jumps at each."""
    t, decaying = intensity_steps(ticks, beta, jump)
    return scan(t, [decaying], 86400, ("seq",)).drop("_g")


def impact_and_intensity(ticks: DataFrame) -> DataFrame:
    """Both in one scan, over a written table: its passes over the rows do not work out the windows before it again."""
    t, smoothed = impact_steps(ticks)
    t, decaying = intensity_steps(t)
    return scan(staged(t, "trades"), [smoothed, decaying], 86400, ("seq",)).drop("_m", "_z", "_g")
