"""Tick features with a memory of the day: event intensity, flow momentum, turning points, liquidity traps, and when a score fires."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scan import Recurrence, scan
from orderloom.spec import CANCEL_ACTIONS, KEY, TS, bucket, is_trade, signed_size

DAY = 86400


def day_order():
    return Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS, "seq")


def last(n: int):
    return day_order().rowsBetween(-(n - 1), 0)


def micros() -> Column:
    return F.unix_micros(F.col(TS).cast("timestamp"))


def event_intensity(ticks: DataFrame, beta: float = 1.0, book_jump: float = 0.5, trade_jump: float = 0.175, baseline: float = 0.1, window: int = 100, least: int = 10) -> DataFrame:
    """Adds event_intensity: the baseline and a sum that decays by the second and jumps with each add, cancel and trade after the day's
    first row, over its mean of the last `window` such rows once there are `least`.
    """
    w = day_order()
    before = F.lag(micros()).over(w)
    jump = F.when(F.upper("action").isin("A", "ADD") | F.upper("action").isin(*CANCEL_ACTIONS), book_jump).when(is_trade(), trade_jump).otherwise(0.0)
    t = ticks.withColumn("_g", before).withColumn("_a", F.when(F.col("_g").isNull(), 0.0).otherwise(F.exp(-beta * F.greatest(micros() - F.col("_g"), F.lit(0)) / 1e6)))
    t = t.withColumn("_b", F.when(F.col("_g").isNull(), 0.0).otherwise(jump))
    t = scan(t, [Recurrence(["_y"], [[F.col("_a")]], [F.col("_b")], [0.0])], DAY, ("seq",))
    t = t.withColumn("_v", F.when(F.col("_g").isNotNull(), F.col("_y") + baseline))
    mean, n = F.avg("_v").over(last(window)), F.count("_v").over(last(window))
    return t.withColumn("event_intensity", F.when(F.col("_v").isNull(), baseline).when((n >= least) & (mean > 0), F.col("_v") / mean).otherwise(F.col("_v"))).drop("_g", "_a", "_b", "_y", "_v")


def momentum_divergence(ticks: DataFrame, momentum: int = 100, swing: int = 200, least: int = 20) -> DataFrame:
    """Adds flow_momentum, divergence, trend_strength, correction_depth of each trade from the day's running flow and its prices.

    flow_momentum: change of the flow over the first window by the larger of both ends (1 at least). divergence: 1 if the halves of the second
    window move alike in price and flow, -1 if not, 0 while the price's halves are level. trend_strength: net move by range of
    the first window; correction_depth: how far the price is from the extreme of the second one that its move points to, by range.
    """
    run = day_order().rowsBetween(Window.unboundedPreceding, 0)
    t = ticks.where(is_trade()).withColumn("_c", F.sum(signed_size()).over(run))
    past, n = F.lag("_c", momentum - 1).over(day_order()), F.count(F.lit(1)).over(last(swing))
    t = t.withColumn("flow_momentum", F.round(F.coalesce((F.col("_c") - past) / F.greatest(F.abs("_c"), F.abs(past), F.lit(1.0)), F.lit(0.0)), 4))
    half = swing // 2
    new, old = day_order().rowsBetween(-(half - 1), 0), day_order().rowsBetween(-(swing - 1), -half)
    side = lambda c: F.signum(F.round(F.avg(c).over(new) - F.avg(c).over(old), 9))
    t = t.withColumn("_n", n).withColumn("_p", side("price")).withColumn("_s", side("_c"))
    t = t.withColumn("divergence", F.when((F.col("_n") < swing) | (F.col("_p") == 0), 0.0).when(F.col("_p") == F.col("_s"), 1.0).otherwise(-1.0))
    spread = lambda m: F.max("price").over(last(m)) - F.min("price").over(last(m))
    t = t.withColumns({"_r": spread(momentum), "_f": F.first("price").over(last(momentum)), "_r2": spread(swing), "_f2": F.first("price").over(last(swing)), "_h": F.max("price").over(last(swing)), "_l": F.min("price").over(last(swing))})
    ready = F.col("_n") >= least
    t = t.withColumn("trend_strength", F.when(ready & (F.col("_r") > 0), F.round(F.least(F.abs(F.col("price") - F.col("_f")) / F.col("_r"), F.lit(1.0)), 4)).otherwise(0.0))
    depth = F.when(F.col("price") > F.col("_f2"), F.col("_h") - F.col("price")).otherwise(F.col("price") - F.col("_l")) / F.col("_r2")
    return t.withColumn("correction_depth", F.when(ready & (F.col("_r2") > 0), F.round(depth, 4)).otherwise(0.0)).drop("_c", "_n", "_p", "_s", "_r", "_f", "_r2", "_f2", "_h", "_l")


def by_day(rows: DataFrame, columns: list[str], out: str, step) -> DataFrame:
    """symbol, time, seq and the columns of out: step goes over a symbol's day, a bounded group, in order and gives a row for each."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([TS, "seq"], ignore_index=True)
        made = pd.DataFrame(step(*(pdf[c].tolist() for c in columns)), columns=[x.split()[0] for x in out.split(", ")])
        return pdf[[KEY, TS, "seq"]].join(made)

    return rows.select(KEY, TS, "seq", F.to_date(TS).alias("_day"), *columns).groupBy(KEY, "_day").applyInPandas(run, f"{KEY} string, {TS} timestamp_ntz, seq bigint, {out}")


def fisher_turns(ticks: DataFrame, lookback: int = 10, smoothing: int = 9, threshold: float = 0.3) -> DataFrame:
    """symbol, time, seq, fisher, trigger, turn of each trade: Fisher transform of the smoothed place of the price in its trailing range, its
    exponential mean, and 1 or -1 where it crosses that out of an extreme, if the trade's flow agrees or the step is large.

    The clamp inside makes it sequential; a symbol's day is one group. Null and 0 before `lookback` trades.
    """
    high, low = F.max("price").over(last(lookback)), F.min("price").over(last(lookback))
    x = F.when(F.count("price").over(last(lookback)) >= lookback, 2 * (F.col("price") - low) / F.when(high > low, high - low).otherwise(0.0001) - 1)
    alpha = 2 / (smoothing + 1)

    def step(places: list, flows: list):
        v = f = 0.0
        mean = None
        for place, flow in zip(places, flows, strict=True):
            if place is None or place != place:
                yield None, None, 0
                continue
            v = min(max(0.5 * place + 0.5 * v, -0.999), 0.999)
            now = 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * f
            trigger = now if mean is None else alpha * now + (1 - alpha) * mean
            turn = 0
            if mean is not None:
                was, is_ = f > mean, now > trigger
                if is_ and not was and f < -threshold and (flow >= 0 or now - f >= threshold):
                    turn = 1
                elif was and not is_ and f > threshold and (flow <= 0 or f - now >= threshold):
                    turn = -1
            f, mean = now, trigger
            yield now, trigger, turn

    t = ticks.where(is_trade()).withColumn("_x", x).withColumn("_g", signed_size())
    return by_day(t, ["_x", "_g"], "fisher double, trigger double, turn int", step)


def liquidity_trap(book: DataFrame, move: float = 0.1, window: int = 100) -> DataFrame:
    """symbol, time, seq, trap, trap_mean: where the price has moved past a threshold from its reference (which then moves), the imbalance of the snapshot
    before against the move, else null; and the mean of the last `window` of these, 0 before the first. The reference is state of a symbol's day.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = total("bid_sz") + total("ask_sz")

    def step(prices: list, imbalances: list):
        ref, before, held = None, 0.0, deque(maxlen=window)
        for price, now in zip(prices, imbalances, strict=True):
            ref = price if ref is None else ref
            hit = round(abs(price - ref), 9) >= move
            if hit:
                held.append(-before if price > ref else before)
                ref = price
            before = now
            yield held[-1] if hit else None, sum(held) / len(held) if held else 0.0

    return by_day(book.withColumn("_i", (total("bid_sz") - total("ask_sz")) / F.greatest(both, F.lit(1e-9))), ["price", "_i"], "trap double, trap_mean double", step)


def firing_structure(rows: DataFrame, score: str, thresholds: list[float], session: str = "session", freq: str = "1 hour", longest_gap: float = 3600.0) -> DataFrame:
    """threshold, session, hour (each null in the rows of the other, both in the overall row), n, fire_rate, gap_cv2, bar_share.

    gap_cv2: squared deviation by mean of the seconds between a symbol's firings, those over `longest_gap` left out, by where the later one
    stands; bar_share: of the bars with rows those with a firing. Thresholds, a few, are exploded on each row.
    """
    r = rows.select(KEY, TS, "seq", F.col(session).alias("session"), F.hour(TS).alias("hour"), bucket(freq).alias("_b"), F.abs(score).alias("_s"), F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    r = r.withColumn("_f", F.col("_s") >= F.col("threshold"))
    w = Window.partitionBy(KEY, F.to_date(TS), "threshold").orderBy(TS, "seq").rowsBetween(Window.unboundedPreceding, -1)
    gap = (micros() - F.last(F.when(F.col("_f"), micros()), ignorenulls=True).over(w)) / 1e6
    r = r.withColumn("_g", F.when(F.col("_f") & (gap <= longest_gap), gap))
    bar = r.groupBy("threshold", KEY, "_b", "session", "hour").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_f").cast("bigint")).alias("_k"), F.count("_g").alias("_gn"), F.sum("_g").alias("_gs"), F.sum(F.col("_g") * F.col("_g")).alias("_gq")
    )
    n, s, q = F.sum("_gn"), F.sum("_gs"), F.sum("_gq")
    sets = [[F.col("threshold")], [F.col("threshold"), F.col("session")], [F.col("threshold"), F.col("hour")]]
    return bar.groupingSets(sets, "threshold", "session", "hour").agg(
        F.sum("_n").alias("n"), (F.sum("_k") / F.sum("_n")).alias("fire_rate"), F.when(n > 1, F.greatest(q / n / ((s / n) * (s / n)) - 1, F.lit(0.0))).alias("gap_cv2"), F.avg((F.col("_k") > 0).cast("double")).alias("bar_share")
    )


def tick_feature_job(ticks: DataFrame, momentum: int = 100, swing: int = 200, least: int = 20) -> DataFrame:
    """All features of trades on one frame: each operator adds its columns, so their windows share one partitioning by symbol and day.

    The recurrences come first: the windows stand behind their scan, not before each of its passes.
    """
    from orderloom.operators import ticks as X

    steps = (X.impact_and_intensity, X.absorption_intensity, X.tape_speed_minutes, X.micro_range_burst_gap, X.net_signed_volume, X.session_vwap_z, X.liquidity_sweep, lambda t: momentum_divergence(t, momentum, swing, least))
    out = ticks
    for step in steps:
        out = step(out)
    return out
