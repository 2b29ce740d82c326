"""Market structure: swings and what follows from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.stats import percentiles
from orderloom.spec import KEY, TS, by_time

SWINGS = f"{KEY} string, bar_ts timestamp_ntz, confirmed_at timestamp_ntz, price double, is_high boolean"


def zigzag_swings(bars: DataFrame, factor: float = 2.0) -> DataFrame:
    """Alternating extremes, each confirmed once the price has come back by `factor` ATR.

    A state machine over a symbol's bars (small beside its ticks). Joins use confirmed_at, never the extreme's own time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TS, ignore_index=True)
        out, up = [], True
        best, at = None, None
        for t, hi, lo, atr in zip(pdf[TS], pdf["high"], pdf["low"], pdf["atr"], strict=True):
            price = hi if up else lo
            if best is None or (price > best if up else price < best):
                best, at = price, t
            elif (best - lo if up else hi - best) >= factor * atr:
                out.append((pdf[KEY].iloc[0], at, t, best, up))
                up = not up
                best, at = (hi if up else lo), t
        return pd.DataFrame(out, columns=[KEY, "bar_ts", "confirmed_at", "price", "is_high"])

    return bars.select(KEY, TS, "high", "low", "atr").groupBy(KEY).applyInPandas(run, SWINGS)


def swing_class_score(swings: DataFrame, n: int = 6) -> DataFrame:
    """HH, LH, HL or LL against the previous swing of the same kind, and the mean of +1 / -1 over the last n."""
    prev = F.lag("price").over(Window.partitionBy(KEY, "is_high").orderBy("confirmed_at"))
    s = swings.withColumn("_p", prev)
    kind = F.when(F.col("_p").isNull(), None).when(F.col("is_high"), F.when(F.col("price") > F.col("_p"), "HH").otherwise("LH")).otherwise(F.when(F.col("price") > F.col("_p"), "HL").otherwise("LL"))
    s = s.withColumn("swing_class", kind).withColumn("_s", F.when(F.col("swing_class").isin("HH", "HL"), 1.0).when(F.col("swing_class").isNotNull(), -1.0).otherwise(0.0))
    w = Window.partitionBy(KEY).orderBy("confirmed_at", "bar_ts").rowsBetween(-(n - 1), 0)
    return s.withColumn("structure_score", F.avg("_s").over(w)).drop("_p", "_s")


def trend_maturity(bars: DataFrame, swings: DataFrame, young: int = 5, mature: int = 20) -> DataFrame:
    """Bars since the latest confirmed swing (as of its confirmation) and the trend's age class."""
    from orderloom.operators.joins import asof_backward_join

    numbered = bars.withColumn("i", F.row_number().over(by_time()))
    marks = swings.select(KEY, F.col("confirmed_at").alias(TS)).distinct().join(numbered.select(KEY, TS, "i"), [KEY, TS])
    j = asof_backward_join(numbered.select(KEY, TS, "i"), marks, ["i"])
    age = F.col("i") - F.col("right_i")
    return j.withColumn("age", age).withColumn("maturity", F.when(age <= young, "young").when(age <= mature, "mature").when(age.isNotNull(), "exhausted"))


def timeframe_alignment(bars: DataFrame, steps: tuple[int, ...] = (1, 4, 16), window: int = 5) -> DataFrame:
    """Majority sign of the moves over windows of 1, 4 and 16 times the bar."""
    signs = [F.coalesce(F.signum(F.round(F.col("close") - F.lag("close", window * k).over(by_time()), 9)), F.lit(0.0)) for k in steps]
    return bars.withColumn("alignment", F.signum(sum(signs[1:], signs[0])).cast("int"))


def volatility_quartile(df: DataFrame) -> DataFrame:
    """Quartile (1 to 4) of ATR over price; cut points are values, so equal ones stay together. The one row of cuts is broadcast."""
    df = df.withColumn("_r", F.col("atr") / F.col("close"))
    cuts = percentiles(df, "_r", [0.25, 0.5, 0.75])
    quartile = F.when(F.col("_r") <= F.col("p0"), 1).when(F.col("_r") <= F.col("p1"), 2).when(F.col("_r") <= F.col("p2"), 3).otherwise(4)
    return df.crossJoin(F.broadcast(cuts.drop("n"))).withColumn("quartile", quartile).drop("_r", "p0", "p1", "p2")
