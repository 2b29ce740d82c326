"""Sequential gates, book windows, cycle features, scenario grids and trackers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scan import in_blocks
from orderloom.operators.labels import triple_barrier
from orderloom.operators.trades import one_at_a_time
from orderloom.operators.windows import EPS
from orderloom.spec import CANCEL_ACTIONS, KEY, TS, bucket, by_time, is_trade, signed_size, trailing


def day_order():
    return Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS, "seq")


def cancel_ratio(ticks: DataFrame, window: int = 500, large: float = 2.0) -> DataFrame:
    """Mean weight of the day's last add and cancel events (add 0, large cancel 1, other cancel 0.3), carried to every tick."""
    cancel = F.upper("action").isin(*CANCEL_ACTIONS)
    weight = F.when(F.upper("action") == "A", 0.0).when(cancel & (F.col("size") > large * F.avg("size").over(day_order().rowsBetween(-99, 0))), 1.0).when(cancel, 0.3)
    t = ticks.withColumn("_w", weight)
    return t.withColumn("cancel_ratio", F.coalesce(F.avg("_w").over(day_order().rowsBetween(-(window - 1), 0)), F.lit(0.0))).drop("_w")


def order_rows(ticks: DataFrame, freq: str = "1 hour", most: int = 200) -> DataFrame:
    """Up to `most` evenly spaced orders of each bar, with size, distance from the bar's first price, place in time and repeats."""
    t = ticks.withColumn("b", bucket(freq))
    w = Window.partitionBy(KEY, "b").orderBy(TS, "seq")
    every = Window.partitionBy(KEY, "b")
    t = t.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy(KEY, "b", "order_id"))).withColumn("first_px", F.first("price").over(w))
    keep = (F.col("n") <= most) | (F.floor(F.col("i") * most / F.col("n")) != F.floor((F.col("i") - 1) * most / F.col("n")))
    return t.where(keep).select(KEY, F.col("b").alias(TS), "seq", F.log1p("size").alias("log_size"), (F.col("price") - F.col("first_px")).alias("distance"), (F.col("i") / F.col("n")).alias("place"), "repeats")


def rolling_book_window(cells: DataFrame, bars: DataFrame, lookback: int = 50) -> DataFrame:
    """(bar, lag, columns of cells) of the last bars that have cells: a join on bar number less lag; nothing is stored twice until it is exported.

    filled_share: of the window's `lookback` bars those with cells.
    """
    marked = bars.select(KEY, TS).join(cells.select(KEY, TS, F.lit(1).alias("_there")), [KEY, TS], "left")
    n = marked.withColumn("i", F.row_number().over(by_time())).withColumn("_share", F.sum(F.coalesce("_there", F.lit(0))).over(trailing(lookback)) / lookback)
    c = cells.join(n.select(KEY, TS, "i"), [KEY, TS]).drop(TS)
    want = n.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lookback - 1)))).withColumn("j", F.col("i") - F.col("lag")).select(KEY, TS, "lag", "j", F.col("_share").alias("filled_share"))
    return want.join(c.withColumnRenamed("i", "j"), [KEY, "j"]).drop("j")


def flow_only_book(ticks: DataFrame, freq: str = "1 hour") -> DataFrame:
    """Flow channels of a bar where no book exists; depth is 0 and marked so."""
    return ticks.where(is_trade()).groupBy(KEY, bucket(freq).alias(TS)).agg(F.sum(F.greatest(signed_size(), F.lit(0.0))).alias("buy"), F.sum(F.greatest(-signed_size(), F.lit(0.0))).alias("sell")).select(KEY, TS, "buy", "sell", F.lit(0.0).alias("depth"), F.lit(False).alias("has_book"))


def book_fidelity(stored: DataFrame, snapshots: DataFrame, tolerances: tuple[float, ...] = (1e-3, 1e-6)) -> DataFrame:
    """Cells of the source snapshots, those that the stored table (symbol, time, level, depth_log) lacks, stored cells without a source, the
    largest difference of sizes, and for each tolerance, a share of the size (1 at least), the cells that are further apart.
    """
    source = snapshots.select(KEY, TS, F.posexplode(F.concat(F.reverse("bid_sz"), "ask_sz")).alias("level", "size"))
    j = source.join(stored.select(KEY, TS, "level", "depth_log"), [KEY, TS, "level"], "full_outer")
    diff = F.abs(F.expm1(F.col("depth_log").cast("double")) - F.col("size"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    apart = [n(diff > t * F.greatest("size", F.lit(1.0))).alias(f"apart_{i}") for i, t in enumerate(tolerances)]
    return j.agg(F.count("size").alias("n"), n(F.col("depth_log").isNull()).alias("missing"), n(F.col("size").isNull()).alias("unknown"), F.max(diff).alias("largest"), *apart)


def cycle_phase(bars: DataFrame, n: int = 20) -> DataFrame:
    """Chances of accumulation, markup, distribution and markdown from slope, place in range and width: a softmax of fixed scores."""
    w = trailing(n)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    b = bars.withColumn("_place", (F.col("close") - lo) / F.greatest(hi - lo, F.lit(EPS))).withColumn("_slope", F.tanh((F.col("close") - F.avg("close").over(w)) / F.greatest("atr", F.lit(EPS))))
    s = {"accumulation": 1 - F.abs("_slope") - F.col("_place"), "markup": F.col("_slope") + F.col("_place"), "distribution": F.col("_place") - F.abs("_slope"), "markdown": -F.col("_slope") + 1 - F.col("_place")}
    total = sum((F.exp(x) for x in s.values()), F.lit(0.0))
    return b.select("*", *[(F.exp(x) / total).alias(f"p_{k}") for k, x in s.items()]).drop("_place", "_slope")


def rolling_hurst(bars: DataFrame, window: int = 100, lags: tuple[int, ...] = tuple(range(2, 20)), least: int = 40, flat: float = 1e-9) -> DataFrame:
    """Slope of the log deviation of k-step differences on log k over the trailing window, within 0 and 1, and the dimension 2 - H.

    One deviation for each lag; lags without movement are left out. 0.5 before `least` bars or with fewer than three lags.
    """
    import math

    b = bars.withColumns({f"_d{k}": F.col("close") - F.lag("close", k).over(by_time()) for k in lags})
    b = b.withColumns({f"_s{k}": F.round(F.stddev_pop(f"_d{k}").over(trailing(window - k)), 12) for k in lags})
    x = {k: math.log(k) for k in lags}
    total = lambda f: sum((F.when(F.col(f"_s{k}") > flat, f(k)).otherwise(0.0) for k in lags), F.lit(0.0))
    y = lambda k: F.log(f"_s{k}")
    b = b.withColumns({"_n": total(lambda k: F.lit(1.0)), "_x": total(lambda k: F.lit(x[k])), "_y": total(y), "_xx": total(lambda k: F.lit(x[k] ** 2)), "_xy": total(lambda k: x[k] * y(k))})
    slope = (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"))
    ready = (F.count("close").over(trailing(window)) >= least) & (F.col("_n") >= 3)
    b = b.withColumn("hurst", F.when(ready, F.least(F.greatest(slope, F.lit(0.0)), F.lit(1.0))).otherwise(0.5))
    return b.withColumn("dimension", 2 - F.col("hurst")).drop("_n", "_x", "_y", "_xx", "_xy", *[f"_{c}{k}" for c in "ds" for k in lags])


def regime_mixture(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """Gaussian mixture by the library's distributed implementation; adds its component."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns))
    return GaussianMixture(k=k, seed=7, maxIter=10).fit(v).transform(v).withColumnRenamed("prediction", "component").drop("features", "probability")


def scenario_soft_labels(bars: DataFrame, scenarios: list[tuple[float, float, int]]) -> DataFrame:
    """Share of up and down outcomes of each bar over scenarios (target, stop, horizon), and their entropy."""
    out = None
    for tp, sl, h in scenarios:
        one = triple_barrier(bars, tp, sl, h).select(KEY, TS, "label")
        out = one if out is None else out.unionByName(one)
    g = out.where("label is not null").groupBy(KEY, TS).agg(F.avg((F.col("label") == 1).cast("double")).alias("p_up"), F.avg((F.col("label") == -1).cast("double")).alias("p_down"))
    p0 = 1 - F.col("p_up") - F.col("p_down")
    ent = lambda p: F.when(p > 1e-9, -p * F.log(p)).otherwise(0.0)
    return g.withColumn("entropy", ent(F.col("p_up")) + ent(F.col("p_down")) + ent(p0))


def label_grid(bars: DataFrame, multiples: list[float], horizons: list[int], observed: DataFrame) -> DataFrame:
    """Counts of labels under each barrier and horizon, and the share of them that the observed labels agree with."""
    out, seen = None, observed.select(KEY, TS, F.col("label").alias("observed"))
    for m in multiples:
        for h in horizons:
            one = triple_barrier(bars, m, m, h).where("label is not null").select(KEY, TS, F.lit(m).alias("multiple"), F.lit(h).alias("horizon"), "label")
            out = one if out is None else out.unionByName(one)
    both = out.join(seen, [KEY, TS])
    return both.groupBy("multiple", "horizon", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("observed")).cast("double")).alias("agreement"))


def combine_quarters(parts: list[DataFrame]) -> DataFrame:
    """Quarterly tables one after the other, absent columns null, each cut where the next begins."""
    out = None
    for i, p in enumerate(parts):
        if i + 1 < len(parts):
            start = parts[i + 1].agg(F.min(TS).alias("_s"))
            p = p.crossJoin(F.broadcast(start)).where(F.col("_s").isNull() | (F.col(TS) < F.col("_s"))).drop("_s")
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def non_overlapping(df: DataFrame, horizon: int = 4) -> DataFrame:
    """Signals held for a fixed number of bars, entered at the next bar, one at a time."""
    c = df.withColumn("ts_entry", F.lead(TS).over(by_time())).withColumn("ts_exit", F.lead(TS, horizon + 1).over(by_time())).withColumn("pnl", F.signum("signal") * (F.lead("close", horizon + 1).over(by_time()) - F.lead("open").over(by_time())))
    c = c.where("signal <> 0 and ts_exit is not null").select(KEY, F.col("ts_entry").alias(TS), "ts_exit", "pnl")
    return one_at_a_time(c)


def thirteen_channels(book: DataFrame) -> DataFrame:
    """Adds to a level's channels three wall tiers, the thin-level flag, the distance to the nearest thin level of the side and the five-snapshot gradient.

    Snapshots stay whole, a row each, until all that needs a shuffle or a window is done; a level that the snapshot five before lacks has no gradient.
    """
    from orderloom.operators.more import depth_channels

    x, w, own = in_blocks(book.where(F.size(F.arrays_zip("bid_sz", "ask_sz")) > 0).select(KEY, TS, "seq", "bid_sz", "ask_sz"), 5)
    x = x.withColumn("_p", F.lag("bid_sz", 5).over(w)).where(own)
    size = lambda v: F.expm1(F.log1p(v))  # noqa: E731  (as told by the channel)
    x = x.withColumn("_z", F.sort_array(F.filter(F.transform("bid_sz", size), lambda v: v.isNotNull())))
    at = lambda k: F.get("_z", F.floor(k).cast("int")) * 0.5
    x = x.withColumn("_m", F.greatest(F.round(at((F.size("_z") - 1) / 2) + at(F.size("_z") / 2), 6), F.lit(1.0)))
    x = x.withColumn("_t", F.filter(F.transform("bid_sz", lambda v, i: F.when(F.round(size(v), 6) < 5, i)), lambda i: i.isNotNull()))
    c = depth_channels(x, "_m", "_t", "_p").withColumn("_s", F.round(F.expm1("bid_log"), 6))
    tier = F.when(F.col("_s") >= 10 * F.col("_m"), 3).when(F.col("_s") >= 5 * F.col("_m"), 2).when(F.col("_s") >= 3 * F.col("_m"), 1).otherwise(0)
    c = c.withColumn("wall_tier", tier).withColumn("thin", (F.col("_s") < 5).cast("int"))
    c = c.withColumn("gap_distance", F.array_min(F.transform("_t", lambda i: F.abs(F.col("level") - i))))
    return c.withColumn("gradient", (F.col("bid_log") - F.log1p(F.get("_p", F.col("level")))) / 5).drop("_s", "_m", "_t", "_p")
