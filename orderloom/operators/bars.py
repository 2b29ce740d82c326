"""Bars and grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.clean import with_previous
from orderloom.spec import BUY_SIDES, CANCEL_ACTIONS, KEY, SELL_SIDES, TS, bucket, by_time, is_trade, median, signed_size, so_far, trailing



def ohlcv_bars(ticks: DataFrame, freq: str = "1 hour") -> DataFrame:
    """Open, high, low, close and volume of the trades of each bucket; buckets without trades have no bar."""
    order = F.struct(TS, "seq")
    return (
        ticks.where(is_trade())
        .groupBy(KEY, bucket(freq).alias(TS))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
    )


def tick_to_bar_features(ticks: DataFrame, reducers: dict[str, str], freq: str = "1 hour") -> DataFrame:
    """One aggregate from a table of column to reducer: max, sum, mean, std or last (by time, then sequence)."""
    order = F.struct(TS, "seq")
    how = {"max": F.max, "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "last": lambda c: F.max_by(c, order)}
    return ticks.groupBy(KEY, bucket(freq).alias(TS)).agg(*[how[r](c).alias(f"{c}_{r}") for c, r in reducers.items()])


def bar_cvd(ticks: DataFrame, freq: str = "1 hour") -> DataFrame:
    """Net flow of each bucket and its running total: the running sum is over bars, never over all ticks."""
    flow = ticks.where(is_trade()).groupBy(KEY, bucket(freq).alias(TS)).agg(F.sum(signed_size()).alias("cvd_delta"), F.avg(signed_size()).alias("cvd_velocity"))
    return flow.withColumn("cvd", F.sum("cvd_delta").over(so_far())).withColumn("cvd_sign", F.signum("cvd_delta"))


def session_cvd(ticks: DataFrame, freq: str = "1 hour") -> DataFrame:
    flow = ticks.where(is_trade()).groupBy(KEY, bucket(freq).alias(TS)).agg(F.sum(signed_size()).alias("cvd_delta"))
    day = Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    return flow.withColumn("session_cvd", F.sum("cvd_delta").over(day))


def buy_sell_volume(ticks: DataFrame, freq: str = "1 hour", trades_only: bool = True, net: str | None = None, imbalance: str | None = None) -> DataFrame:
    """Volume by aggressor. Where no tick of the table has a known side, the sign of the net flow column gives it; where that says
    nothing either, the sign of the book's imbalance; else the tick rule, by which a price not below the one before is a buy.

    Which of the four holds is decided once, from one row of counts.
    """
    t = ticks.where(is_trade()) if trades_only else ticks
    side = F.upper(F.trim("side"))
    known = F.when(side.isin(*BUY_SIDES), 1).when(side.isin(*SELL_SIDES), -1).otherwise(0)
    signs = [known, *[F.coalesce(F.signum(c).cast("int"), F.lit(0)) for c in (net, imbalance) if c]]
    counts = t.agg(*[F.sum(F.abs(s)).alias(f"s{i}") for i, s in enumerate(signs)]).first()
    chosen = next((s for i, s in enumerate(signs) if counts[i]), None)
    if chosen is None:
        t = with_previous(t, F.col("price"), "_before", *[c for c in ("seq",) if c in t.columns])
        chosen = F.when(F.col("price") < F.col("_before"), -1).otherwise(1)
    buy, sell = F.sum(F.when(chosen > 0, F.col("size")).otherwise(0.0)), F.sum(F.when(chosen < 0, F.col("size")).otherwise(0.0))
    b = t.groupBy(KEY, bucket(freq).alias(TS)).agg(F.sum("size").alias("volume"), buy.alias("buy_volume"), sell.alias("sell_volume"))
    return b.withColumn("buy_ratio", F.col("buy_volume") / F.greatest(F.col("buy_volume") + F.col("sell_volume"), F.lit(1.0)))


def bar_vwap(ticks: DataFrame, freq: str = "1 hour", trades_only: bool = True) -> DataFrame:
    t = ticks.where(is_trade()) if trades_only else ticks
    return t.groupBy(KEY, bucket(freq).alias(TS)).agg((F.sum(F.col("price") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1e-9))).alias("micro_price"))


def imbalance_reversals(ticks: DataFrame, freq: str = "1 hour") -> DataFrame:
    """Changes of the flow's sign from tick to tick inside a bucket."""
    t = ticks.where(is_trade()).withColumn("b", bucket(freq)).withColumn("s", F.signum(signed_size()))
    t = t.withColumn("p", F.lag("s").over(Window.partitionBy(KEY, "b").orderBy(TS, "seq")))
    return t.groupBy(KEY, F.col("b").alias(TS)).agg(F.sum((F.col("s") != F.col("p")).cast("bigint")).alias("n")).select(KEY, TS, F.coalesce("n", F.lit(0)).alias("reversals"))


def cancel_volume_ratio(ticks: DataFrame, freq: str = "1 hour") -> DataFrame:
    cancel = F.upper("action").isin(*CANCEL_ACTIONS).cast("double")
    return ticks.groupBy(KEY, bucket(freq).alias(TS)).agg((F.sum(cancel) / F.count(F.lit(1))).alias("cancel_ratio"))


def liquidity_bridge(ticks: DataFrame, freq: str = "1 hour", book: DataFrame | None = None) -> DataFrame:
    """Trades, mean size, buyers' share and imbalance within -1 and 1; with book snapshots also the bar's mean spread."""
    buy = F.upper("side").isin(*BUY_SIDES).cast("double")
    b = ticks.where(is_trade()).groupBy(KEY, bucket(freq).alias(TS)).agg(F.count(F.lit(1)).alias("trades"), F.avg("size").alias("mean_size"), F.avg(buy).alias("buy_share"), (F.sum(signed_size()) / F.greatest(F.sum("size"), F.lit(1e-9))).alias("ofi"))
    b = b.withColumn("ofi", F.greatest(F.least("ofi", F.lit(1.0)), F.lit(-1.0)))
    if book is None:
        return b
    spread = F.get("ask_px", F.lit(0)) - F.get("bid_px", F.lit(0))
    quotes = book.where(spread >= 0).groupBy(KEY, bucket(freq).alias(TS)).agg(F.avg(spread).alias("mean_spread"))
    return b.join(quotes, [KEY, TS], "left")


def flow_proxy(cvd: DataFrame, window: int = 24) -> DataFrame:
    """Bar flow over three times its trailing median size, within -1 and 1."""
    scale = median(F.abs("cvd_delta")).over(trailing(window))
    return cvd.withColumn("flow_proxy", F.greatest(F.least(F.col("cvd_delta") / F.greatest(3 * scale, F.lit(1e-9)), F.lit(1.0)), F.lit(-1.0)))


def tick_coverage(ticks: DataFrame, freq: str = "1 hour", window: int = 50, least: int = 20) -> DataFrame:
    c = ticks.groupBy(KEY, bucket(freq).alias(TS)).agg(F.count(F.lit(1)).alias("n_ticks"))
    w = trailing(window)
    mid = F.when(F.count("n_ticks").over(w) >= least, median("n_ticks").over(w))
    return c.withColumn("coverage", F.coalesce(F.least(F.col("n_ticks") / F.greatest(mid, F.lit(1.0)), F.lit(1.0)), F.lit(1.0)))


def book_coverage(bars: DataFrame, book: DataFrame, freq: str = "1 hour", expected: int = 10) -> DataFrame:
    n = book.groupBy(KEY, bucket(freq).alias(TS)).agg(F.count(F.lit(1)).alias("n"))
    return bars.select(KEY, TS).join(n, [KEY, TS], "left").select(KEY, TS, F.least(F.coalesce("n", F.lit(0)) / expected, F.lit(1.0)).alias("book_coverage"))


def downsample_bars(bars: DataFrame, factor: int) -> DataFrame:
    """Each `factor` bars to one; the last may be partial."""
    n = bars.withColumn("_i", F.floor((F.row_number().over(by_time()) - 1) / factor))
    return n.groupBy(KEY, F.col("_i").alias("idx")).agg(F.min(TS).alias(TS), F.min_by("open", TS).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TS).alias("close"), F.sum("volume").alias("volume"))


def merge_partial_bars(partials: DataFrame) -> DataFrame:
    """Bars from partial ones of equal (symbol, time) with a `part` number that orders them."""
    return partials.groupBy(KEY, TS).agg(F.min_by("open", "part").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "part").alias("close"), F.sum("volume").alias("volume"))


def session_table(bars: DataFrame, sums: list[str], least: int = 3) -> DataFrame:
    """One row for each symbol and day: return from the first open to the last close, columns summed; days of fewer bars left out."""
    g = bars.groupBy(KEY, F.to_date(TS).alias("day")).agg(F.count(F.lit(1)).alias("n_bars"), (F.max_by("close", TS) / F.min_by("open", TS) - 1).alias("ret"), *[F.sum(c).alias(c) for c in sums])
    return g.where(F.col("n_bars") >= least)


def grouping_metrics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The same metrics overall, by each key, and by all keys together, in one pass."""
    sets = [[], *[[F.col(k)] for k in keys], [F.col(k) for k in keys]]
    return df.groupingSets(sets, *keys).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and share of the most frequent one for each column, from one long count."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("top_share"))


def weighted_mean(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    total = F.sum(weight)
    return df.groupBy(*keys).agg(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0).alias("weighted_mean"))


def contingency_table(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def refined_bar_vote(labels: DataFrame, floor: float = 0.35, quality: str | None = None, regime: str | None = None) -> DataFrame:
    """Label of a bar from its parts' labels (-1, 0, 1): the larger side if its share reaches the floor, else neutral.

    With their columns also the best quality among the parts and their most frequent regime, the lowest on ties.
    """
    best = [F.max(quality).alias("quality")] if quality else []
    n = labels.groupBy(KEY, TS).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("bigint")).alias("up"), F.sum((F.col("label") == -1).cast("bigint")).alias("down"), *best)
    vote = F.when((F.col("up") >= F.col("down")) & (F.col("up") / F.col("n") >= floor), 1).when((F.col("down") > F.col("up")) & (F.col("down") / F.col("n") >= floor), -1).otherwise(0)
    out = n.withColumn("vote", vote)
    if regime:
        often = labels.groupBy(KEY, TS, regime).agg(F.count(F.lit(1)).alias("_c")).groupBy(KEY, TS).agg(F.min(F.struct(-F.col("_c"), F.col(regime).alias("r")))["r"].alias("regime"))
        out = out.join(often, [KEY, TS])
    return out
