"""Cleaning and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.spec import KEY, TS, by_time, median, so_far, trailing


def finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def keep_last(df: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sanitize_ticks(ticks: DataFrame, ingest: str | None = None) -> DataFrame:
    """Rows with time and a positive finite price; of equal (symbol, time, sequence) the last stays, full repeats go.

    The order id stands in for a sequence that is not there; without either, only full repeats go. Last means last by
    `ingest`, a column of the order of arrival, or else by the other columns, so that the result is one.
    """
    good = ticks.where(F.col(TS).isNotNull() & finite("price") & (F.col("price") > 0))
    key = next((c for c in ("seq", "sequence", "sequence_id", "order_id") if c in ticks.columns), None)
    if key is None:
        return good.dropDuplicates()
    last = [ingest] if ingest else sorted(set(ticks.columns) - {KEY, TS, key})
    w = Window.partitionBy(KEY, TS, key).orderBy(*[F.col(c).desc_nulls_last() for c in last])
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sanitize_book(book: DataFrame) -> DataFrame:
    """As for ticks, without snapshots whose best ask is below the best bid."""
    good = book.where(F.col(TS).isNotNull() & ~(F.get("ask_px", F.lit(0)) < F.get("bid_px", F.lit(0))))
    return keep_last(good, KEY, TS)


# The codes that the audited cleaning accepts, and those that may have no size.
KNOWN_ACTIONS = ("T", "A", "C", "M", "F", "R", "B", "N", "X")
KNOWN_SIDES = ("A", "B", "N", "")
SIZELESS_ACTIONS = ("C", "R", "X")


def first_failed_rule(price_min: float, price_max: float):
    """The name of the first rule that a tick breaks by itself, null for one that breaks none."""
    action, side = F.upper(F.trim(F.col("action"))), F.upper(F.trim(F.col("side")))
    sized = (F.col("size") > 0) | (action.isin(*SIZELESS_ACTIONS) & (F.col("size") >= 0))
    return (
        F.when(F.col(TS).isNull() | ~finite("price") | F.col("action").isNull(), "null_or_inf")
        .when(~F.col("price").between(price_min, price_max), "price_range")
        .when(~action.isin(*KNOWN_ACTIONS), "action")
        .when(side.isNull() | ~side.isin(*KNOWN_SIDES), "side")
        .when(~F.coalesce(sized & ~F.isnan("size"), F.lit(False)), "size")
    )


def marked_ticks(ticks: DataFrame, price_min: float, price_max: float) -> DataFrame:
    """Adds the first rule that a tick breaks: its own values, then the dominant symbol of what is left, then first of its key."""
    marked = ticks.withColumn("rule", first_failed_rule(price_min, price_max))
    top = marked.where("rule is null").groupBy(KEY).count().orderBy(F.col("count").desc(), KEY).limit(1).select(F.col(KEY).alias("_top"))
    marked = marked.join(F.broadcast(top), F.lit(True), "left")
    marked = marked.withColumn("rule", F.coalesce("rule", F.when(F.col(KEY) != F.col("_top"), "symbol"))).drop("_top")
    order = [F.col(c) for c in ("seq", "ingest") if c in ticks.columns] or [F.col("price")]
    w = Window.partitionBy(F.col("rule").isNull(), TS, "order_id", "action").orderBy(*order)
    return marked.withColumn("_n", F.row_number().over(w)).withColumn("rule", F.coalesce("rule", F.when(F.col("_n") > 1, "duplicate"))).drop("_n")


def clean_ticks_audited(ticks: DataFrame, price_min: float = 0.0, price_max: float = 1e9, gap_seconds: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """The ticks that break no rule, with a flag for gaps of the feed, and the count of each rule's removals."""
    marked = marked_ticks(ticks, price_min, price_max)
    kept = flag_feed_gap(marked.where("rule is null").drop("rule"), gap_seconds)
    return kept, marked.where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("removed"))


def flag_crossed_book(book: DataFrame, drop_above_ticks: int = 100, tick_size: float = 0.01) -> DataFrame:
    gap = F.get("bid_px", F.lit(0)) - F.get("ask_px", F.lit(0))
    return book.withColumn("is_crossed_book", gap > 0).where(~(gap > drop_above_ticks * tick_size))


def flag_level_disorder(book: DataFrame, max_depth: int = 10) -> DataFrame:
    """True where bids do not fall or asks do not rise with depth."""
    step = F.sequence(F.lit(0), F.lit(max_depth - 2))
    bid = F.exists(step, lambda i: F.get("bid_px", i) < F.get("bid_px", i + 1))
    ask = F.exists(step, lambda i: F.get("ask_px", i) > F.get("ask_px", i + 1))
    return book.withColumn("level_disorder", F.coalesce(bid | ask, F.lit(False)))


def micros(ts: str = TS):
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_previous(df: DataFrame, value, out: str, *order: str) -> DataFrame:
    """Adds the value of the symbol's row before, by time and `order`. Windows hold a day; a row a day carries over midnight."""
    day, at = F.to_date(TS), F.struct(TS, *order)
    x = df.withColumns({"_day": day, "_value": value})
    w = Window.partitionBy(KEY, "_day").orderBy(TS, *order)
    ends = x.groupBy(KEY, "_day").agg(F.max_by(F.struct("_value"), at).alias("_end"))
    carried = ends.select(KEY, "_day", F.lag("_end").over(Window.partitionBy(KEY).orderBy("_day")).alias("_carried"))
    x = x.withColumns({"_first": F.row_number().over(w) == 1, out: F.lag("_value").over(w)})
    x = x.join(carried, [KEY, "_day"], "left").withColumn(out, F.when(F.col("_first"), F.col("_carried._value")).otherwise(F.col(out)))
    return x.select(*df.columns, out)


def flag_feed_gap(ticks: DataFrame, gap_seconds: float = 3600.0) -> DataFrame:
    order = [c for c in ("seq",) if c in ticks.columns]
    t = with_previous(ticks, micros(), "_us", *order)
    return t.withColumn("feed_gap", F.coalesce(micros() - F.col("_us") > gap_seconds * 1e6, F.lit(False))).drop("_us")


def dominant_symbol_filter(ticks: DataFrame) -> DataFrame:
    """The rows of the most frequent symbol (the first by name on ties); the one-row winner is broadcast."""
    top = ticks.groupBy(KEY).count().orderBy(F.col("count").desc(), KEY).limit(1).select(KEY)
    return ticks.join(F.broadcast(top), KEY, "left_semi")


def drop_extreme_bars(bars: DataFrame, max_abs_pct_ret: float) -> DataFrame:
    return bars.where(F.abs(F.col("close") - F.col("open")) / F.abs("open") <= max_abs_pct_ret)


def clean_bar_moves(bars: DataFrame, max_move_pct: float = 1.5) -> DataFrame:
    """Bars that moved too far lose their prices and take the last good ones."""
    previous = F.lag("close").over(by_time())
    bad = F.coalesce(F.abs(F.col("close") / previous - 1) * 100 > max_move_pct, F.lit(False))
    marked = bars.withColumn("_bad", bad)
    for c in ("open", "high", "low", "close"):
        marked = marked.withColumn(c, F.last(F.when(~F.col("_bad"), F.col(c)), ignorenulls=True).over(so_far()))
    return marked.withColumnRenamed("_bad", "was_bad")


def repair_ohlc(bars: DataFrame, low: float, high: float, window: int = 20, z_limit: float = 3.5) -> DataFrame:
    """Prices out of range become null and are filled forward, outliers of the trailing median are replaced by it twice, high and low are put around the body."""
    for c in ("open", "high", "low", "close"):
        bars = bars.withColumn(c, F.last(F.when(F.col(c).between(low, high), F.col(c)), ignorenulls=True).over(so_far()))
    for _ in range(2):
        for c in ("open", "high", "low", "close"):
            w = trailing(window)
            mid, sd = median(c).over(w), F.stddev_samp(c).over(w)
            bars = bars.withColumn(c, F.when(F.abs(F.col(c) - mid) > z_limit * sd, mid).otherwise(F.col(c)))
    return bars.withColumn("high", F.greatest("open", "high", "low", "close")).withColumn("low", F.least("open", "high", "low", "close"))


def clip_feature_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]], density: str | None = None, train: str = "true") -> DataFrame:
    """Columns within fixed bounds; the density column below its 99th percentile on the training rows."""
    if density:
        from orderloom.operators.stats import percentiles

        limit = percentiles(df.where(train), density, [0.99]).select(F.col("p0").alias("_limit"))
        df = df.crossJoin(F.broadcast(limit)).withColumn(density, F.least(F.col(density), F.col("_limit"))).drop("_limit")
    for c, (lo, hi) in bounds.items():
        df = df.withColumn(c, F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
    return df


def session_time_mask(df: DataFrame, start: str, end: str, ts: str = TS) -> DataFrame:
    """True from hh:mm on and before the end; a start after the end goes over midnight."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    a, b = (int(x[:2]) * 60 + int(x[3:]) for x in (start, end))
    inside = (minute >= a) & (minute < b) if a <= b else (minute >= a) | (minute < b)
    return df.withColumn("in_session", inside)


def time_range_slice(df: DataFrame, start: str, end: str, ts: str = TS) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
