"""Dataset contracts, composed features, scenario labels, fold tables and composed studies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from orderloom.functions.scan import in_blocks
from orderloom.operators import stats as M
from orderloom.operators.windows import EPS, forward_return
from orderloom.spec import CANCEL_ACTIONS, KEY, TS, ahead, bucket, by_time, is_trade, median, trailing

# Dataset contracts


def depth_feature_join(keys: DataFrame, depth: DataFrame) -> DataFrame:
    """Every bar with its depth features, null where there are none."""
    return keys.select(KEY, TS).join(depth, [KEY, TS], "left")


def write_checkpoint(bars: DataFrame, path: str, freq: str, profile: str) -> None:
    """Bars and a one-row table of what they were made with."""
    bars.write.parquet(f"{path}/bars")
    bars.sparkSession.range(1).select(F.lit(freq).alias("freq"), F.lit(profile).alias("profile")).write.parquet(f"{path}/meta")


def read_checkpoint(spark, path: str, freq: str, profile: str) -> DataFrame:
    """The bars, refused when they were made with another bar size or session profile."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta.freq, meta.profile) != (freq, profile):
        raise ValueError(f"the checkpoint holds {meta.freq}, {meta.profile}")
    return spark.read.parquet(f"{path}/bars")


def schema_check(df: DataFrame, specs: dict[str, str]) -> DataFrame:
    """column, problem: registered columns that are missing, of another type, or hold nulls. One aggregate over the rows."""
    kinds = dict(df.dtypes)
    n = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in specs if c in kinds])
    rows = [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("problem")) if c not in kinds else F.struct(F.lit(c).alias("column"), F.lit("type" if kinds[c] != t else None).cast("string").alias("problem")) if kinds[c] != t else F.struct(F.lit(c).alias("column"), F.when(F.col(c) > 0, "nulls").alias("problem")) for c, t in specs.items()]
    return n.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("problem is not null")


def select_features(df: DataFrame, keep: list[str], mode: str, top: list[str], noise: list[str]) -> DataFrame:
    """keep_top: only the named features; drop_noise: all but the named; all: everything."""
    names = [c for c in df.columns if c not in keep]
    chosen = {"keep_top": [c for c in names if c in top], "drop_noise": [c for c in names if c not in noise], "all": names}[mode]
    return df.select(*keep, *chosen)


FORWARD = ("fwd_", "label", "target", "mfe", "mae", "max_r", "future_")


def drop_forward_columns(df: DataFrame) -> DataFrame:
    """Without columns whose name begins as those of forward-looking values do."""
    return df.select(*[c for c in df.columns if not c.startswith(FORWARD)])


# Features


def derived_block(bars: DataFrame, n: int = 14) -> DataFrame:
    """Normalised columns of a bar for sequence models."""
    w = trailing(n)
    span = F.greatest(F.col("high") - F.col("low"), F.lit(EPS))
    return bars.select("*", F.log(F.col("close") / F.lag("close").over(by_time())).alias("log_ret"), ((F.col("close") - F.col("low")) / span).alias("close_place"), (F.col("volume") / F.greatest(F.avg("volume").over(w), F.lit(EPS))).alias("rel_volume"), ((F.col("high") - F.col("low")) / F.greatest(F.avg(F.col("high") - F.col("low")).over(w), F.lit(EPS))).alias("rel_range"), ((F.col("close") - F.avg("close").over(w)) / (F.stddev_samp("close").over(w) + EPS)).alias("close_z"))


def technical_pack(bars: DataFrame) -> DataFrame:
    """Mean range from the first bar on, wicks, and their ratio within 3."""
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    return bars.withColumn("pack_atr", F.avg(F.col("high") - F.col("low")).over(trailing(14))).withColumn("upper_wick", upper).withColumn("lower_wick", lower).withColumn("wick_ratio", F.greatest(F.least((upper - lower) / F.greatest(F.col("pack_atr"), F.lit(EPS)), F.lit(3.0)), F.lit(-3.0)))


def tick_day():
    return Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS, "seq")


def refill_slice_ratio(ticks: DataFrame, window: int = 200) -> DataFrame:
    """Adds net of cancels at the tick's side and hundredth of price so far, over the day's trailing maximum."""
    net = F.when(F.upper("action") == "A", F.col("size")).when(F.upper("action").isin(*CANCEL_ACTIONS), -F.col("size")).otherwise(0.0)
    place = Window.partitionBy(KEY, F.to_date(TS), F.round("price", 1), "side").orderBy(TS, "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = ticks.withColumn("_n", F.greatest(F.sum(net).over(place), F.lit(0.0)))
    return t.withColumn("refill_ratio", F.col("_n") / F.greatest(F.max("_n").over(tick_day().rowsBetween(-(window - 1), 0)), F.lit(1.0))).drop("_n")


def information_anomaly(ticks: DataFrame, n: int = 50, k: float = 1.5) -> DataFrame:
    """Trailing variance of the standardised price above its own trailing mean and deviations."""
    f = tick_day().rowsBetween(-(n - 1), 0)
    t = ticks.where(is_trade()).withColumn("_z", (F.col("price") - F.avg("price").over(f)) / (F.stddev_pop("price").over(f) + 1e-6))
    t = t.withColumn("_v", F.round(F.var_pop("_z").over(f), 6))
    return t.withColumn("anomaly", (F.col("_v") > F.round(F.avg("_v").over(f) + k * F.stddev_pop("_v").over(f), 6)).cast("int")).drop("_z", "_v")


def iceberg_detect(fills: DataFrame, ratio: float = 1.5, seconds: float = 16.0) -> DataFrame:
    """(symbol, day, price, side) where more was executed than `ratio` times the largest displayed size, a refill followed
    a fill within the seconds, and size is still displayed. fills: ts_event, seq, price, side, action, displayed_size, executed_size.
    """
    key = [KEY, F.to_date(TS).alias("day"), "price", "side"]
    w = Window.partitionBy(KEY, F.to_date(TS), "price", "side").orderBy(TS, "seq")
    us = F.unix_micros(F.col(TS).cast("timestamp"))
    x = fills.withColumn("_us", us).withColumn("_fill", F.last(F.when(F.col("executed_size") > 0, F.col("_us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_shown", F.lag("displayed_size").over(w))
    refill = (F.col("displayed_size") > F.col("_shown")) & (F.col("_us") - F.col("_fill") <= seconds * 1e6)
    g = x.withColumn("_refill", F.coalesce(refill, F.lit(False)).cast("int")).groupBy(*key).agg(F.sum("executed_size").alias("executed"), F.max("displayed_size").alias("shown"), F.max("_refill").alias("refills"), F.max_by("displayed_size", F.struct(TS, "seq")).alias("last_shown"), F.max(TS).alias(TS))
    return g.where((F.col("executed") >= ratio * F.col("shown")) & (F.col("refills") == 1) & (F.col("last_shown") > 0)).select(KEY, "day", "price", "side", TS, (F.col("executed") - F.col("shown")).alias("hidden_volume"))


def per_bar_counts(bars: DataFrame, events: DataFrame, value: str, freq: str = "1 hour") -> DataFrame:
    """Number of events and sum of a value in each bar, zeros elsewhere."""
    e = events.groupBy(KEY, bucket(freq).alias(TS)).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("event_value"))
    return bars.select(KEY, TS).join(e, [KEY, TS], "left").select(KEY, TS, F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("event_value", F.lit(0.0)).alias("event_value"))


def calibration(ticks: DataFrame, n: int = 2000) -> DataFrame:
    """Typical size, tick size (the most frequent move, the smaller on ties), smallest move and price deviation of each symbol
    from its first n trades (the first ones are the feature), without prices beyond 1.5 interquartile ranges.

    Each day's first n trades by themselves hold the symbol's first n, so no window sorts a symbol's whole history.
    """
    day = Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS, "seq")
    t = ticks.where(is_trade()).withColumn("_n", F.row_number().over(day)).where(F.col("_n") <= n)
    sizes = t.groupBy(KEY, F.to_date(TS).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(KEY).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(KEY, "_d", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    t = t.withColumn("_d", F.to_date(TS)).join(sizes, [KEY, "_d"]).where(F.col("_b") + F.col("_n") <= n).drop("_b", "_n", "_d")
    q = t.groupBy(KEY).agg(median("price", 0.25).alias("_q1"), median("price", 0.75).alias("_q3"))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    t = t.join(q, KEY).where(F.col("price").between(F.col("_q1") - reach, F.col("_q3") + reach))
    t = t.withColumn("_m", F.round(F.abs(F.col("price") - F.lag("price").over(by_time("seq"))), 6))
    moves = t.where(F.col("_m") > 0).groupBy(KEY, "_m").agg(F.count(F.lit(1)).alias("_c")).groupBy(KEY).agg(F.min(F.struct(-F.col("_c"), "_m"))["_m"].alias("tick_size"))
    out = t.groupBy(KEY).agg(median("size").alias("typical_size"), F.min(F.when(F.col("_m") > 0, F.col("_m"))).alias("smallest_move"), F.stddev_samp("price").alias("price_std"))
    return out.join(moves, KEY, "left")


def dynamic_exits(df: DataFrame, tick: float = 0.01, least_target: float = 3.0, most_stop: float = 30.0) -> DataFrame:
    """Target and stop distances in ticks from the walls on both sides, and their ratio."""
    target = F.greatest(F.when(F.col("ask_wall") >= 0, F.col("ask_wall") + 1.0).otherwise(10.0), F.lit(least_target))
    stop = F.least(F.when(F.col("bid_wall") >= 0, F.col("bid_wall") + 2.0).otherwise(12.0), F.lit(most_stop))
    return df.withColumn("target_ticks", target).withColumn("stop_ticks", stop).withColumn("reward_risk", F.col("target_ticks") / F.col("stop_ticks"))


def depth_channels(book: DataFrame, *kept: str) -> DataFrame:
    """Long rows (symbol, time, level, side sizes as logs, wall flag): the channels of a level. kept: columns of the snapshot to keep."""
    med = lambda a: F.get(F.sort_array(a), F.lit(4))
    z = F.arrays_zip(F.col("bid_sz").alias("b"), F.col("ask_sz").alias("a"))
    x = book.withColumn("_mb", med("bid_sz")).withColumn("_ma", med("ask_sz")).select(KEY, TS, "seq", *kept, "_mb", "_ma", F.posexplode(z).alias("level", "z"))
    return x.select(KEY, TS, "seq", *kept, "level", F.log1p("z.b").alias("bid_log"), F.log1p("z.a").alias("ask_log"), ((F.col("z.b") >= 3 * F.greatest("_mb", F.lit(1.0))) | (F.col("z.a") >= 3 * F.greatest("_ma", F.lit(1.0)))).cast("int").alias("wall"))


def causal_normalise(cells: DataFrame, value: str, n: int = 222, least: int = 50, clip: float = 6.0) -> DataFrame:
    """z of a cell from the previous n snapshots of its level alone, zeros ignored; as it is until `least` of them.

    Cells go in blocks of a level's rows; a block is one numpy array, over which a window costs n additions a row.
    """
    c, _, _ = in_blocks(cells, n, (KEY, "level"))
    columns = cells.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        x = table.column(value).to_numpy(zero_copy_only=False).astype(float)
        own = (table.column("_own").to_numpy() == table.column("_block").to_numpy()).nonzero()[0]
        some = np.where((x != 0) & ~np.isnan(x), x, 0.0)
        out = np.empty(len(own))
        before = np.concatenate([np.zeros(n), some])
        for at in range(0, len(own), 2048):  # own rows follow one another
            lines = own[at : at + 2048]
            w = np.lib.stride_tricks.sliding_window_view(before[lines[0] : lines[-1] + n], n)
            k = (w != 0).sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = w.sum(1) / k
                sd = np.sqrt((np.where(w != 0, w - mean[:, None], 0.0) ** 2).sum(1) / k)
                z = np.clip((x[lines] - mean) / (sd + 1e-6), -clip, clip)
            out[at : at + 2048] = np.where(x[lines] == 0, 0.0, np.where(k < least, x[lines], z))
        return table.take(pa.array(own)).select(columns).append_column(f"{value}_norm", pa.array(out, from_pandas=True))

    schema = StructType([*cells.schema.fields]).add(f"{value}_norm", DoubleType())
    return c.groupBy(KEY, "level", "_block").applyInArrow(run, schema)


def soft_regime(df: DataFrame) -> DataFrame:
    """Softmax over trend, calm and wild scores, and its entropy."""
    e = [F.exp(F.col(c)) for c in ("s_trend", "s_calm", "s_wild")]
    total = e[0] + e[1] + e[2]
    df = df.select("*", *[(x / total).alias(f"p_{n}") for x, n in zip(e, ("trend", "calm", "wild"), strict=True)])
    return df.withColumn("entropy", -sum((F.col(f"p_{n}") * F.log(F.col(f"p_{n}")) for n in ("trend", "calm", "wild")), F.lit(0.0)))


def regime_scores(df: DataFrame, columns: list[str], train: str = "true") -> DataFrame:
    """Lagged features, scaled by training quantiles to between 0 and 1, and their mean."""
    for c in columns:
        df = df.withColumn(f"{c}_lag", F.lag(c).over(by_time()))
    fit = df.where(train).agg(*[e for c in columns for e in (median(f"{c}_lag", 0.05).alias(f"_l_{c}"), median(f"{c}_lag", 0.95).alias(f"_h_{c}"))])
    df = df.crossJoin(F.broadcast(fit))
    scaled = [F.least(F.greatest((F.col(f"{c}_lag") - F.col(f"_l_{c}")) / F.greatest(F.col(f"_h_{c}") - F.col(f"_l_{c}"), F.lit(EPS)), F.lit(0.0)), F.lit(1.0)) for c in columns]
    return df.withColumn("regime_score", sum(scaled, F.lit(0.0)) / len(columns))


def structure_bucket(df: DataFrame) -> DataFrame:
    place = F.col("range_position")
    return df.withColumn("structure_bucket", F.when(place >= 1, "breakout_up").when(place <= 0, "breakout_down").when(place > 0.8, "near_high").when(place < 0.2, "near_low").when(place > 0.55, "upper_mid").when(place < 0.45, "lower_mid").otherwise("mid"))


def train_pool_flag(df: DataFrame) -> DataFrame:
    """Directional labels with at least half the median ATR (one scalar)."""
    mid = df.agg(median("atr").alias("_m"))
    return df.crossJoin(F.broadcast(mid)).withColumn("in_pool", (F.coalesce(F.col("label"), F.lit(0)) != 0) & (F.col("atr") >= F.col("_m") / 2)).drop("_m")


def bar_quality(df: DataFrame, n: int = 100) -> DataFrame:
    """Quality from event score, activity and pressure, each against its past only."""
    past = trailing(n, back=1)
    act = F.least(F.col("volume") / F.greatest(median("volume").over(past) * 2, F.lit(EPS)), F.lit(1.0))
    return df.withColumn("bar_quality", 0.30 * F.abs("ofi") + 0.35 * F.coalesce(act, F.lit(0.0)) + 0.35 * F.abs(F.col("buy_share") - 0.5) * 2)


# Labels


def adaptive_horizon(df: DataFrame, base: int = 12, least: float = 0.5, most: float = 2.0, n: int = 100) -> DataFrame:
    ratio = F.col("atr") / F.greatest(median("atr").over(trailing(n)), F.lit(EPS))
    return df.withColumn("horizon", F.round(base * F.least(F.greatest(ratio, F.lit(least)), F.lit(most))).cast("int"))


# The probability of a side by what came first, (weak, strong) quality: its target, its stop, the other's target, the other's stop.
OUTCOME_SOFT = {"target": (0.72, 0.88), "stop": (0.12, 0.09), "other_target": (0.12, 0.12), "other_stop": (0.62, 0.68)}


def analytic_soft_labels(df: DataFrame, unit: str = "atr", scale: float = 1.5, reach: float = 0.4, boost: float = 1.3, floor: float = 0.1, most: int = 24) -> DataFrame:
    """Probabilities of a long and a short by outcome (up, down, timeout) and quality (2 strong), for timeouts by a sigmoid of
    the move ahead; soft_p is that of the label's side. Confidence, and weights with a mean of 1 (one scalar that is broadcast).
    """
    strong = F.col("quality") == 2
    of = lambda kind: F.when(strong, OUTCOME_SOFT[kind][1]).otherwise(OUTCOME_SOFT[kind][0])
    x = F.least(F.greatest(scale * F.coalesce(F.col("move_ahead"), F.lit(0.0)) / F.greatest(F.col(unit), F.lit(1e-10)), F.lit(-60.0)), F.lit(60.0))
    late = 0.5 + reach * (1 / (1 + F.exp(-x)) - 0.5)
    up, down, timeout = (F.col("outcome") == k for k in ("up", "down", "timeout"))
    df = df.withColumn("soft_long", F.when(up, of("target")).when(down, of("other_target")).when(timeout, late).otherwise(0.5))
    df = df.withColumn("soft_short", F.when(down, of("target")).when(up, of("other_target")).when(timeout, 1 - late).otherwise(0.5))
    df = df.withColumn("soft_p", F.when(F.col("label") == 1, F.col("soft_long")).when(F.col("label") == -1, F.col("soft_short")).otherwise(0.5))
    used = F.least(F.coalesce(F.col("bars_held"), F.lit(0)) / most, F.lit(1.0))
    sure = F.when(timeout, 0.4 + 0.15 * used).otherwise(0.75) + F.when(strong, 0.1).otherwise(0.0)
    df = df.withColumn("soft_confidence", F.least(sure, F.lit(1.0)))
    w = F.greatest(F.col("soft_confidence") * F.abs(F.col("soft_p") - 0.5) * 2 * F.when(strong, boost).otherwise(1.0), F.lit(floor))
    df = df.withColumn("_w", w)
    return df.crossJoin(F.broadcast(df.agg(F.avg("_w").alias("_m")))).withColumn("soft_weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


def gap_fill_label(df: DataFrame, n: int = 6) -> DataFrame:
    """Whether the next bars' range touches the previous bar's close that this bar's open left behind."""
    prev = F.lag("close").over(by_time())
    df = df.withColumn("_g", prev)
    inside = (F.min("low").over(ahead(n)) <= F.col("_g")) & (F.max("high").over(ahead(n)) >= F.col("_g"))
    return df.withColumn("gap_fill", F.coalesce(inside, F.lit(False)).cast("int")).drop("_g")


# Folds and studies


def fold_aggregate(folds: DataFrame, metric: str) -> DataFrame:
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.avg((F.col(metric) > 0).cast("double")).alias("positive_share"))


def out_of_fold(parts: list[DataFrame], keys: DataFrame, prior: float) -> DataFrame:
    """Fold predictions placed on the keys; overlaps are refused, uncovered keys get the prior."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if not every.groupBy(KEY, TS).count().where("count > 1").limit(1).isEmpty():
        raise ValueError("folds overlap")
    return keys.select(KEY, TS).join(every, [KEY, TS], "left").withColumn("prediction", F.coalesce("prediction", F.lit(prior)))


def overfit_probability(results: DataFrame) -> DataFrame:
    """For each split the out-of-sample rank share of the in-sample winner and its logit; results: split, model, ins, outs."""
    n = F.count(F.lit(1)).over(Window.partitionBy("split"))
    r = results.withColumn("_r", F.rank().over(Window.partitionBy("split").orderBy("outs")) / (n + 1))
    best = r.groupBy("split").agg(F.max_by("_r", "ins").alias("rank_share"))
    return best.withColumn("logit", F.log(F.col("rank_share") / (1 - F.col("rank_share")))).withColumn("overfit", (F.col("logit") <= 0).cast("int"))


def ic_audit(pairs: DataFrame, blocks: int = 8, cost: float = 0.0005) -> DataFrame:
    """IC, block stability, information, IC after costs and decay over horizons of each (feature, horizon), with a verdict: the
    first of noise, cost_bound, unstable, fast_decay that holds, else signal.
    """
    by = ["feature", "horizon"]
    ic, st, mi = M.rank_correlation(pairs, *by), M.block_stability(pairs, blocks), M.mutual_information(pairs)
    after = M.rank_correlation(M.cost_adjusted(pairs, cost), *by).select(*by, F.col("spearman").alias("after_cost"))
    j = ic.join(st, by).join(mi, by).join(after, by).join(M.horizon_decay(ic), "feature")
    one_sided = F.greatest(F.col("positive_share"), 1 - F.col("positive_share"))
    verdict = (
        F.when(F.abs("spearman") < 0.01, "noise").when(F.abs("after_cost") < 0.5 * F.abs("spearman"), "cost_bound").when(one_sided < 0.7, "unstable")
        .when(F.col("decay") > 0.8 * F.abs("spearman"), "fast_decay").otherwise("signal")
    )
    return j.withColumn("verdict", verdict)


def event_outcomes(bars: DataFrame, horizons: tuple[int, ...] = (4, 8), target: float = 1.0, stop: float = 1.0) -> DataFrame:
    """symbol, time, horizon, r, up, down, target_first of each bar and horizon with that many bars ahead: return, excursions in ATR, and whether a high
    reaches the target before a low does the stop (a bar with both counts as the stop), both in ATR.
    """
    unit = F.greatest("atr", F.lit(EPS))
    cells = []
    for h in horizons:
        w = ahead(h)
        first = lambda c, hit: F.array_position(F.transform(F.collect_list(c).over(w), hit), F.lit(True))  # noqa: E731, B023
        won, lost = first("high", lambda x: x >= F.col("close") + target * F.col("atr")), first("low", lambda x: x <= F.col("close") - stop * F.col("atr"))
        r = F.lead("close", h).over(by_time()) / F.col("close") - 1
        bars = bars.withColumn(f"_o{h}", F.struct(F.lit(h).alias("horizon"), r.alias("r"), ((F.max("high").over(w) - F.col("close")) / unit).alias("up"), ((F.col("close") - F.min("low").over(w)) / unit).alias("down"), ((won > 0) & ((lost == 0) | (won < lost))).cast("int").alias("target_first")))
        cells.append(F.col(f"_o{h}"))
    return bars.select(KEY, TS, F.explode(F.array(*cells)).alias("_o")).select(KEY, TS, "_o.*").where("r is not null")


def event_study(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """By level, depth, reclaim and horizon: number, bounce rate, mean return and excursions, and target-first rate after the events."""
    j = events.join(outcomes, [KEY, TS])
    return j.groupBy("level", "depth", "reclaim", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("bounce_rate"), F.avg("r").alias("mean_ret"), F.avg("up").alias("mean_up"), F.avg("down").alias("mean_down"), F.avg(F.col("target_first").cast("double")).alias("target_first_rate")
    )


def event_study_null(events: DataFrame, pool: DataFrame, outcomes: DataFrame, session: str = "session", reps: int = 20, seed: int = 7) -> DataFrame:
    """The study beside its matched null: each event against `reps` bars of its session drawn by a hash. Adds null_n, null_bounce_rate, null_ret, null_target_first_rate
    and excess, the difference of the mean returns.
    """
    from orderloom.operators.joins import null_sample_join

    marked = events.join(pool.select(KEY, TS, session), [KEY, TS])
    drawn = null_sample_join(marked, pool, session, reps, seed).select("level", "depth", "reclaim", F.col("null_symbol").alias(KEY), F.col("null_ts").alias(TS))
    by = ["level", "depth", "reclaim", "horizon"]
    null = event_study(drawn, outcomes).select(*by, F.col("n").alias("null_n"), F.col("bounce_rate").alias("null_bounce_rate"), F.col("mean_ret").alias("null_ret"), F.col("target_first_rate").alias("null_target_first_rate"))
    return event_study(events, outcomes).join(null, by, "left").withColumn("excess", F.col("mean_ret") - F.col("null_ret"))


def zone_edges(bars: DataFrame, horizon: int, spread: float) -> DataFrame:
    """Mean long and short return of every bar by zone, net of the spread."""
    f = forward_return(bars, horizon).withColumn("r", F.col(f"fwd_ret_{horizon}")).where("r is not null")
    return f.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r") - spread).alias("long_net"), F.avg(-F.col("r") - spread).alias("short_net"))


def best_partner(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """For each column of a the column of b with the largest |Spearman| on shared bars."""
    j = a.select(KEY, TS, *left).join(b.select(KEY, TS, *[F.col(c).alias(f"r_{c}") for c in right]), [KEY, TS])
    x = j.unpivot([KEY, TS, *[f"r_{c}" for c in right]], left, "column", "x").unpivot([KEY, TS, "column", "x"], [f"r_{c}" for c in right], "partner", "y")
    ic = M.rank_correlation(x.where("x is not null and y is not null"), "column", "partner")
    top = F.row_number().over(Window.partitionBy("column").orderBy(F.abs(F.round("spearman", 9)).desc(), "partner"))
    return ic.withColumn("_n", top).where("_n = 1").select("column", F.substring("partner", 3, 1000).alias("partner"), "spearman")


def zone_strategy(df: DataFrame, spread: float = 0.01) -> DataFrame:
    """Every-bar long and short in R, net of the spread, by zone. df: long_win, short_win, session, atr (target 1.5, stop 1)."""
    r = lambda w: F.when(F.col(w) == 1, 1.5).otherwise(-1.0) - spread / F.greatest("atr", F.lit(EPS))
    return df.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.avg(r("long_win")).alias("long_r"), F.avg(r("short_win")).alias("short_r"))


def side_policy(df: DataFrame, cost: float) -> DataFrame:
    """Win share weighted by confidence, cost and expectation by bucket and side."""
    w = F.greatest(F.abs("ofi"), F.lit(0.01))
    g = df.where("label is not null").groupBy("structure_bucket", (F.col("ofi") >= 0).alias("long_side"))
    win = F.sum(F.when(F.col("label") * F.when(F.col("ofi") >= 0, 1).otherwise(-1) > 0, w).otherwise(0.0)) / F.sum(w)
    return g.agg(F.count(F.lit(1)).alias("n"), win.alias("win"), (2 * win - 1 - cost).alias("expectation"))


def book_shares(ticks: DataFrame, book: DataFrame) -> DataFrame:
    """Of each symbol: ticks, share of trades, mean spread in ticks and mean filled levels."""
    t = ticks.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_ticks"), F.avg(is_trade().cast("double")).alias("trade_share"))
    b = book.groupBy(KEY).agg(F.avg((F.get("ask_px", F.lit(0)) - F.get("bid_px", F.lit(0))) / 0.01).alias("spread_ticks"), F.avg(F.size(F.filter("bid_sz", lambda x: x > 0)).cast("double")).alias("filled_levels"))
    return t.join(b, KEY)


def health(df: DataFrame, required: list[str], forbidden: tuple[str, ...] = (), warn: float = 0.01, fail: float = 0.05, break_column: str = "session_break", lookback: int = 50, embargo: int = 24, ahead_bars: int = 24, least: int = 100) -> DataFrame:
    """check, value, status (ok, warn, fail): the null share of each required column (absent: all), the number of forbidden columns
    (targets that leak) that are there, and the samples whose window back and bars ahead hold no break.
    """
    n, i = F.count(F.lit(1)).over(Window.partitionBy(KEY)), F.row_number().over(by_time())
    near = F.sum(F.coalesce(F.col(break_column).cast("int"), F.lit(0))).over(by_time().rowsBetween(-lookback, ahead_bars)) if break_column in df.columns else F.lit(0)
    inside = (i > lookback) & (i <= n - embargo)
    rows = df.withColumn("_sample", (inside & (near == 0)).cast("bigint"))
    share = lambda c: F.avg(F.col(c).isNull().cast("double")) if c in df.columns else F.lit(1.0)
    checks = [F.struct(F.lit(f"nulls:{c}").alias("check"), share(c).alias("value")) for c in required]
    checks.append(F.struct(F.lit("forbidden").alias("check"), F.lit(float(len(set(forbidden) & set(df.columns)))).alias("value")))
    checks.append(F.struct(F.lit("samples").alias("check"), F.sum("_sample").cast("double").alias("value")))
    out = rows.agg(F.array(*checks).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    v = F.col("value")
    nulls = F.when(v > fail, "fail").when(v > warn, "warn").otherwise("ok")
    few = F.when(v < least, "fail").when(v < 10 * least, "warn").otherwise("ok")
    status = F.when(F.col("check") == "forbidden", F.when(v > 0, "fail").otherwise("ok")).when(F.col("check") == "samples", few).otherwise(nulls)
    return out.withColumn("status", status)
