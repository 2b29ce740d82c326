"""Regimes from range, intensity, flow and activity; excursion diagnostics, structural weights and wall breaks of labelled bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.stage import staged
from orderloom.operators.stats import percentiles
from orderloom.spec import KEY, TS, ahead, bucket, median, trailing

EPS = 1e-12


def regime_labels(
    bars: DataFrame, *, intensity: str, flow: str, activity: str, trend: str | None = None, atr: str = "atr", window: int = 100, least: int = 20,
    volatile_ratio: float = 1.5, volatile_z: float = 1.5, trending_ratio: float = 0.8, trending_strength: float = 0.55, low_share: float = 0.5,
) -> DataFrame:
    """Adds regime, the first that holds: low_liquidity (activity below a share of its median), volatile (range over its median by the ratio and
    intensity over its mean by so many deviations), trending (range over the lower ratio and flow over its median, or a strong trend),
    else ranging. Windows end at the bar; until `least` bars none but flow can tell a bar from ranging.
    """
    w = trailing(window)
    ready = F.count(F.lit(1)).over(w) >= least
    of = lambda f, c: F.when(ready, f(F.coalesce(c, F.lit(0.0))).over(w))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    b = bars.withColumns({"_a": zero(atr), "_i": zero(intensity), "_f": F.abs(zero(flow)), "_l": F.col(activity).cast("double"), "_t": F.abs(zero(trend)) if trend else F.lit(0.0)})
    middle = of(median, F.col("_a"))
    b = b.withColumn("_r", F.coalesce(F.col("_a") / F.when(middle != 0, middle), F.lit(1.0)))
    b = b.withColumn("_z", F.coalesce((F.col("_i") - of(F.avg, F.col("_i"))) / (of(F.stddev_samp, F.col("_i")) + 1e-9), F.lit(0.0))).withColumn("_m", F.coalesce(of(median, F.col("_f")), F.lit(0.0)))
    quiet = F.coalesce(F.col("_l") < low_share * F.when(ready, median("_l").over(w)), F.lit(False))
    b = b.withColumns({c: F.round(c, 9) for c in ("_r", "_z", "_m", "_f", "_t")}).withColumn("_q", quiet)
    wild = (F.col("_r") > volatile_ratio) & (F.col("_z") > volatile_z)
    moving = (F.col("_r") > trending_ratio) & ((F.col("_f") > F.col("_m") + EPS) | (F.col("_t") > trending_strength))
    return b.withColumn("regime", F.when(F.col("_q"), "low_liquidity").when(wild, "volatile").when(moving, "trending").otherwise("ranging")).drop("_a", "_i", "_f", "_l", "_t", "_r", "_z", "_m", "_q")


# What a regime is called as a state of the market.
STATES = {"trending": "trend", "ranging": "chop", "volatile": "volatile", "low_liquidity": "liquidity_vacuum"}


def excursion_diagnostics(df: DataFrame, horizon: int = 24, spread_ticks: float = 1.0, tick: float = 0.0001, fees_atr: float = 0.05, small: float = 0.5, large: float = 2.0, late: float = 0.7) -> DataFrame:
    """Adds mfe, mae, mfe_atr, mae_atr, bars_to_touch, stop_first, expectancy, neutral_type, tradable, market_state.

    df: bars with close, atr, label (1, -1, 0 or null), is_event, regime. Excursions are of the next closes; bars_to_touch is the first at half an ATR either way,
    0 if none; stop_first: one ATR down comes before one ATR up. expectancy: the label's excursion in ATR less spread and fees, for
    neutral bars the larger one. neutral_type says why a bar has no side: non_event, data_quality, no_edge, stop_first, low_expectancy, late_move,
    ambiguous; of bars with a side it is directional.
    """
    atr = F.coalesce(F.col("atr"), F.lit(0.0))
    has = atr > EPS
    b = df.withColumn("_w", F.transform(F.collect_list("close").over(ahead(horizon)), lambda x: F.round(x - F.col("close"), 9)))
    there = has & (F.size("_w") > 0)
    best, worst = F.greatest(F.array_max("_w"), F.lit(0.0)), F.greatest(-F.array_min("_w"), F.lit(0.0))
    b = b.withColumns({"mfe": F.when(there, best).otherwise(0.0), "mae": F.when(there, worst).otherwise(0.0)})
    b = b.withColumns({f"{c}_atr": F.when(there, F.col(c) / atr).otherwise(0.0) for c in ("mfe", "mae")})
    first = lambda hit: F.array_position(F.transform("_w", lambda x: hit(x)), F.lit(True))
    up, down, touch = first(lambda x: x >= atr), first(lambda x: x <= -atr), first(lambda x: F.abs(x) >= small * atr)
    b = b.withColumn("bars_to_touch", F.when(there, touch).otherwise(0).cast("int")).withColumn("stop_first", (there & (down > 0) & ((up == 0) | (down < up))).cast("int"))
    cost = fees_atr + F.when(has, spread_ticks * tick / F.greatest(atr, F.lit(EPS))).otherwise(0.0)
    side = F.coalesce("label", F.lit(0))
    gain = F.when(side > 0, F.col("mfe_atr")).when(side < 0, F.col("mae_atr")).otherwise(F.greatest("mfe_atr", "mae_atr"))
    b = b.withColumn("expectancy", F.round(gain - cost, 9))
    f, a = F.round("mfe_atr", 9), F.round("mae_atr", 9)
    reason = (
        F.when(side != 0, "directional").when(~F.coalesce("is_event", F.lit(True)), "non_event").when(~has, "data_quality").when((f < small) & (a < small), "no_edge").when(F.col("stop_first") == 1, "stop_first")
        .when((f >= small) & (F.col("expectancy") < 0), "low_expectancy").when((f > large) & (F.col("bars_to_touch") > int(horizon * late)), "late_move").otherwise("ambiguous")
    )
    b = b.withColumn("neutral_type", reason).withColumn("tradable", ((side != 0) & (F.col("expectancy") > 0) & (F.col("stop_first") == 0)).cast("int"))
    state = F.lit("chop")
    for regime, name in STATES.items():
        state = F.when(F.col("regime") == regime, name).otherwise(state)
    return b.withColumn("market_state", state).drop("_w")


def ruin_chance(target: Column, stop: Column, sigma: Column, drift: Column | None = None, clip: float = 0.3) -> Column:
    """Chance of the target before the stop, both distances, of a walk with a deviation and, if given, a drift a bar within a share of it."""
    a, b, s = (F.greatest(c, F.lit(EPS)) for c in (target, stop, sigma))
    plain = b / (a + b)
    if drift is None:
        return plain
    mu = F.least(F.greatest(drift, -clip * s), clip * s)
    power = lambda d: F.exp(F.least(F.greatest(-2 * mu * d / (s * s), F.lit(-500.0)), F.lit(500.0)))
    rest = 1 - power(a + b)
    return F.least(F.greatest(F.when(F.abs(rest) < 1e-9, plain).otherwise((1 - power(b)) / rest), F.lit(0.005)), F.lit(0.995))


# Factors of quality 0, 1 and 2, limits of the horizon's factor, of a wall's and of the weight, and the wall strength of scale 1.
QUALITY_FACTOR, HORIZON_LIMITS, WALL_LIMITS, WEIGHT_LIMITS, WALL_SCALE = (0.60, 1.00, 1.40), (0.40, 1.60), (0.40, 1.20), (0.10, 3.50), 3.0


def ruin_weights(df: DataFrame, target: float = 1.5, stop: float = 1.0, power: float = 0.5, drift: Column | None = None) -> DataFrame:
    """Adds ruin_weight: the chance of the target before the stop (a half for neutral bars), times factors of horizon, wall and quality, by their mean.

    df: bars with atr (the unit of both distances), label, quality (0 to 2), horizon and the wall strengths of both sides. Shorter horizons than the median
    and stronger walls weigh more. Median and mean are of all rows.
    """
    label, unit = F.coalesce("label", F.lit(0)), F.coalesce("atr", F.lit(1e-4))
    chance = F.when(label == 0, 0.5).otherwise(ruin_chance(unit * target, unit * stop, unit, drift))
    b = df.withColumn("_h", F.greatest(F.coalesce(F.col("horizon").cast("double"), F.lit(20.0)), F.lit(1.0)))
    b = b.crossJoin(F.broadcast(percentiles(b.select("_h"), "_h", [0.5]).select(F.col("p0").alias("_mid"))))  # one row
    short = F.pow(1 / F.greatest(F.col("_h") / F.greatest("_mid", F.lit(1.0)), F.lit(0.1)), F.lit(power))
    wall = F.greatest(F.coalesce("bid_wall_strength", F.lit(0.0)), F.coalesce("ask_wall_strength", F.lit(0.0)))
    firm = WALL_LIMITS[0] + (WALL_LIMITS[1] - WALL_LIMITS[0]) / (1 + F.exp(-3.0 * wall / WALL_SCALE))
    good = F.when(F.col("quality") == 2, QUALITY_FACTOR[2]).when(F.coalesce("quality", F.lit(1)) == 1, QUALITY_FACTOR[1]).otherwise(QUALITY_FACTOR[0])
    within = lambda x, limits: F.least(F.greatest(x, F.lit(limits[0])), F.lit(limits[1]))
    b = staged(b.withColumn("_w", within(chance * within(short, HORIZON_LIMITS) * firm * good, WEIGHT_LIMITS)), "weights")
    b = b.crossJoin(F.broadcast(b.agg(F.avg("_w").alias("_mean"))))  # one row
    return b.withColumn("ruin_weight", within(F.when(F.col("_mean") > 1e-8, F.col("_w") / F.col("_mean")).otherwise(F.col("_w")), WEIGHT_LIMITS)).drop("_h", "_mid", "_w", "_mean")


def wall_break(bars: DataFrame, book: DataFrame, freq: str = "1 hour", n: int = 1, multiple: float = 5.0) -> DataFrame:
    """Adds wall_px, wall_side (1 ask, -1 bid) and wall_break: 1 if a high of the next n bars passes an ask wall, -1 if a low passes a bid wall, 0 if neither.

    The wall is the largest level over `multiple` times the median of the sizes in the bar's last snapshot (the deepest bid first on ties). All three
    are null without one, wall_break also without a next bar or, where bars have session_break, with a break among the next bars.
    """
    at = F.struct(TS, "seq")
    ladder = lambda side, sign: F.zip_with(f"{side}_px", f"{side}_sz", lambda p, z: F.struct(p.alias("p"), z.alias("z"), F.lit(sign).alias("side")))
    last = book.groupBy(KEY, bucket(freq).alias("_b")).agg(F.max_by(F.concat(F.reverse(ladder("bid", -1)), ladder("ask", 1)), at).alias("_x")).withColumnRenamed("_b", TS)
    sizes = F.sort_array(F.transform(F.filter("_x", lambda x: x["z"] > 0), lambda x: x["z"]))
    k = F.size(sizes)
    middle = (F.get(sizes, F.floor((k - 1) / 2).cast("int")) + F.get(sizes, F.floor(k / 2).cast("int"))) / 2
    last = last.withColumn("_m", middle).withColumn("_x", F.filter("_x", lambda x: x["z"] > multiple * F.col("_m")))
    most = F.array_max(F.transform("_x", lambda x: x["z"]))
    last = last.withColumn("_w", F.get(F.filter("_x", lambda x: x["z"] == most), F.lit(0))).select(KEY, TS, F.col("_w.p").alias("wall_px"), F.col("_w.side").alias("wall_side"))
    b = bars.join(last, [KEY, TS], "left")
    high, low = F.max("high").over(ahead(n)), F.min("low").over(ahead(n))
    clean = high.isNotNull()
    if "session_break" in bars.columns:
        clean = clean & (F.coalesce(F.max(F.col("session_break").cast("int")).over(ahead(n)), F.lit(0)) == 0)
    broken = F.when((F.col("wall_side") > 0) & (high > F.col("wall_px")), 1).when((F.col("wall_side") < 0) & (low < F.col("wall_px")), -1).otherwise(0)
    return b.withColumn("wall_break", F.when(F.col("wall_side").isNotNull() & clean, broken))
