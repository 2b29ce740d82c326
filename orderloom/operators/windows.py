"""Window features of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from orderloom.functions.scan import Recurrence, affine_scan, ewm, numbered, scan
from orderloom.operators.clean import micros
from orderloom.spec import KEY, SESSIONS, TS, ahead, by_time, exact_mean, median, so_far, trailing

EPS = 1e-9


def day() -> WindowSpec:
    return Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS)


def day_so_far() -> WindowSpec:
    return day().rowsBetween(Window.unboundedPreceding, 0)


def session_break_flag(bars: DataFrame, factor: float = 3.0) -> DataFrame:
    """True where the step from the previous bar exceeds `factor` times the symbol's median step."""
    gap = bars.withColumn("_gap", micros() - F.lag(micros()).over(by_time()))
    mid = gap.groupBy(KEY).agg(median("_gap").alias("_mid"))
    return gap.join(F.broadcast(mid), KEY).withColumn("session_break", F.coalesce(F.col("_gap") > factor * F.col("_mid"), F.lit(False))).drop("_gap", "_mid")


def true_range_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range (previous close ignored across a break, if session_break is there) and its n-mean; before n bars the mean so far."""
    prev = F.lag("close").over(by_time())
    if "session_break" in bars.columns:
        prev = F.when(~F.col("session_break"), prev)
    bars = bars.withColumn("_p", prev)
    tr = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - F.col("_p")), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - F.col("_p")), F.lit(0.0)))
    return bars.withColumn("tr", tr).drop("_p").withColumn("atr", exact_mean(F.col("tr"), trailing(n)))


def wilder_atr(bars: DataFrame, n: int = 14, seed: str = "mean") -> DataFrame:
    """atr_t = atr_(t-1) + (tr_t - atr_(t-1)) / n, from the mean of the first n ranges on (seed "mean") or from the first range."""
    df = bars.withColumn("_n", F.row_number().over(by_time())).withColumn("_m", F.avg("tr").over(trailing(n)))
    start = n if seed == "mean" else 1
    a = F.when(F.col("_n") <= start, 0.0).otherwise(1 - 1 / n)
    b = F.when(F.col("_n") < start, 0.0).when(F.col("_n") == start, F.col("_m") if seed == "mean" else F.col("tr")).otherwise(F.col("tr") / n)
    out = affine_scan(df, a, b, "wilder_atr")
    return out.withColumn("wilder_atr", F.when(F.col("_n") >= start, F.col("wilder_atr"))).drop("_n", "_m")


def rolling_vwap_distance(bars: DataFrame, n: int = 20) -> DataFrame:
    w = trailing(n, back=1)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    bars = bars.withColumn("_pv", typical * F.col("volume"))
    vwap = F.when(F.count("volume").over(w) == n, F.sum("_pv").over(w) / F.greatest(F.sum("volume").over(w), F.lit(EPS)))
    return bars.withColumn("vwap_anchor", vwap).withColumn("vwap_distance", (F.col("close") - F.col("vwap_anchor")) / F.greatest("atr", F.lit(EPS))).drop("_pv")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from simple means; 50 before n changes."""
    bars = bars.withColumn("_d", F.col("close") - F.lag("close").over(by_time()))
    w = trailing(n)
    bars = bars.withColumn("_u", F.greatest("_d", F.lit(0.0))).withColumn("_v", F.greatest(-F.col("_d"), F.lit(0.0))).withColumn("_u", F.when(F.col("_d").isNotNull(), F.col("_u"))).withColumn("_v", F.when(F.col("_d").isNotNull(), F.col("_v")))
    up, down = F.avg("_u").over(w), F.avg("_v").over(w)
    return bars.withColumn("rsi", F.when(F.count("_d").over(w) == n, 100 - 100 / (1 + up / (down + EPS))).otherwise(50.0)).drop("_d", "_u", "_v")


def macd_histogram(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponential means, less its own exponential mean: one recurrence of three numbers."""
    f, s, g = (2 / (n + 1) for n in (fast, slow, signal))
    close = F.col("close")
    means = Recurrence(["_f", "_s", "_g"], [[1 - f, 0, 0], [0, 1 - s, 0], [g * (1 - f), -g * (1 - s), 1 - g]], [f * close, s * close, g * (f - s) * close], [close, close, 0.0])
    df = scan(bars, [means]).withColumn("macd", F.col("_f") - F.col("_s"))
    return df.withColumn("macd_hist", F.col("macd") - F.col("_g")).drop("_f", "_s", "_g")


def multi_horizon_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 4, 12)) -> DataFrame:
    for h in horizons:
        bars = bars.withColumn(f"ret_{h}", F.col("close") / F.lag("close", h).over(by_time()) - 1).withColumn(f"vol_ratio_{h}", F.col("volume") / F.greatest(F.avg("volume").over(trailing(h)), F.lit(EPS)))
    return bars


def candle_shape(bars: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return bars.withColumn("range_atr", span / F.greatest("atr", F.lit(EPS))).withColumn("body_ratio", F.abs(F.col("close") - F.col("open")) / F.greatest(span, F.lit(EPS))).withColumn("wick_balance", ((F.col("high") - top) - (bottom - F.col("low"))) / F.greatest("atr", F.lit(EPS)))


def in_session(name: str, ts: str = TS) -> Column:
    a, b = SESSIONS[name]
    return (F.hour(ts) >= a) & (F.hour(ts) < b)


def session_name(ts: str = TS) -> Column:
    return F.when(in_session("overlap", ts), "overlap").when(in_session("ny", ts), "ny").when(in_session("london", ts), "london").when(in_session("asia", ts), "asia").otherwise("off")


def session_flags(bars: DataFrame) -> DataFrame:
    for s in ("london", "overlap", "ny"):
        bars = bars.withColumn(f"is_{s}", in_session(s).cast("int"))
    return bars.withColumn("session", session_name())


def session_running_levels(bars: DataFrame, start: int = 7, end: int = 12) -> DataFrame:
    """Running high and low of the day's hours from start to end, frozen after; the close before."""
    inside = (F.hour(TS) >= start) & (F.hour(TS) < end)
    hi, lo = F.max(F.when(inside, F.col("high"))).over(day_so_far()), F.min(F.when(inside, F.col("low"))).over(day_so_far())
    bars = bars.withColumn("sess_high", F.coalesce(hi, F.col("close"))).withColumn("sess_low", F.coalesce(lo, F.col("close")))
    return bars.withColumn("dist_sess_high", (F.col("sess_high") - F.col("close")) / F.greatest("atr", F.lit(EPS))).withColumn("dist_sess_low", (F.col("close") - F.col("sess_low")) / F.greatest("atr", F.lit(EPS)))


def asia_distances(bars: DataFrame) -> DataFrame:
    a = in_session("asia")
    hi, lo = F.max(F.when(a, F.col("high"))).over(day_so_far()), F.min(F.when(a, F.col("low"))).over(day_so_far())
    return bars.withColumn("dist_asia_high", (F.col("close") - F.coalesce(hi, F.col("close"))) / F.greatest("atr", F.lit(EPS))).withColumn("dist_asia_low", (F.col("close") - F.coalesce(lo, F.col("close"))) / F.greatest("atr", F.lit(EPS))).withColumn("vol_session_ratio", F.col("volume") / F.greatest(F.avg("volume").over(day_so_far()), F.lit(EPS)))


def previous_period_levels(bars: DataFrame) -> DataFrame:
    """High and low of the previous day and week with bars; before there is one, those of the period so far."""
    for name, period in (("day", F.to_date(TS)), ("week", F.date_trunc("week", TS).cast("date"))):
        bars = bars.withColumn("_p", period)
        agg = bars.groupBy(KEY, "_p").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
        w = Window.partitionBy(KEY).orderBy("_p")
        prev = agg.select(KEY, "_p", F.lag("_h").over(w).alias("_ph"), F.lag("_l").over(w).alias("_pl"))
        run = Window.partitionBy(KEY, "_p").orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
        bars = bars.join(prev, [KEY, "_p"], "left").withColumn(f"prev_{name}_high", F.coalesce("_ph", F.max("high").over(run))).withColumn(f"prev_{name}_low", F.coalesce("_pl", F.min("low").over(run))).drop("_p", "_ph", "_pl")
    span = F.col("prev_day_high") - F.col("prev_day_low")
    return bars.withColumn("range_position", F.least(F.greatest((F.col("close") - F.col("prev_day_low")) / F.greatest(span, F.lit(EPS)), F.lit(0.0)), F.lit(1.0)))


def mid_levels(bars: DataFrame) -> DataFrame:
    """Previous day's midpoint, and each session's running high and low up to the previous bar of it."""
    bars = bars.withColumn("prev_day_mid", (F.col("prev_day_high") + F.col("prev_day_low")) / 2)
    before = day().rowsBetween(Window.unboundedPreceding, -1)
    for s in ("asia", "london", "ny"):
        bars = bars.withColumn(f"{s}_high", F.max(F.when(in_session(s), F.col("high"))).over(before)).withColumn(f"{s}_low", F.min(F.when(in_session(s), F.col("low"))).over(before))
    return bars


def zone_and_third(bars: DataFrame) -> DataFrame:
    """The session and which third of it the bar starts in (0 to 2, null outside)."""
    minute = F.hour(TS) * 60 + F.minute(TS)
    third = None
    for s in ("overlap", "ny", "london", "asia"):
        a, b = SESSIONS[s]
        value = F.floor((minute - a * 60) * 3 / ((b - a) * 60))
        third = F.when(in_session(s), value) if third is None else third.when(in_session(s), value)
    return bars.withColumn("zone", session_name()).withColumn("third", third.cast("int"))


def level_events(bars: DataFrame, levels: list[str], near: float = 0.5, touch: float = 0.1) -> DataFrame:
    """For each level: near, touch, reject, break or failed_break; a later rule of this order wins."""
    long = bars.withColumn("_pc", F.lag("close").over(by_time())).unpivot([KEY, TS, "close", "high", "low", "atr", "_pc"], levels, "level", "price").where("price is not null")
    d, unit = F.abs(F.col("close") - F.col("price")), F.greatest("atr", F.lit(EPS))
    over, under = F.col("high") >= F.col("price"), F.col("low") <= F.col("price")
    broke = ((F.col("_pc") < F.col("price")) & (F.col("close") > F.col("price"))) | ((F.col("_pc") > F.col("price")) & (F.col("close") < F.col("price")))
    failed = ((F.col("_pc") < F.col("price")) & over & (F.col("close") < F.col("price"))) | ((F.col("_pc") > F.col("price")) & under & (F.col("close") > F.col("price")))
    event = F.when(failed & (d > touch * unit), "failed_break").when(broke, "break").when(over & under & (d > touch * unit), "reject").when(d <= touch * unit, "touch").when(d <= near * unit, "near")
    return long.select(KEY, TS, "level", event.alias("event")).where("event is not null")


def atr_level_distances(bars: DataFrame, levels: list[str]) -> DataFrame:
    return bars.select("*", *[((F.col("close") - F.col(c)) / F.greatest("atr", F.lit(EPS))).alias(f"dist_{c}") for c in levels])


def flow_bar_features(bars: DataFrame, strong: float = 0.3) -> DataFrame:
    """Flow over volume within 1, flow over ATR, and the length of the run of strong bars of one sign."""
    share = F.least(F.abs("cvd_delta") / F.greatest("volume", F.lit(EPS)), F.lit(1.0))
    bars = bars.withColumn("flow_share", share).withColumn("flow_atr", F.abs("cvd_delta") / F.greatest("atr", F.lit(EPS)))
    bars = bars.withColumn("_s", F.when(F.col("flow_share") >= strong, F.signum("cvd_delta")).otherwise(0.0))
    return runs(bars, "_s", "flow_streak").withColumn("flow_streak", F.when(F.col("_s") != 0, F.col("flow_streak")).otherwise(0)).drop("_s")


def runs(df: DataFrame, column: str, out: str) -> DataFrame:
    """How many rows in sequence have had the value, this one included (gaps and islands)."""
    change = (~F.col(column).eqNullSafe(F.lag(column).over(by_time()))).cast("int")
    df = df.withColumn("_g", F.sum("_x").over(so_far())) if "_x" in df.columns else df.withColumn("_x", change).withColumn("_g", F.sum("_x").over(so_far()))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(KEY, "_g").orderBy(TS))).drop("_x", "_g")


def consecutive_runs(bars: DataFrame) -> DataFrame:
    """Lengths of the run of rising and of falling closes."""
    d = F.signum(F.col("close") - F.lag("close").over(by_time()))
    df = runs(bars.withColumn("_d", F.coalesce(d, F.lit(0.0))), "_d", "_n")
    return df.withColumn("up_run", F.when(F.col("_d") > 0, F.col("_n")).otherwise(0)).withColumn("down_run", F.when(F.col("_d") < 0, F.col("_n")).otherwise(0)).drop("_d", "_n")


def seasonal_calendar(bars: DataFrame) -> DataFrame:
    """The calendar columns of a bar's time: minutes since and to the edges of the sessions (0 outside), phase (0 first and 2 last
    half hour, 1 between, 3 outside; New York goes before London), weekday, month, quarter, year and week, weeks of clock changes.
    """
    date, minute = F.to_date(TS), F.hour(TS) * 60 + F.minute(TS)
    turn = lambda x, n: 2 * 3.141592653589793 * x / n
    dow, dom, month, woy = F.weekday(date), F.dayofmonth(date), F.month(date), F.weekofyear(date)
    left = F.datediff(F.last_day(date), date)
    out, phase = {}, F.lit(3)
    for name in ("london", "ny"):
        a, b = (60 * h for h in SESSIONS[name])
        inside = (minute >= a) & (minute < b)
        out[f"minutes_since_{name}_open"] = F.when(inside, minute - a).otherwise(0)
        out[f"minutes_to_{name}_close"] = F.when(inside, b - minute).otherwise(0)
        phase = F.when(inside, F.when(minute - a < 30, 0).when(b - minute < 30, 2).otherwise(1)).otherwise(phase)
    flag = lambda c: c.cast("int")
    clocks = (month == 3) & dom.between(8, 14) | (month == 11) & (dom <= 7) | month.isin(3, 10) & (dom >= 25)
    out |= {
        "session_phase": phase, "dow_sin": F.sin(turn(dow, 7)), "dow_cos": F.cos(turn(dow, 7)), "is_monday": flag(dow == 0), "is_friday": flag(dow == 4),
        "dom": dom, "dom_sin": F.sin(turn(dom - 1, 31)), "dom_cos": F.cos(turn(dom - 1, 31)), "is_month_end": flag(left <= 1), "is_month_start": flag(dom <= 2),
        "is_quarter_end": flag(month.isin(3, 6, 9, 12) & (left <= 4)), "is_year_end": flag((month == 12) & (left <= 4)),
        "woy_sin": F.sin(turn(woy, 52)), "woy_cos": F.cos(turn(woy, 52)), "is_first_week_of_year": flag(woy == 1),
        "is_clock_change_week": flag(clocks), "is_event_window": F.lit(0),
    }
    return bars.withColumns(out)


def cyclic_time(bars: DataFrame) -> DataFrame:
    pi2 = 2 * 3.141592653589793
    out = {f"{n}_{f}": getattr(F, f)(pi2 * x / m) for n, x, m in (("hour", F.hour(TS), 24), ("minute", F.minute(TS), 60)) for f in ("sin", "cos")}
    active = {f"{n}_active": F.hour(TS).between(SESSIONS[n][0], SESSIONS[n][1] - 1).cast("double") for n in ("london", "ny", "overlap")}
    return bars.withColumns(out | active)


def rolling_zscore(df: DataFrame, column: str, n: int = 100, least: int = 20, out: str | None = None) -> DataFrame:
    w = trailing(n)
    z = (F.col(column) - F.avg(column).over(w)) / (F.stddev_samp(column).over(w) + EPS)
    return df.withColumn(out or f"{column}_z", F.when(F.count(column).over(w) >= least, z).otherwise(0.0))


def rolling_rank(df: DataFrame, column: str, n: int = 50, least: int = 20) -> DataFrame:
    """Share of the trailing window at or below the current value."""
    w = trailing(n)
    df = df.withColumn("_w", F.collect_list(column).over(w))
    return df.withColumn(f"{column}_rank", F.when(F.size("_w") >= least, F.size(F.filter("_w", lambda v: v <= F.col(column))) / F.size("_w"))).drop("_w")


def diff_mean_z_bundle(df: DataFrame, columns: list[str], n: int = 20, imbalance: str | None = None) -> DataFrame:
    """Difference (0 first), mean and z of each column over the last n rows or those there are; with an imbalance column also
    its state: 1 where its deviation is above the median of all its deviations so far.
    """
    w = trailing(n)
    for c in columns:
        x = F.coalesce(F.col(c), F.lit(0.0))
        sd = F.stddev_samp(x).over(w)
        df = df.withColumns({
            f"{c}_diff": F.coalesce(x - F.lag(x).over(by_time()), F.lit(0.0)), f"{c}_mean": F.avg(x).over(w),
            f"{c}_z": F.coalesce((x - F.avg(x).over(w)) / F.when(sd == 0, EPS).otherwise(sd), F.lit(0.0)),
        })
    if imbalance:
        df = df.withColumn("_sd", F.round(F.coalesce(F.stddev_samp(F.coalesce(F.col(imbalance), F.lit(0.0))).over(w), F.lit(0.0)), 9))
        df = df.withColumn("volatility_state", (F.col("_sd") > median("_sd").over(so_far())).cast("int")).drop("_sd")
    return df


def rolling_ols_slope(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    df = df.withColumn("_i", F.row_number().over(by_time()).cast("double"))
    w = trailing(n)
    return df.withColumn(f"{column}_slope", F.when(F.count(column).over(w) == n, F.regr_slope(column, "_i").over(w))).withColumn(f"{column}_momentum", F.col(column) - F.lag(column, n).over(by_time())).drop("_i")


def ewma_volatility(bars: DataFrame, decay: float = 0.94, n: int = 20) -> DataFrame:
    """Exponentially weighted variance of log returns, and its standing against the plain deviation: 0 below, 1 about, 2 above."""
    df = bars.withColumn("_r", F.coalesce(F.log(F.col("close") / F.lag("close").over(by_time())), F.lit(0.0))).withColumn("_r2", F.col("_r") * F.col("_r"))
    df = ewm(df, "_r2", 1 - decay, "ewma_var").withColumn("_sd", F.stddev_samp("_r").over(trailing(n)))
    ratio = F.sqrt("ewma_var") / (F.col("_sd") + EPS)
    return df.withColumn("vol_regime", F.when(ratio < 0.8, 0).when(ratio > 1.2, 2).otherwise(1)).drop("_r", "_r2", "_sd")


def fractional_weights(d: float = 0.4, threshold: float = 1e-5, most: int = 512) -> tuple[list[float], bool]:
    """The weights of a fractional difference down to the threshold, `most` of them at most, and whether that cut them short."""
    weights, k = [1.0], 1
    while abs(w := -weights[-1] * (d - k + 1) / k) >= threshold:
        if k == most:
            return weights, True
        weights.append(w)
        k += 1
    return weights, False


def fractional_difference(df: DataFrame, column: str, d: float = 0.4, threshold: float = 1e-5, most: int = 512) -> DataFrame:
    """Fixed-width fractional difference, null before the width is there; fd_cut tells whether `most` cut its weights short."""
    weights, short = fractional_weights(d, threshold, most)
    arr = F.array(*[F.lit(w) for w in reversed(weights)])
    df = df.withColumn("_w", F.collect_list(column).over(trailing(len(weights))))
    value = F.aggregate(F.zip_with("_w", arr, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(f"{column}_fd", F.when(F.size("_w") == len(weights), value)).withColumn("fd_cut", F.lit(short)).drop("_w")


def daily_range_fuel(bars: DataFrame, n: int = 20, least: int = 3, default_range: float = 0.8, tick: float = 0.01, first_hour: int = 8) -> DataFrame:
    """The median range of the last n completed days (a default before `least` of them), what the day has left of it, whether
    that is a tenth at most, and the state of the day's first hour: 1 for a close above it, -1 below it, 0 else.
    """
    bars = bars.withColumn("_d", F.to_date(TS))
    daily = bars.groupBy(KEY, "_d").agg(F.greatest(F.max("high") - F.min("low"), F.lit(tick)).alias("_r"))
    w = Window.partitionBy(KEY).orderBy("_d").rowsBetween(-n, -1)
    usual = F.when(F.count("_r").over(w) >= least, median("_r").over(w)).otherwise(default_range)
    daily = daily.select(KEY, "_d", F.greatest(usual, F.lit(tick)).alias("usual_range"))
    run = F.max("high").over(day_so_far()) - F.min("low").over(day_so_far())
    first = F.hour(TS) == first_hour
    top, low = F.max(F.when(first, F.col("high"))).over(day_so_far()), F.min(F.when(first, F.col("low"))).over(day_so_far())
    out = bars.join(daily, [KEY, "_d"], "left").withColumn("_run", run)
    left = F.round(F.greatest(F.col("usual_range") - F.col("_run"), F.lit(0.0)), 6)
    return out.withColumns({
        "range_used": F.col("_run") / F.col("usual_range"), "range_left": left, "range_spent": (left <= F.col("usual_range") * 0.1).cast("int"),
        "first_hour_state": F.when(first, 0).when(F.col("close") > top, 1).when(F.col("close") < low, -1).otherwise(0),
    }).drop("_d", "_run")


def level_gains(obs_noise: float, trans_noise: float) -> list[float]:
    """Gains of the local-level filter until they stay the same; the first row is taken as it is, its variance being 1."""
    p = obs_noise / (1 + obs_noise)  # what is left of a variance of 1 after the first row
    gains: list[float] = []
    while len(gains) < 2 or abs(gains[-1] - gains[-2]) > 1e-15:
        p += trans_noise
        gains.append(p / (p + obs_noise))
        p *= 1 - gains[-1]
    return gains


def trend_gains(process_var: float, obs_var: float) -> list[tuple[float, float]]:
    """Gains of level and slope of the local linear trend until they stay the same, from unit variances."""
    import numpy as np

    move, p = np.array([[1.0, 1.0], [0.0, 1.0]]), np.eye(2)
    gains: list[tuple[float, float]] = []
    while len(gains) < 2 or max(abs(x - y) for x, y in zip(gains[-1], gains[-2], strict=True)) > 1e-15:
        p = move @ p @ move.T + np.eye(2) * process_var
        k = p[:, 0] / (p[0, 0] + obs_var)
        p = p - np.outer(k, p[0])
        gains.append((float(k[0]), float(k[1])))
    return gains


def local_level_trend(
    bars: DataFrame, obs_noise: float = 1e-3, trans_noise: float = 1e-5, process_var: float = 1e-4, obs_var: float = 1e-2, slope_threshold: float = 0.05
) -> DataFrame:
    """Kalman filters of the close. level and trend_sign: the local level and the sign of its step. trend_level and trend_slope:
    level and slope of the local linear trend; trend_strength: the slope's size by the largest so far; trend: 1 or -1 where that
    share passes the threshold, else 0.

    Gains do not depend on the data: they are worked out beforehand by row number, so each filter is a linear recurrence with
    known factors. A missing close takes the last one.
    """
    close = F.coalesce("close", F.last("close", ignorenulls=True).over(so_far()), F.lit(0.0))
    one, two = level_gains(obs_noise, trans_noise), trend_gains(process_var, obs_var)
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), F.least(n, F.lit(len(values))).cast("int"))
    df = numbered(bars.withColumn("_z", close), "_n")
    df = df.withColumn("_k", F.when(F.col("_n") == 1, 1.0).otherwise(at(one, F.greatest(F.col("_n") - 1, F.lit(1)))))
    df = df.withColumn("_k0", at([k for k, _ in two], F.col("_n"))).withColumn("_k1", at([k for _, k in two], F.col("_n")))
    k, k0, k1, z = (F.col(c) for c in ("_k", "_k0", "_k1", "_z"))
    level = Recurrence(["level"], [[1 - k]], [k * z], [0.0])
    trend = Recurrence(["trend_level", "trend_slope"], [[1 - k0, 1 - k0], [-k1, 1 - k1]], [k0 * z, k1 * z], [z, 0.0])
    df = scan(df, [level, trend]).drop("_n", "_z", "_k", "_k0", "_k1")
    share = F.col("trend_slope") / F.greatest(F.max(F.abs("trend_slope")).over(so_far()), F.lit(1e-10))
    df = df.withColumn("trend_sign", F.coalesce(F.signum(F.col("level") - F.lag("level").over(by_time())), F.lit(0.0))).withColumn("_share", share)
    side = F.when(F.col("_share") > slope_threshold, 1).when(F.col("_share") < -slope_threshold, -1).otherwise(0)
    return df.withColumn("trend", side).withColumn("trend_strength", F.abs("_share")).drop("_share")


def causal_window_bundle(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    w = trailing(n, back=1)
    return df.select("*", F.avg(column).over(w).alias(f"{column}_lag_mean"), F.stddev_samp(column).over(w).alias(f"{column}_lag_std"), F.min(column).over(w).alias(f"{column}_lag_min"), F.max(column).over(w).alias(f"{column}_lag_max"))


def warmup_mask(bars: DataFrame, n: int = 20) -> DataFrame:
    """True for the first n bars after the start and after each break."""
    df = bars.withColumn("_g", F.sum(F.col("session_break").cast("int")).over(so_far()))
    return df.withColumn("warmup", F.row_number().over(Window.partitionBy(KEY, "_g").orderBy(TS)) <= n).drop("_g")


def session_interactions(bars: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        for s in ("london", "ny"):
            bars = bars.withColumn(f"{c}_x_{s}", F.col(c) * in_session(s).cast("int"))
    return bars


def fallback_fill(df: DataFrame, pairs: dict[str, str], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Primary columns, or their stand-ins where they are null or not a number, within limits."""
    for first, other in pairs.items():
        lo, hi = limits.get(first, (-1e300, 1e300))
        df = df.withColumn(first, F.least(F.greatest(F.coalesce(F.nanvl(F.col(first), F.lit(None).cast("double")), F.col(other)), F.lit(lo)), F.lit(hi)))
    return df


def forward_return(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn(f"fwd_ret_{n}", F.lead("close", n).over(by_time()) / F.col("close") - 1)


def break_free(bars: DataFrame, n: int) -> Column:
    """True where none of the next n bars starts a session after a break, and there are n."""
    w = ahead(n)
    return (F.coalesce(F.sum(F.col("session_break").cast("int")).over(w), F.lit(0)) == 0) & (F.count(TS).over(w) == n)
