"""Forward labels, event gates and regimes of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.stats import percentile_row
from orderloom.operators.windows import EPS, in_session, runs
from orderloom.spec import KEY, TS, ahead, by_time, median, trailing


def triple_barrier(
    bars: DataFrame, tp: float = 1.0, sl: float = 1.0, horizon: int = 24, min_atr: float = 1e-6, regimes: dict[str, tuple[float, int]] | None = None,
    session_ends: dict[str, int] | None = None, rescue_ratio: float | None = None, rescue_move: float = 1.0,
) -> DataFrame:
    """First touch of close +/- barriers by the next bars' highs and lows: label 1, -1, or 0 at the horizon.

    A bar that touches both goes to the side nearer to its open, the upper one on ties. One shuffle by symbol; each row
    sees its next `horizon` bars as an array. label_end is the touching bar, or the last one seen.
    regimes: barrier (for both sides) and horizon by the value of `regime`. session_ends: hours by the value of `session`
    (21 for others); bars from that hour on are not seen. rescue_ratio: a timeout takes the side whose excursion of closes
    is that many times the other's and at least rescue_move ATR. Adds outcome (up, down, timeout) and bars_held as well.
    """
    unit, up, down, cap = F.greatest("atr", F.lit(min_atr)), F.lit(tp), F.lit(sl), F.lit(horizon)
    for name, (size, bars_ahead) in (regimes or {}).items():
        here = F.col("regime") == name
        up, down, cap = F.when(here, size).otherwise(up), F.when(here, size).otherwise(down), F.when(here, bars_ahead).otherwise(cap)
    df = bars.withColumn("_up", F.col("close") + up * unit).withColumn("_dn", F.col("close") - down * unit)
    most = max([horizon, *(n for _, n in (regimes or {}).values())])
    df = df.withColumn("_w", F.collect_list(F.struct(F.col(TS).alias("t"), "open", "high", "low", "close")).over(ahead(most)))
    df = df.withColumn("_any", F.size("_w") > 0)
    if regimes:
        df = df.withColumn("_w", F.slice("_w", 1, cap))
    if session_ends:
        end = F.lit(21)
        for name, hour in session_ends.items():
            end = F.when(F.col("session") == name, hour).otherwise(end)
        at = F.array_position(F.transform("_w", lambda b: (F.hour(b["t"]) >= end).cast("int")), 1)
        df = df.withColumn("_w", F.slice("_w", 1, F.when(at > 0, at - 1).otherwise(F.size("_w")).cast("int")))
    k = F.array_position(F.transform("_w", lambda b: ((b["high"] >= F.col("_up")) | (b["low"] <= F.col("_dn"))).cast("int")), 1)
    df = df.withColumn("_k", k).withColumn("_h", F.when(F.col("_k") > 0, F.get("_w", (F.col("_k") - 1).cast("int"))))
    both = (F.col("_h.high") >= F.col("_up")) & (F.col("_h.low") <= F.col("_dn"))
    nearer = F.when(F.abs(F.col("_up") - F.col("_h.open")) <= F.abs(F.col("_h.open") - F.col("_dn")), 1).otherwise(-1)
    rest = F.lit(0)
    if rescue_ratio is not None:
        moves = F.transform("_w", lambda b: b["close"] - F.col("close"))
        won, lost = F.greatest(F.array_max(moves), F.lit(0.0)), F.greatest(-F.array_min(moves), F.lit(0.0))
        rest = F.when((won > rescue_ratio * lost) & (won >= rescue_move * unit), 1).when((lost > rescue_ratio * won) & (lost >= rescue_move * unit), -1).otherwise(0)
    label = F.when(F.col("_h").isNull(), rest).when(both, nearer).when(F.col("_h.high") >= F.col("_up"), 1).otherwise(-1)
    last = F.get("_w", F.size("_w") - 1)["t"]
    df = df.withColumns({"label": F.when(F.col("_any"), label), "label_end": F.coalesce("_h.t", last), "bars_held": F.when(F.col("_any"), F.when(F.col("_k") > 0, F.col("_k")).otherwise(F.size("_w"))).cast("int")})
    outcome = F.when(F.col("_h").isNull(), "timeout").when(F.col("label") > 0, "up").otherwise("down")
    return df.withColumn("outcome", F.when(F.col("_any"), outcome)).drop("_up", "_dn", "_w", "_h", "_k", "_any")


def close_barrier_labels(bars: DataFrame, tp: float = 1.0, sl: float = 1.0, horizon: int = 24) -> DataFrame:
    """As triple_barrier, on closes only; valid where the whole horizon is there or a barrier was touched."""
    df = bars.withColumn("_up", F.col("close") + tp * F.col("atr")).withColumn("_dn", F.col("close") - sl * F.col("atr"))
    df = df.withColumn("_w", F.collect_list("close").over(ahead(horizon)))
    first = F.get(F.filter("_w", lambda c: (c >= F.col("_up")) | (c <= F.col("_dn"))), F.lit(0))
    df = df.withColumn("_f", first)
    label = F.when(F.col("_f") >= F.col("_up"), 1).when(F.col("_f") <= F.col("_dn"), -1).otherwise(0)
    return df.withColumn("close_label", label).withColumn("close_valid", F.col("_f").isNotNull() | (F.size("_w") == horizon)).drop("_up", "_dn", "_w", "_f")


def dual_side_scan(
    bars: DataFrame, target: float = 1.5, stop: float = 1.0, horizon: int = 24, unit: str | None = None, horizon_column: str | None = None,
    walls: tuple[str, str] | None = None, least_target: float = 0.02,
) -> DataFrame:
    """Whether a long and a short meet their target before their stop, on the next closes.

    unit: a column with each row's threshold (its ATR without one); horizon_column: each row's own horizon, `horizon` at
    most; walls: prices of the bid and ask wall ahead, short of which the target lies if that is at least least_target away.
    Adds the bar of the end of each side (null: timeout) and the path's side: the target met first, 0 for none.
    """
    df = bars.withColumn("_w", F.collect_list("close").over(ahead(horizon)))
    if horizon_column:
        df = df.withColumn("_w", F.slice("_w", 1, F.greatest(F.col(horizon_column), F.lit(0)).cast("int")))
    c, u = F.col("close"), F.greatest(F.col(unit or "atr"), F.lit(EPS))
    for side, sign, wall in (("long", 1, walls and walls[1]), ("short", -1, walls and walls[0])):
        far = target * u
        if wall:
            room = sign * (F.col(wall) - c)
            far = F.when(room >= least_target, F.least(far, room)).otherwise(far)
        df = df.withColumn("_t", far)
        moves = lambda v: sign * (v - c)  # noqa: B023, E731
        k = F.array_position(F.transform("_w", lambda v: ((moves(v) >= F.col("_t")) | (moves(v) <= -stop * u)).cast("int")), 1)  # noqa: B023
        df = df.withColumn("_k", k).withColumn(f"{side}_bar", F.when(F.col("_k") > 0, F.col("_k")).cast("int"))
        won = (F.col("_k") > 0) & (moves(F.get("_w", (F.col("_k") - 1).cast("int"))) >= F.col("_t"))
        df = df.withColumn(f"{side}_win", F.coalesce(won, F.lit(False)).cast("int"))
    first = (F.col("short_win") == 0) | (F.col("long_bar") <= F.col("short_bar"))
    return df.withColumn("first_side", F.when((F.col("long_win") == 1) & first, 1).when(F.col("short_win") == 1, -1).otherwise(0)).drop("_w", "_t", "_k")


def excursion_labels(bars: DataFrame, horizon: int = 12, ratio: float = 2.0, least: float = 0.25, usual: float = 0.5, history: int = 24, lookback: int = 96) -> DataFrame:
    """Largest favourable and adverse moves of the next bars, in ATR, the direction of one that is `ratio` times the other, and
    its quality: 2 at or above the 70th percentile of earlier directional moves (`usual` before `history` of them), else 1.
    """
    unit = F.greatest("atr", F.lit(EPS))
    up, down = (F.max("high").over(ahead(horizon)) - F.col("close")) / unit, (F.col("close") - F.min("low").over(ahead(horizon))) / unit
    df = bars.withColumn("mfe", F.round(F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))), 9)).withColumn("mae", F.round(F.when(down.isNotNull(), F.greatest(down, F.lit(0.0))), 9))
    side = F.when((F.col("mfe") > ratio * F.col("mae")) & (F.col("mfe") >= least), 1).when((F.col("mae") > ratio * F.col("mfe")) & (F.col("mae") >= least), -1).otherwise(0)
    df = df.withColumn("excursion_dir", side).withColumn("_s", F.when(F.col("excursion_dir") != 0, F.greatest("mfe", "mae")))
    w = trailing(lookback, back=1)
    bar = F.greatest(F.coalesce(F.when(F.count("_s").over(w) >= history, median("_s", 0.7).over(w)), F.lit(usual)), F.lit(0.8 * usual))
    return df.withColumn("_b", bar).withColumn("excursion_quality", F.when(F.col("_s").isNull(), 0).when(F.col("_s") >= F.col("_b"), 2).otherwise(1)).drop("_s", "_b")


def trend_veto(df: DataFrame, strength: float = 0.5) -> DataFrame:
    """Labels against a strong trend become neutral."""
    against = (F.signum("trend") * F.col("label") < 0) & (F.abs("trend") >= strength)
    return df.withColumn("vetoed_label", F.when(against, 0).otherwise(F.col("label")))


def log_target(bars: DataFrame, horizon: int = 4, clip: float = 0.05) -> DataFrame:
    r = F.log(F.lead("close", horizon).over(by_time()) / F.col("close"))
    return bars.withColumn("target_valid", r.isNotNull()).withColumn("log_target", F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-clip)), F.lit(clip))))


def label_stability(df: DataFrame, steps: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of the neighbours at these steps, both ways, with the same label."""
    near = [f(F.col("label"), s).over(by_time()) for s in steps for f in (F.lag, F.lead)]
    same = sum((F.coalesce((n == F.col("label")).cast("int"), F.lit(0)) for n in near), F.lit(0))
    there = sum((n.isNotNull().cast("int") for n in near), F.lit(0))
    return df.withColumn("label_stability", same / F.greatest(there, F.lit(1)))


def imbalance_flip_label(df: DataFrame, column: str, n: int = 6, floor: float = 0.1) -> DataFrame:
    frame = F.collect_list(column).over(ahead(n))
    flip = F.exists(frame, lambda v: (F.signum(v) == -F.signum(F.col(column))) & (F.abs(v) >= floor) & (F.signum(v) != 0))
    return df.withColumn("flip", flip.cast("int"))


def r_multiple_labels(df: DataFrame, horizon: int = 12, cap: float = 5.0) -> DataFrame:
    """How many ATR the label's side went in its favour, and its class: 0 none, 1 half, 2 one, 3 two or more."""
    best = F.when(F.col("label") >= 0, F.max("high").over(ahead(horizon)) - F.col("close")).otherwise(F.col("close") - F.min("low").over(ahead(horizon)))
    df = df.withColumn("max_r", F.least(F.greatest(best / F.greatest("atr", F.lit(EPS)), F.lit(0.0)), F.lit(cap)))
    return df.withColumn("r_class", F.when(F.col("max_r") >= 2, 3).when(F.col("max_r") >= 1, 2).when(F.col("max_r") >= 0.5, 1).otherwise(0))


def sweep_volume_label(bars: DataFrame, n: int = 6, factor: float = 3.0, window: int = 20) -> DataFrame:
    return bars.withColumn("_m", median("volume").over(trailing(window))).withColumn("volume_sweep", F.coalesce(F.max("volume").over(ahead(n)) >= factor * F.col("_m"), F.lit(False)).cast("int")).drop("_m")


def risk_tier_label(bars: DataFrame, window: int = 100, elevated: float = 1.3, extreme: float = 2.0) -> DataFrame:
    ratio = F.col("atr") / F.greatest(median("atr").over(trailing(window, back=1)), F.lit(EPS))
    return bars.withColumn("risk_tier", F.when(ratio >= extreme, 2).when(ratio >= elevated, 1).otherwise(0))


def bars_to_flip(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """Bars until the column's sign turns, n + 1 if it doesn't; null without the whole window."""
    frame = F.collect_list(column).over(ahead(n))
    at = F.array_position(F.transform(frame, lambda v: (F.signum(v) * F.signum(F.col(column)) < 0).cast("int")), 1)
    return df.withColumn("bars_to_flip", F.when(F.size(frame) == n, F.when(at > 0, at).otherwise(n + 1)))


def clean_segment_mask(bars: DataFrame, back: int = 10, forward: int = 10) -> DataFrame:
    w = by_time().rowsBetween(-back, forward)
    return bars.withColumn("clean_segment", F.sum(F.col("session_break").cast("int")).over(w) == 0)


def sequence_windows(df: DataFrame, columns: list[str], size: int = 16, stride: int = 4) -> DataFrame:
    """Overlapping windows of the columns, one each `stride` rows, with the last row's time."""
    df = df.withColumn("_i", F.row_number().over(by_time())).withColumn("window_rows", F.collect_list(F.struct(*columns)).over(trailing(size)))
    return df.where((F.size("window_rows") == size) & ((F.col("_i") - size) % stride == 0)).select(KEY, TS, "window_rows")


def soft_labels_rule(df: DataFrame, score: str = "event_score", held: str = "bars_held", most: int = 24) -> DataFrame:
    """Probability of the upper side: 0.55 to 1 for label 1, 0 to 0.45 for -1, by 0.6 of the event's score and 0.4 of its speed."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    strength = clip(0.6 * clip(F.coalesce(F.col(score), F.lit(0.0))) + 0.4 * clip(1 - F.coalesce(F.col(held), F.lit(0)) / most))
    p = F.when(F.col("label") == 1, 0.55 + 0.45 * strength).when(F.col("label") == -1, 0.45 - 0.45 * strength).otherwise(0.5)
    df = df.withColumn("p_up", p).withColumn("confidence", clip(F.abs(F.col("p_up") - 0.5) * 2))
    return df.withColumn("soft_weight", 1 + F.col("confidence"))


def embargo_tail(df: DataFrame, bars: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col(TS).desc()))
    return df.withColumn("_n", back).withColumn("label", F.when(F.col("_n") > bars, F.col("label"))).drop("_n")


def regime_rule(bars: DataFrame, window: int = 50, volatile: float = 1.4, trending: float = 0.6) -> DataFrame:
    """low_liquidity, volatile, trending or ranging; the first that holds, on past rows only."""
    w = trailing(window, back=1)
    calm = F.col("volume") < 0.3 * median("volume").over(w)
    wild = F.col("atr") > volatile * median("atr").over(w)
    move = F.abs(F.col("close") - F.lag("close", 10).over(by_time())) / F.greatest(10 * F.col("atr"), F.lit(EPS))
    return bars.withColumn("regime", F.when(calm, "low_liquidity").when(wild, "volatile").when(move > trending, "trending").otherwise("ranging"))


def regime_group_rare(df: DataFrame, rare: tuple[str, ...], name: str = "other") -> DataFrame:
    return df.withColumn("regime", F.when(F.col("regime").isin(*rare), name).otherwise(F.col("regime")))


def regime_session_label(df: DataFrame, least: int = 200, share: float = 0.005) -> DataFrame:
    """regime|session; combinations below the support become `other`."""
    df = df.withColumn("_l", F.concat_ws("|", "regime", "session"))
    n = df.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    keep = n.crossJoin(F.broadcast(total)).where(F.col("_n") >= F.greatest(F.lit(float(least)), share * F.col("_t"))).select("_l", F.col("_l").alias("_k"))
    return df.join(F.broadcast(keep), "_l", "left").withColumn("regime_session", F.coalesce("_k", F.lit("other"))).drop("_l", "_k")


def distribution_regime(bars: DataFrame, window: int = 50, train_until: str | None = None, trending: float = 0.6, volatile: float = 0.8, thin: float = 0.3) -> DataFrame:
    """Deviation, mean size and skew of returns and the standing of volume over the window, and the regime that they make.

    The limits are percentiles of the training rows (before train_until; all without it), one row that is broadcast.
    """
    w = trailing(window)
    r = bars.withColumn("ret", F.col("close") / F.lag("close").over(by_time()) - 1)
    n = F.count("ret").over(w)
    skew = F.when(n > 2, F.skewness("ret").over(w) * F.sqrt(n * (n - 1)) / (n - 2))
    r = r.withColumns({
        "ret_std": F.when(n >= 20, F.stddev_samp("ret").over(w)), "ret_l1": F.avg(F.abs("ret")).over(w), "ret_skew": F.when((n >= 20) & ~F.isnan(skew), skew),
        "liquidity_ratio": F.col("volume") / F.greatest(F.avg("volume").over(w), F.lit(EPS)),
    })
    r = r.withColumns({c: F.round(c, 12) for c in ("ret_std", "ret_l1", "ret_skew", "liquidity_ratio")})
    learn = r.where(F.col(TS) < F.lit(train_until).cast("timestamp_ntz")) if train_until else r
    limits = percentile_row(learn, {"ret_std": [volatile], "ret_l1": [trending]}).select(F.col("ret_std_p0").alias("_v"), F.col("ret_l1_p0").alias("_t"))
    regime = F.when(F.col("liquidity_ratio") < thin, "low_liquidity").when(F.col("ret_std") > F.col("_v"), "volatile").when(F.col("ret_l1") > F.col("_t"), "trending").otherwise("ranging")
    return r.crossJoin(F.broadcast(limits)).withColumn("regime", regime).drop("_v", "_t")


def range_context_runs(df: DataFrame, column: str, strength: float = 0.3, trend: str | None = None, walls: tuple[str, ...] = (), steps: int = 4) -> DataFrame:
    """Weak-trend flag (and neutral, if a trend column is given), the length of its run, the run's first bar and the first bar
    after it; for wall columns their change over the next `steps` bars (a target, not a feature).
    """
    weak = F.abs(F.col(column)) < strength
    df = df.withColumn("range_like", weak & (F.col(trend) == 0) if trend else weak)
    df = runs(df, "range_like", "range_run")
    before = F.coalesce(F.lag("range_like").over(by_time()), F.lit(False))
    df = df.withColumns({"range_start": (F.col("range_like") & ~before).cast("int"), "range_end": (~F.col("range_like") & before).cast("int")})
    return df.withColumns({f"{c}_ahead": F.lead(c, steps).over(by_time()) - F.col(c) for c in walls})


def micro_event_gate(df: DataFrame, weights: dict[str, float], threshold: float, scale: float = 1.0, shift: float = 0.0, least_rate: float = 0.0) -> DataFrame:
    """Weighted score of signals between 0 and 1, and the flag of scores over threshold * scale + shift.

    With a least rate, the bars with the highest positive scores are promoted until the rate over the whole table is reached
    (ties to the earlier time, then symbol). That looks at all rows, later ones too: not for features, only for sampling.
    """
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    df = df.withColumn("event_score", F.round(score, 9)).withColumn("event_flag", (F.col("event_score") >= threshold * scale + shift).cast("int"))
    if not least_rate:
        return df
    # the candidates that may be promoted are as many as are needed: found by a top-n, not by a sort of the table
    need = df.agg((F.ceil(F.count(F.lit(1)) * least_rate) - F.sum("event_flag")).alias("n")).first().n or 0
    top = df.where((F.col("event_flag") == 0) & (F.col("event_score") > 0)).orderBy(F.col("event_score").desc(), TS, KEY).limit(max(0, int(need)))
    chosen = top.select(KEY, TS, F.lit(1).alias("promoted"))
    return df.join(chosen, [KEY, TS], "left").withColumn("promoted", F.coalesce("promoted", F.lit(0))).withColumn("event_flag", F.greatest("event_flag", "promoted"))


def structure_event_gate(
    df: DataFrame, ceilings: tuple[str, ...], floors: tuple[str, ...], near: float = 0.5, flow: float = 0.3, stretch: float = 1.5, touch: float = 0.3, delta: str = "cvd_delta", vwap_z: str = "vwap_z",
) -> DataFrame:
    """1 in an active session near a level when imbalance, a divergence at a level, or the stretch from VWAP confirms it.

    divergence: 1 at a ceiling with selling flow, -1 at a floor with buying flow, ceilings first. event_score: nearness times
    the size of what confirms.
    """
    active, atr = in_session("london") | in_session("ny"), F.when(F.col("atr") > 1e-12, F.col("atr"))
    away = lambda level: F.abs(F.col("close") - F.col(level)) / atr
    df = df.withColumn("_near", F.least(F.lit(1e300), F.lit(1e300), *[away(c) for c in (*ceilings, *floors)]))
    at = lambda levels: F.greatest(F.lit(0), F.lit(0), *[F.coalesce((away(c) < touch).cast("int"), F.lit(0)) for c in levels]) == 1
    df = df.withColumn("divergence", F.when(at(ceilings) & (F.col(delta) < 0), 1).when(at(floors) & (F.col(delta) > 0), -1).otherwise(0))
    lean, z = F.abs(F.coalesce("ofi", F.lit(0.0))), F.abs(F.coalesce(vwap_z, F.lit(0.0)))
    confirmed = (lean > flow) | (F.col("divergence") != 0) | (z > stretch)
    size = F.least(F.least(lean, F.lit(1.0)) * 0.4 + F.abs("divergence") * 0.3 + F.least(z / 3, F.lit(1.0)) * 0.3, F.lit(1.0))
    closeness = F.least(F.greatest(1 - F.col("_near") / near, F.lit(0.0)), F.lit(1.0))
    df = df.withColumn("event_score", F.when(active, closeness * size).otherwise(0.0))
    return df.withColumn("structure_event", (active & (F.col("_near") < near) & confirmed).cast("int")).drop("_near")


def event_direction_vote(df: DataFrame, columns: list[str], need: int | None = None, weights: dict[str, float] | None = None, scaled: tuple[str, ...] = (), least: float = 0.1, window: int = 50) -> DataFrame:
    """The side that `need` of the signs agree on (3 of 4, 2 of fewer); else the side of the weighted score beyond `least`; else
    the sign of the sum of signs.

    In the score each column counts within -1 and 1, a scaled one after division by the trailing median of its size.
    """
    need = need or (3 if len(columns) > 3 else 2)
    total = sum((F.signum(F.coalesce(F.col(c), F.lit(0.0))) for c in columns), F.lit(0.0))
    df, score, w = df.withColumn("vote_sum", total), F.lit(0.0), trailing(window)
    for c, weight in (weights or {}).items():
        x = F.coalesce(F.col(c), F.lit(0.0))
        if c in scaled:
            df = df.withColumn(f"_{c}", F.abs(x))
            mid = F.when(F.count(f"_{c}").over(w) >= 5, median(f"_{c}").over(w))
            df = df.withColumn(f"_{c}", mid)
            x = F.coalesce(x / F.when(F.col(f"_{c}") != 0, F.col(f"_{c}")), F.lit(0.0))
        score = score + weight * F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    df = df.withColumn("vote_score", F.round(score, 9)).drop(*[f"_{c}" for c in scaled])
    strict, scored = F.abs("vote_sum") >= need, F.abs("vote_score") > least
    side = F.when(strict, F.signum("vote_sum")).when(scored, F.signum("vote_score")).otherwise(F.signum("vote_sum"))
    kind = F.when(strict, "strict").when(scored, "score").when(F.col("vote_sum") != 0, "weak").otherwise("none")
    return df.withColumn("direction", side.cast("int")).withColumn("vote_kind", kind)


def activity_event_filter(bars: DataFrame, factor: float = 2.0, obi: float = 0.5, window: int = 20, walls: tuple[str, ...] = (), wall: float = 3.0, shifts: tuple[str, ...] = (), z: float = 2.0) -> DataFrame:
    """1 where volume is `factor` times its mean, the imbalance is large, a wall is strong, or a column is far from its mean."""
    w = trailing(window)
    hit = (F.col("volume") > factor * F.avg("volume").over(w)) | (F.abs("ofi") > obi)
    for c in walls:
        hit = hit | (F.coalesce(F.col(c), F.lit(0.0)) > wall)
    for c in shifts:
        x = F.coalesce(F.col(c), F.lit(0.0))
        sd = F.stddev_samp(x).over(w)
        hit = hit | F.coalesce(F.abs(x - F.avg(x).over(w)) / F.when(sd == 0, EPS).otherwise(sd) > z, F.lit(False))
    return bars.withColumn("activity_event", F.coalesce(hit, F.lit(False)).cast("int"))


def sweep_events(bars: DataFrame, level: str, depths: tuple[float, ...], reclaim: tuple[bool, ...] = (False, True)) -> DataFrame:
    """Bars whose low falls below the level by a depth in ATR, for each depth, with and without a close back above."""
    out = None
    for d in depths:
        for r in reclaim:
            hit = (F.col("low") < F.col(level) - d * F.col("atr")) & ((F.col("close") > F.col(level)) if r else F.lit(True))
            part = bars.where(hit).select(KEY, TS, F.lit(d).alias("depth"), F.lit(r).alias("reclaim"))
            out = part if out is None else out.unionByName(part)
    return out


def setup_class(df: DataFrame) -> DataFrame:
    return df.withColumn("setup", F.when(F.col("cancel_ratio") > 0.25, "withdrawal").when(F.abs("ofi") > 0.5, "imbalance").when(F.col("range_atr") < 0.5, "absorption").otherwise("mixed"))


def liquidity_score(df: DataFrame, depth: str | None = None, gap: str | None = None, walls: tuple[str, ...] = (), imbalance: str | None = None) -> DataFrame:
    """Log volume, raised by the imbalance and the stronger wall, with shares of depth and gap, within 0 and 100."""
    above = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) if c else F.lit(0.0)
    wall = F.greatest(F.lit(0.0), F.lit(0.0), *[above(c) for c in walls])
    lean = F.abs(F.coalesce(F.col(imbalance), F.lit(0.0))) if imbalance else F.lit(0.0)
    raw = F.log1p(above("volume")) * (1 + lean) * (1 + wall) + 0.25 * above(depth) + 0.1 * above(gap)
    return df.withColumn("liquidity_score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)))
