"""Queries: window features of bars (section E) and tick features (section F) and book features (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import book as K
from orderloom.operators import ticks as X
from orderloom.operators import windows as W
from orderloom.plans.base import ATR, BARS, BOOK_SQL, FLOW, FLOW_BARS, SIGNED, TICKS_SQL, WINDOW, atr_bars, bars, flow_bars, frame, sql, stage
from orderloom.plans.catalog import query
from orderloom.plans.flow import SESSION
from orderloom.sources import market
from orderloom.spec import rounded

ID = ["symbol", "ts_event"]
DAY = "(PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event)"


def feature(name, op, columns, ctes, select):
    """A query of op over a starting table, its columns rounded, and its SQL."""
    query(name, sql(*ctes, select=f"SELECT symbol, ts_event, {select}"))(lambda spark, d: rounded(op(spark, d).select(*ID, *columns)))


A = (TICKS_SQL, BARS, ATR)
AB = lambda s, d: stage(atr_bars(s, d))

BREAK = "brk AS (SELECT *, coalesce(gap > 3 * median(gap) OVER (PARTITION BY symbol), false) AS session_break FROM (SELECT *, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER (PARTITION BY symbol ORDER BY ts_event) AS gap FROM bars))"
feature("e1_session_break_flag", lambda s, d: W.session_break_flag(bars(s, d), 1.5), ["session_break"], (TICKS_SQL, BARS, BREAK.replace("3 * median", "1.5 * median")), "session_break FROM brk")
# integer sums give one result in any order, so nothing is rounded here
query("e2_true_range_atr", sql(*A, select="SELECT symbol, ts_event, tr, mean_tr AS atr FROM exact_tr"))(lambda s, d: atr_bars(s, d).select(*ID, "tr", "atr"))

RECURSE = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS i FROM atr),
r(symbol, i, y) AS (
  SELECT symbol, i, {start} FROM n WHERE i = {first}
  UNION ALL
  SELECT n.symbol, n.i, {step} FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)"""


def recursive(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


query("e3_wilder_atr", recursive(*A, RECURSE.format(first=14, start="(SELECT avg(m.tr) FROM n m WHERE m.symbol = n.symbol AND m.i <= 14)", step="r.y * (1 - 1 / 14.0) + n.tr / 14"), select="SELECT n.symbol, ts_event, round(y, 6) AS wilder_atr FROM n LEFT JOIN r ON n.symbol = r.symbol AND n.i = r.i"))(lambda s, d: rounded(W.wilder_atr(AB(s, d)).select(*ID, "wilder_atr")))

feature(
    "e4_rolling_vwap_distance", lambda s, d: W.rolling_vwap_distance(AB(s, d)), ["vwap_anchor", "vwap_distance"], (*A, f"v AS (SELECT *, CASE WHEN count(*) OVER {frame(20, 1)} = 20 THEN sum((high + low + close) / 3 * volume) OVER {frame(20, 1)} / greatest(sum(volume) OVER {frame(20, 1)}, 1e-9) END AS a FROM atr)"),
    "round(a, 6) AS vwap_anchor, round((close - a) / greatest(atr, 1e-9), 6) AS vwap_distance FROM v",
)
feature(
    "e5_rsi", lambda s, d: W.rsi(AB(s, d)), ["rsi"], (*A, f"c AS (SELECT *, close - lag(close) OVER w AS x FROM atr {WINDOW})"),
    f"round(CASE WHEN count(x) OVER {frame(14)} = 14 THEN 100 - 100 / (1 + avg(greatest(x, 0)) OVER {frame(14)} / (avg(greatest(-x, 0)) OVER {frame(14)} + 1e-9)) ELSE 50 END, 6) AS rsi FROM c",
)
query(
    "e6_macd_histogram",
    recursive(*A, """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS i FROM atr),
r(symbol, i, f, s, g) AS (
  SELECT symbol, i, close, close, CAST(0 AS DOUBLE) FROM n WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.i, r.f * 11 / 13.0 + n.close * 2 / 13, r.s * 25 / 27.0 + n.close * 2 / 27,
         r.g * 0.8 + 0.2 * ((r.f * 11 / 13.0 + n.close * 2 / 13) - (r.s * 25 / 27.0 + n.close * 2 / 27))
  FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)""", select="SELECT n.symbol, ts_event, round(f - s, 6) AS macd, round(f - s - g, 6) AS macd_hist FROM n JOIN r ON n.symbol = r.symbol AND n.i = r.i"),
)(lambda s, d: rounded(W.macd_histogram(AB(s, d)).select(*ID, "macd", "macd_hist")))
feature(
    "e7_multi_horizon_returns", lambda s, d: W.multi_horizon_returns(AB(s, d)), ["ret_1", "ret_4", "ret_12", "vol_ratio_4"], A,
    f"round(close / lag(close) OVER w - 1, 6) AS ret_1, round(close / lag(close, 4) OVER w - 1, 6) AS ret_4, round(close / lag(close, 12) OVER w - 1, 6) AS ret_12, round(volume / greatest(avg(volume) OVER {frame(4)}, 1e-9), 6) AS vol_ratio_4 FROM atr {WINDOW}",
)
feature(
    "e8_candle_shape", lambda s, d: W.candle_shape(AB(s, d)), ["range_atr", "body_ratio", "wick_balance"], A,
    "round((high - low) / greatest(atr, 1e-9), 6) AS range_atr, round(abs(close - open) / greatest(high - low, 1e-9), 6) AS body_ratio, round(((high - greatest(open, close)) - (least(open, close) - low)) / greatest(atr, 1e-9), 6) AS wick_balance FROM atr",
)
feature("e9_session_flags", lambda s, d: W.session_flags(bars(s, d)), ["is_london", "is_ny", "session"], (TICKS_SQL, BARS), f"CAST(hour(ts_event) BETWEEN 7 AND 15 AS INTEGER) AS is_london, CAST(hour(ts_event) BETWEEN 13 AND 21 AS INTEGER) AS is_ny, {SESSION} AS session FROM bars")
feature(
    "e10_session_running_levels", lambda s, d: W.session_running_levels(AB(s, d)), ["sess_high", "sess_low", "dist_sess_high"], (*A, f"l AS (SELECT *, coalesce(max(CASE WHEN hour(ts_event) BETWEEN 7 AND 11 THEN high END) OVER d, close) AS h, coalesce(min(CASE WHEN hour(ts_event) BETWEEN 7 AND 11 THEN low END) OVER d, close) AS g FROM atr WINDOW d AS {DAY})"),
    "round(h, 6) AS sess_high, round(g, 6) AS sess_low, round((h - close) / greatest(atr, 1e-9), 6) AS dist_sess_high FROM l",
)
feature(
    "e11_asia_distances", lambda s, d: W.asia_distances(AB(s, d)), ["dist_asia_high", "dist_asia_low", "vol_session_ratio"], A,
    f"round((close - coalesce(max(CASE WHEN hour(ts_event) < 8 THEN high END) OVER d, close)) / greatest(atr, 1e-9), 6) AS dist_asia_high, round((close - coalesce(min(CASE WHEN hour(ts_event) < 8 THEN low END) OVER d, close)) / greatest(atr, 1e-9), 6) AS dist_asia_low, round(volume / greatest(avg(volume) OVER d, 1e-9), 6) AS vol_session_ratio FROM atr WINDOW d AS {DAY}",
)
PREV = f"""dd AS (SELECT symbol, CAST(ts_event AS DATE) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL),
dp AS (SELECT symbol, p, lag(h) OVER x AS ph, lag(l) OVER x AS pl FROM dd WINDOW x AS (PARTITION BY symbol ORDER BY p)),
ww AS (SELECT symbol, date_trunc('week', ts_event) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL),
wp AS (SELECT symbol, p, lag(h) OVER x AS ph, lag(l) OVER x AS pl FROM ww WINDOW x AS (PARTITION BY symbol ORDER BY p)),
prev AS (
  SELECT b.*, coalesce(dp.ph, max(high) OVER d) AS prev_day_high, coalesce(dp.pl, min(low) OVER d) AS prev_day_low,
         coalesce(wp.ph, max(high) OVER k) AS prev_week_high, coalesce(wp.pl, min(low) OVER k) AS prev_week_low
  FROM bars b LEFT JOIN dp ON dp.symbol = b.symbol AND dp.p = CAST(b.ts_event AS DATE) LEFT JOIN wp ON wp.symbol = b.symbol AND wp.p = date_trunc('week', b.ts_event)
  WINDOW d AS (PARTITION BY b.symbol, CAST(b.ts_event AS DATE) ORDER BY b.ts_event), k AS (PARTITION BY b.symbol, date_trunc('week', b.ts_event) ORDER BY b.ts_event))"""
feature(
    "e12_previous_period_levels", lambda s, d: W.previous_period_levels(bars(s, d)), ["prev_day_high", "prev_day_low", "prev_week_high", "prev_week_low", "range_position"], (TICKS_SQL, BARS, PREV),
    "prev_day_high, prev_day_low, prev_week_high, prev_week_low, round(least(greatest((close - prev_day_low) / greatest(prev_day_high - prev_day_low, 1e-9), 0), 1), 6) AS range_position FROM prev",
)
BEFORE = DAY.replace("ORDER BY ts_event", "ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
feature(
    "e13_mid_levels", lambda s, d: W.mid_levels(W.previous_period_levels(bars(s, d))), ["prev_day_mid", "asia_high", "london_low", "ny_high"], (TICKS_SQL, BARS, PREV),
    f"round((prev_day_high + prev_day_low) / 2, 6) AS prev_day_mid, max(CASE WHEN hour(ts_event) < 8 THEN high END) OVER b AS asia_high, min(CASE WHEN hour(ts_event) BETWEEN 7 AND 15 THEN low END) OVER b AS london_low, max(CASE WHEN hour(ts_event) BETWEEN 13 AND 21 THEN high END) OVER b AS ny_high FROM prev WINDOW b AS {BEFORE}",
)
feature(
    "e14_zone_and_third", lambda s, d: W.zone_and_third(bars(s, d)), ["zone", "third"], (TICKS_SQL, BARS),
    f"{SESSION} AS zone, CAST(CASE WHEN hour(ts_event) BETWEEN 13 AND 15 THEN floor((hour(ts_event) - 13) * 60 * 3 / 180) WHEN hour(ts_event) BETWEEN 13 AND 21 THEN floor((hour(ts_event) - 13) * 180 / 540) WHEN hour(ts_event) BETWEEN 7 AND 15 THEN floor((hour(ts_event) - 7) * 180 / 540) WHEN hour(ts_event) < 8 THEN floor(hour(ts_event) * 180 / 480) END AS INTEGER) AS third FROM bars",
)
LEVEL_ROWS = """lv AS (SELECT a.symbol, a.ts_event, a.close, a.high, a.low, a.atr, lag(a.close) OVER (PARTITION BY a.symbol ORDER BY a.ts_event) AS pc, p.prev_day_high, p.prev_day_low FROM atr a JOIN prev p ON a.symbol = p.symbol AND a.ts_event = p.ts_event),
lg AS (SELECT *, 'prev_day_high' AS level, round(prev_day_high, 9) AS price FROM lv UNION ALL SELECT *, 'prev_day_low', round(prev_day_low, 9) FROM lv)"""
query(
    "e15_level_events",
    sql(*A, PREV, LEVEL_ROWS, """ev AS (SELECT symbol, ts_event, level, CASE
  WHEN ((pc < price AND high >= price AND close < price) OR (pc > price AND low <= price AND close > price)) AND abs(close - price) > 0.1 * greatest(atr, 1e-9) THEN 'failed_break'
  WHEN (pc < price AND close > price) OR (pc > price AND close < price) THEN 'break'
  WHEN high >= price AND low <= price AND abs(close - price) > 0.1 * greatest(atr, 1e-9) THEN 'reject'
  WHEN abs(close - price) <= 0.1 * greatest(atr, 1e-9) THEN 'touch' WHEN abs(close - price) <= 0.5 * greatest(atr, 1e-9) THEN 'near' END AS event FROM lg)""", select="SELECT * FROM ev WHERE event IS NOT NULL"),
)(lambda s, d: W.level_events(stage(W.previous_period_levels(atr_bars(s, d))), ["prev_day_high", "prev_day_low"]))
feature(
    "e16_atr_level_distances", lambda s, d: W.atr_level_distances(stage(W.previous_period_levels(atr_bars(s, d))), ["prev_day_high", "prev_week_low"]), ["dist_prev_day_high", "dist_prev_week_low"], (*A, PREV),
    "round((a.close - p.prev_day_high) / greatest(a.atr, 1e-9), 6) AS dist_prev_day_high, round((a.close - p.prev_week_low) / greatest(a.atr, 1e-9), 6) AS dist_prev_week_low FROM atr a JOIN prev p USING (symbol, ts_event)",
)
feature("e17_session_interactions", lambda s, d: W.session_interactions(bars(s, d), ["volume"]), ["volume_x_london", "volume_x_ny"], (TICKS_SQL, BARS), "CASE WHEN hour(ts_event) BETWEEN 7 AND 15 THEN volume ELSE 0 END AS volume_x_london, CASE WHEN hour(ts_event) BETWEEN 13 AND 21 THEN volume ELSE 0 END AS volume_x_ny FROM bars")
STREAK = f"""fs AS (SELECT *, CASE WHEN least(abs(cvd_delta) / greatest(volume, 1e-9), 1) >= 0.3 THEN sign(cvd_delta) ELSE 0 END AS s FROM flow_bars),
fg AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) - row_number() OVER (PARTITION BY symbol, s ORDER BY ts_event) AS g FROM fs)"""
feature(
    "e18_flow_bar_features", lambda s, d: W.flow_bar_features(W.true_range_atr(flow_bars(s, d))).withColumn("flow_streak", F.col("flow_streak").cast("bigint")), ["flow_share", "flow_streak"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, STREAK),
    "round(least(abs(cvd_delta) / greatest(volume, 1e-9), 1), 6) AS flow_share, CASE WHEN s <> 0 THEN row_number() OVER (PARTITION BY symbol, s, g ORDER BY ts_event) ELSE 0 END AS flow_streak FROM fg",
)
CALENDAR_SQL = """c AS (
  SELECT *, hour(ts_event) * 60 + minute(ts_event) AS mi, isodow(ts_event) - 1 AS dow, day(ts_event) AS dm, month(ts_event) AS mo,
         week(ts_event) AS wk, date_diff('day', CAST(ts_event AS DATE), last_day(ts_event)) AS le
  FROM bars),
m AS (
  SELECT symbol, ts_event, CASE WHEN mi >= 420 AND mi < 960 THEN mi - 420 ELSE 0 END AS minutes_since_london_open,
         CASE WHEN mi >= 420 AND mi < 960 THEN 960 - mi ELSE 0 END AS minutes_to_london_close,
         CASE WHEN mi >= 780 AND mi < 1320 THEN mi - 780 ELSE 0 END AS minutes_since_ny_open,
         CASE WHEN mi >= 780 AND mi < 1320 THEN 1320 - mi ELSE 0 END AS minutes_to_ny_close,
         CASE WHEN mi >= 780 AND mi < 1320 THEN CASE WHEN mi < 810 THEN 0 WHEN mi > 1290 THEN 2 ELSE 1 END
              WHEN mi >= 420 AND mi < 960 THEN CASE WHEN mi < 450 THEN 0 WHEN mi > 930 THEN 2 ELSE 1 END ELSE 3 END AS session_phase,
         round(sin(2 * pi() * dow / 7), 6) AS dow_sin, round(cos(2 * pi() * dow / 7), 6) AS dow_cos, CAST(dow = 0 AS INT) AS is_monday,
         CAST(dow = 4 AS INT) AS is_friday, CAST(dm AS INT) AS dom, round(sin(2 * pi() * (dm - 1) / 31), 6) AS dom_sin,
         round(cos(2 * pi() * (dm - 1) / 31), 6) AS dom_cos, CAST(le <= 1 AS INT) AS is_month_end, CAST(dm <= 2 AS INT) AS is_month_start,
         CAST(mo IN (3, 6, 9, 12) AND le <= 4 AS INT) AS is_quarter_end, CAST(mo = 12 AND le <= 4 AS INT) AS is_year_end,
         round(sin(2 * pi() * wk / 52), 6) AS woy_sin, round(cos(2 * pi() * wk / 52), 6) AS woy_cos, CAST(wk = 1 AS INT) AS is_first_week_of_year,
         CAST(mo = 3 AND dm BETWEEN 8 AND 14 OR mo = 11 AND dm <= 7 OR mo IN (3, 10) AND dm >= 25 AS INT) AS is_clock_change_week,
         0 AS is_event_window
  FROM c)"""
CALENDAR = [x.strip() for x in """minutes_since_london_open minutes_to_london_close minutes_since_ny_open minutes_to_ny_close session_phase dow_sin dow_cos
is_monday is_friday dom dom_sin dom_cos is_month_end is_month_start is_quarter_end is_year_end woy_sin woy_cos is_first_week_of_year
is_clock_change_week is_event_window""".split()]
CALENDAR_SELECT = ", ".join(f"CAST({c} AS INT) AS {c}" if c == "dom" or c.startswith(("minutes", "session", "is_")) else c for c in CALENDAR)
feature("e19_seasonal_calendar", lambda s, d: W.seasonal_calendar(bars(s, d)), CALENDAR, (TICKS_SQL, BARS, CALENDAR_SQL), f"{CALENDAR_SELECT} FROM m")
CYCLIC = ["hour_sin", "hour_cos", "minute_sin", "minute_cos", "london_active", "ny_active", "overlap_active"]
CYCLIC_SELECT = ", ".join(f"round({f}(2 * pi() * {n}(ts_event) / {m}), 6) AS {n}_{f}" for n, m in (("hour", 24), ("minute", 60)) for f in ("sin", "cos"))
CYCLIC_SELECT += ", " + ", ".join(f"CAST(hour(ts_event) BETWEEN {a} AND {b} AS DOUBLE) AS {n}_active" for n, a, b in (("london", 7, 15), ("ny", 13, 21), ("overlap", 13, 15)))
feature("e20_cyclic_time", lambda s, d: W.cyclic_time(bars(s, d)), CYCLIC, (TICKS_SQL, BARS), f"{CYCLIC_SELECT} FROM bars")
feature("e21_rolling_zscore", lambda s, d: W.rolling_zscore(bars(s, d), "volume"), ["volume_z"], (TICKS_SQL, BARS), f"round(CASE WHEN count(*) OVER {frame(100)} >= 20 THEN (volume - avg(volume) OVER {frame(100)}) / (stddev_samp(volume) OVER {frame(100)} + 1e-9) ELSE 0 END, 6) AS volume_z FROM bars")
feature(
    "e22_rolling_rank", lambda s, d: W.rolling_rank(bars(s, d), "volume"), ["volume_rank"], (TICKS_SQL, BARS, f"n AS (SELECT *, list(volume) OVER {frame(50)} AS x FROM bars)"),
    "CASE WHEN len(x) >= 20 THEN round(len(list_filter(x, lambda v: v <= volume)) / len(x), 6) END AS volume_rank FROM n",
)
E23 = f"""z AS (
  SELECT symbol, ts_event, volume, close, stddev_samp(volume) OVER {frame(20)} AS vs, stddev_samp(close) OVER {frame(20)} AS cs, lag(volume) OVER w AS lv, lag(close) OVER w AS lc,
         avg(volume) OVER {frame(20)} AS vm, avg(close) OVER {frame(20)} AS cm, round(coalesce(stddev_samp(ofi) OVER {frame(20)}, 0), 9) AS sd
  FROM flow_bars {WINDOW})"""
E23_SELECT = f"""coalesce(volume - lv, 0) AS volume_diff, round(vm, 6) AS volume_mean,
       round(coalesce((volume - vm) / CASE WHEN vs = 0 THEN 1e-9 ELSE vs END, 0), 6) AS volume_z, round(coalesce(close - lc, 0), 6) AS close_diff,
       CAST(sd > quantile_cont(sd, 0.5) OVER (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS volatility_state FROM z"""
feature(
    "e23_diff_mean_z_bundle", lambda s, d: W.diff_mean_z_bundle(flow_bars(s, d), ["volume", "close"], imbalance="ofi"),
    ["volume_diff", "volume_mean", "volume_z", "close_diff", "volatility_state"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, E23), E23_SELECT,
)
feature(
    "e24_rolling_ols_slope", lambda s, d: W.rolling_ols_slope(bars(s, d), "close"), ["close_slope", "close_momentum"], (TICKS_SQL, BARS, f"n AS (SELECT *, row_number() OVER w AS i FROM bars {WINDOW})"),
    f"round(CASE WHEN count(*) OVER {frame(10)} = 10 THEN regr_slope(close, i) OVER {frame(10)} END, 6) AS close_slope, round(close - lag(close, 10) OVER w, 6) AS close_momentum FROM n {WINDOW}",
)
feature(
    "e25_consecutive_runs", lambda s, d: W.consecutive_runs(bars(s, d)).withColumns({c: F.col(c).cast("bigint") for c in ("up_run", "down_run")}), ["up_run", "down_run"],
    (TICKS_SQL, BARS, f"x AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) AS s FROM bars {WINDOW})", "g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) - row_number() OVER (PARTITION BY symbol, s ORDER BY ts_event) AS k FROM x)", "m AS (SELECT *, row_number() OVER (PARTITION BY symbol, s, k ORDER BY ts_event) AS n FROM g)"),
    "CASE WHEN s > 0 THEN n ELSE 0 END AS up_run, CASE WHEN s < 0 THEN n ELSE 0 END AS down_run FROM m",
)
query(
    "e26_ewma_volatility",
    recursive(*A, f"q AS (SELECT *, coalesce(ln(close / lag(close) OVER w), 0) AS x, row_number() OVER w AS i FROM atr {WINDOW})", """r(symbol, i, y) AS (SELECT symbol, i, x * x FROM q WHERE i = 1 UNION ALL SELECT q.symbol, q.i, r.y * 0.94 + 0.06 * q.x * q.x FROM r JOIN q ON q.symbol = r.symbol AND q.i = r.i + 1)""", select="SELECT q.symbol, ts_event, round(y * 1e6, 6) AS ewma_var FROM q JOIN r ON q.symbol = r.symbol AND q.i = r.i"),
)(lambda s, d: rounded(W.ewma_volatility(AB(s, d)).select(*ID, (F.col("ewma_var") * 1e6).alias("ewma_var"))))


FD = W.fractional_weights()[0]
feature(
    "e27_fractional_difference", lambda s, d: W.fractional_difference(bars(s, d), "close"), ["close_fd", "fd_cut"], (TICKS_SQL, BARS, f"n AS (SELECT *, list(close ORDER BY ts_event DESC) OVER {frame(len(FD))} AS x FROM bars)"),
    f"CASE WHEN len(x) = {len(FD)} THEN round(list_sum(list_transform(list_zip(x, {FD}), lambda z: z[1] * z[2])), 6) END AS close_fd, true AS fd_cut FROM n",
)
E28 = (
    "dr AS (SELECT symbol, CAST(ts_event AS DATE) AS day, greatest(max(high) - min(low), 0.01) AS r FROM bars GROUP BY ALL)",
    """du AS (
  SELECT symbol, day, greatest(CASE WHEN count(*) OVER x >= 3 THEN quantile_cont(r, 0.5) OVER x ELSE 0.8 END, 0.01) AS u
  FROM dr WINDOW x AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    f"""dd AS (
  SELECT b.*, u, max(high) OVER d - min(low) OVER d AS run, max(CASE WHEN hour(ts_event) = 8 THEN high END) OVER d AS top,
         min(CASE WHEN hour(ts_event) = 8 THEN low END) OVER d AS bot
  FROM bars b JOIN du USING (symbol) WHERE du.day = CAST(ts_event AS DATE) WINDOW d AS {DAY})""",
)
E28_SELECT = """round(u, 6) AS usual_range, round(run / u, 6) AS range_used, round(greatest(u - run, 0), 6) AS range_left,
       CAST(round(greatest(u - run, 0), 6) <= u * 0.1 AS INT) AS range_spent,
       CASE WHEN hour(ts_event) = 8 THEN 0 WHEN close > top THEN 1 WHEN close < bot THEN -1 ELSE 0 END AS first_hour_state FROM dd"""
feature("e28_daily_range_fuel", lambda s, d: W.daily_range_fuel(bars(s, d)), ["usual_range", "range_used", "range_left", "range_spent", "first_hour_state"], (TICKS_SQL, BARS, *E28), E28_SELECT)
# both filters row by row, with their variances beside them
E29 = """n AS (SELECT symbol, ts_event, close AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS i FROM bars),
r(symbol, i, y, v, l, s, p, q, w) AS (
  SELECT symbol, i, z, 0.001 / 1.001, z, CAST(0 AS DOUBLE), 2.0001 - 2.0001 * 2.0001 / 2.0101, 1 - 2.0001 / 2.0101, 1.0001 - 1 / 2.0101 FROM n WHERE i = 1
  UNION ALL
  SELECT symbol, i, y + (v + 1e-5) / (v + 1.01e-3) * (z - y), (v + 1e-5) * 1e-3 / (v + 1.01e-3),
         l + s + k * (z - l - s), s + m * (z - l - s), (1 - k) * pp, (1 - k) * qq, ww - m * qq
  FROM (SELECT *, pp / (pp + 1e-2) AS k, qq / (pp + 1e-2) AS m
        FROM (SELECT n.symbol, n.i, n.z, y, v, l, s, p + 2 * q + w + 1e-4 AS pp, q + w AS qq, w + 1e-4 AS ww FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))),
x AS (SELECT n.symbol, ts_event, y, l, s, sign(round(y - lag(y) OVER o, 9)) AS g, s / greatest(max(abs(s)) OVER (PARTITION BY n.symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING), 1e-10) AS t
      FROM n JOIN r ON n.symbol = r.symbol AND n.i = r.i WINDOW o AS (PARTITION BY n.symbol ORDER BY ts_event))"""
query(
    "e29_local_level_trend",
    recursive(TICKS_SQL, BARS, E29, select="SELECT symbol, ts_event, round(y, 6) AS level, CAST(coalesce(g, 0) AS DOUBLE) AS trend_sign, round(l, 6) AS trend_level, round(s, 6) AS trend_slope, round(abs(t), 6) AS trend_strength, CASE WHEN round(t, 9) > 0.05 THEN 1 WHEN round(t, 9) < -0.05 THEN -1 ELSE 0 END AS trend FROM x"),
)(lambda s, d: rounded(W.local_level_trend(bars(s, d)).select(*ID, "level", "trend_sign", "trend_level", "trend_slope", "trend_strength", "trend")))
feature(
    "e30_causal_window_bundle", lambda s, d: W.causal_window_bundle(bars(s, d), "volume"), ["volume_lag_mean", "volume_lag_std", "volume_lag_min", "volume_lag_max"], (TICKS_SQL, BARS),
    f"round(avg(volume) OVER {frame(10, 1)}, 6) AS volume_lag_mean, round(stddev_samp(volume) OVER {frame(10, 1)}, 6) AS volume_lag_std, min(volume) OVER {frame(10, 1)} AS volume_lag_min, max(volume) OVER {frame(10, 1)} AS volume_lag_max FROM bars",
)
feature(
    "e31_fallback_fill", lambda s, d: W.fallback_fill(flow_bars(s, d).withColumn("signal", F.when(F.col("n_trades") > 2, F.col("ofi"))), {"signal": "buy_share"}, {"signal": (-0.5, 0.9)}), ["signal"], (TICKS_SQL, BARS, FLOW, FLOW_BARS),
    "round(least(greatest(coalesce(CASE WHEN n_trades > 2 THEN ofi END, buy_share), -0.5), 0.9), 6) AS signal FROM flow_bars",
)
feature(
    "e32_warmup_mask", lambda s, d: W.warmup_mask(W.session_break_flag(bars(s, d), 1.5), 5), ["warmup"], (TICKS_SQL, BARS, BREAK.replace("3 * median", "1.5 * median"), "g AS (SELECT *, sum(CAST(session_break AS INT)) OVER (PARTITION BY symbol ORDER BY ts_event) AS k FROM brk)"),
    "row_number() OVER (PARTITION BY symbol, k ORDER BY ts_event) <= 5 AS warmup FROM g",
)

# Ticks
TICK_FRAME = "(PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq ROWS BETWEEN {a} PRECEDING AND {b})"


def tf(n: int, back: int = 0) -> str:
    return TICK_FRAME.format(a=n - 1 + back, b=f"{back} PRECEDING" if back else "CURRENT ROW")


TR = "tt AS (SELECT * FROM ticks WHERE action = 'T')"
TW = "WINDOW w AS (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq)"


def tick_feature(name, op, columns, ctes, select):
    query(name, sql(*ctes, select=f"SELECT seq, {select}"))(lambda spark, d: rounded(op(market.ticks(spark, d)).select("seq", *columns)))


tick_feature("f5_tape_speed", X.tape_speed_minutes, ["tape_speed"], (TICKS_SQL, TR), "count(*) OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY epoch_us(ts_event) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS tape_speed FROM tt")
F6 = f"""x AS (SELECT *, abs(price - lag(price) OVER w) AS m, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER w AS g FROM tt {TW})"""
F6_SELECT = f"""SELECT seq, sum(CAST(round(m * 1000000.0) AS BIGINT)) OVER {tf(100)} / (count(m) OVER {tf(100)} * 1000000.0) AS micro_range,
       size / greatest(avg(size) OVER {tf(500, 1)}, 1e-9) AS burst,
       sum(g) OVER {tf(50)} / (count(g) OVER {tf(50)} * 1000.0) AS trade_gap_ms
FROM x"""
query("f6_micro_range_burst_gap", sql(TICKS_SQL, TR, F6, select=F6_SELECT))(lambda spark, d: X.micro_range_burst_gap(market.ticks(spark, d)).select("seq", "micro_range", "burst", "trade_gap_ms"))
tick_feature(
    "f2_absorption_intensity", X.absorption_intensity, ["absorption"], (TICKS_SQL, TR, f"x AS (SELECT *, sum({SIGNED}) OVER {tf(50)} AS fl, abs(price - lag(price, 49) OVER w) AS mv FROM tt {TW})", "y AS (SELECT *, abs(fl) / greatest(mv, 0.01) AS raw FROM x)"),
    f"round(least(raw / greatest(quantile_cont(raw, 0.5) OVER {tf(200)}, 1e-9), 25), 6) AS absorption FROM y",
)
tick_feature(
    "f9_net_signed_volume", X.net_signed_volume, ["net_signed"], (TICKS_SQL, TR, f"x AS (SELECT *, {SIGNED} AS s, CASE WHEN size > 2 * avg(size) OVER {tf(100)} THEN 2.0 ELSE 1.0 END AS k FROM tt)"),
    f"round(sum(s * k) OVER {tf(100)} / greatest(sum(size * k) OVER {tf(100)}, 1e-9), 6) AS net_signed FROM x",
)
tick_feature(
    "f10_session_vwap_z", X.session_vwap_z, ["session_vwap", "vwap_z", "vwap_slope"], (TICKS_SQL, TR, f"x AS (SELECT *, sum(price * size) OVER w / sum(size) OVER w AS v FROM tt {TW})", "y AS (SELECT *, price - v AS dv FROM x)"),
    f"round(v, 6) AS session_vwap, round(CASE WHEN stddev_pop(dv) OVER {tf(500)} > 1e-6 THEN dv / stddev_pop(dv) OVER {tf(500)} ELSE 0 END, 4) AS vwap_z, round(coalesce(v - lag(v, 19) OVER w, 0), 6) AS vwap_slope FROM y {TW}",
)
F12 = (
    f"lw AS (SELECT *, list(price) OVER {tf(300)} AS w, stddev_pop(price) OVER {tf(300)} AS sd FROM tt)",
    "lk AS (SELECT *, CAST(floor(len(w) * 0.8) AS INT) AS k FROM lw)",
    "le AS (SELECT *, list_max(w[1:k]) AS a1, list_min(w[1:k]) AS a0, list_max(w[k + 1:len(w)]) AS b1, list_min(w[k + 1:len(w)]) AS b0 FROM lk)",
    "lr AS (SELECT *, greatest(a1 - a0, 2 * sd, 1e-8) AS r FROM le)",
)
F12_SELECT = """round(CASE WHEN len(w) < 50 THEN 0.0 WHEN price < a1 AND (b1 - a1) / r > 0.05 THEN least(5 * (b1 - a1) / r, 1.0)
       WHEN price > a0 AND (a0 - b0) / r > 0.05 THEN -least(5 * (a0 - b0) / r, 1.0) ELSE 0.0 END, 4) AS sweep FROM lr"""
tick_feature("f12_liquidity_sweep", lambda t: X.liquidity_sweep(t), ["sweep"], (TICKS_SQL, TR, *F12), F12_SELECT)
# all figures of a trade that the stream keeps, with the recurrences of impact and intensity by day
FEED = f"""{TICKS_SQL}, {TR},
fx AS (SELECT *, CAST(ts_event AS DATE) AS d, {SIGNED} AS s, abs(price - lag(price) OVER w) AS m, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER w AS g, row_number() OVER w AS i,
  CASE WHEN size > 2 * avg(size) OVER {tf(100)} THEN 2.0 ELSE 1.0 END AS k, sum(price * size) OVER w / sum(size) OVER w AS v FROM tt {TW}),
fy AS (SELECT *, price - v AS dv, m / greatest(size, 1e-9) AS q FROM fx),
fz AS (SELECT *, coalesce(quantile_cont(CASE WHEN q > 0 THEN q END, 0.5) OVER {tf(30)}, 0) AS qm, stddev_pop(dv) OVER {tf(500)} AS sd,
  count(*) OVER (PARTITION BY symbol, d ORDER BY epoch_us(ts_event) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS tape_speed,
  sum(CAST(round(m * 1000000.0) AS BIGINT)) OVER {tf(100)} / (count(m) OVER {tf(100)} * 1000000.0) AS micro_range, size / greatest(avg(size) OVER {tf(500, 1)}, 1e-9) AS burst,
  sum(g) OVER {tf(50)} / (count(g) OVER {tf(50)} * 1000.0) AS trade_gap_ms, sum(s * k) OVER {tf(100)} / greatest(sum(size * k) OVER {tf(100)}, 1e-9) AS net_signed,
  coalesce(v - lag(v, 19) OVER w, 0) AS vwap_slope FROM fy {TW}),
fr(symbol, d, i, impact, intensity) AS (
  SELECT symbol, d, i, CASE WHEN qm > 0 THEN 0.18 ELSE 0.05 END * qm, CAST(0.175 AS DOUBLE) FROM fz WHERE i = 1
  UNION ALL
  SELECT z.symbol, z.d, z.i, r.impact + CASE WHEN qm > 0 THEN 0.18 ELSE 0.05 END * (qm - r.impact), r.intensity * exp(-0.05 * g / 60000000.0) + 0.175
  FROM fr r JOIN fz z ON z.symbol = r.symbol AND z.d = r.d AND z.i = r.i + 1)"""
FEED_SELECT = """
SELECT fz.symbol, ts_event, seq, tape_speed, round(micro_range, 7) AS micro_range, round(least(burst, 1e6), 7) AS burst, round(trade_gap_ms, 7) AS trade_gap_ms, round(impact, 7) AS impact,
  round(intensity, 7) AS intensity, round(net_signed, 7) AS net_signed, round(v, 7) AS session_vwap, round(CASE WHEN sd > 1e-6 THEN dv / sd ELSE 0 END, 7) AS vwap_z, round(vwap_slope, 7) AS vwap_slope
FROM fz JOIN fr USING (symbol, d, i)"""
query("f7_price_impact_lambda", f"WITH RECURSIVE {FEED} SELECT seq, round(impact, 6) AS impact FROM fz JOIN fr USING (symbol, d, i)")(lambda s, d: rounded(X.price_impact_lambda(market.ticks(s, d)).select("seq", "impact")))
query("f8_self_exciting_intensity", f"WITH RECURSIVE {FEED} SELECT seq, round(intensity, 6) AS intensity FROM fz JOIN fr USING (symbol, d, i)")(lambda s, d: rounded(X.self_exciting_intensity(market.ticks(s, d)).select("seq", "intensity")))

# Book
query("g1_book_imbalance", sql(BOOK_SQL, "s AS (SELECT *, list_sum(list_transform(list_zip(bid_sz, range(10)), lambda z: z[1] / (z[2] + 1))) AS wb, list_sum(list_transform(list_zip(ask_sz, range(10)), lambda z: z[1] / (z[2] + 1))) AS wa FROM book)", select="SELECT seq, round((wb - wa) / greatest(wb + wa, 1e-9), 6) AS imbalance, round(ask_px[1] - bid_px[1], 6) AS spread, list_sum(bid_sz) + list_sum(ask_sz) AS depth FROM s"))(lambda s, d: rounded(K.book_imbalance(market.book(s, d)).select("seq", "imbalance", "spread", "depth")))
query("g2_top5_imbalance_microprice", sql(BOOK_SQL, "s AS (SELECT *, list_sum(bid_sz[1:5]) AS b5, list_sum(ask_sz[1:5]) AS a5 FROM book)", select="SELECT seq, round((b5 - a5) / greatest(b5 + a5, 1e-9), 6) AS imbalance5, round(CASE WHEN bid_sz[1] + ask_sz[1] > 0 THEN (bid_px[1] * ask_sz[1] + ask_px[1] * bid_sz[1]) / (bid_sz[1] + ask_sz[1]) ELSE (bid_px[1] + ask_px[1]) / 2 END, 6) AS microprice FROM s"))(lambda s, d: rounded(K.top5_imbalance_microprice(market.book(s, d)).select("seq", "imbalance5", "microprice")))
MEAN_SIZE = """mp AS (SELECT *, flatten(list(list_filter(list_concat(bid_sz, ask_sz), lambda v: v > 0)) OVER (PARTITION BY symbol ORDER BY ts_event, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS every FROM book),
mz AS (SELECT * EXCLUDE (every), list_avg(every[greatest(len(every) - 199, 1):]) AS mean_size FROM mp)"""
WALLS = """wp AS (SELECT *, (bid_px[1] + ask_px[1]) / 2 AS mid, coalesce(list_position(list_transform(bid_sz, lambda x: x >= 1.5 * mean_size), true), 0) AS bw, coalesce(list_position(list_transform(ask_sz, lambda x: x >= 1.5 * mean_size), true), 0) AS aw FROM mz),
walls AS (SELECT *, CASE WHEN bw > 0 THEN bid_px[bw] END AS bid_wall_px, CASE WHEN aw > 0 THEN ask_px[aw] END AS ask_wall_px, CASE WHEN bw > 0 THEN bid_sz[bw] ELSE 0 END AS bid_wall_size, CASE WHEN aw > 0 THEN ask_sz[aw] ELSE 0 END AS ask_wall_size FROM wp)"""
WALL_COLUMNS = ["mean_size", "bid_wall", "ask_wall", "bid_wall_px", "ask_wall_px", "bid_wall_strength", "ask_wall_strength", "bid_wall_distance", "ask_wall_distance", "wall_ticks"]
G3_SELECT = """SELECT seq, round(mean_size, 6) AS mean_size, CAST(bw - 1 AS BIGINT) AS bid_wall, CAST(aw - 1 AS BIGINT) AS ask_wall, round(bid_wall_px, 6) AS bid_wall_px, round(ask_wall_px, 6) AS ask_wall_px,
  round(bid_wall_size / mean_size, 6) AS bid_wall_strength, round(ask_wall_size / mean_size, 6) AS ask_wall_strength, round(mid - bid_wall_px, 6) AS bid_wall_distance, round(ask_wall_px - mid, 6) AS ask_wall_distance,
  round(coalesce(least(CASE WHEN mid - bid_wall_px > 0 THEN mid - bid_wall_px END, CASE WHEN ask_wall_px - mid > 0 THEN ask_wall_px - mid END), 0) / 0.01, 6) AS wall_ticks FROM walls"""
query("g3_wall_scan", sql(BOOK_SQL, MEAN_SIZE, WALLS, select=G3_SELECT))(lambda s, d: rounded(K.wall_scan(market.book(s, d), 1.5).select("seq", *WALL_COLUMNS)))
query("g5_withdrawal_detector", sql(BOOK_SQL, "x AS (SELECT *, list_sum(bid_sz[1:3]) + list_sum(ask_sz[1:3]) AS d3 FROM book)", "y AS (SELECT *, CASE WHEN action <> 'T' AND lag(d3) OVER v > d3 THEN lag(d3) OVER v - d3 ELSE 0 END AS dr, CASE WHEN action = 'T' THEN size ELSE 0 END AS tv FROM x WINDOW v AS (PARTITION BY symbol ORDER BY ts_event, seq))", select="SELECT seq, round(sum(dr) OVER f / greatest(sum(tv) OVER f, 1), 6) AS withdrawal FROM y WINDOW f AS (PARTITION BY symbol ORDER BY ts_event, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"))(lambda s, d: rounded(K.withdrawal_detector(market.book(s, d)).select("seq", "withdrawal")))
GAPS = """lb AS (SELECT *, list_filter(list_zip(bid_px, bid_sz), lambda x: x[2] > 0) AS b, list_filter(list_zip(ask_px, ask_sz), lambda x: x[2] > 0) AS a FROM mz),
gp AS (SELECT *, list_filter(list_transform(range(1, len(b)), lambda i: {'s': round(abs(b[i][1] - b[i + 1][1]) / 0.01, 9), 'c': greatest(1 - least(b[i][2], b[i + 1][2]) / mean_size, 0), 'v': greatest(1 - (b[i][2] + b[i + 1][2]) / 2 / mean_size, 0), 'p': b[i + 1][1]}),
    lambda g: g.s >= 2 OR g.s >= 1 AND g.c >= 0.65 AND g.s + 0.8 * g.c + 0.6 * g.v >= 2)[1] AS bg,
  list_filter(list_transform(range(1, len(a)), lambda i: {'s': round(abs(a[i][1] - a[i + 1][1]) / 0.01, 9), 'c': greatest(1 - least(a[i][2], a[i + 1][2]) / mean_size, 0), 'v': greatest(1 - (a[i][2] + a[i + 1][2]) / 2 / mean_size, 0), 'p': a[i + 1][1]}),
    lambda g: g.s >= 2 OR g.s >= 1 AND g.c >= 0.65 AND g.s + 0.8 * g.c + 0.6 * g.v >= 2)[1] AS ag,
  greatest(round(abs(b[least(len(b), 5)][1] - b[1][1]) / 0.01 + abs(a[least(len(a), 5)][1] - a[1][1]) / 0.01, 9), 1) AS span, list_sum(list_transform(b[1:5], lambda x: x[2])) AS b5, list_sum(list_transform(a[1:5], lambda x: x[2])) AS a5 FROM lb),
gs AS (SELECT *, coalesce(bg.s + 0.8 * bg.c + 0.6 * bg.v, 0) AS bs, coalesce(ag.s + 0.8 * ag.c + 0.6 * ag.v, 0) AS az FROM gp)"""
GAP_COLUMNS = ["bid_gap_px", "ask_gap_px", "bid_gap_size", "ask_gap_size", "gap_size", "bid_density", "ask_density", "liquidity_density"]
G4_SELECT = """SELECT seq, round(bg.p, 6) AS bid_gap_px, round(ag.p, 6) AS ask_gap_px, round(bs, 6) AS bid_gap_size, round(az, 6) AS ask_gap_size, round(greatest(bs, az), 6) AS gap_size,
  round(b5 / span, 6) AS bid_density, round(a5 / span, 6) AS ask_density, round((b5 + a5) / span, 6) AS liquidity_density FROM gs"""
query("g4_gap_and_density", sql(BOOK_SQL, MEAN_SIZE, GAPS, select=G4_SELECT))(lambda s, d: rounded(K.gap_and_density(market.book(s, d)).select("seq", *GAP_COLUMNS)))
BLEND = """sm AS (SELECT symbol, date_trunc('hour', ts_event) AS b, ts_event, seq, bid_sz, ask_sz, bid_px[1] AS bp, ask_px[1] AS ap, round(abs((list_sum(bid_sz) - list_sum(ask_sz)) / (list_sum(bid_sz) + list_sum(ask_sz) + 1e-9)), 9) AS m FROM book),
tp AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY symbol, b ORDER BY m DESC, ts_event, seq) <= 3),
tw AS (SELECT *, CASE WHEN sum(m) OVER p > 1e-12 THEN m / sum(m) OVER p ELSE 1.0 / count(*) OVER p END AS w FROM tp WINDOW p AS (PARTITION BY symbol, b)),
bl AS (SELECT symbol, b AS ts_event, CAST(i - 1 AS INT) AS level, sum(w * bid_sz[i]) AS bz, sum(w * ask_sz[i]) AS az, sum(w * bp) AS bid0, sum(w * ap) AS ask0 FROM tw, range(1, 11) r(i) GROUP BY ALL)"""
FOOT = """qu AS (SELECT symbol, ts_event, any_value(bid0) AS bid0, any_value(ask0) AS ask0 FROM bl GROUP BY ALL),
fo AS (SELECT t.symbol, q.ts_event, size, CASE WHEN side = 'A' THEN true WHEN side = 'B' THEN false ELSE price >= (bid0 + ask0) / 2 END AS buy,
  CAST(least(round_even(round(abs(price - CASE side WHEN 'A' THEN ask0 WHEN 'B' THEN bid0 ELSE (bid0 + ask0) / 2 END) / CASE WHEN ask0 > bid0 THEN round(ask0 - bid0, 9) ELSE 0.01 END, 6), 0), 9) AS INT) AS level
  FROM ticks t JOIN qu q ON q.symbol = t.symbol AND q.ts_event = date_trunc('hour', t.ts_event) WHERE action = 'T' AND size > 0 AND price > 0),
fp AS (SELECT symbol, ts_event, level, sum(CASE WHEN buy THEN size ELSE 0 END) AS buy, sum(CASE WHEN buy THEN 0 ELSE size END) AS sell FROM fo GROUP BY ALL)"""
TENSOR = """td AS (SELECT symbol, ts_event, 9 - level AS level, bz AS d, bz AS bid, 0 AS ask FROM bl UNION ALL SELECT symbol, ts_event, 10 + level, az, 0, az FROM bl),
tv AS (SELECT symbol, ts_event, 9 - level AS level, 0 AS buy, sell FROM fp UNION ALL SELECT symbol, ts_event, 10 + level, buy, 0 FROM fp),
tc AS (SELECT td.*, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, lag(d) OVER (PARTITION BY td.symbol, td.level ORDER BY td.ts_event) AS p, quantile_cont(CASE WHEN d > 0 THEN d END, 0.5) OVER (PARTITION BY td.symbol, td.ts_event) AS md
  FROM td LEFT JOIN tv ON tv.symbol = td.symbol AND tv.ts_event = td.ts_event AND tv.level = td.level),
cells9 AS (SELECT symbol, ts_event, CAST(level AS INT) AS level, ln(1 + d) AS depth_log, (buy - sell) / greatest(buy + sell, 1e-9) AS trade_imbalance, ln(1 + buy + sell) AS trade_log, ln(1 + bid) AS bid_log, ln(1 + ask) AS ask_log,
  ln(1 + buy) AS buy_log, ln(1 + sell) AS sell_log, CASE WHEN d > 3 * round(md, 9) THEN 1.0 ELSE 0.0 END AS wall, CASE WHEN p IS NULL THEN 0 ELSE least(greatest((d - p) / greatest(p, 1), -10), 10) END AS depth_change, d FROM tc)"""


def snapshots(s, d):
    return K.bar_book_snapshot(market.book(s, d))


def tensor(s, d):
    b = snapshots(s, d)
    return K.nine_channel_book(b, K.trade_footprint(market.ticks(s, d), b))


def flat(df, *columns):
    """A row for each place of some arrays of one length."""
    rest = [c for c in df.columns if c not in columns]
    x = df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("level", "z"))
    return x.select(*rest, "level", *[F.col(f"z.{c}").alias(c) for c in columns])


query("g8_bar_book_snapshot", sql(BOOK_SQL, BLEND, select="SELECT symbol, ts_event, level, round(bz, 6) AS bid_sz, round(az, 6) AS ask_sz, round(bid0, 6) AS bid0, round(ask0, 6) AS ask0, round((sum(bz) OVER b - sum(az) OVER b) / greatest(sum(bz) OVER b + sum(az) OVER b, 1e-9), 6) AS imbalance FROM bl WINDOW b AS (PARTITION BY symbol, ts_event)"))(lambda s, d: rounded(flat(snapshots(s, d), "bid_sz", "ask_sz")))
query("g9_trade_footprint", sql(BOOK_SQL, BLEND, FOOT, select="SELECT q.symbol, q.ts_event, CAST(i AS INT) AS level, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell FROM (SELECT DISTINCT symbol, ts_event FROM fp) q CROSS JOIN range(10) r(i) LEFT JOIN fp ON fp.symbol = q.symbol AND fp.ts_event = q.ts_event AND fp.level = i"))(lambda s, d: flat(K.trade_footprint(market.ticks(s, d), snapshots(s, d)), "buy", "sell"))
query("g10_nine_channel_book", sql(BOOK_SQL, BLEND, FOOT, TENSOR, select="SELECT symbol, ts_event, level, " + ", ".join(f"round({c}, 6) AS {c}" for c in K.CHANNELS) + " FROM cells9"))(lambda s, d: rounded(K.tensor_cells(tensor(s, d))))
