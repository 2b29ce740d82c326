"""Queries: regimes (H), event gates (I), labels (J), contract rolls (K), splits (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import labels as L
from orderloom.operators import rolls as R
from orderloom.operators import splits as S
from orderloom.operators import structure as H
from orderloom.operators import windows as W
from orderloom.plans.base import ATR, BARS, CONTRACTS_SQL, FLOW, FLOW_BARS, LABELS, TICKS_SQL, WINDOW, atr_bars, bars, flow_bars, frame, labelled, nxt, sql, stage
from orderloom.plans.catalog import query
from orderloom.plans.features import BREAK, ID, PREV, feature
from orderloom.plans.flow import SESSION
from orderloom.sources import market
from orderloom.spec import rounded

A = (TICKS_SQL, BARS, ATR)
AL = (*A, LABELS)
AB = lambda s, d: stage(atr_bars(s, d))
MED = "quantile_cont({c}, 0.5) OVER {f}"
REGIME = f"""rg AS (SELECT *, CASE WHEN volume < 0.3 * quantile_cont(volume, 0.5) OVER {frame(50, 1)} THEN 'low_liquidity'
  WHEN atr > 1.4 * quantile_cont(atr, 0.5) OVER {frame(50, 1)} THEN 'volatile'
  WHEN abs(close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts_event)) / greatest(10 * atr, 1e-9) > 0.6 THEN 'trending' ELSE 'ranging' END AS regime FROM atr)"""
regime = lambda s, d: L.regime_rule(AB(s, d))

query("h9_regime_group_rare", sql(*A, REGIME, select="SELECT CASE WHEN regime IN ('volatile', 'trending') THEN 'other' ELSE regime END AS regime, count(*) AS n FROM rg GROUP BY ALL"))(lambda s, d: L.regime_group_rare(regime(s, d), ("volatile", "trending")).groupBy("regime").agg(F.count(F.lit(1)).alias("n")))
H12 = (
    f"x AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {WINDOW})",
    f"""y AS (
  SELECT *, round(CASE WHEN count(ret) OVER {frame(50)} >= 20 THEN stddev_samp(ret) OVER {frame(50)} END, 12) AS sd, round(avg(abs(ret)) OVER {frame(50)}, 12) AS l1,
         round(CASE WHEN count(ret) OVER {frame(50)} >= 20 THEN skewness(ret) OVER {frame(50)} END, 12) AS sk,
         round(volume / greatest(avg(volume) OVER {frame(50)}, 1e-9), 12) AS lq
  FROM x)""",
    "k AS (SELECT quantile_cont(sd, 0.8) AS v, quantile_cont(l1, 0.6) AS t FROM y WHERE ts_event < TIMESTAMP '2024-01-20')",
)
H12_SELECT = """round(sd, 6) AS ret_std, round(l1, 6) AS ret_l1, round(sk, 6) AS ret_skew, round(lq, 6) AS liquidity_ratio,
       CASE WHEN lq < 0.3 THEN 'low_liquidity' WHEN sd > v THEN 'volatile' WHEN l1 > t THEN 'trending' ELSE 'ranging' END AS regime FROM y, k"""
feature(
    "h12_distribution_regime", lambda s, d: L.distribution_regime(bars(s, d), train_until="2024-01-20"), ["ret_std", "ret_l1", "ret_skew", "liquidity_ratio", "regime"],
    (TICKS_SQL, BARS, *H12), H12_SELECT,
)
query(
    "h14_regime_session_label",
    sql(*A, REGIME, f"z AS (SELECT regime || '|' || {SESSION} AS l FROM rg)", "c AS (SELECT l, count(*) AS n FROM z GROUP BY l)", "k AS (SELECT CASE WHEN n >= greatest(100.0, 0.005 * (SELECT count(*) FROM z)) THEN l ELSE 'other' END AS regime_session, n FROM c)", select="SELECT regime_session, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL"),
)(lambda s, d: L.regime_session_label(regime(s, d).withColumn("session", W.session_name()), 100).groupBy("regime_session").agg(F.count(F.lit(1)).alias("n")))
H17 = (
    f"x AS (SELECT *, abs(ofi) < 0.3 AND sign(round(close - open, 9)) <= 0 AND sign(round(close - open, 9)) >= 0 AS q, lead(buy_share, 4) OVER w - buy_share AS ahead FROM flow_bars {WINDOW})",
    f"""g AS (
  SELECT *, coalesce(lag(q) OVER w, false) AS p, row_number() OVER w - row_number() OVER (PARTITION BY symbol, q ORDER BY ts_event) AS k FROM x {WINDOW})""",
)
H17_SELECT = """q AS range_like, row_number() OVER (PARTITION BY symbol, q, k ORDER BY ts_event) AS range_run, CAST(q AND NOT p AS INT) AS range_start,
       CAST(NOT q AND p AS INT) AS range_end, round(ahead, 6) AS buy_share_ahead FROM g"""
feature(
    "h17_range_context_runs",
    lambda s, d: L.range_context_runs(flow_bars(s, d).withColumn("trend", F.signum(F.round(F.col("close") - F.col("open"), 9))), "ofi", trend="trend", walls=("buy_share",)).withColumn("range_run", F.col("range_run").cast("bigint")),
    ["range_like", "range_run", "range_start", "range_end", "buy_share_ahead"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, *H17), H17_SELECT,
)
query("h1_zigzag_swings")(lambda s, d: H.zigzag_swings(AB(s, d)))
query("h2_swing_class_score")(lambda s, d: rounded(H.swing_class_score(H.zigzag_swings(AB(s, d)))))
query("h3_trend_maturity")(lambda s, d: H.trend_maturity(AB(s, d), H.zigzag_swings(AB(s, d))).select(*ID, "age", "maturity"))
feature(
    "h6_timeframe_alignment", lambda s, d: H.timeframe_alignment(bars(s, d)), ["alignment"], (TICKS_SQL, BARS, f"x AS (SELECT *, close - lag(close, 5) OVER w AS a, close - lag(close, 20) OVER w AS b, close - lag(close, 80) OVER w AS c FROM bars {WINDOW})"),
    "CAST(sign(coalesce(sign(round(a, 9)), 0) + coalesce(sign(round(b, 9)), 0) + coalesce(sign(round(c, 9)), 0)) AS INTEGER) AS alignment FROM x",
)
query(
    "h16_volatility_quartile",
    sql(*A, "q AS (SELECT quantile_cont(atr / close, 0.25) AS a, quantile_cont(atr / close, 0.5) AS b, quantile_cont(atr / close, 0.75) AS c FROM atr)", select="SELECT CAST(CASE WHEN atr / close <= a THEN 1 WHEN atr / close <= b THEN 2 WHEN atr / close <= c THEN 3 ELSE 4 END AS INTEGER) AS quartile, count(*) AS n FROM atr, q GROUP BY ALL"),
)(lambda s, d: H.volatility_quartile(AB(s, d)).groupBy("quartile").agg(F.count(F.lit(1)).alias("n")))

# Events
I1 = """g0 AS (
  SELECT symbol, ts_event, round(ofi * 0.6 + buy_share * 0.4, 9) AS sc FROM flow_bars),
g1 AS (SELECT *, CAST(sc >= 0.67 AS INT) AS fl FROM g0),
g2 AS (
  SELECT *, CASE WHEN fl = 0 AND sc > 0 THEN row_number() OVER (PARTITION BY fl = 0 AND sc > 0 ORDER BY sc DESC, ts_event, symbol) END AS r,
         (SELECT greatest(ceil(count(*) * 0.5) - sum(fl), 0) FROM g1) AS need FROM g1)"""
I1_SELECT = "round(sc, 6) AS event_score, CAST(coalesce(r <= need, false) AS INT) AS promoted, greatest(fl, CAST(coalesce(r <= need, false) AS INT)) AS event_flag FROM g2"
feature(
    "i1_micro_event_gate", lambda s, d: L.micro_event_gate(flow_bars(s, d), {"ofi": 0.6, "buy_share": 0.4}, 0.7, 0.9, 0.04, 0.5), ["event_score", "promoted", "event_flag"],
    (TICKS_SQL, BARS, FLOW, FLOW_BARS, I1), I1_SELECT,
)
I2 = (
    """lv AS (
  SELECT a.symbol, a.ts_event, a.close, CASE WHEN a.atr > 1e-12 THEN a.atr END AS atr, round(p.prev_day_high, 9) AS dh, round(p.prev_day_low, 9) AS dl, round(p.prev_week_high, 9) AS wh,
         round(p.prev_week_low, 9) AS wl, round(f.ofi, 9) AS ofi, f.cvd_delta, round(f.cvd_velocity, 9) / 30 AS vz
  FROM atr a JOIN prev p USING (symbol, ts_event) JOIN flow_bars f USING (symbol, ts_event))""",
    """le AS (
  SELECT *, least(1e300, abs(close - dh) / atr, abs(close - wh) / atr, abs(close - dl) / atr, abs(close - wl) / atr) AS nr,
         CASE WHEN (coalesce(abs(close - dh) / atr < 0.3, false) OR coalesce(abs(close - wh) / atr < 0.3, false)) AND cvd_delta < 0 THEN 1
              WHEN (coalesce(abs(close - dl) / atr < 0.3, false) OR coalesce(abs(close - wl) / atr < 0.3, false)) AND cvd_delta > 0 THEN -1 ELSE 0 END AS dv FROM lv)""",
)
I2_SELECT = """dv AS divergence, CAST(hour(ts_event) BETWEEN 7 AND 21 AND nr < 0.5 AND (abs(ofi) > 0.3 OR dv <> 0 OR abs(vz) > 1.5) AS INT) AS structure_event,
       round(CASE WHEN hour(ts_event) BETWEEN 7 AND 21 THEN least(greatest(1 - nr / 0.5, 0.0), 1.0)
             * least(least(abs(ofi), 1.0) * 0.4 + abs(dv) * 0.3 + least(abs(vz) / 3, 1.0) * 0.3, 1.0) ELSE 0 END, 6) AS event_score FROM le"""
STRUCTURE = lambda s, d: stage(W.previous_period_levels(W.true_range_atr(flow_bars(s, d)))).withColumn("vwap_z", F.col("cvd_velocity") / 30)
feature(
    "i2_structure_event_gate", lambda s, d: L.structure_event_gate(STRUCTURE(s, d), ("prev_day_high", "prev_week_high"), ("prev_day_low", "prev_week_low")),
    ["divergence", "structure_event", "event_score"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, ATR, PREV, *I2), I2_SELECT,
)
I3 = (
    """v AS (
  SELECT *, round(close - open, 9) AS mv, abs(cvd_delta) AS ca, abs(round(close - open, 9)) AS ma,
         sign(ofi) + sign(cvd_delta) + sign(round(close - open, 9)) + sign(round(buy_share - 0.5, 9)) AS q
  FROM flow_bars)""",
    f"""u AS (
  SELECT *, CASE WHEN count(ca) OVER {frame(50)} >= 5 THEN nullif(quantile_cont(ca, 0.5) OVER {frame(50)}, 0) END AS cm,
         CASE WHEN count(ma) OVER {frame(50)} >= 5 THEN nullif(quantile_cont(ma, 0.5) OVER {frame(50)}, 0) END AS mm FROM v)""",
    """t AS (
  SELECT *, round(0.38 * coalesce(CASE WHEN cm IS NOT NULL THEN least(greatest(cvd_delta / cm, -1.0), 1.0) END, 0)
              + 0.30 * least(greatest(ofi, -1.0), 1.0) + 0.17 * least(greatest(round(buy_share - 0.5, 9), -1.0), 1.0)
              + 0.15 * coalesce(CASE WHEN mm IS NOT NULL THEN least(greatest(mv / mm, -1.0), 1.0) END, 0), 9) AS sc
  FROM u)""",
)
I3_SELECT = """CAST(CASE WHEN abs(q) >= 3 THEN sign(q) WHEN abs(sc) > 0.1 THEN sign(sc) ELSE sign(q) END AS INTEGER) AS direction, round(sc, 6) AS vote_score,
       CASE WHEN abs(q) >= 3 THEN 'strict' WHEN abs(sc) > 0.1 THEN 'score' WHEN q <> 0 THEN 'weak' ELSE 'none' END AS vote_kind FROM t"""
VOTES = lambda s, d: flow_bars(s, d).withColumns({"move": F.round(F.col("close") - F.col("open"), 9), "lean": F.round(F.col("buy_share") - 0.5, 9)})
feature(
    "i3_event_direction_vote",
    lambda s, d: L.event_direction_vote(VOTES(s, d), ["ofi", "cvd_delta", "move", "lean"], weights={"cvd_delta": 0.38, "ofi": 0.30, "lean": 0.17, "move": 0.15}, scaled=("cvd_delta", "move")),
    ["direction", "vote_score", "vote_kind"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, *I3), I3_SELECT,
)
I4 = f"""z AS (
  SELECT *, avg(cvd_delta) OVER {frame(20)} AS cm, stddev_samp(cvd_delta) OVER {frame(20)} AS cs, avg(volume) OVER {frame(20)} AS vm FROM flow_bars)"""
feature(
    "i4_activity_event_filter", lambda s, d: L.activity_event_filter(flow_bars(s, d), obi=0.9, walls=("n_trades",), wall=5, shifts=("cvd_delta",)), ["activity_event"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, I4),
    """CAST(volume > 2.0 * vm OR abs(ofi) > 0.9 OR n_trades > 5 OR coalesce(abs(cvd_delta - cm) / CASE WHEN cs = 0 THEN 1e-9 ELSE cs END > 2, false) AS INTEGER) AS activity_event FROM z""",
)
query(
    "i6_sweep_events",
    sql(*A, PREV, "g AS (SELECT a.*, round(p.prev_day_low, 9) AS lv FROM atr a JOIN prev p USING (symbol, ts_event))", select="SELECT symbol, ts_event, d AS depth, r AS reclaim FROM g, (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) x(d), (VALUES (true), (false)) y(r) WHERE low < lv - d * atr AND (NOT r OR close > lv)"),
)(lambda s, d: L.sweep_events(stage(W.previous_period_levels(atr_bars(s, d))), "prev_day_low", (0.0, 0.5)))
feature("i8_setup_class", lambda s, d: L.setup_class(W.candle_shape(stage(W.true_range_atr(flow_bars(s, d)))).withColumn("cancel_ratio", F.col("buy_share") / 3)), ["setup"], (*A, FLOW), "CASE WHEN round(buy_share, 9) / 3 > 0.25 THEN 'withdrawal' WHEN abs(round(ofi, 9)) > 0.5 THEN 'imbalance' WHEN (high - low) / greatest(atr, 1e-9) < 0.5 THEN 'absorption' ELSE 'mixed' END AS setup FROM atr JOIN cvd USING (symbol, ts_event)")
I9 = "round(least(greatest(ln(1 + volume) * (1 + abs(ofi)) * (1 + buy_share) + 0.25 * n_trades + 0.1 * (high - low), 0), 100), 6) AS liquidity_score FROM flow_bars"
feature(
    "i9_liquidity_score", lambda s, d: L.liquidity_score(flow_bars(s, d).withColumn("gap", F.col("high") - F.col("low")), depth="n_trades", gap="gap", walls=("buy_share",), imbalance="ofi"),
    ["liquidity_score"], (TICKS_SQL, BARS, FLOW, FLOW_BARS), I9,
)


# Labels
BARRIERS_SQL = (
    REGIME,
    f"""b0 AS (
  SELECT *, {SESSION} AS session, CASE regime WHEN 'volatile' THEN 2.0 WHEN 'trending' THEN 1.5 WHEN 'ranging' THEN 1.0 ELSE 1.25 END * greatest(atr, 1e-6) AS wide,
         CASE regime WHEN 'volatile' THEN 12 WHEN 'trending' THEN 24 WHEN 'ranging' THEN 8 ELSE 10 END AS cap,
         list({{'t': ts_event, 'o': open, 'h': high, 'l': low, 'c': close}}) OVER {nxt(24)} AS w0
  FROM rg)""",
    """b1 AS (
  SELECT *, w0[1:cap] AS w1, CASE session WHEN 'asia' THEN 8 WHEN 'london' THEN 16 WHEN 'overlap' THEN 16 WHEN 'ny' THEN 22 ELSE 21 END AS eh FROM b0)""",
    """b2 AS (
  SELECT *, CASE WHEN coalesce(list_position(list_transform(w1, lambda b: hour(b.t) >= eh), true), 0) > 0
                 THEN w1[1:list_position(list_transform(w1, lambda b: hour(b.t) >= eh), true) - 1] ELSE w1 END AS w FROM b1)""",
    "b3 AS (SELECT *, coalesce(list_position(list_transform(w, lambda b: b.h >= close + wide OR b.l <= close - wide), true), 0) AS k FROM b2)",
    """b4 AS (
  SELECT *, CASE WHEN k > 0 THEN w[k] END AS hit, coalesce(list_max(list_transform(w, lambda b: b.c - close)), 0) AS mx,
         coalesce(list_min(list_transform(w, lambda b: b.c - close)), 0) AS mn FROM b3)""",
    """barrier_labels AS (
  SELECT symbol, ts_event, open, close, atr, regime,
         CASE WHEN coalesce(len(w0), 0) = 0 THEN NULL
              WHEN k = 0 THEN CASE WHEN greatest(mx, 0) > 2 * greatest(-mn, 0) AND greatest(mx, 0) >= greatest(atr, 1e-6) THEN 1
                                   WHEN greatest(-mn, 0) > 2 * greatest(mx, 0) AND greatest(-mn, 0) >= greatest(atr, 1e-6) THEN -1 ELSE 0 END
              WHEN hit.h >= close + wide AND hit.l <= close - wide THEN CASE WHEN abs(close + wide - hit.o) <= abs(hit.o - (close - wide)) THEN 1 ELSE -1 END
              WHEN hit.h >= close + wide THEN 1 ELSE -1 END AS label,
         coalesce(hit.t, w[len(w)].t) AS label_end, CASE WHEN coalesce(len(w0), 0) > 0 THEN CAST(CASE WHEN k > 0 THEN k ELSE len(w) END AS INT) END AS bars_held,
         CASE WHEN coalesce(len(w0), 0) = 0 THEN NULL WHEN k = 0 THEN 'timeout' WHEN hit.h >= close + wide AND hit.l <= close - wide
              THEN CASE WHEN abs(close + wide - hit.o) <= abs(hit.o - (close - wide)) THEN 'up' ELSE 'down' END
              WHEN hit.h >= close + wide THEN 'up' ELSE 'down' END AS outcome
  FROM b4)""",
)
CAPS = {"volatile": (2.0, 12), "trending": (1.5, 24), "ranging": (1.0, 8), "low_liquidity": (1.25, 10)}
ENDS = {"asia": 8, "london": 16, "overlap": 16, "ny": 22}


def barrier_labels(s, d):
    """Barriers and horizons by regime, ends of sessions, timeouts decided by their excursions."""
    return L.triple_barrier(regime(s, d).withColumn("session", W.session_name()), regimes=CAPS, session_ends=ENDS, rescue_ratio=2.0)


feature("j1_triple_barrier", barrier_labels, ["label", "label_end", "outcome", "bars_held"], (*A, *BARRIERS_SQL), "label, label_end, outcome, bars_held FROM barrier_labels")
CLOSES = f"c24 AS (SELECT *, list(close) OVER {nxt(24)} AS x FROM atr), f24 AS (SELECT *, list_filter(x, lambda v: v >= close + atr OR v <= close - atr)[1] AS f FROM c24)"
feature("j2_close_barrier_labels", lambda s, d: L.close_barrier_labels(AB(s, d)), ["close_label", "close_valid"], (*A, CLOSES), "CASE WHEN f >= close + atr THEN 1 WHEN f <= close - atr THEN -1 ELSE 0 END AS close_label, f IS NOT NULL OR coalesce(len(x), 0) = 24 AS close_valid FROM f24")
J4 = (
    f"""h AS (
  SELECT *, list(close) OVER {nxt(24)} AS x0, greatest(atr, 1e-9) AS u, CAST(4 + (hour(ts_event) % 3) * 8 AS INT) AS hz,
         floor(close * 20 + 1) / 20 AS ask_wall, ceil(close * 20 - 1) / 20 AS bid_wall FROM atr)""",
    """e AS (
  SELECT *, x0[1:hz] AS x, CASE WHEN ask_wall - close >= 0.02 THEN least(1.5 * u, ask_wall - close) ELSE 1.5 * u END AS tl,
         CASE WHEN -(bid_wall - close) >= 0.02 THEN least(1.5 * u, -(bid_wall - close)) ELSE 1.5 * u END AS ts FROM h)""",
    """f AS (
  SELECT *, list_position(list_transform(x, lambda v: v - close >= tl OR v - close <= -u), true) AS kl,
         list_position(list_transform(x, lambda v: -(v - close) >= ts OR -(v - close) <= -u), true) AS ks FROM e)""",
    """g AS (
  SELECT *, CAST(coalesce(x[nullif(kl, 0)] - close >= tl, false) AS INT) AS long_win, CAST(coalesce(-(x[nullif(ks, 0)] - close) >= ts, false) AS INT) AS short_win FROM f)""",
)
J4_SELECT = """long_win, short_win, CAST(nullif(kl, 0) AS INT) AS long_bar, CAST(nullif(ks, 0) AS INT) AS short_bar,
       CASE WHEN long_win = 1 AND (short_win = 0 OR kl <= ks) THEN 1 WHEN short_win = 1 THEN -1 ELSE 0 END AS first_side FROM g"""
WALLS = lambda s, d: AB(s, d).withColumns({"hz": 4 + (F.hour("ts_event") % 3) * 8, "ask_wall": F.floor(F.col("close") * 20 + 1) / 20, "bid_wall": F.ceil(F.col("close") * 20 - 1) / 20})
feature(
    "j4_dual_side_scan", lambda s, d: L.dual_side_scan(WALLS(s, d), horizon_column="hz", walls=("bid_wall", "ask_wall")),
    ["long_win", "short_win", "long_bar", "short_bar", "first_side"], (*A, *J4), J4_SELECT,
)
EXC = f"""ex0 AS (
  SELECT *, round(greatest((max(high) OVER {nxt(12)} - close) / greatest(atr, 1e-9), 0 * max(high) OVER {nxt(12)}), 9) AS mfe0,
         round(greatest((close - min(low) OVER {nxt(12)}) / greatest(atr, 1e-9), 0 * min(low) OVER {nxt(12)}), 9) AS mae0 FROM labelled),
ex AS (
  SELECT *, mfe0 AS mfe, mae0 AS mae, CASE WHEN mfe0 > 2 * mae0 AND mfe0 >= 0.25 THEN 1 WHEN mae0 > 2 * mfe0 AND mae0 >= 0.25 THEN -1 ELSE 0 END AS dir FROM ex0)"""
J5 = (
    "st AS (SELECT *, CASE WHEN dir <> 0 THEN greatest(mfe, mae) END AS s FROM ex)",
    f"bq AS (SELECT *, greatest(coalesce(CASE WHEN count(s) OVER {frame(96, 1)} >= 24 THEN quantile_cont(s, 0.7) OVER {frame(96, 1)} END, 0.5), 0.4) AS b FROM st)",
)
J5_SELECT = "round(mfe, 6) AS mfe, round(mae, 6) AS mae, dir AS excursion_dir, CASE WHEN s IS NULL THEN 0 WHEN s >= b THEN 2 ELSE 1 END AS excursion_quality FROM bq"
feature("j5_excursion_labels", lambda s, d: L.excursion_labels(AB(s, d)), ["mfe", "mae", "excursion_dir", "excursion_quality"], (*AL, EXC, *J5), J5_SELECT)
feature("j7_trend_veto", lambda s, d: L.trend_veto(labelled(s, d).withColumn("trend", F.coalesce(F.round(F.col("close") - F.lag("close", 4).over(L.by_time()), 9), F.lit(0.0)))), ["vetoed_label"], AL, f"CASE WHEN sign(t) * label < 0 AND abs(t) >= 0.5 THEN 0 ELSE label END AS vetoed_label FROM (SELECT *, coalesce(round(close - lag(close, 4) OVER w, 9), 0) AS t FROM labelled {WINDOW})")
feature("j8_forward_return", lambda s, d: W.forward_return(bars(s, d), 5), ["fwd_ret_5"], (TICKS_SQL, BARS), f"round(lead(close, 5) OVER w / close - 1, 6) AS fwd_ret_5 FROM bars {WINDOW}")
feature("j9_log_target", lambda s, d: L.log_target(bars(s, d), 4, 0.003), ["target_valid", "log_target"], (TICKS_SQL, BARS), f"lead(close, 4) OVER w IS NOT NULL AS target_valid, round(least(greatest(ln(lead(close, 4) OVER w / close), CASE WHEN lead(close, 4) OVER w IS NULL THEN NULL ELSE -0.003 END), 0.003 + 0 * lead(close, 4) OVER w), 6) AS log_target FROM bars {WINDOW}")
J11 = "sr AS (SELECT *, least(greatest(0.6 * least(abs(close - open) / greatest(atr, 1e-9), 1) + 0.4 * least(greatest(1 - coalesce(bars_held, 0) / 24, 0), 1), 0), 1) AS g FROM barrier_labels)"
J11_P = "CASE label WHEN 1 THEN 0.55 + 0.45 * g WHEN -1 THEN 0.45 - 0.45 * g ELSE 0.5 END"
J11_SELECT = f"round({J11_P}, 6) AS p_up, round(least(abs({J11_P} - 0.5) * 2, 1), 6) AS confidence, round(1 + least(abs({J11_P} - 0.5) * 2, 1), 6) AS soft_weight FROM sr"
feature(
    "j11_soft_labels_rule", lambda s, d: L.soft_labels_rule(barrier_labels(s, d).withColumn("event_score", F.least(F.abs(F.col("close") - F.col("open")) / F.greatest("atr", F.lit(1e-9)), F.lit(1.0)))),
    ["p_up", "confidence", "soft_weight"], (*A, *BARRIERS_SQL, J11), J11_SELECT,
)
NEAR = [f"{f}(label, {k}) OVER w" for k in (1, 3, 5) for f in ("lag", "lead")]
feature("j15_label_stability", lambda s, d: L.label_stability(labelled(s, d)), ["label_stability"], AL, "round((" + " + ".join(f"coalesce(CAST({x} = label AS INT), 0)" for x in NEAR) + ") / greatest(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in NEAR) + f", 1), 6) AS label_stability FROM labelled {WINDOW}")
feature(
    "j17_imbalance_flip_label", lambda s, d: L.imbalance_flip_label(rounded(flow_bars(s, d), 9), "ofi"), ["flip"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, f"x AS (SELECT *, list(round(ofi, 9)) OVER {nxt(6)} AS x FROM flow_bars)"),
    "CAST(coalesce(len(list_filter(x, lambda v: sign(v) = -sign(ofi) AND abs(v) >= 0.1 AND v <> 0)), 0) > 0 AS INTEGER) AS flip FROM x",
)
feature("j18_r_multiple_labels", lambda s, d: L.r_multiple_labels(labelled(s, d).where("label is not null")).withColumn("r_class", F.col("r_class")), ["max_r", "r_class"], (*AL, f"q AS (SELECT *, CASE WHEN label >= 0 THEN max(high) OVER {nxt(12)} - close ELSE close - min(low) OVER {nxt(12)} END AS b FROM labelled WHERE label IS NOT NULL)", "m AS (SELECT *, least(greatest(b / greatest(atr, 1e-9), 0), 5) AS r FROM q)"), "round(r, 6) AS max_r, CASE WHEN r >= 2 THEN 3 WHEN r >= 1 THEN 2 WHEN r >= 0.5 THEN 1 ELSE 0 END AS r_class FROM m")
feature("j19_sweep_volume_label", lambda s, d: L.sweep_volume_label(bars(s, d), 6, 2.0), ["volume_sweep"], (TICKS_SQL, BARS), f"CAST(coalesce(max(volume) OVER {nxt(6)} >= 2 * quantile_cont(volume, 0.5) OVER {frame(20)}, false) AS INTEGER) AS volume_sweep FROM bars")
feature("j21_risk_tier_label", lambda s, d: L.risk_tier_label(AB(s, d), 100, 1.05, 1.2), ["risk_tier"], (*A, f"m AS (SELECT *, quantile_cont(atr, 0.5) OVER {frame(100, 1)} AS m FROM atr)"), "CASE WHEN atr / greatest(m, 1e-9) >= 1.2 THEN 2 WHEN atr / greatest(m, 1e-9) >= 1.05 THEN 1 ELSE 0 END AS risk_tier FROM m WHERE true")
feature(
    "j22_bars_to_flip", lambda s, d: L.bars_to_flip(flow_bars(s, d), "cvd_delta", 6).withColumn("bars_to_flip", F.col("bars_to_flip").cast("bigint")), ["bars_to_flip"], (TICKS_SQL, BARS, FLOW, FLOW_BARS, f"x AS (SELECT *, list(cvd_delta) OVER {nxt(6)} AS x FROM flow_bars)"),
    "CASE WHEN len(x) = 6 THEN coalesce(CAST(list_position(list_transform(x, lambda v: sign(v) * sign(cvd_delta) < 0), true) AS BIGINT), 7) END AS bars_to_flip FROM x",
)
feature("j23_clean_segment_mask", lambda s, d: L.clean_segment_mask(W.session_break_flag(bars(s, d), 1.5)), ["clean_segment"], (TICKS_SQL, BARS, BREAK.replace("3 * median", "1.5 * median")), "sum(CAST(session_break AS INT)) OVER (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 0 AS clean_segment FROM brk")
query(
    "j24_sequence_windows",
    sql(TICKS_SQL, BARS, f"x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS i, sum(volume) OVER {frame(16)} AS v, count(*) OVER {frame(16)} AS n FROM bars)", select="SELECT symbol, ts_event, n AS width, v AS volume FROM x WHERE n = 16 AND (i - 16) % 4 = 0"),
)(lambda s, d: L.sequence_windows(bars(s, d), ["volume", "close"]).select(*ID, F.size("window_rows").cast("bigint").alias("width"), F.aggregate("window_rows", F.lit(0.0), lambda a, r: a + r["volume"]).alias("volume")))

# Rolls and sets
CT = market.contracts
query("k1_parse_contract_code", "SELECT c AS code, 'ES' AS root, c[3] AS letter, position(c[3] IN 'FGHJKMNQUVXZ') AS month, CAST(c[4] AS INTEGER) AS year FROM (SELECT DISTINCT 'ES' || 'FGHJKMNQUVXZ'[month(l_shipdate)] || CAST(year(l_shipdate) % 10 AS VARCHAR) AS c FROM lineitem)")(lambda s, d: R.parse_contract_code(R.codes(CT(s, d)), "code"))
DAILY = "daily AS (SELECT CAST(ts_event AS DATE) AS day, sum(CASE WHEN contract = 'near' THEN size ELSE 0 END) AS near, sum(CASE WHEN contract = 'far' THEN size ELSE 0 END) AS far FROM contracts GROUP BY ALL)"
ROLL = "roll AS (SELECT min(day) AS roll_day FROM daily WHERE far > near)"
query("k2_roll_day_by_volume", sql(CONTRACTS_SQL, DAILY, ROLL, select="SELECT roll_day FROM roll"))(lambda s, d: R.roll_day_by_volume(CT(s, d)))
OFFSET = "offs AS (SELECT quantile_cont(price, 0.5) FILTER (contract = 'far') - quantile_cont(price, 0.5) FILTER (contract = 'near') AS add_to_old FROM contracts, roll WHERE CAST(ts_event AS DATE) >= roll_day - 30 AND CAST(ts_event AS DATE) < roll_day + 30)"
query("k3_roll_offset", sql(CONTRACTS_SQL, DAILY, ROLL, OFFSET, select="SELECT round(add_to_old, 6) AS add_to_old FROM offs"))(lambda s, d: rounded(R.roll_offset(CT(s, d), R.roll_day_by_volume(CT(s, d)), 30).select("add_to_old")))
query("k4_continuous_series", sql(CONTRACTS_SQL, DAILY, ROLL, OFFSET, select="SELECT seq, round(CASE WHEN contract = 'near' THEN price + add_to_old ELSE price END, 6) AS price, CAST(ts_event AS DATE) = roll_day AS is_roll FROM contracts, roll, offs WHERE (contract = 'near' AND CAST(ts_event AS DATE) < roll_day) OR (contract = 'far' AND CAST(ts_event AS DATE) >= roll_day)"))(lambda s, d: rounded(R.continuous_series(CT(s, d), R.roll_offset(CT(s, d), R.roll_day_by_volume(CT(s, d)), 30)).select("seq", "price", "is_roll")))
query("k7_roll_continuity_check", sql(TICKS_SQL, BARS, select="SELECT symbol, count(*) AS jumps FROM (SELECT symbol, abs(open - lag(close) OVER (PARTITION BY symbol ORDER BY ts_event)) / 0.01 AS g FROM bars) WHERE g > 20.0001 GROUP BY ALL"))(lambda s, d: R.roll_continuity_check(bars(s, d), 0.01, 20.0001))
query("k9_key_set_difference", sql(TICKS_SQL, BARS, "b2 AS (SELECT symbol, ts_event FROM bars WHERE volume > 50)", select="SELECT 'only_a' AS side, count(*) AS n FROM (SELECT symbol, ts_event FROM bars EXCEPT SELECT * FROM b2) UNION ALL SELECT 'only_b', 0 UNION ALL SELECT 'both', count(*) FROM b2"))(lambda s, d: R.key_set_difference(bars(s, d), bars(s, d).where("volume > 50")))

# Splits
NUM = "nn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM labelled)"
query("l1_purged_split", sql(*AL, NUM, "st AS (SELECT symbol, min(ts_event) AS t FROM nn WHERE i > floor(0.8 * m) GROUP BY ALL)", "sp AS (SELECT CASE WHEN i > floor(0.8 * m) THEN 'test' WHEN label_end >= t THEN 'purged' ELSE 'train' END AS part FROM nn LEFT JOIN st USING (symbol))", select="SELECT part, count(*) AS n FROM sp GROUP BY ALL"))(lambda s, d: S.purged_split(labelled(s, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n")))
query("l2_three_way_split", sql(*AL, NUM, "p AS (SELECT CASE WHEN i <= floor(0.6 * m) - 5 THEN 'train' WHEN i > floor(0.6 * m) AND i <= floor(0.8 * m) - 5 THEN 'validation' WHEN i > floor(0.8 * m) THEN 'test' ELSE 'gap' END AS part FROM nn)", select="SELECT part, count(*) AS n FROM p GROUP BY ALL"))(lambda s, d: S.three_way_split(labelled(s, d), 0.6, 0.2, 5).groupBy("part").agg(F.count(F.lit(1)).alias("n")))
query("l3_expanding_walk_forward", sql(*AL, NUM, "f AS (SELECT *, k, floor(m * (k + 1) / 6) AS a, floor(m * (k + 2) / 6) AS b FROM nn, range(5) r(k))", "g AS (SELECT k AS fold, CASE WHEN i > a AND i <= b THEN 'test' WHEN i <= a - 10 THEN 'train' END AS part FROM f)", select="SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n FROM g WHERE part IS NOT NULL GROUP BY ALL"))(lambda s, d: S.expanding_walk_forward(labelled(s, d), 5, 10).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n")))
query("l4_combinatorial_purged_cv", sql(*AL, NUM, "g AS (SELECT CAST(least(floor((i - 1) * 5 / m), 4) AS INT) AS g FROM nn)", "c AS (SELECT a.range AS a, b.range AS b FROM range(5) a, range(5) b WHERE a.range < b.range)", select="SELECT CAST(a AS INTEGER) AS test_a, CAST(b AS INTEGER) AS test_b, count(*) FILTER (g IN (a, b)) AS n_test, count(*) FILTER (g NOT IN (a, b)) AS n_train FROM g, c GROUP BY ALL"))(lambda s, d: S.combinatorial_cv(labelled(s, d), 5))
query("l5_month_folds", "SELECT CAST(k AS INTEGER) AS fold, DATE '1995-01-01' + to_months(CAST(12 + 6 * k AS INTEGER)) AS test_start, DATE '1995-01-01' + to_months(CAST(18 + 6 * k AS INTEGER)) AS test_end FROM range(20) r(k), (SELECT max(l_shipdate) AS m FROM lineitem) WHERE DATE '1995-01-01' + to_months(CAST(18 + 6 * k AS INTEGER)) <= m")(lambda s, d: S.month_folds(CT(s, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("test_start", "test_end")}))
feature("l9_embargo_tail", lambda s, d: L.embargo_tail(labelled(s, d), 10), ["label"], (*AL, NUM), "CASE WHEN i <= m - 10 THEN label END AS label FROM nn")
