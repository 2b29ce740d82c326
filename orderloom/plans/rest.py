"""Queries: sinks and contracts that write, sequential gates, book windows, grids and trackers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orderloom.functions.stage import folder
from orderloom.operators import book as K
from orderloom.operators import diagnostics as Q
from orderloom.operators import gates as G
from orderloom.operators import joins as J
from orderloom.operators import more as X
from orderloom.operators import ranges as N
from orderloom.operators import replay as P
from orderloom.operators import resample as R
from orderloom.operators import slices as I
from orderloom.operators import stats as M
from orderloom.operators import structure as H
from orderloom.operators import studies as S
from orderloom.operators import ticks as TK
from orderloom.operators import turns as U
from orderloom.operators import windows as W
from orderloom.plans.base import ATR, BARS, BOOK_SQL, FLOW, FLOW_BARS, LABELS, SIGNED, TICKS_SQL, WINDOW, bars, flow_bars, frame, labelled, nxt, sql
from orderloom.plans.catalog import query
from orderloom.plans.composed import CELLS
from orderloom.plans.flow import SESSION
from orderloom.plans.features import BLEND, F12, F12_SELECT, FEED, FEED_SELECT, FOOT, ID, MEAN_SIZE, TENSOR, WALLS, feature, snapshots, tensor, tf
from orderloom.plans.labels import AB, A
from orderloom.sources import market
from orderloom.spec import bucket, rounded, signed_size, trailing

T, BK = market.ticks, market.book
FA = (TICKS_SQL, BARS, FLOW, FLOW_BARS)
new = lambda s: f"{folder(s)}/orderloom-{uuid.uuid4().hex}"


@query("a3_csv_to_parquet_ingest", sql(TICKS_SQL, select="SELECT symbol, count(*) AS n, sum(size) AS size FROM ticks GROUP BY ALL"))
def a3(spark, d):
    t, path = T(spark, d), new(spark)
    t.write.option("header", True).csv(f"{path}/csv")
    market.csv_to_parquet(spark, f"{path}/csv", f"{path}/pq", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema))
    return spark.read.parquet(f"{path}/pq").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("a6_bar_checkpoint", sql(TICKS_SQL, BARS, select="SELECT * FROM bars"))
def a6(spark, d):
    path = new(spark)
    X.write_checkpoint(bars(spark, d), path, "1 hour", "utc")
    return X.read_checkpoint(spark, path, "1 hour", "utc")


@query("a11_parquet_shards", sql(TICKS_SQL, select="SELECT seq, price FROM ticks"))
def a11(spark, d):
    path = new(spark)
    market.parquet_shards(T(spark, d), path, 1000)
    return spark.read.parquet(path).select("seq", "price")


@query("a12_execution_log_sink", sql(TICKS_SQL, select="SELECT seq, size FROM ticks WHERE action = 'T'"))
def a12(spark, d):
    path = new(spark)
    market.execution_log_sink(T(spark, d).where("action = 'T'").select("seq", "size"), path)
    return spark.read.schema("seq bigint, size double").json(path)


@query("c5_alignment_assert", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event FROM bars"))
def c5(spark, d):
    J.alignment_assert(bars(spark, d), flow_bars(spark, d), "bars and flow")
    return bars(spark, d).select(*ID)


query("f3_cancel_ratio", sql(TICKS_SQL, f"w AS (SELECT *, CASE WHEN action = 'A' THEN 0.0 WHEN action = 'C' AND size > 2 * avg(size) OVER {tf(100)} THEN 1.0 WHEN action = 'C' THEN 0.3 END AS w FROM ticks)", select=f"SELECT seq, round(CAST(coalesce(avg(w) OVER {tf(500)}, 0) AS DOUBLE), 6) AS cancel_ratio FROM w"))(lambda s, d: rounded(S.cancel_ratio(T(s, d)).select("seq", "cancel_ratio")))
query("f18_order_feature_rows", sql(TICKS_SQL, "o AS (SELECT *, date_trunc('hour', ts_event) AS b FROM ticks)", "n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, b) AS n, count(*) OVER (PARTITION BY symbol, b, order_id) AS repeats, first_value(price) OVER w AS p FROM o WINDOW w AS (PARTITION BY symbol, b ORDER BY ts_event, seq))", select="SELECT seq, round(ln(1 + size), 6) AS log_size, round(price - p, 6) AS distance, round(i / n, 6) AS place, repeats FROM n WHERE n <= 3 OR floor(i * 3 / n) <> floor((i - 1) * 3 / n)"))(lambda s, d: rounded(S.order_rows(T(s, d), most=3).select("seq", "log_size", "distance", "place", "repeats")))
def with_recursive(*ctes, select):
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + select


F8E = (
    "te AS (SELECT *, CAST(ts_event AS DATE) AS d, row_number() OVER w AS i, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER w AS g, CASE WHEN action = 'T' THEN 0.175 WHEN action IN ('A', 'C') THEN 0.5 ELSE 0 END AS j FROM ticks WINDOW w AS (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq))",
    "re(symbol, d, i, y) AS (SELECT symbol, d, i, CAST(0 AS DOUBLE) FROM te WHERE i = 1 UNION ALL SELECT t.symbol, t.d, t.i, r.y * exp(-0.001 * g / 1000000.0) + j FROM re r JOIN te t ON t.symbol = r.symbol AND t.d = r.d AND t.i = r.i + 1)",
    "ve AS (SELECT te.*, CASE WHEN i > 1 THEN y + 0.1 END AS v FROM te JOIN re USING (symbol, d, i))",
)
query("f8_event_intensity", with_recursive(TICKS_SQL, *F8E, select=f"SELECT seq, round(CASE WHEN v IS NULL THEN 0.1 WHEN count(v) OVER {tf(100)} >= 10 THEN v / avg(v) OVER {tf(100)} ELSE v END, 5) AS event_intensity FROM ve"))(lambda s, d: rounded(U.event_intensity(T(s, d), beta=0.001).select("seq", "event_intensity"), 5))
HALF = "(PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq ROWS BETWEEN {a} PRECEDING AND {b})"
F11 = (
    "tt AS (SELECT * FROM ticks WHERE action = 'T')", f"fc AS (SELECT *, sum({SIGNED}) OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq) AS c FROM tt)",
    f"""fm AS (SELECT *, lag(c, 9) OVER w AS p, count(*) OVER {tf(20)} AS n, sign(round(avg(price) OVER {HALF.format(a=9, b='CURRENT ROW')} - avg(price) OVER {HALF.format(a=19, b='10 PRECEDING')}, 9)) AS ps, sign(round(avg(c) OVER {HALF.format(a=9, b='CURRENT ROW')} - avg(c) OVER {HALF.format(a=19, b='10 PRECEDING')}, 9)) AS cs,
  max(price) OVER {tf(10)} - min(price) OVER {tf(10)} AS r, first_value(price) OVER {tf(10)} AS f, max(price) OVER {tf(20)} AS h, min(price) OVER {tf(20)} AS l, first_value(price) OVER {tf(20)} AS f2 FROM fc WINDOW w AS (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq))""",
)
F11_SELECT = """SELECT seq, round(coalesce((c - p) / greatest(abs(c), abs(p), 1), 0), 4) AS flow_momentum, CASE WHEN n < 20 OR ps = 0 THEN 0.0 WHEN ps = cs THEN 1.0 ELSE -1.0 END::DOUBLE AS divergence,
  CASE WHEN n >= 5 AND r > 0 THEN round(least(abs(price - f) / r, 1), 4) ELSE 0 END AS trend_strength, CASE WHEN n >= 5 AND h > l THEN round(CASE WHEN price > f2 THEN h - price ELSE price - l END / (h - l), 4) ELSE 0 END AS correction_depth FROM fm"""
query("f11_flow_momentum_divergence", sql(TICKS_SQL, *F11, select=F11_SELECT))(lambda s, d: U.momentum_divergence(T(s, d), 10, 20, 5).select("seq", "flow_momentum", "divergence", "trend_strength", "correction_depth"))
F1_COLUMNS = ["tape_speed", "micro_range", "burst", "trade_gap_ms", "impact", "intensity", "net_signed", "session_vwap", "vwap_z", "vwap_slope", "absorption", "flow_momentum", "divergence", "trend_strength", "correction_depth", "sweep"]


@query(
    "f1_tick_feature_job",
    with_recursive(
        FEED, *F11[1:], f"aa AS (SELECT seq, abs(sum({SIGNED}) OVER {tf(50)}) / greatest(abs(price - lag(price, 49) OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq)), 0.01) AS r, symbol, ts_event FROM tt)",
        f"ab AS (SELECT seq, round(least(r / greatest(quantile_cont(r, 0.5) OVER {tf(200)}, 1e-9), 25), 7) AS absorption FROM aa)", *F12,
        select=f"SELECT x.* EXCLUDE (symbol, ts_event), absorption, flow_momentum, divergence, trend_strength, correction_depth, sweep FROM ({FEED_SELECT.replace('dv / sd ELSE 0 END, 7)', 'dv / sd ELSE 0 END, 4)')}) x JOIN ab USING (seq) JOIN ({F11_SELECT}) m USING (seq) JOIN (SELECT seq, {F12_SELECT}) w USING (seq)",
    ),
)
def f1(spark, d):
    return rounded(U.tick_feature_job(T(spark, d), 10, 20, 5).withColumn("burst", F.least("burst", F.lit(1e6))).select("seq", *F1_COLUMNS), 7)


F13 = (
    f"tf1 AS (SELECT *, CAST(ts_event AS DATE) AS d, {SIGNED} AS g, row_number() OVER w AS i, max(price) OVER {tf(4)} AS h, min(price) OVER {tf(4)} AS l FROM ticks WHERE action = 'T' WINDOW w AS (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq))",
    "tf2 AS (SELECT *, 2 * (price - l) / CASE WHEN h > l THEN h - l ELSE 0.0001 END - 1 AS x FROM tf1)",
    """rf(symbol, d, i, v, f, e, t) AS (
  SELECT symbol, d, i, v, 0.5 * ln((1 + v) / (1 - v)), 0.5 * ln((1 + v) / (1 - v)), 0 FROM (SELECT symbol, d, i, least(greatest(0.5 * x, -0.999), 0.999) AS v FROM tf2 WHERE i = 4)
  UNION ALL
  SELECT symbol, d, i, v, n, m, CASE WHEN n > m AND NOT f > e AND f < -0.3 AND (g >= 0 OR n - f >= 0.3) THEN 1 WHEN f > e AND NOT n > m AND f > 0.3 AND (g <= 0 OR f - n >= 0.3) THEN -1 ELSE 0 END
  FROM (SELECT *, 0.2 * n + 0.8 * e AS m FROM (SELECT *, 0.5 * ln((1 + v) / (1 - v)) + 0.5 * f AS n FROM (SELECT z.symbol, z.d, z.i, z.g, least(greatest(0.5 * x + 0.5 * r.v, -0.999), 0.999) AS v, f, e FROM rf r JOIN tf2 z ON z.symbol = r.symbol AND z.d = r.d AND z.i = r.i + 1))))""",
)
query("f13_fisher_turn_signal", with_recursive(TICKS_SQL, *F13, select="SELECT seq, round(f, 6) AS fisher, round(e, 6) AS trigger, coalesce(t, 0) AS turn FROM tf2 LEFT JOIN rf USING (symbol, d, i)"))(lambda s, d: rounded(U.fisher_turns(T(s, d), lookback=4).select("seq", "fisher", "trigger", "turn")))
F19 = (
    f"ns AS (SELECT symbol, ts_event, seq, {SESSION} AS session, CAST(hour(ts_event) AS INT) AS hour, date_trunc('hour', ts_event) AS b, round(abs(sum({SIGNED}) OVER {tf(5)} / greatest(sum(size) OVER {tf(5)}, 1e-9)), 9) AS s FROM ticks WHERE action = 'T')",
    "nf AS (SELECT *, s >= t AS f FROM ns, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) v(t))",
    "ng AS (SELECT *, (epoch_us(ts_event) - last_value(CASE WHEN f THEN epoch_us(ts_event) END IGNORE NULLS) OVER (PARTITION BY symbol, CAST(ts_event AS DATE), t ORDER BY ts_event, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1000000.0 AS g FROM nf)",
    "nb AS (SELECT t, symbol, b, session, hour, count(*) AS n, count(*) FILTER (f) AS k, count(g) FILTER (f AND g <= 7200) AS gn, sum(g) FILTER (f AND g <= 7200) AS gs, sum(g * g) FILTER (f AND g <= 7200) AS gq FROM ng GROUP BY ALL)",
)
F19_SELECT = "SELECT t AS threshold, session, hour, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n), 6) AS fire_rate, round(CASE WHEN sum(gn) > 1 THEN greatest(sum(gq) / sum(gn) / ((sum(gs) / sum(gn)) * (sum(gs) / sum(gn))) - 1, 0) END, 6) AS gap_cv2, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 6) AS bar_share FROM nb GROUP BY GROUPING SETS ((t), (t, session), (t, hour))"


@query("f19_firing_structure", sql(TICKS_SQL, *F19, select=F19_SELECT))
def f19(spark, d):
    w = TK.last(5)
    t = TK.trades(T(spark, d))
    t = W.session_flags(t.withColumn("v", F.round(F.sum(signed_size()).over(w) / F.greatest(F.sum("size").over(w), F.lit(1e-9)), 9)))
    return rounded(U.firing_structure(t, "v", [0.5, 0.9], longest_gap=7200.0))


G6 = (
    "gi AS (SELECT symbol, CAST(ts_event AS DATE) AS d, seq, ts_event, price, (list_sum(bid_sz) - list_sum(ask_sz)) / greatest(list_sum(bid_sz) + list_sum(ask_sz), 1e-9) AS im, row_number() OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq) AS i FROM book)",
    "gl AS (SELECT *, lag(im) OVER (PARTITION BY symbol, d ORDER BY i) AS b FROM gi)",
    "rt(symbol, d, i, ref, x) AS (SELECT symbol, d, i, price, CAST(NULL AS DOUBLE) FROM gl WHERE i = 1 UNION ALL SELECT g.symbol, g.d, g.i, CASE WHEN round(abs(price - ref), 9) >= 0.1 THEN price ELSE ref END, CASE WHEN round(abs(price - ref), 9) >= 0.1 THEN CASE WHEN price > ref THEN -b ELSE b END END FROM rt r JOIN gl g ON g.symbol = r.symbol AND g.d = r.d AND g.i = r.i + 1)",
    "gh AS (SELECT symbol, d, i, avg(x) OVER (PARTITION BY symbol, d ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM rt WHERE x IS NOT NULL)",
    "gj AS (SELECT gl.*, x, m FROM gl JOIN rt USING (symbol, d, i) LEFT JOIN gh USING (symbol, d, i))",
)
query("g6_liquidity_trap", with_recursive(BOOK_SQL, *G6, select="SELECT seq, round(x, 6) AS trap, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS trap_mean FROM gj"))(lambda s, d: rounded(U.liquidity_trap(BK(s, d)).select("seq", "trap", "trap_mean")))
query("g13_flow_only_book", sql(TICKS_SQL, select=f"SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, sum(greatest({SIGNED}, 0)) AS buy, sum(greatest(-({SIGNED}), 0)) AS sell, 0.0::DOUBLE AS depth, false AS has_book FROM ticks t WHERE action = 'T' GROUP BY ALL"))(lambda s, d: S.flow_only_book(T(s, d)))
G12 = (
    f"bn AS (SELECT symbol, ts_event, row_number() OVER w AS i FROM bars {WINDOW})",
    "tb AS (SELECT symbol, ts_event, sum(depth_log) AS depth, sum(trade_imbalance) AS flow, sum(wall) AS walls FROM cells9 GROUP BY ALL)",
    "bt AS (SELECT bn.*, depth, flow, walls, sum(CASE WHEN depth IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY bn.symbol ORDER BY bn.ts_event ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS held FROM bn LEFT JOIN tb USING (symbol, ts_event))",
)
G12_SELECT = """SELECT a.symbol, a.ts_event, CAST(k AS INTEGER) AS lag, round(b.depth, 5) AS depth, round(b.flow, 5) AS flow, b.walls, round(a.held / 50, 6) AS filled_share
FROM bt a, range(50) r(k), bt b WHERE b.symbol = a.symbol AND b.i = a.i - k AND b.depth IS NOT NULL"""


@query("g12_rolling_book_window", sql(BOOK_SQL, BARS, BLEND, FOOT, TENSOR, *G12, select=G12_SELECT))
def g12(spark, d):
    """The book arrays of the last 50 bars of each bar; what a row of the window holds is reported as sums over the levels."""
    w = S.rolling_book_window(tensor(spark, d), bars(spark, d))
    over = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rounded(w.select(*ID, "lag", over("depth_log").alias("depth"), over("trade_imbalance").alias("flow"), over("wall").alias("walls"), "filled_share").withColumns({c: F.round(c, 5) for c in ("depth", "flow")}))


@query(
    "g15_book_fidelity_check",
    sql(
        BOOK_SQL, BLEND, FOOT, TENSOR, "st AS (SELECT *, exp(CAST(CAST(depth_log AS FLOAT) AS DOUBLE)) - 1 AS back, level = 7 AND hour(ts_event) = 3 AS lost, CASE WHEN level = 4 AND hour(ts_event) = 5 THEN 1 ELSE 0 END AS off FROM cells9)",
        select="SELECT count(*) AS n, CAST(count(*) FILTER (lost) AS BIGINT) AS missing, 0::BIGINT AS unknown, CAST(count(*) FILTER (NOT lost AND abs(back + off * (1 + back) - d) > 1e-3 * greatest(d, 1)) AS BIGINT) AS apart_0, CAST(count(*) FILTER (NOT lost AND abs(back + off * (1 + back) - d) > 1e-6 * greatest(d, 1)) AS BIGINT) AS apart_1 FROM st",
    ),
)
def g15(spark, d):
    """A stored tensor of single precision with planted faults, a level lost in some bars and one of twice the size in others, against the book."""
    cells = K.tensor_cells(tensor(spark, d)).where(~((F.col("level") == 7) & (F.hour("ts_event") == 3)))
    twice = F.when((F.col("level") == 4) & (F.hour("ts_event") == 5), F.log(F.lit(2.0))).otherwise(0.0)
    path = new(spark)
    cells.select(*ID, "level", (F.col("depth_log").cast("float").cast("double") + twice).alias("depth_log")).write.parquet(path)
    return S.book_fidelity(spark.read.parquet(path), snapshots(spark, d)).drop("largest")


PH = f"ph AS (SELECT *, (close - min(low) OVER {frame(20)}) / greatest(max(high) OVER {frame(20)} - min(low) OVER {frame(20)}, 1e-9) AS pl, tanh((close - avg(close) OVER {frame(20)}) / greatest(atr, 1e-9)) AS sl FROM atr), pe AS (SELECT *, exp(1 - abs(sl) - pl) AS a, exp(sl + pl) AS b, exp(pl - abs(sl)) AS c, exp(-sl + 1 - pl) AS e FROM ph)"
feature("h4_cycle_phase_probs", lambda s, d: S.cycle_phase(AB(s, d)), ["p_accumulation", "p_markup", "p_markdown"], (*A, PH), "round(a / (a + b + c + e), 6) AS p_accumulation, round(b / (a + b + c + e), 6) AS p_markup, round(e / (a + b + c + e), 6) AS p_markdown FROM pe")
LAGS = range(2, 20)
H5_D = ", ".join(f"close - lag(close, {k}) OVER w AS d{k}" for k in LAGS)
H5_S = ", ".join(f"round(stddev_pop(d{k}) OVER {frame(100 - k)}, 12) AS s{k}" for k in LAGS)


def h5_total(f: str) -> str:
    return " + ".join(f"CASE WHEN s{k} > 1e-9 THEN {f.format(k=k)} ELSE 0 END" for k in LAGS)


H5 = (
    f"hd AS (SELECT symbol, ts_event, close, {H5_D} FROM bars {WINDOW})",
    f"hs AS (SELECT symbol, ts_event, count(close) OVER {frame(100)} AS c, {H5_S} FROM hd)",
    f"ht AS (SELECT symbol, ts_event, c, {h5_total('1')} AS n, {h5_total('ln({k})')} AS x, {h5_total('ln(s{k})')} AS y, {h5_total('ln({k}) * ln({k})')} AS xx, {h5_total('ln({k}) * ln(s{k})')} AS xy FROM hs)",
    "hh AS (SELECT *, CASE WHEN c >= 40 AND n >= 3 THEN least(greatest((n * xy - x * y) / (n * xx - x * x), 0.0), 1.0) ELSE 0.5 END AS h FROM ht)",
)
query("h5_rolling_hurst", sql(TICKS_SQL, BARS, *H5, select="SELECT symbol, ts_event, round(h, 6) AS hurst, round(2 - h, 6) AS dimension FROM hh"))(lambda s, d: rounded(S.rolling_hurst(bars(s, d)).select(*ID, "hurst", "dimension")))
query("h7_cycle_feature_pack")(lambda s, d: rounded(S.cycle_phase(AB(s, d)).join(S.rolling_hurst(bars(s, d)).select(*ID, "hurst"), ID).join(H.timeframe_alignment(bars(s, d)).select(*ID, "alignment"), ID).select(*ID, "p_markup", "hurst", "alignment")))
query("h11_regime_mixture")(lambda s, d: S.regime_mixture(flow_bars(s, d), ["ofi", "volume"]).groupBy("component").agg(F.count(F.lit(1)).alias("n")))
I5_Z = "coalesce(abs((cvd_delta - avg(cvd_delta) OVER {f}) / CASE WHEN stddev_samp(cvd_delta) OVER {f} = 0 THEN 1e-9 ELSE stddev_samp(cvd_delta) OVER {f} END), 0)".format(f=frame(20))
I5 = (
    f"g0 AS (SELECT *, round(volume / greatest(avg(volume) OVER {frame(20)}, 1e-9), 9) AS v, round(abs(ofi), 9) AS o, round({I5_Z}, 9) AS z FROM flow_bars)",
    "g1 AS (SELECT *, CAST(v > 1.2 AS INT) + CAST(o > 0.3 AS INT) + CAST(z > 0.75 AS INT) AS triggers, volume > 1.5 OR abs(ofi) > 0.2 AS base FROM g0)",
    "g2 AS (SELECT *, round(0.3 * greatest(v / 1.2 - 1, 0) + 0.3 * greatest(o / 0.3 - 1, 0) + 0.2 * greatest(z / 0.75 - 1, 0) + 0.5 * greatest(triggers - 1, 0), 9) AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts_event) - 1 AS i FROM g1)",
    """g3 AS (SELECT symbol, ts_event, i, score, count(*) OVER w AS m, list_sort(list(score) OVER w) AS past FROM g2 WHERE base
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "g4 AS (SELECT *, least(0.25, m / greatest(i, 1)) / greatest(m / greatest(i, 1), 1e-9) AS keep FROM g3)",
    "g5 AS (SELECT *, CASE WHEN m >= 20 THEN CASE WHEN keep >= 0.999 THEN 0 ELSE 1 - keep END * (m - 1) END AS pos FROM g4)",
    "g6 AS (SELECT symbol, ts_event, greatest(coalesce(past[floor(pos)::INT + 1] + (past[ceil(pos)::INT + 1] - past[floor(pos)::INT + 1]) * (pos - floor(pos)), 0), 0) AS threshold FROM g5)",
    "g7 AS (SELECT g2.*, threshold, coalesce(score >= round(threshold, 9), false) AS k, base AND triggers >= 2 AS two FROM g2 LEFT JOIN g6 USING (symbol, ts_event))",
)
I5_SELECT = """SELECT symbol, ts_event, round(score, 6) AS score, triggers, round(threshold, 6) AS threshold,
  CAST(CASE WHEN bool_or(k) OVER s THEN k WHEN bool_or(two) OVER s THEN two ELSE base END AS INT) AS kept FROM g7 WINDOW s AS (PARTITION BY symbol)"""


@query("i5_adaptive_rate_gate", sql(*FA, *I5, select=I5_SELECT))
def i5(spark, d):
    gated = G.training_gate(flow_bars(spark, d), (F.col("volume") > 1.5) | (F.abs("ofi") > 0.2), shifts=["cvd_delta"])
    return rounded(gated.select(*ID, "score", "triggers", "threshold", "kept"))


SCEN = [(1.0, 1.0, 24), (0.8, 1.0, 12), (1.2, 1.0, 24)]
def labels_sql(k: str, tp: float, sl: float, horizon: int) -> str:
    """The label CTEs under other names, barriers and horizon; the last one is la{k}."""
    x = LABELS
    for was, now in (
        ("barriers AS", f"ba{k} AS"), ("touched AS", f"to{k} AS"), ("labelled AS", f"la{k} AS"), ("FROM touched", f"FROM to{k}"), ("FROM barriers", f"FROM ba{k}"),
        ("close + greatest(atr, 1e-6)", f"close + {tp} * greatest(atr, 1e-6)"), ("close - greatest(atr, 1e-6)", f"close - {sl} * greatest(atr, 1e-6)"), ("AND 24 FOLLOWING", f"AND {horizon} FOLLOWING"),
    ):
        x = x.replace(was, now)
    return x


J13_ROWS = " UNION ALL ".join(f"SELECT symbol, ts_event, label FROM la{i}" for i in range(len(SCEN)))
J13 = (
    *(labels_sql(str(i), *x) for i, x in enumerate(SCEN)),
    f"jr AS (SELECT symbol, ts_event, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS u, avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) AS d FROM ({J13_ROWS}) WHERE label IS NOT NULL GROUP BY ALL)",
    "je AS (SELECT *, 1 - u - d AS z FROM jr)",
)
J13_SELECT = "SELECT symbol, ts_event, round(u, 6) AS p_up, round(d, 6) AS p_down, round(" + " + ".join(f"CASE WHEN {p} > 1e-9 THEN -{p} * ln({p}) ELSE 0 END" for p in "udz") + ", 6) AS entropy FROM je"
query("j13_soft_labels_scenarios", sql(*A, *J13, select=J13_SELECT))(lambda s, d: rounded(S.scenario_soft_labels(AB(s, d), SCEN)))
WITH_FEED = (FEED, BARS, FLOW, FLOW_BARS, ATR)
H8_W = "(PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
H8 = (
    "it AS (SELECT symbol, date_trunc('hour', ts_event) AS ts_event, arg_max(intensity, (fz.ts_event, seq)) AS intensity FROM fz JOIN fr USING (symbol, d, i) GROUP BY ALL)",
    "hb AS (SELECT a.*, round(ofi, 9) AS ofi, round(cvd_delta, 9) AS cvd_delta, round(intensity, 9) AS intensity FROM atr a JOIN (SELECT symbol, ts_event, ofi, cvd_delta FROM flow_bars) USING (symbol, ts_event) JOIN it USING (symbol, ts_event))",
    f"""hr AS (SELECT *, round(coalesce(CASE WHEN count(*) OVER w >= 20 THEN atr / nullif(quantile_cont(atr, 0.5) OVER w, 0) END, 1), 9) AS r, round(coalesce(CASE WHEN count(*) OVER w >= 20 THEN (intensity - avg(intensity) OVER w) / (stddev_samp(intensity) OVER w + 1e-9) END, 0), 9) AS z,
  round(coalesce(CASE WHEN count(*) OVER w >= 20 THEN quantile_cont(abs(cvd_delta), 0.5) OVER w END, 0), 9) AS m, coalesce(count(*) OVER w >= 20 AND n_trades < 0.5 * quantile_cont(n_trades, 0.5) OVER w, false) AS q FROM hb WINDOW w AS {H8_W})""",
    "rg8 AS (SELECT *, CASE WHEN q THEN 'low_liquidity' WHEN r > 1.5 AND z > 1.5 THEN 'volatile' WHEN r > 0.8 AND (round(abs(cvd_delta), 9) > m + 1e-12 OR abs(ofi) > 0.55) THEN 'trending' ELSE 'ranging' END AS regime FROM hr)",
)


def regimes(s, d):
    b = rounded(AB(s, d).join(flow_bars(s, d).select(*ID, "ofi", "cvd_delta"), ID), 9)
    t = TK.self_exciting_intensity(T(s, d)).withColumn("_b", bucket("1 hour")).groupBy("symbol", F.col("_b").alias("_t")).agg(F.max_by("intensity", F.struct("ts_event", "seq")).alias("intensity")).withColumnRenamed("_t", "ts_event")
    return Q.regime_labels(rounded(b.join(t, ID), 9), intensity="intensity", flow="cvd_delta", activity="n_trades", trend="ofi")


query("h8_regime_rule", with_recursive(*WITH_FEED, *H8, select="SELECT symbol, ts_event, regime FROM rg8"))(lambda s, d: regimes(s, d).select(*ID, "regime"))
J10 = (
    LABELS, "je AS (SELECT g.*, label, volume > 1.2 * avg(volume) OVER (PARTITION BY g.symbol ORDER BY g.ts_event ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS is_event FROM rg8 g LEFT JOIN (SELECT symbol, ts_event, label FROM labelled) USING (symbol, ts_event))",
    f"jw AS (SELECT *, list_transform(coalesce(list(close) OVER {nxt(24)}, []), lambda x: round(x - close, 9)) AS w FROM je)",
    "jf AS (SELECT *, len(w) > 0 AND atr > 1e-12 AS there, coalesce(label, 0) AS side, list_position(list_transform(w, lambda x: x >= atr), true) AS u, list_position(list_transform(w, lambda x: x <= -atr), true) AS n, list_position(list_transform(w, lambda x: abs(x) >= 0.5 * atr), true) AS t FROM jw)",
    "jg AS (SELECT *, CASE WHEN there THEN greatest(list_max(w), 0) ELSE 0 END AS mfe, CASE WHEN there THEN greatest(-list_min(w), 0) ELSE 0 END AS mae, CASE WHEN there THEN coalesce(t, 0) ELSE 0 END AS touch, CAST(there AND coalesce(n, 0) > 0 AND (coalesce(u, 0) = 0 OR n < u) AS INT) AS sf FROM jf)",
    "jh AS (SELECT *, CASE WHEN there THEN mfe / atr ELSE 0 END AS f, CASE WHEN there THEN mae / atr ELSE 0 END AS a, 0.05 + CASE WHEN atr > 1e-12 THEN 0.0001 / greatest(atr, 1e-12) ELSE 0 END AS cost FROM jg)",
    "ji AS (SELECT *, round(CASE WHEN side > 0 THEN f WHEN side < 0 THEN a ELSE greatest(f, a) END - cost, 9) AS x FROM jh)",
)
J10_SELECT = """SELECT symbol, ts_event, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(f, 6) AS mfe_atr, round(a, 6) AS mae_atr, CAST(touch AS INT) AS bars_to_touch, sf AS stop_first, round(x, 6) AS expectancy,
  CASE WHEN side <> 0 THEN 'directional' WHEN NOT is_event THEN 'non_event' WHEN NOT atr > 1e-12 THEN 'data_quality' WHEN round(f, 9) < 0.5 AND round(a, 9) < 0.5 THEN 'no_edge' WHEN sf = 1 THEN 'stop_first' WHEN round(f, 9) >= 0.5 AND x < 0 THEN 'low_expectancy'
       WHEN round(f, 9) > 2 AND touch > 16 THEN 'late_move' ELSE 'ambiguous' END AS neutral_type, CAST(side <> 0 AND x > 0 AND sf = 0 AS INT) AS tradable,
  CASE regime WHEN 'trending' THEN 'trend' WHEN 'volatile' THEN 'volatile' WHEN 'low_liquidity' THEN 'liquidity_vacuum' ELSE 'chop' END AS market_state FROM ji"""


@query("j10_excursion_diagnostics", with_recursive(*WITH_FEED, *H8, *J10, select=J10_SELECT))
def j10(spark, d):
    b = regimes(spark, d).join(labelled(spark, d).select(*ID, "label"), ID, "left").withColumn("is_event", F.col("volume") > 1.2 * F.avg("volume").over(trailing(20)))
    return rounded(Q.excursion_diagnostics(b).select(*ID, "mfe", "mae", "mfe_atr", "mae_atr", "bars_to_touch", "stop_first", "expectancy", "neutral_type", "tradable", "market_state"))


J14 = (
    MEAN_SIZE, WALLS, BARS, ATR, LABELS, "bs AS (SELECT symbol, date_trunc('hour', ts_event) AS ts_event, greatest(arg_max(bid_wall_size / mean_size, (walls.ts_event, seq)), arg_max(ask_wall_size / mean_size, (walls.ts_event, seq))) AS wall FROM walls GROUP BY ALL)",
    f"rh AS (SELECT l.*, wall, round(12 * least(greatest(atr / greatest(quantile_cont(atr, 0.5) OVER {frame(100)}, 1e-9), 0.5), 2.0)) AS hz, CASE WHEN coalesce(label, 0) = 0 THEN 0 WHEN volume > round(avg(volume) OVER {frame(20)}, 9) THEN 2 ELSE 1 END AS ql FROM labelled l LEFT JOIN bs USING (symbol, ts_event))",
    """rw AS (SELECT *, least(greatest(CASE WHEN coalesce(label, 0) = 0 THEN 0.5 ELSE greatest(atr, 1e-12) / (greatest(1.5 * atr, 1e-12) + greatest(atr, 1e-12)) END * least(greatest(pow(1 / greatest(greatest(hz, 1) / greatest((SELECT quantile_cont(greatest(hz, 1), 0.5) FROM rh), 1), 0.1), 0.5), 0.4), 1.6)
  * (0.4 + 0.8 / (1 + exp(-3 * coalesce(wall, 0) / 3))) * CASE ql WHEN 2 THEN 1.4 WHEN 1 THEN 1.0 ELSE 0.6 END, 0.1), 3.5) AS w FROM rh)""",
)


@query("j14_ruin_weights", sql(BOOK_SQL, *J14, select="SELECT symbol, ts_event, round(least(greatest(w / (SELECT avg(w) FROM rw), 0.1), 3.5), 6) AS ruin_weight FROM rw"))
def j14(spark, d):
    walls = K.wall_scan(BK(spark, d), 1.5).withColumn("_b", bucket("1 hour")).groupBy("symbol", F.col("_b").alias("_t")).agg(F.max_by(F.struct("bid_wall_strength", "ask_wall_strength"), F.struct("ts_event", "seq")).alias("_w"))
    walls = walls.select("symbol", F.col("_t").alias("ts_event"), "_w.*")
    quality = F.when(F.coalesce("label", F.lit(0)) == 0, 0).when(F.col("volume") > F.round(F.avg("volume").over(trailing(20)), 9), 2).otherwise(1)
    b = X.adaptive_horizon(labelled(spark, d)).withColumn("quality", quality).join(walls, ID, "left")
    return rounded(Q.ruin_weights(b).select(*ID, "ruin_weight"))


J16 = (
    "ls AS (SELECT symbol, date_trunc('hour', ts_event) AS ts_event, arg_max(list_concat(list_reverse(list_transform(range(1, 11), lambda i: {'p': bid_px[i], 'z': bid_sz[i], 's': -1})), list_transform(range(1, 11), lambda i: {'p': ask_px[i], 'z': ask_sz[i], 's': 1})), (book.ts_event, seq)) AS x FROM book GROUP BY ALL)",
    "lm AS (SELECT *, list_filter(x, lambda v: v.z > 1.8 * list_median(list_filter(list_transform(x, lambda y: y.z), lambda z: z > 0))) AS f FROM ls)",
    "lw AS (SELECT symbol, ts_event, list_filter(f, lambda v: v.z = list_max(list_transform(f, lambda y: y.z)))[1] AS w FROM lm)",
    f"wb AS (SELECT b.symbol, b.ts_event, w, max(high) OVER {nxt(3).replace('symbol', 'b.symbol').replace('ts_event', 'b.ts_event')} AS h, min(low) OVER {nxt(3).replace('symbol', 'b.symbol').replace('ts_event', 'b.ts_event')} AS l FROM bars b LEFT JOIN lw ON lw.symbol = b.symbol AND lw.ts_event = b.ts_event)",
)
query("j16_wall_break_label", sql(BOOK_SQL, BARS, *J16, select="SELECT symbol, ts_event, round(w.p, 6) AS wall_px, w.s AS wall_side, CASE WHEN w IS NULL OR h IS NULL THEN NULL WHEN w.s > 0 AND h > w.p THEN 1 WHEN w.s < 0 AND l < w.p THEN -1 ELSE 0 END AS wall_break FROM wb"))(lambda s, d: rounded(Q.wall_break(bars(s, d), BK(s, d), n=3, multiple=1.8).select(*ID, "wall_px", "wall_side", "wall_break")))
query("k6_combine_quarters", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, close, CASE WHEN ts_event >= TIMESTAMP '2024-01-12' THEN volume END AS volume FROM bars"))(lambda s, d: S.combine_quarters([bars(s, d).where("ts_event < timestamp_ntz '2024-01-15'").select(*ID, "close"), bars(s, d).where("ts_event >= timestamp_ntz '2024-01-12'").select(*ID, "close", "volume")]).select(*ID, "close", "volume"))
SLICE = "least(CAST(floor((epoch_us(ts_event) - epoch_us(date_trunc('hour', ts_event))) * 12 / 3600000000) AS INT), 11)"
SPINE = "SELECT symbol, b, CAST(i AS INT) AS s FROM (SELECT DISTINCT symbol, b FROM {x}), range(12) r(i)"
D13 = (
    f"ca AS (SELECT seq, coalesce(avg(w) OVER {tf(500)}, 0) AS cancel FROM (SELECT *, CASE WHEN action = 'A' THEN 0.0 WHEN action = 'C' AND size > 2 * avg(size) OVER {tf(100)} THEN 1.0 WHEN action = 'C' THEN 0.3 END AS w FROM ticks))",
    "tt AS (SELECT * FROM ticks WHERE action = 'T')",
    f"ab AS (SELECT seq, least(r / greatest(quantile_cont(r, 0.5) OVER {tf(200)}, 1e-9), 25) AS absorption FROM (SELECT *, abs(sum({SIGNED}) OVER {tf(50)}) / greatest(abs(price - lag(price, 49) OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event, seq)), 0.01) AS r FROM tt))",
    "wi AS (SELECT seq, sum(dr) OVER f / greatest(sum(tv) OVER f, 1) AS spoof FROM (SELECT *, CASE WHEN action <> 'T' AND lag(d3) OVER v > d3 THEN lag(d3) OVER v - d3 ELSE 0 END AS dr, CASE WHEN action = 'T' THEN size ELSE 0 END AS tv FROM (SELECT *, list_sum(bid_sz[1:3]) + list_sum(ask_sz[1:3]) AS d3 FROM book) WINDOW v AS (PARTITION BY symbol ORDER BY ts_event, seq)) WINDOW f AS (PARTITION BY symbol ORDER BY ts_event, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))",
    f"tk AS (SELECT t.*, {SIGNED} AS g, cancel, coalesce(absorption, 0) AS absorption, spoof, date_trunc('hour', ts_event) AS b, {SLICE} AS s FROM ticks t JOIN ca USING (seq) LEFT JOIN ab USING (seq) JOIN wi USING (seq))",
    "sl AS (SELECT symbol, b, s, max(spoof) AS sp, max(cancel) AS ca, avg(absorption) AS ab, max(abs(sign(g))) AS im, sum(g) - first(g ORDER BY ts_event, seq) AS fl, avg(size) AS sz FROM tk GROUP BY ALL)",
    f"de AS (SELECT x.*, coalesce(sp, 0) AS sp, coalesce(ca, 0) AS ca, coalesce(ab, 0) AS ab, coalesce(im, 0) AS im, coalesce(fl, 0) AS fl, coalesce(sz, 0) AS sz FROM ({SPINE.format(x='sl')}) x LEFT JOIN sl USING (symbol, b, s))",
    """ba AS (SELECT symbol, b, max(sp) AS sp, avg(sp) AS msp, max(ca) AS ca, stddev_pop(ab) AS sab, avg(ab) AS mab, max(ab) AS ab, round(avg(ab) FILTER (s < 4), 9) AS t0, round(avg(ab) FILTER (s >= 4 AND s < 8), 9) AS t1, round(avg(ab) FILTER (s >= 8), 9) AS t2,
  max(abs(fl)) AS fl, count(*) FILTER (fl > 0) AS up, count(*) FILTER (fl < 0) AS dn, sum(fl) FILTER (s < 4) AS e, sum(fl) FILTER (s >= 8) AS l, max(im) AS im, stddev_pop(sz) AS ssz, avg(sz) AS msz FROM de GROUP BY ALL)""",
)
D13_SELECT = """SELECT symbol, b AS ts_event, round(sp, 6) AS spoof_peak, CAST(msp > 1e-9 AND sp >= 2 * msp AS INT) AS spoof_burst, round(ca, 6) AS cancel_burst, round(CASE WHEN abs(mab) < 1e-12 THEN 0 ELSE sab / (abs(mab) + 1e-12) END, 6) AS absorption_spread,
  round(ab, 6) AS absorption_peak, CASE WHEN abs(t1 - t0) <= 1e-6 + 1e-5 * abs(t0) AND abs(t2 - t0) <= 1e-6 + 1e-5 * abs(t0) THEN 0 WHEN t0 >= t1 AND t0 >= t2 THEN -1 WHEN t1 >= t2 THEN 0 ELSE 1 END AS pressure_phase,
  round(fl / 300, 6) AS flow_velocity, round(CASE WHEN up + dn = 0 THEN 0 WHEN up >= dn THEN up / (up + dn) ELSE dn / (up + dn) END, 6) AS flow_agreement, round((e - l) / (abs(e) + abs(l) + 1e-9), 6) AS flow_early_late, CAST(im AS DOUBLE) AS imbalance_peak,
  round(CASE WHEN abs(msz) < 1e-12 THEN 0 ELSE ssz / (abs(msz) + 1e-12) END, 6) AS size_spread FROM ba"""


@query("d13_intrabar_tick_slices", sql(BOOK_SQL, *D13, select=D13_SELECT))
def d13(spark, d):
    x = K.withdrawal_detector(S.cancel_ratio(BK(spark, d))).withColumnsRenamed({"cancel_ratio": "cancel", "withdrawal": "spoof"})
    x = x.join(TK.absorption_intensity(T(spark, d)).select("seq", "absorption"), "seq", "left")
    x = x.select(*ID, "seq", "size", signed_size().alias("signed"), "spoof", "cancel", F.coalesce("absorption", F.lit(0.0)).alias("absorption"))
    return rounded(I.intrabar_tick_slices(x))


D14 = (
    f"sn AS (SELECT symbol, ts_event, seq, date_trunc('hour', ts_event) AS b, {SLICE} AS s, list_sum(bid_sz) AS bd, list_sum(ask_sz) AS ad, bid_px[1] AS bp, ask_px[1] AS ap, bid_sz[1] AS b1, ask_sz[1] AS a1 FROM book)",
    "si AS (SELECT *, row_number() OVER (PARTITION BY symbol, b, s ORDER BY ts_event, seq) AS i, (ap + bp) / 2 AS mid, CASE WHEN b1 + a1 > 0 THEN (ap * b1 + bp * a1) / (b1 + a1) ELSE (ap + bp) / 2 END AS micro FROM sn)",
    """sl AS (SELECT symbol, b, s, max(greatest(ap - bp, 0)) AS spread, avg(CASE WHEN bd + ad > 0 THEN (bd - ad) / (bd + ad) ELSE 0 END) AS imb, max(bd) AS bid, max(ad) AS ask, max(abs(micro - mid)) AS micro, max(CASE WHEN bd > 0 THEN b1 / bd ELSE 0 END) AS bs,
  max(CASE WHEN ad > 0 THEN a1 / ad ELSE 0 END) AS as_, CASE WHEN count(*) > 1 THEN regr_slope(bd, i) ELSE 0 END AS bsl, CASE WHEN count(*) > 1 THEN regr_slope(ad, i) ELSE 0 END AS asl, arg_max(bd, i) - arg_min(bd, i) - (arg_max(ad, i) - arg_min(ad, i)) AS acc, 1 AS there FROM si GROUP BY ALL)""",
    f"de AS (SELECT x.*, coalesce(spread, 0) AS spread, round(coalesce(imb, 0), 9) AS imb, coalesce(bid, 0) AS bid, coalesce(ask, 0) AS ask, coalesce(bid, 0) + coalesce(ask, 0) AS dep, coalesce(micro, 0) AS micro, coalesce(bs, 0) AS bs, coalesce(as_, 0) AS as_, coalesce(bsl, 0) AS bsl, coalesce(asl, 0) AS asl, coalesce(acc, 0) AS acc, coalesce(there, 0) AS there FROM ({SPINE.format(x='sl')}) x LEFT JOIN sl USING (symbol, b, s))",
    """ba AS (SELECT symbol, b, max(spread) AS sx, avg(spread) AS sm, stddev_pop(spread) AS ss, max(bid) AS bx, max(ask) AS ax, max(dep) AS dx, avg(dep) AS dm, arg_max(imb, (abs(imb), -s)) AS ip, count(*) FILTER (imb > 0) AS up, count(*) FILTER (imb < 0) AS dn,
  CASE WHEN count(*) FILTER (dep > 0) > 1 THEN regr_slope(imb, s) FILTER (dep > 0) ELSE 0 END AS it, max(dep) FILTER (s = 11) - max(dep) FILTER (s = 0) AS dc, max(micro) AS mx, max(bs) AS bs, max(as_) AS as_, sum(bsl) / sum(there) AS bsl, sum(asl) / sum(there) AS asl, sum(acc) / sum(there) AS acc FROM de GROUP BY ALL)""",
)
D14_SELECT = """SELECT symbol, b AS ts_event, round(sx, 6) AS spread_max, round(sm, 6) AS spread_mean, round(ss, 6) AS spread_std, bx AS bid_depth_max, ax AS ask_depth_max, dx AS depth_max, round(ip, 6) AS imbalance_peak,
  round(CASE WHEN up + dn = 0 THEN 0 WHEN up >= dn THEN up / (up + dn) ELSE dn / (up + dn) END, 6) AS imbalance_agreement, round(up / 12, 6) AS imbalance_bid_share, round(it, 6) AS imbalance_trend, round(CASE WHEN dm > 1e-9 THEN dc / dm ELSE 0 END, 6) AS depth_change,
  round(mx, 6) AS microprice_distance, round(bs, 6) AS bid_first_share, round(as_, 6) AS ask_first_share, CAST(dm > 1e-9 AND dx >= 1.5 * dm AS INT) AS depth_shock, round(greatest(CASE WHEN dm > 1e-9 THEN dx / dm ELSE 0 END - 1, 0), 6) AS depth_shock_size,
  round(bsl, 6) AS bid_slope, round(asl, 6) AS ask_slope, round(acc, 6) AS depth_accel FROM ba"""
query("d14_intrabar_book_slices", sql(BOOK_SQL, *D14, select=D14_SELECT))(lambda s, d: rounded(I.intrabar_book_slices(BK(s, d))))


HORIZONS = [1, 4]


def grid(spark, d):
    """Bars of three sessions that break a range or close near its middle, with and against the flow, and on large volume."""
    b = rounded(flow_bars(spark, d), 9)
    w = trailing(12, back=1)
    b = b.withColumn("zone", F.when(F.hour("ts_event") < 8, "asia").when(F.hour("ts_event") < 16, "london").otherwise("ny"))
    b = b.withColumns({"_h": F.max("high").over(w), "_l": F.min("low").over(w), "_v": F.avg("volume").over(w)})
    yes = lambda c: F.coalesce(c, F.lit(False))
    events = {"break_high": yes(F.col("close") > F.col("_h")), "break_low": yes(F.col("close") < F.col("_l")), "inside": yes((F.col("close") <= F.col("_h")) & (F.col("close") >= F.col("_l")))}
    filters = {"any_long": (F.lit(True), 1), "flow_long": (F.col("ofi") > 0, 1), "flow_short": (F.col("ofi") < 0, -1), "volume_long": (yes(F.col("volume") > F.col("_v")), 1)}
    return R.grid_trades(b, "zone", events, filters, HORIZONS)


M17 = (
    f"""b AS (SELECT symbol, ts_event, round(close, 9) AS close, round(ofi, 9) AS ofi, volume, CASE WHEN hour(ts_event) < 8 THEN 'asia' WHEN hour(ts_event) < 16 THEN 'london' ELSE 'ny' END AS zone,
  max(round(high, 9)) OVER {frame(12, 1)} AS h, min(round(low, 9)) OVER {frame(12, 1)} AS l, avg(volume) OVER {frame(12, 1)} AS v, epoch_us(ts_event) AS u, lead(epoch_us(ts_event), 4) OVER w AS e,
  lead(round(close, 9), 1) OVER w / round(close, 9) - 1 AS r1, lead(round(close, 9), 4) OVER w / round(close, 9) - 1 AS r4 FROM flow_bars {WINDOW})""",
    "c AS (SELECT quantile_cont(u, 0.6) AS c0, quantile_cont(u, 0.8) AS c1 FROM b)",
    """s AS (SELECT *, CASE WHEN u < c0 THEN 'train' WHEN u < c1 THEN 'validation' ELSE 'holdout' END AS split FROM b, c
  WHERE NOT coalesce(u < c0 AND e >= c0, false) AND NOT coalesce(u < c1 AND e >= c1, false) AND (e IS NOT NULL OR NOT (u < c0) AND NOT (u < c1)))""",
    "ev AS (SELECT *, CASE WHEN close > h THEN 'break_high' WHEN close < l THEN 'break_low' WHEN h IS NOT NULL THEN 'inside' END AS event FROM s)",
    """fi AS (SELECT *, unnest(list_filter([{'f': 'any_long', 'k': true, 's': 1}, {'f': 'flow_long', 'k': ofi > 0, 's': 1}, {'f': 'flow_short', 'k': ofi < 0, 's': -1}, {'f': 'volume_long', 'k': coalesce(volume > v, false), 's': 1}], lambda x: x.k)) AS x
  FROM ev WHERE event IS NOT NULL)""",
    "ho AS (SELECT *, unnest([{'h': 1, 'r': r1}, {'h': 4, 'r': r4}]) AS y FROM fi)",
    "tr AS (SELECT zone, event, x.f AS filter, CAST(y.h AS INT) AS horizon, split, CAST(ts_event AS DATE) AS d, y.r * x.s AS ret FROM ho WHERE y.r IS NOT NULL)",
    "dy AS (SELECT zone, event, filter, horizon, split, d, count(*) AS n, avg(ret) AS m, sum(ret) AS t FROM tr GROUP BY ALL)",
    "wh AS (SELECT zone, event, filter, horizon, split, CAST(sum(n) AS BIGINT) AS n, sum(t) / sum(n) * 10000 AS mean_units FROM dy GROUP BY ALL)",
    "dd AS (SELECT zone, event, filter, horizon, split, count(*) AS days, coalesce(avg(m) / (nullif(stddev_samp(m), 0) / sqrt(count(*))), 0) AS t FROM dy WHERE n >= 2 GROUP BY ALL HAVING count(*) >= 3)",
)
query(
    "m17_edge_grid_cells",
    sql(*FA, *M17, select="SELECT zone, event, filter, horizon, split, n, round(mean_units, 4) AS mean_units, days, round(t, 4) AS t_value FROM wh JOIN dd USING (zone, event, filter, horizon, split)"),
)(lambda s, d: rounded(M.edge_statistics(grid(s, d), *R.CELL, "split").select(*R.CELL, "split", "n", "mean_units", "days", "t_value"), 4))
query("m17_edge_grid_scan")(lambda s, d: rounded(R.edge_grid(grid(s, d)).select(*R.CELL, "n", "t_value", "p_value", "p_adjusted", "p_permutation", "p_family", "t_validation", "t_holdout", "stage")))


@query("m22_redundancy_filter_mrmr")
def m22(spark, d):
    """Columns that the filter keeps and the best four by relevance less redundancy, with the place of each."""
    b = rounded(W.forward_return(flow_bars(spark, d), 4), 9)
    names = ["ofi", "cvd_delta", "buy_share", "volume", "n_trades", "close"]
    rows = [(how, c, i) for how, own in (("filter", M.redundancy_filter(b, names, "fwd_ret_4", 0.8, ("volume",))), ("mrmr", M.mrmr(b, names, "fwd_ret_4", 4))) for i, c in enumerate(own)]
    return spark.createDataFrame(rows, "method string, column string, place int")


N11_CELLS = [(m, h) for m in (0.75, 1.0, 1.5) for h in (6, 24)]
N11 = tuple(labels_sql(str(i), m, m, h) for i, (m, h) in enumerate(N11_CELLS))
N11_ROWS = " UNION ALL ".join(f"SELECT CAST({m} AS DOUBLE) AS multiple, {h} AS horizon, a.label AS label, o.label AS observed FROM la{i} a JOIN la3 o USING (symbol, ts_event) WHERE a.label IS NOT NULL" for i, (m, h) in enumerate(N11_CELLS))
N11_SELECT = f"SELECT multiple, horizon, label, count(*) AS n, round(avg(CASE WHEN label = observed THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM ({N11_ROWS}) GROUP BY ALL"
query("n11_label_grid_diagnostics", sql(*A, *N11, select=N11_SELECT))(lambda s, d: rounded(S.label_grid(AB(s, d), [0.75, 1.0, 1.5], [6, 24], S.triple_barrier(AB(s, d), 1.0, 1.0, 24))))
query("o6_non_overlapping_predictions")(lambda s, d: rounded(S.non_overlapping(flow_bars(s, d).withColumn("signal", F.when(F.abs("ofi") > 0.5, F.col("ofi")).otherwise(0.0)))))
# both engines draw the latency from the same arithmetic on seq
O9_DRAW = ["({c} * 7919 + 104729) % 1000003", "({c} * 15485863 + 32452843) % 999983"]
O9 = (
    f"si AS (SELECT symbol, ts_event, seq, side = 'A' AS is_buy, size, greatest(5000 + 2000 * abs(sqrt(-2 * ln(({O9_DRAW[0].format(c='seq')} + 0.5) / 1000003)) * cos(2 * pi() * ({O9_DRAW[1].format(c='seq')} + 0.5) / 999983)), 0.1) AS lat FROM ticks WHERE action = 'T' AND size >= 60)",
    "sn AS (SELECT symbol, ts_event, bid_px, bid_sz, ask_px, ask_sz FROM book QUALIFY row_number() OVER (PARTITION BY symbol, ts_event ORDER BY seq DESC) = 1)",
    "de AS (SELECT s.*, s.ts_event + to_microseconds(CAST(floor(lat) AS BIGINT)) AS came, n.bid_px AS dbp, n.bid_sz AS dbs, n.ask_px AS dap, n.ask_sz AS das FROM si s ASOF JOIN sn n ON s.symbol = n.symbol AND s.ts_event >= n.ts_event)",
    "ar AS (SELECT d.*, n.bid_px AS bp, n.ask_px AS ap, CASE WHEN is_buy THEN n.ask_px ELSE n.bid_px END AS px, CASE WHEN is_buy THEN n.ask_sz ELSE n.bid_sz END AS sz FROM de d ASOF JOIN sn n ON d.symbol = n.symbol AND d.came >= n.ts_event)",
    "ta AS (SELECT *, list_transform(range(1, 11), lambda i: greatest(least(sz[i], size - coalesce(list_sum(sz[1:i - 1]), 0)), 0)) AS take FROM ar)",
    "fi AS (SELECT *, list_sum(take) AS filled, list_filter(range(1, 11), lambda i: take[i] > 0) AS used, size / greatest(sz[1], 1) AS r FROM ta)",
    """lg AS (SELECT symbol, seq, is_buy, ts_event AS ts_decision, came AS ts_arrival, round(lat, 1) AS latency_us, size, (dbp[1] + dap[1]) / 2 AS mid_decision, (bp[1] + ap[1]) / 2 AS mid_arrival,
  CASE WHEN filled > 0 THEN list_sum(list_transform(list_zip(px, take), lambda z: z[1] * z[2])) / filled END AS fill_vwap, filled, size - filled AS residual, CAST(len(used) AS INT) AS levels_used,
  px[used[len(used)]] AS worst_px, CASE WHEN r <= 1 THEN 0.5 WHEN r <= 3 THEN 0.5 + 0.5 * (r - 1) / 2 ELSE 1.0 + 0.25 * (r - 3) END AS model_ticks, px[1] AS best, CASE WHEN is_buy THEN das[1] ELSE dbs[1] END AS depth_decision FROM fi)""",
    "lo AS (SELECT * EXCLUDE (best), CASE WHEN is_buy THEN 1 ELSE -1 END * (fill_vwap - best) / 0.01 AS realised_ticks FROM lg)",
)
O9_SUMMARY = """SELECT count(*) AS n_executed, CAST(count(*) FILTER (filled > 0) AS BIGINT) AS n_filled, CAST(count(*) FILTER (residual > 0) AS BIGINT) AS n_with_residual, round(avg(latency_us), 4) AS mean_latency_us,
  round(avg(model_ticks), 4) AS mean_model_ticks, round(avg(realised_ticks), 4) AS mean_realised_ticks, round(avg(levels_used), 4) AS mean_levels, max(levels_used) AS max_levels, sum(size) AS intended_size,
  sum(filled) AS filled_size, sum(residual) AS residual_size, round(quantile_cont(latency_us, 0.95), 4) AS p95_latency_us FROM lo"""


def replayed(spark, d):
    u = [(F.expr(x.format(c="seq")) + 0.5) / n for x, n in zip(O9_DRAW, (1000003, 999983), strict=True)]
    signals = T(spark, d).where("action = 'T' and size >= 60").withColumn("is_buy", F.col("side") == "A")
    return P.signal_replay(signals, BK(spark, d), P.latency_us(*u))


query("o9_signal_replay", sql(BOOK_SQL, *O9, select="SELECT * REPLACE (round(mid_decision, 6) AS mid_decision, round(mid_arrival, 6) AS mid_arrival, round(fill_vwap, 6) AS fill_vwap, round(worst_px, 6) AS worst_px, round(model_ticks, 6) AS model_ticks, round(realised_ticks, 9) AS realised_ticks) FROM lo"))(lambda s, d: rounded(replayed(s, d), 9).withColumns({c: F.round(c, 6) for c in ("mid_decision", "mid_arrival", "fill_vwap", "worst_px", "model_ticks")}))
query("o9_replay_summary", sql(BOOK_SQL, *O9, select=O9_SUMMARY))(lambda s, d: rounded(P.replay_summary(replayed(s, d)), 4))
def range_input(s, d):
    b = rounded(AB(s, d).join(flow_bars(s, d).select(*ID, "ofi", "cvd_delta"), ID), 9)
    w = trailing(20)
    return b.withColumns({"intensity": F.round(F.col("volume") / F.avg("volume").over(w), 9), "_m": F.round(F.avg("atr").over(w), 9)})


def ranged(s, d):
    return N.range_state_filter(range_input(s, d), F.when(F.abs("ofi") > 0.2, F.signum("ofi")), 0.5 + F.abs("ofi") / 2, F.when(F.col("atr") > 1.2 * F.col("_m"), "Trending").when(F.col("atr") < F.col("_m"), "Ranging"))


VOTES = ["flow_flipped", "imbalance_flipped", "intensity_spike", "reversal_score", "reversal_side", "near_bottom", "near_top", "in_middle", "broke_out", "smooth_atr", "range_place"]
mean = lambda x: f"list_sum({x}) / len({x})"
P6 = (
    f"""q AS (SELECT a.*, round(ofi, 9) AS ofi, round(cvd_delta, 9) AS cvd_delta, round(volume / avg(volume) OVER {frame(20)}, 9) AS intensity, abs(close - lag(close) OVER w) AS d, count(*) OVER {frame(42)} AS n
  FROM atr a JOIN (SELECT symbol, ts_event, ofi, cvd_delta FROM flow_bars) USING (symbol, ts_event) {WINDOW})""",
    f"ri AS (SELECT *, list(cvd_delta) OVER {frame(16)} AS f, list(ofi) OVER {frame(10)} AS o, list(intensity) OVER {frame(20)} AS h FROM q)",
    f"""me AS (SELECT *, {mean('f[1:4]')} AS f0, {mean('f[greatest(len(f) - 3, 1):]')} AS f1, greatest(list_max(list_transform(f, lambda x: abs(x))), 1e-10) AS fm, {mean('o[1:2]')} AS o0, {mean('o[greatest(len(o) - 2, 1):]')} AS o1,
  {mean('h[1:greatest(len(h) - 3, 1)]')} AS h0, {mean('h[greatest(len(h) - 2, 1):]')} AS h1 FROM ri)""",
    """vo AS (SELECT *, len(f) >= 8 AND abs(f1 - f0) / fm > 0.3 AND sign(f0) <> sign(f1) AS flow_flipped, len(f) >= 8 AND len(o) >= 5 AND abs(o1) > 0.15 AND sign(o0) <> sign(o1) AND abs(o1 - o0) > 0.15 AS imbalance_flipped,
  len(f) >= 8 AND len(h) >= 10 AND h1 > h0 * 1.4 AND h1 > h0 + 0.05 AS intensity_spike, CASE WHEN len(f) >= 8 THEN sign(sign(f1) + CASE WHEN len(o) >= 5 THEN sign(o1) ELSE 0 END) ELSE 0 END AS side FROM me)""",
    f"aa AS (SELECT *, CASE WHEN atr > 0.0001 THEN atr WHEN n >= 3 THEN greatest(quantile_cont(d, 0.8) OVER {frame(14)}, 0.0002) ELSE 0.0005 END AS a FROM vo)",
    f"bo AS (SELECT *, quantile_cont(a, 0.5) OVER {frame(14)} AS s, CASE WHEN n >= 5 THEN max(close) OVER {frame(42)} ELSE 0 END AS hi, CASE WHEN n >= 5 THEN min(close) OVER {frame(42)} ELSE 0 END AS lo FROM aa)",
)
P6_SELECT = """SELECT symbol, ts_event, flow_flipped, imbalance_flipped, intensity_spike, CAST(CAST(flow_flipped AS INT) + CAST(imbalance_flipped AS INT) + CAST(intensity_spike AS INT) AS DOUBLE) AS reversal_score,
  CAST(side AS INT) AS reversal_side, close <= lo + 1.5 * s AS near_bottom, close >= hi - 1.5 * s AS near_top, abs(close - (hi + lo) / 2) <= 0.5 * s AS in_middle, close > hi + 2.5 * s OR close < lo - 2.5 * s AS broke_out,
  round(s, 6) AS smooth_atr, round(least(greatest((close - lo) / greatest(hi - lo, 2 * s, 1e-10), 0), 1), 3) AS range_place FROM bo"""
query("p6_range_votes", sql(*A, FLOW, FLOW_BARS, *P6, select=P6_SELECT))(lambda s, d: rounded(N.range_boundaries(N.reversal_votes(range_input(s, d), "cvd_delta", "ofi", "intensity"), "atr").select(*ID, *VOTES)))
query("p6_range_state_filter")(lambda s, d: rounded(ranged(s, d).select(*ID, "reversal_score", "action", "direction", "reason", "market", "confirmations")))
query(
    "g11_thirteen_channel_book",
    sql(BOOK_SQL, CELLS, "z AS (SELECT *, round(exp(bid_log) - 1, 6) AS s, greatest(round(quantile_cont(exp(bid_log) - 1, 0.5) OVER (PARTITION BY symbol, seq), 6), 1.0) AS m FROM cells)", "y AS (SELECT *, CASE WHEN s < 5 THEN level END AS t FROM z)", "x AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY symbol, seq ORDER BY level) AS b, first_value(t IGNORE NULLS) OVER (PARTITION BY symbol, seq ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f, lag(bid_log, 5) OVER (PARTITION BY symbol, level ORDER BY ts_event, seq) AS g FROM y)", select="SELECT seq, level, CASE WHEN s >= 10 * m THEN 3 WHEN s >= 5 * m THEN 2 WHEN s >= 3 * m THEN 1 ELSE 0 END AS wall_tier, CAST(s < 5 AS INTEGER) AS thin, least(level - b, f - level) AS gap_distance, round((bid_log - g) / 5, 6) AS gradient FROM x"),
)(lambda s, d: rounded(S.thirteen_channels(BK(s, d)).select("seq", "level", "wall_tier", "thin", "gap_distance", "gradient")))
