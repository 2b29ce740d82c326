"""Queries: evaluation statistics (M), monitors (N), trades and execution (O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.operators import book as K
from orderloom.operators import labels as L
from orderloom.operators import resample as R
from orderloom.operators import stats as M
from orderloom.operators import vectors as V
from orderloom.operators import trades as O
from orderloom.operators import windows as W
from orderloom.plans.base import ATR, BARS, BOOK_SQL, FLOW, FLOW_BARS, TICKS_SQL, WINDOW, bars, flow_bars, nxt, sql, stage
from orderloom.plans.catalog import query
from orderloom.plans.flow import SESSION
from orderloom.plans.labels import REGIME, regime
from orderloom.sources import market
from orderloom.spec import rounded

A = (TICKS_SQL, BARS, FLOW, FLOW_BARS)
FB = lambda s, d: rounded(flow_bars(s, d), 9)


def pairs_sql(extra: str = "", horizons=(1, 4), features=("ofi", "volume")) -> str:
    ex = f", {extra}" if extra else ""
    src = f"src AS (SELECT symbol, ts_event, round(ofi, 9) AS ofi, volume, {SESSION} AS session, " + ", ".join(f"lead(round(close, 9), {h}) OVER w / round(close, 9) - 1 AS y{h}" for h in horizons) + f" FROM flow_bars {WINDOW})"
    rows = " UNION ALL ".join(f"SELECT symbol, ts_event{ex}, '{f}' AS feature, {h} AS horizon, CAST({f} AS DOUBLE) AS x, y{h} AS y FROM src WHERE y{h} IS NOT NULL AND {f} IS NOT NULL" for f in features for h in horizons)
    return f"{src}, pairs AS ({rows})"


def ranks_sql(by: str, source: str = "pairs") -> str:
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM {source}),
ic AS (SELECT {by}, count(*) AS n, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(rx, ry) END AS spearman, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END AS pearson FROM rk GROUP BY {by} HAVING count(*) >= 30)"""


def pairs(s, d, extra=None):
    return M.long_pairs(W.session_flags(FB(s, d)), ["ofi", "volume"], [1, 4], extra)


FH = "feature, horizon"
query("m1_rank_correlation_ic", sql(*A, pairs_sql(), ranks_sql(FH), select="SELECT feature, horizon, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(M.rank_correlation(pairs(s, d), "feature", "horizon")))
BLOCKS = "bl AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY feature, horizon ORDER BY ts_event, symbol) - 1) * 8 / count(*) OVER (PARTITION BY feature, horizon)) AS INT) AS block FROM pairs)"
query("m3_block_ic_stability", sql(*A, pairs_sql(), BLOCKS, ranks_sql(FH + ", block", "bl"), select="SELECT feature, horizon, round(avg(spearman), 6) AS mean_ic, round(stddev_samp(spearman), 6) AS std_ic, round(avg(CASE WHEN spearman > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM ic GROUP BY ALL"))(lambda s, d: rounded(M.block_stability(pairs(s, d))))
query("m5_cost_adjusted_ic", sql(*A, pairs_sql(), "cp AS (SELECT * REPLACE (CASE WHEN abs(y) <= 0.001 THEN 0 ELSE y END AS y) FROM pairs)", ranks_sql(FH, "cp"), select="SELECT feature, horizon, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(M.rank_correlation(M.cost_adjusted(pairs(s, d), 0.0005), "feature", "horizon")))
query("m6_horizon_decay_score", sql(*A, pairs_sql(), ranks_sql(FH), select="SELECT feature, round(abs(arg_min(spearman, horizon)) - abs(arg_max(spearman, horizon)), 6) AS decay FROM ic GROUP BY ALL"))(lambda s, d: rounded(M.horizon_decay(M.rank_correlation(pairs(s, d), "feature", "horizon"))))
query("m10_group_ic", sql(*A, pairs_sql("session"), ranks_sql(FH + ", session"), select="SELECT feature, horizon, session, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(M.rank_correlation(pairs(s, d, ["session"]), "feature", "horizon", "session")))
query("m7_event_split_ic", sql(*A, pairs_sql("abs(ofi) > 0.5 AS event"), ranks_sql("feature, horizon, event"), select="SELECT feature, horizon, event, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(M.rank_correlation(M.long_pairs(FB(s, d).withColumn("event", F.abs("ofi") > 0.5), ["ofi", "volume"], [1, 4], ["event"]), "feature", "horizon", "event")))
query("m13_direction_vs_magnitude", sql(*A, pairs_sql(), "mg AS (SELECT * REPLACE (abs(y) AS y) FROM pairs)", ranks_sql(FH, "mg"), select="SELECT feature, horizon, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(M.rank_correlation(pairs(s, d).withColumn("y", F.abs("y")), "feature", "horizon")))
query(
    "m8_fdr_adjust",
    "WITH t AS (SELECT user_id % 50 AS name, (count(*) * 7 % 97 + 1) / 100.0 AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS n FROM t), a AS (SELECT *, least(min(p * n / r) OVER (ORDER BY r DESC), 1.0) AS q FROM r) SELECT name, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(q AS DOUBLE), 6) AS p_adjusted, q <= 0.3 AS rejected FROM a",
)(lambda s, d: rounded(M.fdr_adjust(s.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 50).alias("name")).agg(((F.count(F.lit(1)) * 7 % 97 + 1) / 100.0).alias("p")), 0.3)))
query(
    "m9_mutual_information",
    sql(*A, pairs_sql(), "q AS (SELECT *, ntile(20) OVER (PARTITION BY feature, horizon ORDER BY x, ts_event, symbol) AS bx, ntile(20) OVER (PARTITION BY feature, horizon ORDER BY y, ts_event, symbol) AS bq FROM pairs)", "c AS (SELECT feature, horizon, bx, bq, count(*) AS n FROM q GROUP BY ALL)", "t AS (SELECT *, sum(n) OVER (PARTITION BY feature, horizon) AS t, sum(n) OVER (PARTITION BY feature, horizon, bx) AS nx, sum(n) OVER (PARTITION BY feature, horizon, bq) AS ny FROM c)", select="SELECT feature, horizon, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mutual_information FROM t GROUP BY ALL"),
)(lambda s, d: rounded(M.mutual_information(pairs(s, d))))
M11 = (
    """sh AS (
  SELECT symbol, ts_event, lead(round(close, 9), 4) OVER w / round(close, 9) - 1 AS y, k AS shift, f AS feature, round(ofi, 9) AS o, volume AS v,
         CASE k WHEN -1 THEN lead(CASE f WHEN 'ofi' THEN round(ofi, 9) ELSE volume END) OVER w WHEN 0 THEN CASE f WHEN 'ofi' THEN round(ofi, 9) ELSE volume END
                WHEN 1 THEN lag(CASE f WHEN 'ofi' THEN round(ofi, 9) ELSE volume END) OVER w ELSE lag(CASE f WHEN 'ofi' THEN round(ofi, 9) ELSE volume END, 5) OVER w END AS x
  FROM flow_bars, (VALUES (-1), (0), (1), (5)) a(k), (VALUES ('ofi'), ('volume')) b(f) WINDOW w AS (PARTITION BY symbol, k, f ORDER BY ts_event))""",
    "sp AS (SELECT * FROM sh WHERE x IS NOT NULL AND y IS NOT NULL)",
)
M11_VERDICT = """wd AS (
  SELECT feature, max(CASE WHEN shift = 0 THEN abs(spearman) END) AS now, max(CASE WHEN shift = 1 THEN abs(spearman) END) AS past_1,
         max(CASE WHEN shift = 5 THEN abs(spearman) END) AS past_5, max(CASE WHEN shift = -1 THEN abs(spearman) END) AS ahead_1 FROM ic GROUP BY feature),
lagged AS (SELECT round(ofi, 9) AS o, lag(round(ofi, 9)) OVER w AS po, volume AS v, lag(volume) OVER w AS pv FROM flow_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)),
au AS (SELECT 'ofi' AS feature, corr(o, po) AS rho FROM lagged WHERE po IS NOT NULL UNION ALL SELECT 'volume', corr(v, pv) FROM lagged WHERE pv IS NOT NULL)"""
M11_SELECT = """SELECT feature, round(now, 6) AS now, round(past_1, 6) AS past_1, round(past_5, 6) AS past_5, round(ahead_1, 6) AS ahead_1, round(rho, 6) AS autocorrelation,
       CASE WHEN now IS NULL OR now < 0.03 THEN 'noise' WHEN ahead_1 > 0.05 AND ahead_1 > now * 1.3 + 0.01 THEN 'leak_future'
            WHEN ahead_1 > 0.05 AND ahead_1 > now * 1.1 + 0.005 AND now > 0.04 THEN 'suspect_future' WHEN past_1 > now + 0.03 AND past_1 > 0.1 THEN 'leak_past_peak'
            WHEN now >= 0.1 THEN CASE WHEN abs(rho) < 0.1 THEN 'pass_low_autocorrelation' WHEN past_1 < 0.4 * now * abs(rho) THEN 'leak_past_alignment'
                 WHEN past_1 < 0.7 * now * abs(rho) THEN 'suspect_high_decay' WHEN past_5 > past_1 + 0.02 THEN 'suspect_not_monotonic' ELSE 'pass' END
            WHEN abs(rho) > 0.7 AND past_1 < 0.3 * now THEN 'suspect' ELSE 'pass' END AS verdict FROM wd JOIN au USING (feature)"""
query("m11_shift_leak_test", sql(*A, *M11, ranks_sql("feature, shift", "sp"), M11_VERDICT, select=M11_SELECT))(
    lambda s, d: rounded(M.shift_verdict(M.shift_leak(FB(s, d), ["ofi", "volume"], 4), M.lag_autocorrelation(FB(s, d), ["ofi", "volume"])))
)
query("m14_permutation_null")(lambda s, d: rounded(R.permutation_null(pairs(s, d).where("horizon = 4"))))


@query("m15_bootstrap_ci")
def m15(spark, d):
    """Intervals of the mean and the Sharpe ratio by symbol, and of the area under the curve of |ofi| for the next bar's rise."""
    f = W.forward_return(FB(spark, d), 1).where("fwd_ret_1 is not null")
    mean, sharpe = (r.select("symbol", F.lit(n).alias("statistic"), "low", "high") for n, r in (("mean", R.bootstrap_mean(f, "fwd_ret_1", "symbol")), ("sharpe", R.bootstrap_sharpe(f, "fwd_ret_1", "symbol"))))
    rise = f.select(F.col("ofi"), (F.col("fwd_ret_1") > 0).cast("int").alias("rise"))
    area = R.bootstrap_auc(rise, "ofi", "rise").select(F.lit(None).cast("string").alias("symbol"), F.lit("auc").alias("statistic"), "low", "high")
    return rounded(mean.union(sharpe).union(area))


TR = f"tr2 AS (SELECT symbol, ts_event, lead(round(close, 9), 4) OVER w / round(close, 9) - 1 AS ret FROM flow_bars {WINDOW})"
M16 = (
    TR,
    "dy AS (SELECT symbol, CAST(ts_event AS DATE) AS d, count(*) AS n, count(*) FILTER (ret > 0) AS w, avg(ret) AS m, sum(ret) AS s FROM tr2 WHERE ret IS NOT NULL GROUP BY ALL)",
    "wh AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS n, sum(w) / sum(n) AS win_rate, sum(s) / sum(n) * 10000 AS mean_units FROM dy GROUP BY symbol)",
    "hd AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) <= floor(count(*) OVER (PARTITION BY symbol) / 2) AS h FROM dy WHERE n >= 2)",
    """dd AS (
  SELECT symbol, count(*) AS days, coalesce(avg(m) / (nullif(stddev_samp(m), 0) / sqrt(count(*))), 0) AS t, avg(m) / stddev_samp(m) * sqrt(252.0) AS sharpe,
         coalesce(avg(m) FILTER (h) / (nullif(stddev_samp(m) FILTER (h), 0) / sqrt(count(*) FILTER (h))), 0) AS t1,
         coalesce(avg(m) FILTER (NOT h) / (nullif(stddev_samp(m) FILTER (NOT h), 0) / sqrt(count(*) FILTER (NOT h))), 0) AS t2
  FROM hd GROUP BY symbol HAVING count(*) >= 3)""",
)
M16_SELECT = """SELECT symbol, n, round(win_rate, 6) AS win_rate, round(mean_units, 4) AS mean_units, days, round(t, 4) AS t_value, round(sharpe, 4) AS sharpe, round(t1, 4) AS t_first,
       round(t2, 4) AS t_second, sign(t1) = sign(t2) AND abs(t1) >= 1 AND abs(t2) >= 1 AND floor(days / 2) >= 3 AS stable FROM wh JOIN dd USING (symbol)"""


def edges(s, d):
    """Without p, which SQL has no function for; a test holds it against known values."""
    e = M.edge_statistics(W.forward_return(FB(s, d), 4).withColumn("ret", F.col("fwd_ret_4")).where("ret is not null"), "symbol").drop("p_value")
    return rounded(e.withColumns({c: F.round(c, 4) for c in ("mean_units", "t_value", "sharpe", "t_first", "t_second")}))


query("m16_edge_statistics", sql(*A, *M16, select=M16_SELECT))(edges)
query("m18_signal_overlap", sql(*A, "g AS (SELECT ofi > 0.2 AS a, cvd_delta > 50 AS b, volume > 150 AS c FROM flow_bars)", select="SELECT 'a' AS a, 'b' AS b, round(count(*) FILTER (g.a AND g.b) / greatest(count(*) FILTER (g.a OR g.b), 1), 6) AS jaccard FROM g UNION ALL SELECT 'a', 'c', round(count(*) FILTER (g.a AND g.c) / greatest(count(*) FILTER (g.a OR g.c), 1), 6) FROM g UNION ALL SELECT 'b', 'c', round(count(*) FILTER (g.b AND g.c) / greatest(count(*) FILTER (g.b OR g.c), 1), 6) FROM g"))(lambda s, d: rounded(M.signal_overlap(FB(s, d).select((F.col("ofi") > 0.2).alias("a"), (F.col("cvd_delta") > 50).alias("b"), (F.col("volume") > 150).alias("c")), ["a", "b", "c"])))
query("m21_correlation_matrix", sql(*A, select="SELECT 'ofi' AS a, 'volume' AS b, round(corr(ofi, volume), 6) AS r FROM flow_bars UNION ALL SELECT 'ofi', 'cvd_delta', round(corr(ofi, cvd_delta), 6) FROM flow_bars UNION ALL SELECT 'volume', 'cvd_delta', round(corr(volume, cvd_delta), 6) FROM flow_bars"))(lambda s, d: rounded(M.correlation_matrix(FB(s, d), ["ofi", "volume", "cvd_delta"])))
PROFILE = "SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.99), 6) AS p99 FROM flow_bars"
query("m26_stationarity_summary", sql(*A, select=" UNION ALL ".join(PROFILE.format(c=c) for c in ("ofi", "volume", "close"))))(lambda s, d: rounded(M.column_profile(FB(s, d), ["ofi", "volume", "close"])))
M23_COLUMNS = {"ofi": "ofi", "zero": "0.0", "small": "ofi * 1e-4", "side": "sign(ofi) * sign(ofi)", "rare": "CASE WHEN n_trades > 12 THEN n_trades ELSE 1 END", "gappy": "CASE WHEN n_trades > 9 THEN ofi END"}
M23_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS c, CAST({e} AS DOUBLE) AS v FROM fb9" for n, e in M23_COLUMNS.items())
M23 = (
    "fb9 AS (SELECT round(ofi, 9) AS ofi, n_trades FROM flow_bars)",
    f"lg AS ({M23_ROWS})",
    "pr AS (SELECT c, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS nl, stddev_pop(v) AS sd FROM lg GROUP BY c)",
    "vc AS (SELECT c, v, count(*) AS n FROM lg WHERE v IS NOT NULL GROUP BY ALL)",
    "vp AS (SELECT c, count(*) AS vals, max(n) / sum(n) AS top FROM vc GROUP BY c)",
)
M23_SELECT = """SELECT c AS "column", vals AS values, round(top, 6) AS top_share,
       CASE WHEN nl > 0.5 THEN 'null_heavy' WHEN sd = 0 THEN 'dead' WHEN sd < 1e-3 THEN 'weak' WHEN coalesce(vals, 0) < 3 THEN 'few_values' WHEN top > 0.95 THEN 'near_constant' ELSE 'alive' END AS verdict
FROM pr LEFT JOIN vp USING (c)"""


def dead(s, d):
    f = FB(s, d).withColumns({
        "zero": F.lit(0.0), "small": F.col("ofi") * 1e-4, "side": F.signum("ofi") * F.signum("ofi"),
        "rare": F.when(F.col("n_trades") > 12, F.col("n_trades")).otherwise(1), "gappy": F.when(F.col("n_trades") > 9, F.col("ofi")),
    })
    return rounded(M.dead_features(M.column_profile(f, list(M23_COLUMNS)), M.value_profile(f, list(M23_COLUMNS))))


query("m23_dead_feature_audit", sql(*A, *M23, select=M23_SELECT))(dead)
query("m24_interaction_test", sql(TICKS_SQL, "c AS (SELECT action, side, count(*) AS n FROM ticks GROUP BY ALL)", "e AS (SELECT *, sum(n) OVER (PARTITION BY action) * sum(n) OVER (PARTITION BY side) / sum(n) OVER () AS e, sum(n) OVER () AS t FROM c)", select="SELECT round(sum((n - e) * (n - e) / e), 6) AS chi_square, round(sqrt(sum((n - e) * (n - e) / e) / max(t)), 6) AS cramers_v FROM e"))(lambda s, d: rounded(M.chi_square(market.ticks(s, d).groupBy("action", "side").agg(F.count(F.lit(1)).alias("n")), "action", "side")))
M27 = (
    TR,
    "j AS (SELECT round(ofi, 9) AS ofi, ret FROM flow_bars JOIN tr2 USING (symbol, ts_event) WHERE ret IS NOT NULL)",
    "c AS (SELECT quantile_cont(ofi, [0.2, 0.4, 0.6, 0.8]) AS c FROM j)",
    "b AS (SELECT len(list_filter(c, lambda x: x < ofi)) AS b, avg(ret) AS m FROM j, c GROUP BY ALL)",
    """rj AS (
  SELECT rank() OVER (ORDER BY ofi) + (count(*) OVER (PARTITION BY ofi) - 1) / 2.0 AS rx, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0 AS ry FROM j)""",
)
query("m27_quantile_spread", sql(*A, *M27, select="SELECT round((arg_max(m, b) - arg_min(m, b)) * 10000, 6) AS spread_bp, (SELECT round(corr(rx, ry), 6) FROM rj) AS ic FROM b"))(
    lambda s, d: rounded(M.quantile_spread(W.forward_return(FB(s, d), 4).where("fwd_ret_4 is not null"), "ofi", "fwd_ret_4"))
)
query("m34_hit_rate_at_horizon", sql(*A, TR, select="SELECT count(*) AS n, round(avg(CASE WHEN sign(cvd_delta) = sign(ret) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM flow_bars JOIN tr2 USING (symbol, ts_event) WHERE ret IS NOT NULL AND cvd_delta <> 0"))(lambda s, d: rounded(M.hit_rate(FB(s, d), "cvd_delta", 4)))
M32_SQL = """WITH x AS (SELECT l.toxic AS y, d.n_chars AS v FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc,
       round(avg(CASE WHEN (v >= 1000) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM r"""
LABELLED_TEXTS = lambda s, d: s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
query("m32_calibration_auc", M32_SQL)(lambda s, d: rounded(M.auc(LABELLED_TEXTS(s, d), "n_chars", "toxic", 1000)))
# the covariance is inverted in place, one pivot a step
M30 = """
e AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
l AS (SELECT i, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM e),
mean AS (SELECT j, avg(v) AS m FROM l GROUP BY j),
c AS (SELECT i, j, v - m AS v FROM l JOIN mean USING (j)),
cell AS (SELECT a.j AS p, b.j AS q, sum(a.v * b.v) / ((SELECT count(*) FROM e) - 1) + CASE WHEN a.j = b.j THEN 1e-6 ELSE 0 END AS s FROM c a JOIN c b USING (i) GROUP BY a.j, b.j),
line AS (SELECT p, list(s ORDER BY q) AS w FROM cell GROUP BY p),
r(k, m) AS (
  SELECT 1, (SELECT list(w ORDER BY p) FROM line)
  UNION ALL
  SELECT k + 1, list_transform(range(1, len(m) + 1), lambda p: list_transform(range(1, len(m) + 1), lambda q:
    CASE WHEN p = k AND q = k THEN 1 / m[k][k] WHEN p = k THEN m[k][q] / m[k][k] WHEN q = k THEN -m[p][k] / m[k][k] ELSE m[p][q] - m[p][k] * m[k][q] / m[k][k] END))
  FROM r WHERE k <= len(m)),
inverse AS (SELECT p, q, m[p][q] AS s FROM (SELECT m FROM r ORDER BY k DESC LIMIT 1), range(1, 65) a(p), range(1, 65) b(q)),
far AS (SELECT a.i, sqrt(sum(a.v * s * b.v)) AS distance FROM c a JOIN inverse ON inverse.p = a.j JOIN c b ON b.i = a.i AND b.j = inverse.q GROUP BY a.i),
near AS (SELECT a.i, list_sort(list(list_distance(a.x, b.x)))[5] AS knn FROM e a JOIN e b ON a.i <> b.i GROUP BY a.i)"""
M30_SELECT = """
SELECT vec_id, round(distance, 5) AS distance, distance > (SELECT avg(distance) + 3 * stddev_pop(distance) FROM far) AS anomaly,
       round(knn, 5) AS knn_distance, knn > (SELECT quantile_cont(knn, 0.99) FROM near) AS knn_anomaly
FROM e JOIN far USING (i) JOIN near USING (i)"""
query("m30_vector_anomaly", f"WITH RECURSIVE {M30}{M30_SELECT}")(lambda s, d: rounded(V.vector_anomaly(s.read.parquet(f"{d}/embeddings.parquet")), 5))


@query("m29_cluster_embeddings")
def m29(spark, d):
    """k-means++ by the library's distributed implementation; the profile of its clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=5, seed=7, maxIter=10).fit(v).transform(v).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


# Monitors
query("n1_tick_quality_report", sql(TICKS_SQL, select="SELECT count(*) AS n, count(*) FILTER (price IS NULL) AS null_price, count(*) FILTER (price <= 0) AS bad_price, round(quantile_cont(price, 0.01), 6) AS p01, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.99), 6) AS p99, min(ts_event) AS first_ts, max(ts_event) AS last_ts FROM ticks"))(lambda s, d: rounded(M.tick_quality(market.ticks(s, d))))
N4 = f"""g AS (
  SELECT {SESSION} AS session, abs(ofi) > 0.5 AND volume > 60 AS e, abs(ofi) > 0.5 AS p1, volume > 60 AS p2, lag(close, 20) OVER w IS NULL AS wu, lag(close, 40) OVER w IS NULL AS nl
  FROM flow_bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_event))"""
N4_SELECT = """SELECT session, count(*) AS n, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS event_rate, round(avg(CASE WHEN nl THEN 1.0 ELSE 0.0 END), 6) AS null_share,
       round(avg(CASE WHEN wu THEN 1.0 ELSE 0.0 END), 6) AS warm_up_share, round(avg(CASE WHEN p1 THEN 0.0 ELSE 1.0 END), 6) AS imbalance_fails,
       round(avg(CASE WHEN p2 THEN 0.0 ELSE 1.0 END), 6) AS volume_fails,
       CASE WHEN avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) = 0 THEN 'empty' WHEN avg(CASE WHEN nl THEN 1.0 ELSE 0.0 END) > 0.05 THEN 'null_inputs'
            WHEN avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) < 0.01 THEN 'rare' WHEN avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'frequent' ELSE 'ok' END AS verdict
FROM g GROUP BY GROUPING SETS ((), (session))"""


def gate_audit(s, d):
    w = Window.partitionBy("symbol").orderBy("ts_event")
    f = W.session_flags(FB(s, d)).withColumns({"p1": F.abs("ofi") > 0.5, "p2": F.col("volume") > 60, "far": F.lag("close", 40).over(w), "old": F.lag("close", 20).over(w)})
    return rounded(M.event_gate_audit(f.withColumn("e", F.col("p1") & F.col("p2")), "e", "session", {"imbalance": F.col("p1"), "volume": F.col("p2")}, ("far",), F.col("old").isNull()))


query("n4_event_gate_audit", sql(*A, N4, select=N4_SELECT))(gate_audit)
query("n5_feature_drift", sql(*A, "n AS (SELECT * FROM flow_bars WHERE ts_event >= TIMESTAMP '2024-01-20')", "b AS (SELECT * FROM flow_bars WHERE ts_event < TIMESTAMP '2024-01-20')", select="SELECT 'volume' AS \"column\", round(abs((SELECT avg(volume) FROM n) - avg(volume)) / greatest(stddev_samp(volume), 1e-9), 6) AS drift FROM b UNION ALL SELECT 'ofi', round(abs((SELECT avg(ofi) FROM n) - avg(ofi)) / greatest(stddev_samp(ofi), 1e-9), 6) FROM b"))(lambda s, d: rounded(M.feature_drift(FB(s, d).where("ts_event >= timestamp_ntz '2024-01-20'"), FB(s, d).where("ts_event < timestamp_ntz '2024-01-20'"), ["volume", "ofi"])))
query("n6_coverage_stats", sql(TICKS_SQL, BARS, select="SELECT round(avg(volume), 6) AS mean, round(quantile_cont(volume, 0.5), 6) AS median, round(quantile_cont(volume, 0.25), 6) AS q25, round(quantile_cont(volume, 0.75), 6) AS q75, round(avg(CASE WHEN volume < 80 THEN 1.0 ELSE 0.0 END), 6) AS low_share FROM bars"))(lambda s, d: rounded(M.coverage_stats(bars(s, d), "volume", 80)))
query("n7_revalidation_gates", sql(TICKS_SQL, BARS, select="SELECT 'rows' AS gate, count(*) > 100 AS ok FROM bars UNION ALL SELECT 'ohlc', count(*) FILTER (high < low OR close > high) = 0 FROM bars UNION ALL SELECT 'volume', min(volume) > 1000 FROM bars"))(lambda s, d: M.gates(bars(s, d), {"rows": F.count(F.lit(1)) > 100, "ohlc": F.sum(((F.col("high") < F.col("low")) | (F.col("close") > F.col("high"))).cast("int")) == 0, "volume": F.min("volume") > 1000}))
query("n9_robust_scaler", sql(TICKS_SQL, BARS, "f AS (SELECT quantile_cont(volume, 0.5) AS m, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS q FROM bars)", select="SELECT symbol, ts_event, round(least(greatest((volume - m) / q, -10), 10), 6) AS volume_scaled FROM bars, f"))(lambda s, d: rounded(M.robust_scale(bars(s, d), ["volume"]).select("symbol", "ts_event", "volume_scaled")))
query("n10_parameter_grid_gate", sql(*A, f"g AS (SELECT {SESSION} AS session, scale, shift, abs(round(ofi, 9)) >= 0.4 * scale + shift AS e FROM flow_bars, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) a(scale), (VALUES (0.0::DOUBLE), (0.05::DOUBLE)) b(shift))", select="SELECT scale, shift, session, count(*) AS n, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS event_rate FROM g GROUP BY GROUPING SETS ((scale, shift), (scale, shift, session))"))(lambda s, d: rounded(M.parameter_grid_rates(W.session_flags(FB(s, d)).withColumn("score", F.abs("ofi")), "score", [0.5, 1.0], [0.0, 0.05], 0.4)))
query("n12_direction_vote_trace", sql(*A, "v AS (SELECT sign(ofi) + sign(cvd_delta) AS q FROM flow_bars)", select="SELECT CASE WHEN abs(q) >= 2 THEN 'strict' WHEN q <> 0 THEN 'weak' ELSE 'none' END AS vote_kind, count(*) AS n FROM v GROUP BY ALL"))(lambda s, d: L.event_direction_vote(FB(s, d), ["ofi", "cvd_delta"]).groupBy("vote_kind").agg(F.count(F.lit(1)).alias("n")))

# Trades
EXITS = f"""xw AS (SELECT a.*, sign(c.cvd_delta) AS d, list({{'t': ts_event, 'h': high, 'l': low, 'c': close}}) OVER {nxt(12)} AS x FROM atr a JOIN (SELECT symbol, ts_event, CASE WHEN abs(cvd_delta) > 60 THEN cvd_delta ELSE 0 END AS cvd_delta FROM cvd) c USING (symbol, ts_event)),
xe AS (SELECT *, list_filter(x, lambda b: CASE WHEN d > 0 THEN b.l <= close - atr OR b.h >= close + 1.5 * atr ELSE b.h >= close + atr OR b.l <= close - 1.5 * atr END)[1] AS e FROM xw WHERE d <> 0 AND len(x) > 0),
xr AS (SELECT *, CASE WHEN e IS NULL THEN 'timeout' WHEN (d > 0 AND e.l <= close - atr) OR (d < 0 AND e.h >= close + atr) THEN 'stop' ELSE 'target' END AS exit_reason FROM xe),
trades AS (SELECT symbol, ts_event, coalesce(e.t, x[len(x)].t) AS ts_exit, CAST(d AS INTEGER) AS side, exit_reason, CASE exit_reason WHEN 'stop' THEN -atr WHEN 'target' THEN 1.5 * atr ELSE d * (x[len(x)].c - close) END - 0.01 AS pnl FROM xr)"""
AE = (TICKS_SQL, BARS, ATR, FLOW, EXITS)


def exits(s, d):
    b = stage(W.true_range_atr(flow_bars(s, d))).withColumn("dir", F.when(F.abs("cvd_delta") > 60, F.col("cvd_delta")).otherwise(0.0))
    return O.candidate_exits(b, "dir")


query("o1_event_backtest_exits", sql(*AE, select="SELECT symbol, ts_event, ts_exit, side, exit_reason, round(pnl, 6) AS pnl FROM trades"))(lambda s, d: rounded(exits(s, d)))
query("o1_event_backtest")(lambda s, d: rounded(O.one_at_a_time(exits(s, d))))
query("o2_equity_drawdown", sql(*AE, "q AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts_exit, ts_event) AS equity FROM trades)", select="SELECT symbol, ts_event, round(equity, 6) AS equity, round(greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts_exit, ts_event), 0) - equity, 6) AS drawdown FROM q"))(lambda s, d: rounded(O.equity_drawdown(exits(s, d)).select("symbol", "ts_event", "equity", "drawdown")))
O2 = (
    "q AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts_exit, ts_event) AS equity FROM trades)",
    "q2 AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts_exit, ts_event), 0) - equity AS dd FROM q)",
    "dq AS (SELECT symbol, CAST(ts_exit AS DATE) AS d, sum(pnl) AS p FROM trades GROUP BY ALL)",
    "sq AS (SELECT symbol, coalesce(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252.0), 0) AS sharpe FROM dq GROUP BY symbol)",
    """wq AS (
  SELECT symbol, count(*) AS n, sum(pnl) AS pnl, max(dd) AS max_drawdown, sum(greatest(pnl, 0)) / greatest(-sum(least(pnl, 0)), 1e-9) AS profit_factor,
         avg(CASE WHEN exit_reason = 'target' THEN 1.0 ELSE 0.0 END) AS ta, avg(CASE WHEN exit_reason = 'stop' THEN 1.0 ELSE 0.0 END) AS st,
         avg(CASE WHEN exit_reason = 'timeout' THEN 1.0 ELSE 0.0 END) AS ti FROM q2 GROUP BY symbol)""",
)
O2_SELECT = """SELECT symbol, n, round(pnl, 6) AS pnl, round(max_drawdown, 6) AS max_drawdown, round(profit_factor, 6) AS profit_factor, round(ta, 6) AS target_share,
       round(st, 6) AS stop_share, round(ti, 6) AS timeout_share, round(sharpe, 4) AS sharpe FROM wq JOIN sq USING (symbol)"""
query("o2_equity_summary", sql(*AE, *O2, select=O2_SELECT))(lambda s, d: rounded(O.equity_summary(exits(s, d), "symbol").withColumn("sharpe", F.round("sharpe", 4))))
METRICS = "count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(pnl), 6) AS pnl, round(sum(greatest(pnl, 0)) / greatest(-sum(least(pnl, 0)), 1e-9), 6) AS profit_factor"
query("o3_stress_grid", sql(*AE, "g AS (SELECT sc AS scenario, pnl - ex AS pnl FROM trades, (VALUES ('base', 0.0), ('wide', 0.02), ('severe', 0.05)) v(sc, ex))", select=f"SELECT scenario, {METRICS} FROM g GROUP BY ALL"))(lambda s, d: rounded(O.stress_grid(exits(s, d), {"base": 0.0, "wide": 0.02, "severe": 0.05})))
query("o4_per_regime_metrics", sql(*AE, REGIME, select=f"SELECT regime, {METRICS} FROM trades JOIN rg USING (symbol, ts_event) GROUP BY ALL"))(lambda s, d: rounded(O.trade_metrics(exits(s, d).join(regime(s, d).select("symbol", "ts_event", "regime"), ["symbol", "ts_event"]), "regime")))
FILL = "fl AS (SELECT seq, ask_px, ask_sz, size AS want, list_transform(range(1, 11), lambda i: greatest(least(ask_sz[i], size - coalesce(list_sum(ask_sz[1:i - 1]), 0)), 0)) AS take FROM book WHERE action = 'T')"
query("o7_walk_the_book_fill", sql(BOOK_SQL, FILL, "q AS (SELECT *, list_sum(take) AS filled, len(list_filter(take, lambda t: t > 0)) AS used FROM fl)", select="SELECT seq, filled, round(CASE WHEN filled > 0 THEN list_sum(list_transform(list_zip(ask_px, take), lambda z: z[1] * z[2])) / filled END, 6) AS fill_vwap, want - filled AS residual, CAST(used AS INTEGER) AS levels_used FROM q"))(lambda s, d: rounded(K.walk_the_book_fill(market.book(s, d).where("action = 'T'").withColumn("is_buy", F.lit(True)).withColumn("want", F.col("size"))).select("seq", "filled", "fill_vwap", "residual", "levels_used")))
SLIP = "sl AS (SELECT seq, size / greatest(ask_sz[1], 1) AS r, size FROM book WHERE action = 'T'), sm AS (SELECT *, CASE WHEN r <= 1 THEN 0.5 WHEN r <= 3 THEN 0.5 + 0.5 * (r - 1) / 2 ELSE 1.0 + 0.25 * (r - 3) END AS m FROM sl)"
slip = lambda s, d: O.depth_slippage(market.book(s, d).where("action = 'T'").withColumn("depth", F.get("ask_sz", F.lit(0))))
query("o8_depth_slippage_model", sql(BOOK_SQL, SLIP, select="SELECT seq, round(m, 6) AS slippage_ticks FROM sm"))(lambda s, d: rounded(slip(s, d).select("seq", "slippage_ticks")))
O10 = (
    "c AS (SELECT CASE WHEN m <= 0.5 THEN 'flat' WHEN m <= 1 THEN 'ramp' ELSE 'deep' END AS region, m AS model, (seq % 5) / 4.0 AS realised FROM sm)",
    "cg AS (SELECT region, count(*) AS n, avg(abs(model)) AS model, avg(abs(realised)) AS realised, sum(abs(model) * abs(realised)) / sum(model * model) AS sl FROM c GROUP BY GROUPING SETS ((), (region)))",
    "ch AS (SELECT *, least(greatest(sl, 0.1), 5.0) AS slope, CASE WHEN realised > 1e-9 THEN (model - realised) / realised END AS gap FROM cg)",
)
O10_SELECT = """SELECT region, n, round(model, 6) AS model, round(realised, 6) AS realised, round(slope, 6) AS slope, round(gap, 6) AS gap,
       CASE WHEN n < 20 OR gap IS NULL THEN 'insufficient' WHEN abs(gap) <= 0.15 THEN 'well_calibrated' WHEN gap > 0 THEN 'over_calibrated' ELSE 'under_calibrated' END AS verdict FROM ch"""
SLIP_LOG = lambda s, d: slip(s, d).select(F.when(F.col("slippage_ticks") <= 0.5, "flat").when(F.col("slippage_ticks") <= 1, "ramp").otherwise("deep").alias("region"), F.col("slippage_ticks").alias("model"), (F.col("seq") % 5 / 4.0).alias("realised"))
query("o10_slippage_calibration", sql(BOOK_SQL, SLIP, *O10, select=O10_SELECT))(lambda s, d: rounded(O.slippage_calibration(SLIP_LOG(s, d))))
query("o13_alpha_filter_top_k", sql(*AE, "r AS (SELECT symbol, CAST(hour(ts_event) AS INTEGER) AS rule, count(*) AS n, round(avg(pnl), 9) AS mean_pnl FROM trades GROUP BY ALL)", "p AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY mean_pnl DESC, rule) AS INTEGER) AS place FROM r WHERE n >= 5)", select="SELECT symbol, rule, n, round(mean_pnl, 6) AS mean_pnl, place FROM p WHERE place <= 3"))(lambda s, d: rounded(O.top_rules(exits(s, d).groupBy("symbol", F.hour("ts_event").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pnl"), 9).alias("mean_pnl")), "symbol", "mean_pnl", 5, 3)))
P5 = (
    """pe AS (
  SELECT symbol, ts_event, round(pnl, 9) AS pnl, 100.0 + sum(round(pnl, 9)) OVER (PARTITION BY symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING) AS eq,
         sum(round(pnl, 9)) OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event ROWS UNBOUNDED PRECEDING) AS dayp FROM trades)""",
    "pd AS (SELECT *, 1 - eq / greatest(max(eq) OVER (PARTITION BY symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING), 100.0) AS dd FROM pe)",
    """pr AS (
  SELECT symbol, ts_event, CASE WHEN coalesce(min(dayp) OVER w <= -0.5, false) THEN 'loss' WHEN coalesce(max(dd) OVER w >= 0.1, false) THEN 'drawdown'
         WHEN count(*) OVER w >= 4 THEN 'trades' ELSE 'none' END AS block_reason
  FROM pd WINDOW w AS (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
query("p5_daily_loss_guard", sql(*AE, *P5, select="SELECT symbol, ts_event, block_reason, block_reason <> 'none' AS blocked FROM pr"))(
    lambda s, d: O.daily_loss_guard(rounded(exits(s, d), 9), 0.5, 4, 0.1).select("symbol", "ts_event", "block_reason", "blocked")
)
