"""Queries: contracts of datasets, composed features, labels and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import labels as L
from orderloom.operators import more as X
from orderloom.operators import replay as P
from orderloom.operators import windows as W
from orderloom.operators.book import wall_scan
from orderloom.operators.rolls import apply_offsets_to_book, combine_raw_files
from orderloom.plans.base import ATR, BARS, BOOK_SQL, FLOW, FLOW_BARS, LABELS, TICKS_SQL, WINDOW, atr_bars, bars, flow_bars, frame, labelled, nxt, sql, stage
from orderloom.plans.catalog import query
from orderloom.plans.features import BREAK, ID, MEAN_SIZE, PREV, WALLS, feature, tf
from orderloom.plans.flow import SESSION
from orderloom.plans.labels import AB, AL, BARRIERS_SQL, A, barrier_labels
from orderloom.plans.statistics import pairs, pairs_sql, ranks_sql
from orderloom.sources import market
from orderloom.spec import rounded

T, BK = market.ticks, market.book
FA = (TICKS_SQL, BARS, FLOW, FLOW_BARS)

query("a5_depth_feature_join", sql(TICKS_SQL, BARS, FLOW, select="SELECT symbol, ts_event, trades FROM bars LEFT JOIN (SELECT * FROM cvd WHERE trades > 1) USING (symbol, ts_event)"))(lambda s, d: X.depth_feature_join(bars(s, d), flow_bars(s, d).where("n_trades > 1").select(*ID, F.col("n_trades").alias("trades"))))
query("a8_schema_registry_validate", "SELECT 'absent' AS \"column\", 'missing' AS problem UNION ALL SELECT 'volume', 'type'")(lambda s, d: X.schema_check(bars(s, d), {"close": "double", "absent": "double", "volume": "int"}))
query("a9_feature_select_mode", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, close, volume FROM bars"))(lambda s, d: X.select_features(bars(s, d), ID, "keep_top", ["close", "volume"], []))
query("a10_leakage_column_filter", sql(TICKS_SQL, BARS, select="SELECT * FROM bars"))(lambda s, d: X.drop_forward_columns(W.forward_return(bars(s, d), 3)))
feature(
    "e33_derived_bar_block", lambda s, d: X.derived_block(bars(s, d)).withColumn("close_z", F.round("close_z", 3)), ["log_ret", "close_place", "rel_volume", "rel_range", "close_z"], (TICKS_SQL, BARS),
    f"round(ln(close / lag(close) OVER w), 6) AS log_ret, round((close - low) / greatest(high - low, 1e-9), 6) AS close_place, round(volume / greatest(avg(volume) OVER {frame(14)}, 1e-9), 6) AS rel_volume, round((high - low) / greatest(avg(high - low) OVER {frame(14)}, 1e-9), 6) AS rel_range, round((close - avg(close) OVER {frame(14)}) / (stddev_samp(close) OVER {frame(14)} + 1e-9), 3) AS close_z FROM bars {WINDOW}",
)
feature(
    "e34_technical_pack", lambda s, d: X.technical_pack(bars(s, d)), ["pack_atr", "upper_wick", "lower_wick", "wick_ratio"], (TICKS_SQL, BARS, f"p AS (SELECT *, avg(high - low) OVER {frame(14)} AS pa, high - greatest(open, close) AS u, least(open, close) - low AS l FROM bars)"),
    "round(pa, 6) AS pack_atr, round(u, 6) AS upper_wick, round(l, 6) AS lower_wick, round(greatest(least((u - l) / greatest(pa, 1e-9), 3), -3), 6) AS wick_ratio FROM p",
)
query(
    "f4_refill_slice_ratio",
    sql(TICKS_SQL, "n AS (SELECT *, greatest(sum(CASE action WHEN 'A' THEN size WHEN 'C' THEN -size ELSE 0 END) OVER (PARTITION BY symbol, CAST(ts_event AS DATE), round(price, 1), side ORDER BY ts_event, seq), 0) AS n FROM ticks)", select=f"SELECT seq, round(n / greatest(max(n) OVER {tf(200)}, 1), 6) AS refill_ratio FROM n"),
)(lambda s, d: rounded(X.refill_slice_ratio(T(s, d)).select("seq", "refill_ratio")))
query("f14_information_anomaly")(lambda s, d: X.information_anomaly(T(s, d)).select("seq", "anomaly"))
ICE = "ic AS (SELECT *, round(price, 1) AS px, size AS shown, CASE WHEN action = 'T' THEN size * 2 ELSE 0 END AS done, CAST(ts_event AS DATE) AS day FROM ticks), iw AS (SELECT *, last_value(CASE WHEN done > 0 THEN epoch_us(ts_event) END IGNORE NULLS) OVER (PARTITION BY symbol, day, px, side ORDER BY ts_event, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, lag(shown) OVER (PARTITION BY symbol, day, px, side ORDER BY ts_event, seq) AS p FROM ic), ig AS (SELECT symbol, day, px AS price, side, sum(done) AS done, max(shown) AS shown, max(CASE WHEN shown > p AND epoch_us(ts_event) - f <= 3600000000 THEN 1 ELSE 0 END) AS r, last(shown ORDER BY iw.ts_event, seq) AS ls, max(iw.ts_event) AS ts_event FROM iw GROUP BY ALL)"
ice = lambda s, d: X.iceberg_detect(T(s, d).select("symbol", "ts_event", "seq", F.round("price", 1).alias("price"), "side", "action", F.col("size").alias("displayed_size"), F.when(F.col("action") == "T", F.col("size") * 2).otherwise(0.0).alias("executed_size")), 1.5, 3600)
query("f15_iceberg_detect", sql(TICKS_SQL, ICE, select="SELECT symbol, day, price, side, ts_event, done - shown AS hidden_volume FROM ig WHERE done >= 1.5 * shown AND r = 1 AND ls > 0"))(ice)
query("f16_iceberg_per_bar", sql(TICKS_SQL, BARS, ICE, "ie AS (SELECT symbol, date_trunc('hour', x.ts_event) AS ts_event, count(*) AS n, sum(done - shown) AS v FROM ig x WHERE done >= 1.5 * shown AND r = 1 AND ls > 0 GROUP BY ALL)", select="SELECT symbol, ts_event, coalesce(n, 0) AS n_events, coalesce(v, 0) AS event_value FROM bars LEFT JOIN ie USING (symbol, ts_event)"))(lambda s, d: X.per_bar_counts(bars(s, d), ice(s, d), "hidden_volume"))
F17 = (
    "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS i FROM ticks WHERE action = 'T')",
    "fq AS (SELECT symbol, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM n WHERE i <= 2000 GROUP BY symbol)",
    """fk AS (
  SELECT n.*, round(abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts_event, seq)), 6) AS m FROM n JOIN fq USING (symbol)
  WHERE i <= 2000 AND price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
    "fm AS (SELECT symbol, m, count(*) AS c FROM fk WHERE m > 0 GROUP BY ALL)",
    "ft AS (SELECT symbol, m AS tick_size FROM fm QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c DESC, m) = 1)",
)
F17_SELECT = """SELECT symbol, quantile_cont(size, 0.5) AS typical_size, round(min(m) FILTER (m > 0), 6) AS smallest_move, round(stddev_samp(price), 6) AS price_std,
       any_value(tick_size) AS tick_size FROM fk LEFT JOIN ft USING (symbol) GROUP BY symbol"""
query("f17_auto_calibration", sql(TICKS_SQL, *F17, select=F17_SELECT))(lambda s, d: rounded(X.calibration(T(s, d))))
EXITS = "ex AS (SELECT seq, greatest(CASE WHEN aw > 0 THEN aw ELSE 10.0 END, 3.0) AS t, least(CASE WHEN bw > 0 THEN bw + 1.0 ELSE 12.0 END, 30.0) AS s FROM walls)"
query("g7_dynamic_exit_levels", sql(BOOK_SQL, MEAN_SIZE, WALLS, EXITS, select="SELECT seq, CAST(t AS DOUBLE) AS target_ticks, CAST(s AS DOUBLE) AS stop_ticks, round(CAST(t AS DOUBLE) / CAST(s AS DOUBLE), 6) AS reward_risk FROM ex"))(lambda s, d: rounded(X.dynamic_exits(wall_scan(BK(s, d), 1.5)).select("seq", "target_ticks", "stop_ticks", "reward_risk")))
CELLS = "mm AS (SELECT *, list_sort(bid_sz)[5] AS mb, list_sort(ask_sz)[5] AS ma FROM book), cells AS (SELECT symbol, ts_event, seq, CAST(i - 1 AS INTEGER) AS level, ln(1 + bid_sz[i]) AS bid_log, ln(1 + ask_sz[i]) AS ask_log, CAST(bid_sz[i] >= 3 * greatest(mb, 1) OR ask_sz[i] >= 3 * greatest(ma, 1) AS INTEGER) AS wall FROM mm, range(1, 11) r(i))"
query("g10_depth_channels", sql(BOOK_SQL, CELLS, select="SELECT seq, level, round(bid_log, 6) AS bid_log, round(ask_log, 6) AS ask_log, wall FROM cells"))(lambda s, d: rounded(X.depth_channels(BK(s, d)).select("seq", "level", "bid_log", "ask_log", "wall")))
CW = "(PARTITION BY symbol, level ORDER BY ts_event, seq ROWS BETWEEN 222 PRECEDING AND 1 PRECEDING)"
query("g14_causal_book_normalise", sql(BOOK_SQL, CELLS, "z AS (SELECT *, nullif(bid_log, 0) AS x FROM cells)", select=f"SELECT seq, level, round(CASE WHEN bid_log = 0 THEN 0 WHEN count(x) OVER {CW} < 50 THEN bid_log ELSE least(greatest((bid_log - avg(x) OVER {CW}) / (stddev_pop(x) OVER {CW} + 1e-6), -6), 6) END, 5) AS bid_log_norm FROM z"))(lambda s, d: rounded(X.causal_normalise(X.depth_channels(BK(s, d)), "bid_log").select("seq", "level", "bid_log_norm"), 5))
query("k5_apply_offsets_to_book", sql(BOOK_SQL, select="SELECT seq, round(price + 0.5, 6) AS price, round(bid_px[1] + 0.5, 6) AS bid FROM book"))(lambda s, d: rounded(apply_offsets_to_book(BK(s, d), 0.5).select("seq", "price", F.get("bid_px", F.lit(0)).alias("bid"))))
query("k8_combine_raw_files", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, CASE WHEN ts_event >= TIMESTAMP '2024-01-10' THEN close + 1 ELSE close END AS close FROM bars"))(lambda s, d: combine_raw_files([bars(s, d).where("ts_event < timestamp_ntz '2024-01-12'"), bars(s, d).where("ts_event >= timestamp_ntz '2024-01-10'").withColumn("close", F.col("close") + 1)]).select(*ID, "close"))
feature(
    "h13_soft_regime", lambda s, d: X.soft_regime(flow_bars(s, d).withColumn("s_trend", F.abs("ofi")).withColumn("s_calm", 1 - F.abs("ofi")).withColumn("s_wild", F.col("buy_share"))), ["p_trend", "entropy"],
    (*FA, "e AS (SELECT *, exp(abs(ofi)) AS a, exp(1 - abs(ofi)) AS b, exp(buy_share) AS c FROM flow_bars)", "p AS (SELECT *, a / (a + b + c) AS pa, b / (a + b + c) AS pb, c / (a + b + c) AS pc FROM e)"),
    "round(pa, 6) AS p_trend, round(-(pa * ln(pa) + pb * ln(pb) + pc * ln(pc)), 6) AS entropy FROM p",
)
feature(
    "h10_regime_scores", lambda s, d: X.regime_scores(flow_bars(s, d), ["volume", "ofi"]), ["regime_score"],
    (*FA, f"l AS (SELECT *, lag(volume) OVER w AS v, lag(ofi) OVER w AS o FROM flow_bars {WINDOW})", "q AS (SELECT quantile_cont(v, 0.05) AS v1, quantile_cont(v, 0.95) AS v2, quantile_cont(o, 0.05) AS o1, quantile_cont(o, 0.95) AS o2 FROM l)"),
    "round((CASE WHEN v IS NULL THEN 0 ELSE least(greatest((v - v1) / greatest(v2 - v1, 1e-9), 0), 1) END + CASE WHEN o IS NULL THEN 0 ELSE least(greatest((o - o1) / greatest(o2 - o1, 1e-9), 0), 1) END) / 2, 6) AS regime_score FROM l, q",
)
BUCKET = "CASE WHEN rp >= 1 THEN 'breakout_up' WHEN rp <= 0 THEN 'breakout_down' WHEN rp > 0.8 THEN 'near_high' WHEN rp < 0.2 THEN 'near_low' WHEN rp > 0.55 THEN 'upper_mid' WHEN rp < 0.45 THEN 'lower_mid' ELSE 'mid' END"
PLACE = "pl AS (SELECT *, round(least(greatest((close - prev_day_low) / greatest(prev_day_high - prev_day_low, 1e-9), 0), 1), 9) AS rp FROM prev)"
feature("h15_structure_bucket", lambda s, d: X.structure_bucket(rounded(W.previous_period_levels(bars(s, d)), 9)), ["structure_bucket"], (TICKS_SQL, BARS, PREV, PLACE), f"{BUCKET} AS structure_bucket FROM pl")
feature("i7_train_pool_flag", lambda s, d: X.train_pool_flag(labelled(s, d)), ["in_pool"], AL, "coalesce(label, 0) <> 0 AND atr >= (SELECT quantile_cont(atr, 0.5) FROM labelled) / 2 AS in_pool FROM labelled")
feature("i10_bar_quality_score", lambda s, d: X.bar_quality(flow_bars(s, d)), ["bar_quality"], FA, f"round(0.30 * abs(ofi) + 0.35 * CASE WHEN quantile_cont(volume, 0.5) OVER {frame(100, 1)} IS NULL THEN least(volume / 1e-9, 1) ELSE least(volume / greatest(quantile_cont(volume, 0.5) OVER {frame(100, 1)} * 2, 1e-9), 1) END + 0.35 * abs(buy_share - 0.5) * 2, 6) AS bar_quality FROM flow_bars")
feature("j6_adaptive_horizon", lambda s, d: X.adaptive_horizon(AB(s, d)), ["horizon"], A, f"CAST(round(12 * least(greatest(atr / greatest(quantile_cont(atr, 0.5) OVER {frame(100)}, 1e-9), 0.5), 2.0)) AS INTEGER) AS horizon FROM atr")
SOFT = (
    f"so0 AS (SELECT *, lead(close, 6) OVER w - close AS mv, CASE WHEN bars_held <= 3 THEN 2 ELSE 1 END AS ql FROM barrier_labels {WINDOW})",
    """so AS (
  SELECT *, 0.5 + 0.4 * (1 / (1 + exp(-least(greatest(1.5 * coalesce(mv, 0) / greatest(atr, 1e-10), -60.0), 60.0))) - 0.5) AS late,
         CASE ql WHEN 2 THEN 0.88 ELSE 0.72 END AS tg FROM so0)""",
    """sp AS (
  SELECT *, CASE outcome WHEN 'up' THEN tg WHEN 'down' THEN 0.12 WHEN 'timeout' THEN late ELSE 0.5 END AS lo,
         CASE outcome WHEN 'down' THEN tg WHEN 'up' THEN 0.12 WHEN 'timeout' THEN 1 - late ELSE 0.5 END AS sh,
         CASE WHEN outcome = 'timeout' THEN 0.4 + 0.15 * least(coalesce(bars_held, 0) / 24, 1) ELSE 0.75 END + CASE ql WHEN 2 THEN 0.1 ELSE 0 END AS cf FROM so)""",
    "sq AS (SELECT *, CASE label WHEN 1 THEN lo WHEN -1 THEN sh ELSE 0.5 END AS p FROM sp)",
    "sw AS (SELECT *, greatest(cf * abs(p - 0.5) * 2 * CASE ql WHEN 2 THEN 1.3 ELSE 1.0 END, 0.1) AS wt FROM sq)",
)
SOFT_SELECT = """round(CAST(p AS DOUBLE), 6) AS soft_p, round(CAST(lo AS DOUBLE), 6) AS soft_long, round(CAST(sh AS DOUBLE), 6) AS soft_short,
       round(CAST(cf AS DOUBLE), 6) AS soft_confidence, round(CAST(wt AS DOUBLE) / (SELECT avg(CAST(wt AS DOUBLE)) FROM sw), 6) AS soft_weight FROM sw"""


def soft_labelled(s, d):
    ahead_6 = F.lead("close", 6).over(X.by_time()) - F.col("close")
    return X.analytic_soft_labels(barrier_labels(s, d).withColumns({"move_ahead": ahead_6, "quality": F.when(F.col("bars_held") <= 3, 2).otherwise(1)}))


feature("j12_soft_labels_analytic", soft_labelled, ["soft_p", "soft_long", "soft_short", "soft_confidence", "soft_weight"], (*A, *BARRIERS_SQL, *SOFT), SOFT_SELECT)
feature("j20_gap_fill_label", lambda s, d: X.gap_fill_label(AB(s, d)), ["gap_fill"], (*A, f"g AS (SELECT *, lag(close) OVER w AS g FROM atr {WINDOW})"), f"CAST(coalesce(min(low) OVER {nxt(6)} <= g AND max(high) OVER {nxt(6)} >= g, false) AS INTEGER) AS gap_fill FROM g")
STRICT = f"c24 AS (SELECT *, list(close) OVER {nxt(24)} AS x FROM atr), f24 AS (SELECT *, list_filter(x, lambda v: v >= close + atr OR v <= close - atr)[1] AS f FROM c24), bk AS (SELECT *, coalesce(gap > 1.5 * median(gap) OVER (PARTITION BY symbol), false) AS b FROM (SELECT symbol, ts_event, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER (PARTITION BY symbol ORDER BY ts_event) AS gap FROM bars)), bs AS (SELECT symbol, ts_event, coalesce(sum(CAST(b AS INT)) OVER {nxt(24)}, 0) = 0 AND count(*) OVER {nxt(24)} = 24 AS clear FROM bk)"
feature("j3_strict_execution_labels", lambda s, d: L.close_barrier_labels(stage(W.true_range_atr(W.session_break_flag(bars(s, d), 1.5).withColumnRenamed("session_break", "brk"))).withColumnRenamed("brk", "session_break")).withColumn("strict_label", F.when(W.break_free(bars(s, d), 24), F.col("close_label"))), ["strict_label"], (*A, STRICT), "CASE WHEN clear THEN CASE WHEN f >= close + atr THEN 1 WHEN f <= close - atr THEN -1 ELSE 0 END END AS strict_label FROM f24 JOIN bs USING (symbol, ts_event)")
query("l6_fold_aggregate", sql(*A, LABELS, "f AS (SELECT symbol, CAST(week(ts_event) AS INT) AS fold, avg(label) AS m FROM labelled WHERE label IS NOT NULL GROUP BY ALL)", select="SELECT count(*) AS n_folds, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM f"))(lambda s, d: rounded(X.fold_aggregate(labelled(s, d).where("label is not null").groupBy("symbol", F.weekofyear("ts_event").alias("fold")).agg(F.avg("label").alias("m")), "m")))
query("l7_out_of_fold_assembly", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, CASE WHEN ts_event < TIMESTAMP '2024-01-08' THEN close WHEN ts_event >= TIMESTAMP '2024-01-15' THEN open ELSE 0.5 END AS prediction FROM bars"))(lambda s, d: X.out_of_fold([bars(s, d).where("ts_event < timestamp_ntz '2024-01-08'").select(*ID, F.col("close").alias("prediction")), bars(s, d).where("ts_event >= timestamp_ntz '2024-01-15'").select(*ID, F.col("open").alias("prediction"))], bars(s, d), 0.5))
query("l8_overfit_probability", sql(TICKS_SQL, "p AS (SELECT CAST(dayofmonth(ts_event) % 5 AS INTEGER) AS split, symbol AS model, avg(CASE WHEN seq % 2 = 0 THEN price END) AS ins, avg(CASE WHEN seq % 2 = 1 THEN price END) AS outs FROM ticks GROUP BY ALL)", "r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY outs) / (count(*) OVER (PARTITION BY split) + 1) AS r FROM p)", "b AS (SELECT split, arg_max(r, ins) AS s FROM r GROUP BY split)", select="SELECT split, round(s, 6) AS rank_share, round(ln(s / (1 - s)), 6) AS logit, CAST(ln(s / (1 - s)) <= 0 AS INTEGER) AS overfit FROM b"))(lambda s, d: rounded(X.overfit_probability(T(s, d).groupBy((F.dayofmonth("ts_event") % 5).alias("split"), F.col("symbol").alias("model")).agg(F.avg(F.when(F.col("seq") % 2 == 0, F.col("price"))).alias("ins"), F.avg(F.when(F.col("seq") % 2 == 1, F.col("price"))).alias("outs")))))
M2 = (
    ranks_sql("feature, horizon"),
    "bl AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY feature, horizon ORDER BY ts_event, symbol) - 1) * 8 / count(*) OVER (PARTITION BY feature, horizon)) AS INT) AS block FROM pairs)",
    ranks_sql("feature, horizon, block", "bl").replace("rk AS", "rkb AS").replace("FROM rk ", "FROM rkb ").replace("\nic AS", "\nicb AS"),
    "st AS (SELECT feature, horizon, avg(spearman) AS mean_ic, stddev_samp(spearman) AS std_ic, avg(CASE WHEN spearman > 0 THEN 1.0 ELSE 0.0 END) AS positive_share FROM icb GROUP BY ALL)",
    "q AS (SELECT *, ntile(20) OVER (PARTITION BY feature, horizon ORDER BY x, ts_event, symbol) AS bx, ntile(20) OVER (PARTITION BY feature, horizon ORDER BY y, ts_event, symbol) AS bq FROM pairs)",
    "c AS (SELECT feature, horizon, bx, bq, count(*) AS n FROM q GROUP BY ALL)",
    "t AS (SELECT *, sum(n) OVER (PARTITION BY feature, horizon) AS t, sum(n) OVER (PARTITION BY feature, horizon, bx) AS nx, sum(n) OVER (PARTITION BY feature, horizon, bq) AS ny FROM c)",
    "mi AS (SELECT feature, horizon, sum(n / t * ln(n * t / (nx * ny))) AS mutual_information FROM t GROUP BY ALL)",
    "cp AS (SELECT * REPLACE (CASE WHEN abs(y) <= 0.001 THEN 0 ELSE y END AS y) FROM pairs)",
    ranks_sql("feature, horizon", "cp").replace("rk AS", "rkc AS").replace("FROM rk ", "FROM rkc ").replace("\nic AS", "\nicc AS"),
    "dc AS (SELECT feature, abs(arg_min(spearman, horizon)) - abs(arg_max(spearman, horizon)) AS decay FROM ic GROUP BY feature)",
)
M2_SELECT = """SELECT feature, horizon, ic.n AS n, round(ic.spearman, 6) AS spearman, round(ic.pearson, 6) AS pearson, round(mean_ic, 6) AS mean_ic, round(std_ic, 6) AS std_ic,
       round(positive_share, 6) AS positive_share, round(mutual_information, 6) AS mutual_information, round(icc.spearman, 6) AS after_cost, round(decay, 6) AS decay,
       CASE WHEN abs(ic.spearman) < 0.01 THEN 'noise' WHEN abs(icc.spearman) < 0.5 * abs(ic.spearman) THEN 'cost_bound'
            WHEN greatest(positive_share, 1 - positive_share) < 0.7 THEN 'unstable' WHEN decay > 0.8 * abs(ic.spearman) THEN 'fast_decay' ELSE 'signal' END AS verdict
FROM ic JOIN st USING (feature, horizon) JOIN mi USING (feature, horizon) JOIN icc USING (feature, horizon) JOIN dc USING (feature)"""
query("m2_ic_audit", sql(*FA, pairs_sql(), *M2, select=M2_SELECT))(lambda s, d: rounded(X.ic_audit(pairs(s, d))))
M4 = """bl AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY feature, horizon ORDER BY ts_event, symbol) - 1) / greatest(floor(count(*) OVER (PARTITION BY feature, horizon) / 8), 1)) AS INT) AS block FROM pairs),
bt AS (SELECT * FROM bl WHERE block > 0 AND block < 8)"""
M4_SELECT = """SELECT feature, horizon, round(avg(spearman), 6) AS mean_ic, round(stddev_samp(spearman), 6) AS std_ic,
       round(avg(CASE WHEN abs(m) <= 1e-9 THEN 0.5 WHEN sign(spearman) = sign(m) THEN 1.0 ELSE 0.0 END), 6) AS same_sign, count(*) AS windows
FROM (SELECT *, avg(spearman) OVER (PARTITION BY feature, horizon) AS m FROM ic) GROUP BY feature, horizon HAVING count(*) >= 3"""
query("m4_walk_forward_ic", sql(*FA, pairs_sql(), M4, ranks_sql("feature, horizon, block", "bt"), select=M4_SELECT))(lambda s, d: rounded(X.M.walk_forward(pairs(s, d))))
query("m12_label_diagnostics", sql(*FA, ATR, LABELS, "pairs AS (SELECT symbol, ts_event, round(ofi, 9) AS x, CAST(label AS DOUBLE) AS y, 'ofi' AS feature FROM flow_bars JOIN labelled USING (symbol, ts_event) WHERE label IS NOT NULL)", ranks_sql("feature"), select="SELECT feature, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(X.M.rank_correlation(rounded(flow_bars(s, d), 9).join(labelled(s, d).select(*ID, "label"), ID).where("label is not null").select(*ID, F.col("ofi").alias("x"), F.col("label").cast("double").alias("y"), F.lit("ofi").alias("feature")), "feature")))
SWEEP = """g AS (SELECT a.*, round(p.prev_day_low, 9) AS prev_day_low, round(p.prev_week_low, 9) AS prev_week_low FROM atr a JOIN prev p USING (symbol, ts_event)),
gl AS (SELECT *, 'prev_day_low' AS level, prev_day_low AS lv FROM g UNION ALL SELECT *, 'prev_week_low', prev_week_low FROM g),
sw AS (SELECT symbol, ts_event, level, d AS depth, r AS reclaim FROM gl, (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) x(d), (VALUES (true), (false)) y(r) WHERE low < lv - d * atr AND (NOT r OR close > lv))"""
OUTCOME = """SELECT symbol, ts_event, {h} AS horizon, lead(close, {h}) OVER w / close - 1 AS r, (max(high) OVER {n} - close) / greatest(atr, 1e-9) AS up, (close - min(low) OVER {n}) / greatest(atr, 1e-9) AS dn,
  coalesce(list_position(list_transform(list(high) OVER {n}, lambda x: x >= close + atr), true), 0) AS won, coalesce(list_position(list_transform(list(low) OVER {n}, lambda x: x <= close - atr), true), 0) AS lost FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)"""
OUTCOMES = "oc AS (" + " UNION ALL ".join(OUTCOME.format(h=h, n=nxt(h)) for h in (4, 8)) + ")"
M19_SELECT = """SELECT level, depth, reclaim, horizon, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS bounce_rate, round(avg(r), 6) AS mean_ret, round(avg(up), 6) AS mean_up, round(avg(dn), 6) AS mean_down,
  round(avg(CASE WHEN won > 0 AND (lost = 0 OR won < lost) THEN 1.0 ELSE 0.0 END), 6) AS target_first_rate FROM sw JOIN oc USING (symbol, ts_event) WHERE r IS NOT NULL GROUP BY ALL"""


def swept(s, d):
    b = stage(W.previous_period_levels(atr_bars(s, d)))
    day, week = (L.sweep_events(b, c, (0.0, 0.5)).withColumn("level", F.lit(c)).select(*ID, "level", "depth", "reclaim") for c in ("prev_day_low", "prev_week_low"))
    return day.union(week)


query("m19_event_study", sql(*A, PREV, SWEEP, OUTCOMES, select=M19_SELECT))(lambda s, d: rounded(X.event_study(swept(s, d), X.event_outcomes(AB(s, d)))))
query("m19_event_study_null")(lambda s, d: rounded(X.event_study_null(swept(s, d), W.session_flags(bars(s, d)), X.event_outcomes(AB(s, d)))))
query("m20_zone_edges", sql(TICKS_SQL, BARS, f"z AS (SELECT {SESSION} AS session, lead(close, 4) OVER w / close - 1 AS r FROM bars {WINDOW})", select="SELECT session, count(*) AS n, round(avg(r - 0.0001), 6) AS long_net, round(avg(-r - 0.0001), 6) AS short_net FROM z WHERE r IS NOT NULL GROUP BY ALL"))(lambda s, d: rounded(X.zone_edges(W.session_flags(bars(s, d)), 4, 0.0001)))
query("m25_feature_transfer")(lambda s, d: rounded(X.best_partner(flow_bars(s, d), flow_bars(s, d), ["ofi", "volume"], ["buy_share", "n_trades", "cvd_delta"])))
query("m28_ic_decay_table", sql(*FA, pairs_sql(horizons=(1, 2, 4, 8)), ranks_sql("feature, horizon"), select="SELECT feature, horizon, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson FROM ic"))(lambda s, d: rounded(X.M.rank_correlation(X.M.long_pairs(rounded(flow_bars(s, d), 9), ["ofi", "volume"], [1, 2, 4, 8]), "feature", "horizon")))
query("m31_seasonal_accuracy", sql(*FA, ATR, LABELS, "z AS (SELECT CAST(isodow(ts_event) - 1 AS INTEGER) AS weekday, label, sign(cvd_delta) AS s FROM flow_bars JOIN labelled USING (symbol, ts_event) WHERE label <> 0)", select="SELECT weekday, count(*) AS n, round(avg(CASE WHEN label = s THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM z GROUP BY ALL"))(lambda s, d: rounded(flow_bars(s, d).join(labelled(s, d).select(*ID, "label"), ID).where("label <> 0").groupBy(F.weekday("ts_event").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.signum("cvd_delta")).cast("double")).alias("accuracy"))))
query("n2_liquidity_report", sql(BOOK_SQL, "t AS (SELECT symbol, count(*) AS n_ticks, avg(CASE WHEN action = 'T' THEN 1.0 ELSE 0.0 END) AS ts FROM ticks GROUP BY ALL)", "k AS (SELECT symbol, avg((ask_px[1] - bid_px[1]) / 0.01) AS sp, avg(len(list_filter(bid_sz, lambda x: x > 0))) AS fl FROM book GROUP BY ALL)", select="SELECT symbol, n_ticks, round(ts, 6) AS trade_share, round(sp, 6) AS spread_ticks, round(fl, 6) AS filled_levels FROM t JOIN k USING (symbol)"))(lambda s, d: rounded(X.book_shares(T(s, d), BK(s, d))))
N3 = f"""hr AS (
  SELECT symbol, b.ts_event, b.close, lead(b.close, 8) OVER w AS far, session_break, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n,
         sum(CAST(session_break AS INT)) OVER (PARTITION BY symbol ORDER BY b.ts_event ROWS BETWEEN 50 PRECEDING AND 24 FOLLOWING) AS br
  FROM brk b WINDOW w AS (PARTITION BY symbol ORDER BY b.ts_event)),
hc AS (
  SELECT 'nulls:close' AS "check", avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS value FROM hr
  UNION ALL SELECT 'nulls:far', avg(CASE WHEN far IS NULL THEN 1.0 ELSE 0.0 END) FROM hr UNION ALL SELECT 'nulls:absent', 1.0
  UNION ALL SELECT 'forbidden', 1.0 UNION ALL SELECT 'samples', CAST(count(*) FILTER (i > 50 AND i <= n - 24 AND br = 0) AS DOUBLE) FROM hr)"""
N3_SELECT = """SELECT "check", round(CAST(value AS DOUBLE), 6) AS value,
       CASE WHEN "check" = 'forbidden' THEN CASE WHEN value > 0 THEN 'fail' ELSE 'ok' END WHEN "check" = 'samples' THEN CASE WHEN value < 100 THEN 'fail' WHEN value < 1000 THEN 'warn' ELSE 'ok' END
            WHEN value > 0.05 THEN 'fail' WHEN value > 0.01 THEN 'warn' ELSE 'ok' END AS status FROM hc"""
query("n3_health_checks", sql(TICKS_SQL, BARS, BREAK.replace("3 * median", "5 * median"), N3, select=N3_SELECT))(
    lambda s, d: rounded(X.health(W.session_break_flag(bars(s, d), 5).withColumn("far", F.lead("close", 8).over(L.by_time())), ["close", "far", "absent"], ("far", "label")))
)
DUAL = (
    f"h AS (SELECT *, list(close) OVER {nxt(24)} AS x, greatest(atr, 1e-9) AS u FROM atr)",
    """e AS (
  SELECT *, list_filter(x, lambda v: v - close >= 1.5 * u OR v - close <= -u)[1] AS lo, list_filter(x, lambda v: -(v - close) >= 1.5 * u OR -(v - close) <= -u)[1] AS sh
  FROM h)""",
    f"z AS (SELECT {SESSION} AS session, atr, coalesce(lo - close >= 1.5 * u, false) AS lw, coalesce(-(sh - close) >= 1.5 * u, false) AS sw FROM e)",
)
O5_SELECT = """SELECT session, count(*) AS n, round(avg(CASE WHEN lw THEN 1.5 ELSE -1.0 END - 0.01 / greatest(atr, 1e-9)), 5) AS long_r,
       round(avg(CASE WHEN sw THEN 1.5 ELSE -1.0 END - 0.01 / greatest(atr, 1e-9)), 5) AS short_r
FROM z WHERE atr > 0.001 GROUP BY ALL"""
query("o5_zone_strategy_backtest", sql(*A, *DUAL, select=O5_SELECT))(lambda s, d: rounded(X.zone_strategy(L.dual_side_scan(W.session_flags(AB(s, d))).where("atr > 0.001")), 5))
query("o12_side_policy_stats", sql(*FA, ATR, LABELS, PREV, PLACE, f"z AS (SELECT {BUCKET} AS structure_bucket, round(ofi, 9) >= 0 AS long_side, greatest(abs(round(ofi, 9)), 0.01) AS w, label FROM pl JOIN labelled USING (symbol, ts_event) JOIN flow_bars USING (symbol, ts_event) WHERE label IS NOT NULL)", "q AS (SELECT structure_bucket, long_side, count(*) AS n, sum(CASE WHEN label * CASE WHEN long_side THEN 1 ELSE -1 END > 0 THEN w ELSE 0 END) / sum(w) AS win FROM z GROUP BY ALL)", select="SELECT structure_bucket, long_side, n, round(win, 6) AS win, round(2 * win - 1 - 0.05, 6) AS expectation FROM q"))(lambda s, d: rounded(X.side_policy(X.structure_bucket(rounded(W.previous_period_levels(flow_bars(s, d)), 9)).join(labelled(s, d).select(*ID, "label"), ID), 0.05)))
# name, priority, zone, level, event, direction, filters (column, above, threshold)
RULES = [
    ("asia_break", 3, "asia", "day_high", "above", 1, [("ofi", True, 0.0)]), ("asia_fade", 3, "asia", "day_high", "above", -1, []), ("asia_low", 1, "asia", "day_low", "inside", 1, [("ofi", True, -0.2), ("share", True, 0.3)]),
    ("london_any", 9, "london", "day_low", "inside", 1, []), ("london_flow", 2, "london", "day_high", "inside", -1, [("ofi", False, -0.1)]), ("london_low", 1, "london", "day_low", "below", -1, [("share", False, 0.5)]),
    ("ny_missing", 1, "ny", "day_low", "inside", 1, [("absent", True, 0.0)]), ("ny_high", 4, "ny", "day_high", "inside", 1, [("ofi", True, 0.3), ("share", True, 0.5)]), ("ny_low", 5, "ny", "day_low", "inside", -1, []),
]
RULES_SQL = ", ".join(f"('{r}', {p}, '{z}', '{lv}', '{e}', {x}, [" + ", ".join(f"{{'name': '{n}', 'above': {str(a).lower()}, 'threshold': CAST({t} AS DOUBLE)}}" for n, a, t in f) + "])" for r, p, z, lv, e, x, f in RULES if f)
PLAIN_SQL = ", ".join(f"('{r}', {p}, '{z}', '{lv}', '{e}', {x})" for r, p, z, lv, e, x, f in RULES if not f)
O14 = (
    f"rules AS (SELECT * FROM (VALUES {RULES_SQL}) v(rule, priority, zone, level, event, direction, filters) UNION ALL SELECT *, [] FROM (VALUES {PLAIN_SQL}) v(rule, priority, zone, level, event, direction))",
    f"""z AS (SELECT symbol, ts_event, {SESSION} AS zone, round(ofi, 9) AS ofi, round(buy_share, 9) AS share, close, prev_day_high AS h, prev_day_low AS l FROM flow_bars JOIN (SELECT symbol, ts_event, prev_day_high, prev_day_low FROM prev) USING (symbol, ts_event))""",
    """e AS (SELECT *, unnest([{'level': 'day_high', 'event': CASE WHEN close > h THEN 'above' ELSE 'inside' END}, {'level': 'day_low', 'event': CASE WHEN close < l THEN 'below' ELSE 'inside' END}]) AS x FROM z)""",
    """m AS (SELECT symbol, ts_event, ofi, arg_min({'rule': rule, 'direction': direction}, (priority, rule)) AS b FROM e JOIN rules r ON r.zone = e.zone AND r.level = e.x.level AND r.event = e.x.event
  WHERE len(list_filter(filters, lambda f: NOT coalesce(CASE WHEN f.above THEN CASE f.name WHEN 'ofi' THEN ofi WHEN 'share' THEN share END > f.threshold ELSE CASE f.name WHEN 'ofi' THEN ofi WHEN 'share' THEN share END <= f.threshold END, false))) = 0 GROUP BY ALL)""",
    "c AS (SELECT symbol, ts_event, b.rule AS rule, b.direction AS direction, CASE WHEN b.direction > 0 THEN (1 + ofi) / 2 ELSE (1 - ofi) / 2 END AS confidence FROM m)",
)


def ruled(s, d):
    b = rounded(W.previous_period_levels(W.session_flags(flow_bars(s, d))), 9).withColumn("share", F.col("buy_share"))
    event = lambda level, name, hit: F.struct(F.lit(level).alias("level"), F.when(hit, name).otherwise("inside").alias("event"))
    b = b.withColumn("events", F.array(event("day_high", "above", F.col("close") > F.col("prev_day_high")), event("day_low", "below", F.col("close") < F.col("prev_day_low"))))
    b = b.withColumns({"p_long": (1 + F.col("ofi")) / 2, "p_short": (1 - F.col("ofi")) / 2})
    return P.match_rules(b, s.createDataFrame(RULES, P.RULE), ["ofi", "share"], "session")


query("o14_rule_match_batch", sql(*FA, PREV, *O14, select="SELECT symbol, ts_event, rule, direction, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.55 THEN direction ELSE 0 END AS decision FROM c"))(lambda s, d: rounded(ruled(s, d)))
