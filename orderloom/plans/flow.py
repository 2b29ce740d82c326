"""Queries: sources, cleaning, joins, bars (sections A to D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import bars as B
from orderloom.operators import clean as C
from orderloom.operators import joins as J
from orderloom.operators import windows as W
from orderloom.plans.base import ATR, BARS, BOOK_SQL, FLOW, SIGNED, TICKS_SQL, bars, frame, labelled, sql, stage
from orderloom.plans.base import LABELS as LABELS_SQL
from orderloom.plans.catalog import query
from orderloom.sources import market
from orderloom.sources.market import DIRTY_SQL
from orderloom.spec import rounded

T, BK = market.ticks, market.book


CLEAN_SQL = """ticks AS (
  SELECT * EXCLUDE n
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_event, seq ORDER BY ingest DESC) AS n FROM dirty WHERE price > 0 AND isfinite(price))
  WHERE n = 1)"""


@query("flagship_label_counts", sql(DIRTY_SQL.replace("ticks AS (", "feed AS (", 1).replace("FROM ticks", "FROM feed"), CLEAN_SQL, BARS, ATR, LABELS_SQL, select="SELECT symbol, label, count(*) AS n FROM labelled GROUP BY ALL"))
def flagship(spark, d):
    from orderloom.operators import labels as L

    t = C.sanitize_ticks(market.dirty_ticks(spark, d), "ingest")
    return L.triple_barrier(stage(W.true_range_atr(B.ohlcv_bars(t)))).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))


@query("a1_tick_source", sql(TICKS_SQL, select="SELECT symbol, action, count(*) AS n, CAST(sum(size) AS DOUBLE) AS size FROM ticks GROUP BY ALL"))
def a1(spark, d):
    return T(spark, d).groupBy("symbol", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("a2_book_source", sql(BOOK_SQL, select="SELECT symbol, ts_event, seq, bid_px[1] AS bid, ask_px[1] AS ask, bid_sz[1] AS bid_size FROM book"))
def a2(spark, d):
    return BK(spark, d).select("symbol", "ts_event", "seq", F.get("bid_px", F.lit(0)).alias("bid"), F.get("ask_px", F.lit(0)).alias("ask"), F.get("bid_sz", F.lit(0)).alias("bid_size"))


@query("a4_feature_table", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, close, CAST(0 AS DOUBLE) AS absent, volume FROM bars"))
def a4(spark, d):
    return market.feature_table_sink(bars(spark, d), ["close", "absent", "volume"], ["symbol", "ts_event"])


@query("a7_dataset_fingerprint", sql(TICKS_SQL, BARS, select="SELECT substr(sha256(concat_ws('|', 'ticks', count(*), '1 hour', 24, strftime(min(ts_event), '%Y-%m-%d %H:%M:%S'), strftime(max(ts_event), '%Y-%m-%d %H:%M:%S'))), 1, 16) AS fingerprint FROM bars"))
def a7(spark, d):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    text = F.concat_ws("|", F.lit("ticks"), F.count(F.lit(1)).cast("string"), F.lit("1 hour"), F.lit("24"), stamp(F.min("ts_event")), stamp(F.max("ts_event")))
    return bars(spark, d).agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


@query(
    "b1_sanitize_ticks",
    sql(
        DIRTY_SQL,
        select="""SELECT * EXCLUDE n
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_event, seq ORDER BY ingest DESC) AS n FROM dirty WHERE price > 0 AND isfinite(price))
WHERE n = 1""",
    ),
)
def b1(spark, d):
    return C.sanitize_ticks(market.dirty_ticks(spark, d), "ingest")


@query("b2_sanitize_book", sql(BOOK_SQL, select="SELECT symbol, ts_event, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_event ORDER BY seq DESC) AS n FROM book WHERE NOT ask_px[1] < bid_px[1]) WHERE n = 1"))
def b2(spark, d):
    return C.sanitize_book(BK(spark, d)).select("symbol", "ts_event", "seq")


B3 = (
    DIRTY_SQL,
    """ruled AS (
  SELECT *, CASE WHEN ts_event IS NULL OR price IS NULL OR action IS NULL THEN 'null_or_inf'
                 WHEN NOT price BETWEEN 100.05 AND 100.9 THEN 'price_range'
                 WHEN action NOT IN ('T', 'A', 'C', 'M', 'F', 'R', 'B', 'N', 'X') THEN 'action'
                 WHEN side NOT IN ('A', 'B', 'N', '') THEN 'side'
                 WHEN NOT (size > 0 OR action IN ('C', 'R', 'X') AND size >= 0) THEN 'size' END AS own
  FROM dirty)""",
    "top AS (SELECT symbol FROM ruled WHERE own IS NULL GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1)",
    "left1 AS (SELECT * REPLACE (coalesce(own, CASE WHEN symbol <> (SELECT symbol FROM top) THEN 'symbol' END) AS own) FROM ruled)",
    """left2 AS (
  SELECT *, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY own IS NULL, ts_event, order_id, action ORDER BY seq, ingest) > 1 THEN 'duplicate' END) AS rule
  FROM left1)""",
)


@query("b3_clean_ticks_audit", sql(*B3, select="SELECT rule, count(*) AS removed FROM left2 WHERE rule IS NOT NULL GROUP BY rule"))
def b3(spark, d):
    return C.clean_ticks_audited(market.dirty_ticks(spark, d), 100.05, 100.9)[1]


B3_ROWS = """SELECT seq, ingest, coalesce(epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER (PARTITION BY symbol ORDER BY ts_event, seq) > 3600000000, false) AS feed_gap
FROM left2 WHERE rule IS NULL"""


@query("b3_clean_ticks", sql(*B3, select=B3_ROWS))
def b3_rows(spark, d):
    return C.clean_ticks_audited(market.dirty_ticks(spark, d), 100.05, 100.9)[0].select("seq", "ingest", "feed_gap")


@query("b4_flag_crossed_book", sql(BOOK_SQL, select="SELECT seq, bid_px[1] - ask_px[1] > 0 AS is_crossed_book FROM book WHERE NOT bid_px[1] - ask_px[1] > 1"))
def b4(spark, d):
    return C.flag_crossed_book(BK(spark, d)).select("seq", "is_crossed_book")


@query("b5_flag_level_disorder", sql(BOOK_SQL, select="SELECT seq, len(list_filter(range(1, 10), lambda i: bid_px[i] < bid_px[i + 1] OR ask_px[i] > ask_px[i + 1])) > 0 AS level_disorder FROM book"))
def b5(spark, d):
    return C.flag_level_disorder(BK(spark, d)).select("seq", "level_disorder")


@query("b6_flag_feed_gap", sql(TICKS_SQL, select="SELECT seq, coalesce(epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER (PARTITION BY symbol ORDER BY ts_event, seq) > 1800 * 1000000, false) AS feed_gap FROM ticks"))
def b6(spark, d):
    return C.flag_feed_gap(T(spark, d), 1800).select("seq", "feed_gap")


@query("b7_dominant_symbol", sql(TICKS_SQL, select="SELECT seq FROM ticks WHERE symbol = (SELECT symbol FROM ticks GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1)"))
def b7(spark, d):
    return C.dominant_symbol_filter(T(spark, d)).select("seq")


@query("b8_drop_extreme_bars", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event FROM bars WHERE abs(close - open) / abs(open) <= 0.002"))
def b8(spark, d):
    return C.drop_extreme_bars(bars(spark, d), 0.002).select("symbol", "ts_event")


@query("b10_clean_bar_moves", sql(TICKS_SQL, BARS, "m AS (SELECT *, coalesce(abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_event) - 1) * 100 > 0.3, false) AS was_bad FROM bars)", select="SELECT symbol, ts_event, was_bad, last_value(CASE WHEN NOT was_bad THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_event) AS close FROM m"))
def b10(spark, d):
    return C.clean_bar_moves(bars(spark, d), 0.3).select("symbol", "ts_event", "was_bad", "close")


@query("b9_repair_ohlc")
def b9(spark, d):
    return rounded(C.repair_ohlc(bars(spark, d), 100.0, 101.5).select("symbol", "ts_event", "open", "high", "low", "close"))


@query("b11_clip_outliers", sql(TICKS_SQL, BARS, "q AS (SELECT quantile_cont(volume, 0.99) AS lim FROM bars)", select="SELECT symbol, ts_event, round(least(volume, lim), 6) AS volume, least(greatest(close, 100.1), 100.5) AS close FROM bars, q"))
def b11(spark, d):
    return rounded(C.clip_feature_outliers(bars(spark, d), {"close": (100.1, 100.5)}, "volume").select("symbol", "ts_event", "volume", "close"))


@query("b12_session_time_mask", sql(TICKS_SQL, select="SELECT seq, (hour(ts_event) * 60 + minute(ts_event) >= 1320 OR hour(ts_event) * 60 + minute(ts_event) < 150) AS in_session FROM ticks"))
def b12(spark, d):
    return C.session_time_mask(T(spark, d), "22:00", "02:30").select("seq", "in_session")


@query("b13_time_range_slice", sql(TICKS_SQL, select="SELECT seq FROM ticks WHERE ts_event >= TIMESTAMP '2024-01-05' AND ts_event < TIMESTAMP '2024-01-09 12:00:00'"))
def b13(spark, d):
    return C.time_range_slice(T(spark, d), "2024-01-05", "2024-01-09 12:00:00").select("seq")


@query("c1_asof_backward_join", sql(BOOK_SQL, "l AS (SELECT * FROM ticks WHERE action = 'T')", "r AS (SELECT * FROM ticks WHERE action = 'A')", select="SELECT l.seq, CASE WHEN epoch_us(l.ts_event) - epoch_us(r.ts_event) <= 600 * 1000000 THEN r.price END AS right_price FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts_event >= r.ts_event"))
def c1(spark, d):
    t = T(spark, d)
    return J.asof_backward_join(t.where("action = 'T'"), t.where("action = 'A'"), ["price"], 600).select("seq", "right_price")


@query("c2_bar_range_join", sql(TICKS_SQL, BARS, select="SELECT t.seq, b.close FROM ticks t JOIN bars b ON t.symbol = b.symbol AND t.ts_event >= b.ts_event AND t.ts_event < b.ts_event + INTERVAL 1 HOUR"))
def c2(spark, d):
    return J.bar_range_join(T(spark, d), bars(spark, d)).select("seq", "close")


@query("c3_map_lookup_join", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, max(high) OVER d AS day_high, min(low) OVER d AS day_low FROM bars WINDOW d AS (PARTITION BY symbol, CAST(ts_event AS DATE))"))
def c3(spark, d):
    return J.map_lookup_join(bars(spark, d)).select("symbol", "ts_event", "day_high", "day_low")


ALL_BARS = "other AS (SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, last(price ORDER BY t.ts_event, seq) AS close, sum(size) AS volume FROM ticks t WHERE action IN ('T', 'A') GROUP BY ALL)"


@query("c4_bars_aligned_compare", sql(TICKS_SQL, BARS, ALL_BARS, select="SELECT count(*) FILTER (o.close IS NULL) AS only_a, count(*) FILTER (b.close IS NULL) AS only_b, count(*) FILTER (abs(b.close - o.close) > 0.01) AS price_apart, count(*) FILTER (abs(b.volume - o.volume) > 1) AS volume_apart FROM bars b FULL JOIN other o USING (symbol, ts_event)"))
def c4(spark, d):
    t = T(spark, d)
    other = B.ohlcv_bars(t.withColumn("action", F.when(F.col("action") == "A", "T").otherwise(F.col("action"))))
    return J.bars_aligned_compare(bars(spark, d), other, 0.01, 1)


@query("c6_theta_barrier_join", sql(TICKS_SQL, BARS, "n AS (SELECT *, list(high) OVER (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS x FROM bars)", select="SELECT symbol, ts_event, CAST(list_position(list_transform(x, lambda h: h >= close + 0.2), true) AS BIGINT) AS hit_step FROM n"))
def c6(spark, d):
    return J.theta_barrier_join(bars(spark, d), 8, 0.2).select("symbol", "ts_event", F.col("hit_step").cast("bigint"))


@query("c8_embedding_attach", "SELECT event_id, e.embedding IS NOT NULL AS valid, coalesce(len(e.embedding), 0) AS width FROM events v LEFT JOIN embeddings e ON v.event_id = e.vec_id")
def c8(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    v = spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "event_id")
    return J.embedding_attach(e, v, "event_id").select("event_id", "valid", F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint").alias("width")).withColumn("width", F.greatest("width", F.lit(0)))


@query("c7_null_sample_join")
def c7(spark, d):
    b = W.session_flags(bars(spark, d))
    return J.null_sample_join(b.where("volume > 400").select("symbol", "ts_event", "session"), b, "session", 3)


@query("d1_ohlcv_bars", sql(TICKS_SQL, BARS, select="SELECT * FROM bars"))
def d1(spark, d):
    return bars(spark, d)


@query("d2_tick_to_bar_features", sql(TICKS_SQL, select="SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, last(price ORDER BY t.ts_event, seq) AS price_last, max(size) AS size_max, round(stddev_samp(order_id), 6) AS order_id_std, round(avg(seq), 6) AS seq_mean FROM ticks t GROUP BY ALL"))
def d2(spark, d):
    return rounded(B.tick_to_bar_features(T(spark, d), {"price": "last", "size": "max", "order_id": "std", "seq": "mean"}))


@query("d3_signed_flow_cvd", sql(TICKS_SQL, FLOW, select="SELECT symbol, ts_event, cvd_delta, round(cvd_velocity, 6) AS cvd_velocity, cvd, cvd_sign FROM cvd"))
def d3(spark, d):
    return rounded(B.bar_cvd(T(spark, d)))


@query("d4_session_cvd", sql(TICKS_SQL, FLOW, select="SELECT symbol, ts_event, cvd_delta, sum(cvd_delta) OVER (PARTITION BY symbol, CAST(ts_event AS DATE) ORDER BY ts_event) AS session_cvd FROM cvd"))
def d4(spark, d):
    return B.session_cvd(T(spark, d))


def d5_sql(source: str, buy: str, sell: str) -> str:
    return f"""SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, sum(size) AS volume, sum(CASE WHEN {buy} THEN size ELSE 0 END) AS buy_volume,
       sum(CASE WHEN {sell} THEN size ELSE 0 END) AS sell_volume,
       round(sum(CASE WHEN {buy} THEN size ELSE 0 END) / greatest(sum(CASE WHEN {buy} OR {sell} THEN size ELSE 0 END), 1.0), 6) AS buy_ratio
FROM {source} t WHERE action = 'T' GROUP BY ALL"""


@query("d5_buy_sell_volume", sql(TICKS_SQL, select=d5_sql("ticks", "side = 'A'", "side = 'B'")))
def d5(spark, d):
    return rounded(B.buy_sell_volume(T(spark, d)))


@query("d5_volume_by_imbalance", sql(BOOK_SQL, select=d5_sql("book", "bid_sz[1] > ask_sz[1]", "bid_sz[1] < ask_sz[1]")))
def d5_imbalance(spark, d):
    """A feed without sides: the book's imbalance decides."""
    t = BK(spark, d).withColumns({"side": F.lit("N"), "net": F.lit(0.0), "obi": F.get("bid_sz", F.lit(0)) - F.get("ask_sz", F.lit(0))})
    return rounded(B.buy_sell_volume(t, net="net", imbalance="obi"))


D5_RULE = "pt AS (SELECT *, coalesce(price < lag(price) OVER (PARTITION BY symbol ORDER BY ts_event, seq), false) AS down FROM ticks WHERE action = 'T')"


@query("d5_volume_by_tick_rule", sql(TICKS_SQL, D5_RULE, select=d5_sql("pt", "NOT down", "down")))
def d5_rule(spark, d):
    return rounded(B.buy_sell_volume(T(spark, d).withColumn("side", F.lit("N"))))


@query("d6_bar_vwap", sql(TICKS_SQL, select="SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, round(sum(price * size) / greatest(sum(size), 1e-9), 6) AS micro_price FROM ticks t WHERE action = 'T' GROUP BY ALL"))
def d6(spark, d):
    return rounded(B.bar_vwap(T(spark, d)))


@query("d7_imbalance_reversals", sql(TICKS_SQL, f"s AS (SELECT symbol, date_trunc('hour', ts_event) AS b, sign({SIGNED}) AS s, lag(sign({SIGNED})) OVER (PARTITION BY symbol, date_trunc('hour', ts_event) ORDER BY ts_event, seq) AS p FROM ticks WHERE action = 'T')", select="SELECT symbol, b AS ts_event, count(*) FILTER (s <> p) AS reversals FROM s GROUP BY ALL"))
def d7(spark, d):
    return B.imbalance_reversals(T(spark, d))


@query("d8_cancel_volume_ratio", sql(TICKS_SQL, select="SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, round(count(*) FILTER (action = 'C') / count(*), 6) AS cancel_ratio FROM ticks t GROUP BY ALL"))
def d8(spark, d):
    return rounded(B.cancel_volume_ratio(T(spark, d)))


D9 = "sp AS (SELECT symbol, date_trunc('hour', k.ts_event) AS ts_event, avg(ask_px[1] - bid_px[1]) AS mean_spread FROM book k WHERE ask_px[1] >= bid_px[1] GROUP BY ALL)"
D9_SELECT = """SELECT symbol, ts_event, trades, round(mean_size, 6) AS mean_size, round(buy_share, 6) AS buy_share, round(ofi, 6) AS ofi, round(mean_spread, 6) AS mean_spread
FROM cvd LEFT JOIN sp USING (symbol, ts_event)"""


@query("d9_liquidity_bridge", sql(BOOK_SQL, FLOW, D9, select=D9_SELECT))
def d9(spark, d):
    return rounded(B.liquidity_bridge(T(spark, d), book=BK(spark, d)))


@query("d10_flow_proxy", sql(TICKS_SQL, FLOW, select=f"SELECT symbol, ts_event, round(greatest(least(cvd_delta / greatest(3 * quantile_cont(abs(cvd_delta), 0.5) OVER {frame(24)}, 1e-9), 1.0), -1.0), 6) AS flow_proxy FROM cvd"))
def d10(spark, d):
    return rounded(B.flow_proxy(B.bar_cvd(T(spark, d))).select("symbol", "ts_event", "flow_proxy"))


@query("d11_tick_coverage", sql(TICKS_SQL, "c AS (SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, count(*) AS n_ticks FROM ticks t GROUP BY ALL)", select=f"SELECT symbol, ts_event, n_ticks, round(CASE WHEN count(*) OVER {frame(50)} >= 20 THEN least(n_ticks / greatest(quantile_cont(n_ticks, 0.5) OVER {frame(50)}, 1.0), 1.0) ELSE 1.0 END, 6) AS coverage FROM c"))
def d11(spark, d):
    return rounded(B.tick_coverage(T(spark, d)))


@query("d12_book_coverage", sql(BOOK_SQL, BARS, "n AS (SELECT symbol, date_trunc('hour', k.ts_event) AS ts_event, count(*) AS n FROM book k GROUP BY ALL)", select="SELECT symbol, ts_event, least(coalesce(n, 0) / 10, 1.0) AS book_coverage FROM bars LEFT JOIN n USING (symbol, ts_event)"))
def d12(spark, d):
    return B.book_coverage(bars(spark, d), BK(spark, d))


@query("d15_downsample_bars", sql(TICKS_SQL, BARS, "i AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY ts_event) - 1) / 4) AS BIGINT) AS idx FROM bars)", select="SELECT symbol, idx, min(i.ts_event) AS ts_event, first(open ORDER BY i.ts_event) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY i.ts_event) AS close, sum(volume) AS volume FROM i GROUP BY symbol, idx"))
def d15(spark, d):
    return B.downsample_bars(bars(spark, d), 4)


@query("d16_partial_bar_merge", sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, open, high, low, close, volume FROM bars"))
def d16(spark, d):
    t = T(spark, d)
    parts = None
    for k, cond in enumerate(("minute(ts_event) < 30", "minute(ts_event) >= 30")):
        p = B.ohlcv_bars(t.where(cond)).withColumn("part", F.lit(k))
        parts = p if parts is None else parts.unionByName(p)
    return B.merge_partial_bars(parts)


D17 = (
    "vx AS (SELECT symbol, date_trunc('day', x.ts_event) AS ts_event, label, CASE WHEN volume > 100 THEN 2 ELSE 1 END AS quality, CASE WHEN atr > 0.3 THEN 1 ELSE 0 END AS regime FROM labelled x WHERE label IS NOT NULL)",
    "v AS (SELECT symbol, ts_event, count(*) AS n, count(*) FILTER (label = 1) AS up, count(*) FILTER (label = -1) AS down, max(quality) AS quality FROM vx GROUP BY ALL)",
    "vc AS (SELECT symbol, ts_event, regime, count(*) AS c FROM vx GROUP BY ALL)",
    "vr AS (SELECT symbol, ts_event, regime FROM vc QUALIFY row_number() OVER (PARTITION BY symbol, ts_event ORDER BY c DESC, regime) = 1)",
)
D17_SELECT = "SELECT *, CASE WHEN up >= down AND up / n >= 0.35 THEN 1 WHEN down > up AND down / n >= 0.35 THEN -1 ELSE 0 END AS vote FROM v JOIN vr USING (symbol, ts_event)"


@query("d17_refined_bar_vote", sql(TICKS_SQL, BARS, ATR, LABELS_SQL, *D17, select=D17_SELECT))
def d17(spark, d):
    x = labelled(spark, d).where("label is not null").withColumns({
        "ts_event": F.date_trunc("day", "ts_event").cast("timestamp_ntz"), "quality": F.when(F.col("volume") > 100, 2).otherwise(1), "regime": F.when(F.col("atr") > 0.3, 1).otherwise(0),
    })
    return B.refined_bar_vote(x, quality="quality", regime="regime")


@query("d18_session_table", sql(TICKS_SQL, BARS, select="SELECT symbol, CAST(b.ts_event AS DATE) AS day, count(*) AS n_bars, round(last(close ORDER BY b.ts_event) / first(open ORDER BY b.ts_event) - 1, 6) AS ret, sum(volume) AS volume FROM bars b GROUP BY ALL HAVING count(*) >= 3"))
def d18(spark, d):
    return rounded(B.session_table(bars(spark, d), ["volume"]))


SESSION = "CASE WHEN hour(ts_event) >= 13 AND hour(ts_event) < 16 THEN 'overlap' WHEN hour(ts_event) >= 13 AND hour(ts_event) < 22 THEN 'ny' WHEN hour(ts_event) >= 7 AND hour(ts_event) < 16 THEN 'london' WHEN hour(ts_event) < 8 THEN 'asia' ELSE 'off' END"


@query("d19_zone_grouping_sets", sql(TICKS_SQL, BARS, f"z AS (SELECT *, {SESSION} AS session, hour(ts_event) AS hour, close - open AS move FROM bars)", select="SELECT session, CAST(hour AS INTEGER) AS hour, CAST(grouping_id(session, hour) AS BIGINT) AS level, count(*) AS n, round(avg(move), 6) AS mean_value, round(avg(CASE WHEN move > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM z GROUP BY GROUPING SETS ((), (session), (hour), (session, hour))"))
def d19(spark, d):
    z = bars(spark, d).select(W.session_name().alias("session"), F.hour("ts_event").alias("hour"), (F.col("close") - F.col("open")).alias("move"))
    return rounded(B.grouping_metrics(z, "move", "session", "hour"))


@query("d20_distinct_counts", sql(TICKS_SQL, "c AS (SELECT 'side' AS \"column\", side AS v, count(*) AS n FROM ticks GROUP BY ALL UNION ALL SELECT 'action', action, count(*) FROM ticks GROUP BY ALL UNION ALL SELECT 'order_id', CAST(order_id AS VARCHAR), count(*) FROM ticks GROUP BY ALL)", select="SELECT \"column\", count(*) AS n_distinct, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY ALL"))
def d20(spark, d):
    return rounded(B.distinct_counts(T(spark, d), ["side", "action", "order_id"]))


@query("d21_weighted_mean", sql(TICKS_SQL, select="SELECT symbol, side, round(sum(price * size) / sum(size), 6) AS weighted_mean FROM ticks GROUP BY ALL"))
def d21(spark, d):
    return rounded(B.weighted_mean(T(spark, d), "price", "size", "symbol", "side"))


@query("d22_contingency_table", sql(TICKS_SQL, select="SELECT action, side, count(*) AS n FROM ticks GROUP BY ALL"))
def d22(spark, d):
    return B.contingency_table(T(spark, d), "action", "side")


