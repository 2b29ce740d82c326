"""Queries: streaming operators (P), run over the events in order of time, in a few micro-batches."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from orderloom.functions.stage import folder
from orderloom.plans.base import BARS, BOOK_SQL, FLOW, TICKS_SQL, sql
from orderloom.plans.catalog import query
from orderloom.sources import market
from orderloom.spec import rounded
from orderloom.plans.features import FEED, FEED_SELECT
from orderloom.streaming import jobs, stateful

PARTS = 3
#: Rows of a part for the jobs that hold a symbol's rows of a micro-batch.
PART_ROWS = 4_000_000
#: Bits of a time that one pass over the times looks at.
BITS = 12


def time_cuts(df, parts, within=0):
    """The times, in microseconds, that cut the rows into equal parts: interpolated percentiles as F.percentile gives them.

    No task holds the times: they are counted by their leading bits, a few thousand counts a cut, then by the next bits among those
    that share a cut's leading ones, down to single microseconds. within: a cut may be the end of a range of at most so many rows.
    """
    x = df.select(F.unix_micros(F.col("ts_event").cast("timestamp")).alias("us"))
    low, high, n = x.agg(F.min("us"), F.max("us"), F.count("us")).first()
    if not n:
        return [0.0] * (parts - 1)
    since = F.col("us") - F.lit(low)
    places = [(n - 1) * (i / parts) for i in range(1, parts)]
    wanted = {k: (0, k) for p in places for k in (math.floor(p), math.ceil(p))}  # place: leading bits of its time, rank among the times that share them
    found, shift = {}, -(-(high - low).bit_length() // BITS) * BITS
    while wanted and shift:
        shift -= BITS
        some = x.where(F.shiftright(since, shift + BITS).isin([p for p, _ in wanted.values()]))
        ranges = {}
        for lead, rows in sorted(map(tuple, some.groupBy(F.shiftright(since, shift)).count().collect())):
            ranges.setdefault(lead >> BITS, []).append((lead, rows))
        for k, (lead, rank) in list(wanted.items()):
            for deeper, rows in ranges[lead]:
                if rank < rows:
                    break
                rank -= rows
            wanted[k] = deeper, rank
            if rows <= within:
                found[k] = low + ((deeper + 1) << shift) - 1
                del wanted[k]
    found |= {k: low + lead for k, (lead, _) in wanted.items()}
    at = [(p, float(found[math.floor(p)]), float(found[math.ceil(p)])) for p in places]
    return [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in at]


def in_parts(df, parts=PARTS, within=0):
    """The rows in a few parts of ascending time."""
    at = F.unix_micros(F.col("ts_event").cast("timestamp"))
    edges = [None, *time_cuts(df, parts, within), None]
    return [df.where(F.lit(True) if a is None else at > a).where(F.lit(True) if b is None else at <= b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def parts_of(df):
    """Parts enough that none has many more than PART_ROWS rows."""
    return in_parts(df, max(PARTS, -(-df.count() // PART_ROWS)), PART_ROWS // 16)


def streamed(spark, d, job, rocksdb=False):
    ticks = market.ticks(spark, d)
    return jobs.replay(parts_of(ticks) if rocksdb else in_parts(ticks), job, f"{folder(spark)}/orderloom-{uuid.uuid4().hex}", rocksdb)


def plain(df, *times):
    """Zoned times back to plain ones (the session is in UTC)."""
    for c in times:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


# A bar comes out once the watermark (latest time less ten minutes) has passed its end; the last micro-batch sees all of it.
CLOSED = "WHERE ts_event + INTERVAL 1 HOUR <= (SELECT max(ts_event) - INTERVAL 10 MINUTE FROM ticks)"
query("p1_streaming_bars", sql(TICKS_SQL, BARS, FLOW, select=f"SELECT symbol, ts_event, open, high, low, close, volume, cvd_delta FROM bars JOIN cvd USING (symbol, ts_event) {CLOSED}"))(lambda s, d: plain(streamed(s, d, jobs.streaming_bars), "ts_event"))
query("p3_stateful_flow_features", f"WITH RECURSIVE {FEED}{FEED_SELECT}")(lambda s, d: rounded(plain(streamed(s, d, stateful.flow_features, rocksdb=True), "ts_event").withColumn("burst", F.least("burst", F.lit(1e6))), 7))


LARGE = 90


def large_trades():
    """1 for large purchases, -1 for large sales, 0 for other rows."""
    return F.when((F.col("action") == "T") & (F.col("size") >= LARGE), F.when(F.col("side") == "A", 1).when(F.col("side") == "B", -1)).otherwise(0)


P4 = (
    "lv AS (SELECT *, 1.5 * (list_sum(bid_sz) + list_sum(ask_sz)) / 20 AS w FROM book)",
    """wa AS (SELECT *, greatest(CASE WHEN a > 0 THEN a ELSE 10.0 END, 3.0) * 0.01 AS up, least(CASE WHEN b > 0 THEN b + 1.0 ELSE 12.0 END, 30.0) * 0.01 AS down
  FROM (SELECT *, coalesce(list_position(list_transform(ask_sz, lambda x: x >= w), true), 0) AS a, coalesce(list_position(list_transform(bid_sz, lambda x: x >= w), true), 0) AS b FROM lv))""",
    f"""sg AS (SELECT symbol, ts_event AS opened, seq, price AS entry, CASE WHEN side = 'A' THEN 1 ELSE -1 END AS dir, up, down,
  row_number() OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS trade_no FROM wa WHERE action = 'T' AND size >= {LARGE} AND side IN ('A', 'B'))""",
    "sl AS (SELECT *, entry + dir * up AS target, entry - dir * down AS stop, opened + INTERVAL 6 HOUR AS over FROM sg)",
    """hi AS (SELECT s.symbol, s.trade_no, arg_min({'t': b.ts_event, 'q': b.seq, 'w': dir * b.price >= dir * target}, (b.ts_event, b.seq)) AS h
  FROM sl s JOIN book b ON b.symbol = s.symbol AND b.ts_event > opened AND b.ts_event <= over AND (dir * b.price >= dir * target OR dir * b.price <= dir * stop) GROUP BY ALL)""",
    "ends AS (SELECT symbol, max(ts_event) AS last FROM book GROUP BY ALL)",
    """cl AS (SELECT s.*, h, coalesce(h.t, over) AS closed, CASE WHEN h IS NULL THEN 'timeout' WHEN h.w THEN 'target' ELSE 'stop' END AS reason
  FROM sl s LEFT JOIN hi USING (symbol, trade_no) JOIN ends USING (symbol)
  WHERE h IS NOT NULL OR last > over OR over <= (SELECT max(ts_event) - INTERVAL 10 MINUTE FROM book))""",
    """ex AS (SELECT c.symbol, c.trade_no, max(b.price) AS hi, min(b.price) AS lo, arg_max(b.price, (b.ts_event, b.seq)) AS last_px
  FROM cl c JOIN book b ON b.symbol = c.symbol AND (b.ts_event > opened AND (h IS NULL AND b.ts_event <= over OR h IS NOT NULL AND (b.ts_event, b.seq) <= (h.t, h.q))) GROUP BY ALL)""",
    """tr AS (SELECT c.*, greatest(coalesce(hi, entry), entry) AS hi, least(coalesce(lo, entry), entry) AS lo,
  CASE reason WHEN 'target' THEN target WHEN 'stop' THEN stop ELSE coalesce(last_px, entry) END AS out_px FROM cl c LEFT JOIN ex USING (symbol, trade_no))""",
    "fi AS (SELECT *, dir * (out_px - entry) AS pnl FROM tr)",
)
P4_SELECT = """SELECT symbol, trade_no, opened, closed, CAST(dir AS INT) AS direction, round(entry, 6) AS entry, round(out_px, 6) AS exit, reason,
  round(CASE WHEN dir > 0 THEN hi - entry ELSE entry - lo END, 6) AS favourable, round(CASE WHEN dir > 0 THEN entry - lo ELSE hi - entry END, 6) AS adverse,
  round(pnl, 6) AS pnl, count(*) OVER w AS closed_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS win_rate
FROM fi WINDOW w AS (PARTITION BY symbol ORDER BY closed, reason = 'timeout', trade_no)"""


@query("p4_virtual_trade_tracker", sql(BOOK_SQL, *P4, select=P4_SELECT))
def p4(spark, d):
    job = lambda b: stateful.tracked_trades(b, large_trades())
    levels = {c: F.when(large_trades() != 0, F.col(c)) for c in ("bid_sz", "ask_sz")}  # only a signal's own snapshot is looked at
    out = jobs.replay(parts_of(market.book(spark, d).drop("bid_px", "ask_px").withColumns(levels)), job, f"{folder(spark)}/orderloom-{uuid.uuid4().hex}", rocksdb=True)
    return rounded(plain(out, "opened", "closed"))


P8 = (
    "ce AS (SELECT quantile_cont(epoch_us(ts_event), 1.0 / 3) AS c FROM ticks)",
    "wm AS (SELECT date_trunc('millisecond', max(ts_event)) - INTERVAL 10 MINUTE AS w FROM ticks, ce WHERE epoch_us(ts_event) <= c AND seq % 11 <> 0)",
)


def with_faults(parts):
    """A feed with faults: a part of the first rows comes with the second batch only, and others come again with it."""
    held, seen = parts[0].where("seq % 11 = 0"), parts[0].where("seq % 11 <> 0")
    return [seen, parts[1].union(held).union(seen.where("seq % 7 = 0")), *parts[2:]]


@query("p8_late_and_duplicate_ticks", sql(TICKS_SQL, *P8, select="SELECT symbol, seq, ts_event, price FROM ticks, ce, wm WHERE NOT (epoch_us(ts_event) <= c AND seq % 11 = 0 AND ts_event <= w)"))
def p8(spark, d):
    """Rows that came too late are gone, rows that came again are there once."""
    parts = with_faults(in_parts(market.ticks(spark, d)))
    out = jobs.replay(parts, jobs.late_and_duplicate_ticks, f"{folder(spark)}/orderloom-{uuid.uuid4().hex}")
    return plain(out, "ts_event").select("symbol", "seq", "ts_event", "price")


query(
    "p9_session_windows",
    sql(TICKS_SQL, "g AS (SELECT *, CASE WHEN ts_event > lag(ts_event) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_event, seq))", "k AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS k FROM g)", "x AS (SELECT symbol, k, min(ts_event) AS session_start, max(ts_event) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_ticks, sum(size) AS size FROM k GROUP BY ALL)", select="SELECT symbol, session_start, session_end, n_ticks, size FROM x WHERE session_end <= (SELECT max(ts_event) - INTERVAL 10 MINUTE FROM ticks)"),
)(lambda s, d: plain(streamed(s, d, jobs.session_windows), "session_start", "session_end"))


@query(
    "p7_drift_monitor_stream",
    sql(TICKS_SQL, "b AS (SELECT symbol, avg(size) AS bm, stddev_samp(size) AS bs FROM ticks WHERE action = 'T' GROUP BY ALL)", "w AS (SELECT symbol, time_bucket(INTERVAL 3 HOUR, ts_event) - k * INTERVAL 3 HOUR AS s, size FROM ticks, (VALUES (0), (1)) v(k) WHERE action = 'T')", "m AS (SELECT symbol, s, avg(size) AS m FROM w GROUP BY ALL)", select="SELECT symbol, s AS ts_event, round(m, 6) AS mean_size, round(abs(m - bm) / greatest(bs, 1e-9), 6) AS drift FROM m JOIN b USING (symbol) WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts_event) - INTERVAL 10 MINUTE FROM ticks)"),
)
def p7(spark, d):
    base = market.ticks(spark, d).where("action = 'T'").groupBy("symbol").agg(F.avg("size").alias("base_mean"), F.stddev_samp("size").alias("base_std"))
    return rounded(plain(streamed(spark, d, lambda t: jobs.drift_monitor(t, base)), "ts_event"))


@query(
    "p2_streaming_event_gate",
    sql(TICKS_SQL, BARS, select="SELECT symbol, ts_event, volume, CAST(coalesce(volume > 2.0 * avg(volume) OVER (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS INTEGER) AS activity_event FROM bars"),
)
def p2(spark, d):
    from orderloom.operators.bars import ohlcv_bars

    b = ohlcv_bars(market.ticks(spark, d)).select("symbol", "ts_event", "volume")
    return plain(jobs.replay(in_parts(b), jobs.activity_gate, f"{folder(spark)}/orderloom-{uuid.uuid4().hex}"), "ts_event")
