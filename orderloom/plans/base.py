"""Tables that many queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.operators import bars as B
from orderloom.operators import labels as L
from orderloom.operators import windows as W
from orderloom.sources import market
from orderloom.sources.market import BOOK_SQL, CONTRACTS_SQL, TICKS_SQL
from orderloom.spec import rounded

__all__ = ["BOOK_SQL", "CONTRACTS_SQL", "TICKS_SQL"]


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.ohlcv_bars(market.ticks(spark, d))


def flow_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars with flow and range columns."""
    t = market.ticks(spark, d)
    return B.ohlcv_bars(t).join(B.bar_cvd(t), ["symbol", "ts_event"]).join(B.liquidity_bridge(t).select("symbol", "ts_event", "ofi", "buy_share"), ["symbol", "ts_event"])


def atr_bars(spark: SparkSession, d: str) -> DataFrame:
    return W.true_range_atr(bars(spark, d))


def stage(df: DataFrame) -> DataFrame:
    """ATR rounded, so that conditions on it agree between engines."""
    return rounded(df, 9)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return L.triple_barrier(stage(atr_bars(spark, d)))


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


BARS = """bars AS (
  SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, first(price ORDER BY t.ts_event, seq) AS open, max(price) AS high,
         min(price) AS low, last(price ORDER BY t.ts_event, seq) AS close, sum(size) AS volume, count(*) AS n_trades
  FROM ticks t WHERE action = 'T' GROUP BY ALL)"""
SIGNED = "CASE WHEN side = 'A' THEN size WHEN side = 'B' THEN -size ELSE 0 END"
FLOW = f"""cvd AS (
  SELECT *, sum(cvd_delta) OVER (PARTITION BY symbol ORDER BY ts_event) AS cvd, CAST(sign(cvd_delta) AS DOUBLE) AS cvd_sign
  FROM (SELECT symbol, date_trunc('hour', t.ts_event) AS ts_event, sum({SIGNED}) AS cvd_delta, avg({SIGNED}) AS cvd_velocity,
               avg(size) AS mean_size, avg(CASE WHEN side = 'A' THEN 1.0 ELSE 0.0 END) AS buy_share, count(*) AS trades,
               greatest(least(sum({SIGNED}) / greatest(sum(size), 1e-9), 1.0), -1.0) AS ofi
        FROM ticks t WHERE action = 'T' GROUP BY ALL))"""
FLOW_BARS = "flow_bars AS (SELECT b.*, c.cvd_delta, c.cvd_velocity, c.cvd, c.cvd_sign, c.ofi, c.buy_share FROM bars b JOIN cvd c USING (symbol, ts_event))"
ATR = """tr AS (
  SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)),
exact_tr AS (
  SELECT *, sum(CAST(round(tr * 1000000.0) AS BIGINT)) OVER w / (count(tr) OVER w * 1000000.0) AS mean_tr
  FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
atr AS (
  SELECT * EXCLUDE (mean_tr) REPLACE (round(tr, 9) AS tr, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close),
         round(mean_tr, 9) AS atr
  FROM exact_tr)"""
LABELS = """barriers AS (
  SELECT *, close + greatest(atr, 1e-6) AS up, close - greatest(atr, 1e-6) AS dn,
         list({'t': ts_event, 'o': open, 'h': high, 'l': low}) OVER (PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS nxt
  FROM atr),
touched AS (SELECT *, list_filter(nxt, lambda x: x.h >= up OR x.l <= dn)[1] AS hit FROM barriers),
labelled AS (
  SELECT * EXCLUDE (nxt, hit, up, dn),
         CASE WHEN coalesce(len(nxt), 0) = 0 THEN NULL WHEN hit IS NULL THEN 0
              WHEN hit.h >= up AND hit.l <= dn THEN CASE WHEN abs(up - hit.o) <= abs(hit.o - dn) THEN 1 ELSE -1 END
              WHEN hit.h >= up THEN 1 ELSE -1 END AS label,
         coalesce(hit.t, nxt[len(nxt)].t) AS label_end
  FROM touched)"""
WINDOW = "WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)"


def frame(n: int, back: int = 0) -> str:
    """An SQL frame of the n rows that end `back` rows before the current one."""
    end = f"{back} PRECEDING" if back else "CURRENT ROW"
    return f"(PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN {n - 1 + back} PRECEDING AND {end})"


def nxt(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts_event ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
