"""Names, vocabularies and window helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY, TS = "symbol", "ts_event"
# Action codes that are trades, and the side codes of buying and selling aggressors.
TRADE_ACTIONS = ("T", "F", "TRADE", "EXECUTE", "E", "0")
BUY_SIDES = ("A", "ASK", "BUY", "BOT")
SELL_SIDES = ("B", "BID", "S", "SELL")
CANCEL_ACTIONS = ("C", "CANCEL", "D", "DELETE", "R")
# Session hours in UTC, end exclusive.
SESSIONS = {"asia": (0, 8), "london": (7, 16), "ny": (13, 22), "overlap": (13, 16)}


def by_time(*order: str, key: str = KEY, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts, *order)


def trailing(n: int, *, back: int = 0, key: str = KEY, ts: str = TS) -> WindowSpec:
    """The n rows that end `back` rows before the current one (0: at it)."""
    return by_time(key=key, ts=ts).rowsBetween(-(n - 1) - back, -back)


def ahead(n: int, *, key: str = KEY, ts: str = TS) -> WindowSpec:
    """The next n rows, without the current one."""
    return by_time(key=key, ts=ts).rowsBetween(1, n)


def so_far(*, key: str = KEY, ts: str = TS) -> WindowSpec:
    return by_time(key=key, ts=ts).rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, count_of: Column, window: WindowSpec, least: int) -> Column:
    """`value` over the window once it holds `least` values that are not null."""
    return F.when(F.count(count_of).over(window) >= least, value.over(window))


def median(column: str | Column, p: float = 0.5) -> Column:
    return F.percentile(column, F.lit(p))


def exact_mean(value: Column, window: WindowSpec, unit: float = 1e-6) -> Column:
    """Mean of prices over a window from integer sums of units: the same in any order of summation."""
    step = 1 / unit
    return F.sum(F.round(value * step).cast("bigint")).over(window) / (F.count(value).over(window) * step)


def is_trade(action: str = "action") -> Column:
    return F.upper(F.trim(F.col(action))).isin(*TRADE_ACTIONS)


def signed_size(side: str = "side", size: str = "size") -> Column:
    """+size for a buying aggressor, -size for a selling one, 0 for unknown sides."""
    s = F.upper(F.trim(F.col(side)))
    return F.when(s.isin(*BUY_SIDES), F.col(size)).when(s.isin(*SELL_SIDES), -F.col(size)).otherwise(F.lit(0.0))


def bucket(freq: str, ts: str = TS) -> Column:
    return F.window(F.col(ts), freq)["start"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating-point columns rounded: the boundary at which results of differing summation order compare."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])
