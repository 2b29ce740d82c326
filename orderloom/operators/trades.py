"""Trades and execution analysis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.spec import KEY, TS, ahead


def candidate_exits(bars: DataFrame, direction: str, tp: float = 1.5, sl: float = 1.0, horizon: int = 12, cost: float = 0.01) -> DataFrame:
    """For each event bar (direction not 0): exit reason, exit time and result in price after costs. The stop wins inside one bar."""
    d = F.signum(direction)
    b = bars.withColumn("_w", F.collect_list(F.struct(F.col(TS).alias("t"), "high", "low", "close")).over(ahead(horizon))).where(F.coalesce(d, F.lit(0.0)) != 0)
    up = d > 0
    stop = lambda x: F.when(up, x["low"] <= F.col("close") - sl * F.col("atr")).otherwise(x["high"] >= F.col("close") + sl * F.col("atr"))
    target = lambda x: F.when(up, x["high"] >= F.col("close") + tp * F.col("atr")).otherwise(x["low"] <= F.col("close") - tp * F.col("atr"))
    b = b.where(F.size("_w") > 0).withColumn("_e", F.get(F.filter("_w", lambda x: stop(x) | target(x)), F.lit(0))).withColumn("_l", F.get("_w", F.size("_w") - 1))
    reason = F.when(F.col("_e").isNull(), "timeout").when(stop(F.col("_e")), "stop").otherwise("target")
    b = b.withColumn("exit_reason", reason).withColumn("ts_exit", F.coalesce("_e.t", "_l.t"))
    gross = F.when(F.col("exit_reason") == "stop", -sl * F.col("atr")).when(F.col("exit_reason") == "target", tp * F.col("atr")).otherwise(d * (F.col("_l.close") - F.col("close")))
    return b.select(KEY, TS, F.col("ts_exit"), d.cast("int").alias("side"), "exit_reason", (gross - cost).alias("pnl"))


def one_at_a_time(candidates: DataFrame, cooldown_seconds: float = 0.0) -> DataFrame:
    """Of a symbol's candidate trades those taken when only one may be open, and none until the cooldown after an exit is over:
    a sequential pick over event rows alone.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    wait = pd.Timedelta(seconds=cooldown_seconds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TS, ignore_index=True)
        free, keep = None, []
        for a, b in zip(pdf[TS], pdf["ts_exit"], strict=True):
            ok = free is None or a >= free
            keep.append(ok)
            free = b + wait if ok else free
        return pdf[keep]

    return candidates.groupBy(KEY).applyInPandas(run, schema)


def equity_summary(trades: DataFrame, *by: str) -> DataFrame:
    """By group: trades, result, largest drawdown, profit factor, yearly Sharpe ratio of days, share of each exit."""
    e = equity_drawdown(trades)
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))
    share = lambda kind: F.avg((F.col("exit_reason") == kind).cast("double")).alias(f"{kind}_share")
    whole = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.max("drawdown").alias("max_drawdown"), (gain / F.greatest(loss, F.lit(1e-9))).alias("profit_factor"), *[share(k) for k in ("target", "stop", "timeout")])
    days = trades.groupBy(*by, F.to_date("ts_exit").alias("_d")).agg(F.sum("pnl").alias("_p"))
    sharpe = F.coalesce(F.when(F.stddev_samp("_p") > 0, F.avg("_p") / F.stddev_samp("_p") * F.sqrt(F.lit(252.0))), F.lit(0.0))
    return whole.join(days.groupBy(*by).agg(sharpe.alias("sharpe")), list(by))


def equity_drawdown(trades: DataFrame) -> DataFrame:
    """Cumulative result, its maximum so far and the drawdown, by symbol in order of exit."""
    w = Window.partitionBy(KEY).orderBy("ts_exit", TS).rowsBetween(Window.unboundedPreceding, 0)
    e = trades.withColumn("equity", F.sum("pnl").over(w))
    return e.withColumn("drawdown", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))


def trade_metrics(trades: DataFrame, *by: str) -> DataFrame:
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("pnl"), (gain / F.greatest(loss, F.lit(1e-9))).alias("profit_factor"))


def stress_grid(candidates: DataFrame, scenarios: dict[str, float]) -> DataFrame:
    """The metrics under further costs a trade, one row a scenario."""
    grid = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("extra")) for n, c in scenarios.items()])
    t = candidates.select("*", F.explode(grid).alias("g")).withColumn("pnl", F.col("pnl") - F.col("g.extra")).withColumn("scenario", F.col("g.scenario"))
    return trade_metrics(t, "scenario")


def depth_slippage(fills: DataFrame, base: float = 0.5, mid: float = 1.0, extra: float = 0.25) -> DataFrame:
    """Ticks by size over first-level depth: flat below 1, a ramp to 3, then more for each further unit."""
    r = F.col("size") / F.greatest("depth", F.lit(1.0))
    return fills.withColumn("slippage_ticks", F.when(r <= 1, base).when(r <= 3, base + (mid - base) * (r - 1) / 2).otherwise(mid + extra * (r - 3)))


def slippage_calibration(log: DataFrame, tolerance: float = 0.15, least: int = 20, low: float = 0.1, high: float = 5.0) -> DataFrame:
    """By region and overall (region null): rows, mean size of modelled and realised ticks, slope through the origin of realised on
    modelled within limits, the gap of the means, and a verdict: insufficient, well_, over_ or under_calibrated.
    """
    m, r = F.abs("model"), F.abs("realised")
    g = log.groupingSets([[], [F.col("region")]], "region").agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("model"), F.avg(r).alias("realised"), (F.sum(m * r) / F.sum(m * m)).alias("_s"))
    g = g.withColumn("slope", F.least(F.greatest("_s", F.lit(low)), F.lit(high))).withColumn("gap", F.when(F.col("realised") > 1e-9, (F.col("model") - F.col("realised")) / F.col("realised"))).drop("_s")
    verdict = F.when((F.col("n") < least) | F.col("gap").isNull(), "insufficient").when(F.abs("gap") <= tolerance, "well_calibrated").when(F.col("gap") > 0, "over_calibrated").otherwise("under_calibrated")
    return g.withColumn("verdict", verdict)


def top_rules(rules: DataFrame, group: str, metric: str, least: int, k: int) -> DataFrame:
    """The k best rules of each group with enough trades."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.col(metric).desc(), "rule"))
    return rules.where(F.col("n") >= least).withColumn("place", n).where(F.col("place") <= k)


def daily_loss_guard(trades: DataFrame, max_loss: float, max_trades: int, max_drawdown: float | None = None, start: float = 100.0) -> DataFrame:
    """blocked and its reason, from what is known before the trade: the day's result at or below -max_loss at any of its trades,
    the equity (`start` and all results) that share below its peak after any of the day's trades, or the day's number of
    trades at the limit. A day once blocked stays so.
    """
    so_far_all = Window.partitionBy(KEY).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy(KEY, F.to_date(TS)).orderBy(TS)
    t = trades.withColumn("_e", start + F.sum("pnl").over(so_far_all)).withColumn("_day", F.sum("pnl").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_dd", 1 - F.col("_e") / F.greatest(F.max("_e").over(so_far_all), F.lit(start)))
    w = day.rowsBetween(Window.unboundedPreceding, -1)
    hit = lambda c: F.coalesce(c, F.lit(False))
    reason = F.when(hit(F.min("_day").over(w) <= -max_loss), "loss")
    if max_drawdown is not None:
        reason = reason.when(hit(F.max("_dd").over(w) >= max_drawdown), "drawdown")
    reason = reason.when(F.count("pnl").over(w) >= max_trades, "trades").otherwise("none")
    return t.withColumn("block_reason", reason).withColumn("blocked", F.col("block_reason") != "none").drop("_e", "_day", "_dd")
