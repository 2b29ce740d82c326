"""Replay of signals against the book, and rules matched to bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.stage import staged
from orderloom.operators.book import walk_the_book_fill
from orderloom.operators.joins import asof_backward_join
from orderloom.operators.stats import percentiles
from orderloom.operators.trades import depth_slippage
from orderloom.spec import KEY, TS

LADDER = ["bid_px", "bid_sz", "ask_px", "ask_sz"]


def latency_us(first: Column, second: Column, mean_us: float = 5000.0, jitter_us: float = 2000.0, least_us: float = 0.1) -> Column:
    """mean + jitter * |z| microseconds, z normal, made of two uniform numbers above 0."""
    z = F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * second)
    return F.greatest(mean_us + jitter_us * F.abs(z), F.lit(least_us))


def hashed_uniform(salt: str, *columns: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def signal_replay(signals: DataFrame, book: DataFrame, latency: Column | None = None, tick: float = 0.01, base: float = 0.5, mid: float = 1.0, extra: float = 0.25) -> DataFrame:
    """Each signal (symbol, time, seq, is_buy, size) against the book (symbol, time, seq, ladders): a row of the execution log.

    The decision sees the last snapshot at or before its time; signals without one are left out. The order arrives after the
    latency, walks the other side of the last snapshot at or before then, and pays ticks against that snapshot's best
    price: realised_ticks. model_ticks comes from the size over that side's first level. Equal times go by seq.
    """
    draw = latency if latency is not None else latency_us(hashed_uniform("first", KEY, "seq"), hashed_uniform("second", KEY, "seq"))
    snapshots = book.select(KEY, TS, "seq", *LADDER)
    at = asof_backward_join(signals.select(KEY, TS, "seq", "is_buy", F.col("size").cast("double").alias("size")), snapshots, LADDER, order=["seq"]).where(f"right_{TS} is not null")
    held = [F.col(f"right_{c}").alias(f"_d_{c}") for c in LADDER]
    us = F.unix_micros(F.col(TS).cast("timestamp"))
    at = at.select(KEY, F.col(TS).alias("ts_decision"), "seq", "is_buy", "size", *held, F.round(draw, 1).alias("latency_us"), F.timestamp_micros(us + F.floor(draw).cast("bigint")).cast("timestamp_ntz").alias(TS))
    came = asof_backward_join(at, snapshots, LADDER, order=["seq"])
    came = came.select(KEY, "ts_decision", F.col(TS).alias("ts_arrival"), "seq", "is_buy", "size", "latency_us", F.col("size").alias("want"), *[f"_d_{c}" for c in LADDER], *[F.coalesce(f"right_{c}", f"_d_{c}").alias(c) for c in LADDER])
    first = lambda c: F.get(c, F.lit(0))
    own = lambda buy, sell: F.when(F.col("is_buy"), first(buy)).otherwise(first(sell))
    filled = walk_the_book_fill(came).withColumn("depth", own("ask_sz", "bid_sz"))
    filled = depth_slippage(filled, base, mid, extra).withColumnRenamed("slippage_ticks", "model_ticks")
    sign = F.when(F.col("is_buy"), 1.0).otherwise(-1.0)
    return filled.select(
        KEY, "seq", "is_buy", "ts_decision", "ts_arrival", "latency_us", "size",
        ((first("_d_bid_px") + first("_d_ask_px")) / 2).alias("mid_decision"), ((first("bid_px") + first("ask_px")) / 2).alias("mid_arrival"),
        "fill_vwap", "filled", "residual", "levels_used", "worst_px", "model_ticks",
        (sign * (F.col("fill_vwap") - own("ask_px", "bid_px")) / tick).alias("realised_ticks"), own("_d_ask_sz", "_d_bid_sz").alias("depth_decision"),
    )


def replay_summary(log: DataFrame) -> DataFrame:
    """One row of an execution log: numbers of orders, latency, slippage, levels and sizes."""
    log = staged(log, "execution-log")
    yes = lambda c: F.sum(c.cast("bigint"))
    one = log.agg(
        F.count(F.lit(1)).alias("n_executed"), yes(F.col("filled") > 0).alias("n_filled"), yes(F.col("residual") > 0).alias("n_with_residual"), F.avg("latency_us").alias("mean_latency_us"),
        F.avg("model_ticks").alias("mean_model_ticks"), F.avg("realised_ticks").alias("mean_realised_ticks"), F.avg("levels_used").alias("mean_levels"), F.max("levels_used").alias("max_levels"),
        F.sum("size").alias("intended_size"), F.sum("filled").alias("filled_size"), F.sum("residual").alias("residual_size"),
    )
    return one.crossJoin(percentiles(log, "latency_us", [0.95]).select(F.col("p0").alias("p95_latency_us")))


RULE = "rule string, priority int, zone string, level string, event string, direction int, filters array<struct<name:string,above:boolean,threshold:double>>"


def match_rules(bars: DataFrame, rules: DataFrame, values: list[str], zone: str = "zone", events: str = "events", least_confidence: float = 0.55, long: str = "p_long", short: str = "p_short") -> DataFrame:
    """symbol, time, rule, direction, confidence, decision of each bar that a rule matches.

    bars: events is an array of (level, event). A rule matches a bar of its zone that has its level event and passes all its
    filters, each a column of `values` above or not above a threshold (a missing value passes none). Of several rules the one of the smallest
    priority counts, then of the smallest name. decision is the rule's direction if the probability of that side is enough, else 0.

    Rules, any number of them, are rows: they meet the bars by (zone, level, event), and their filters are read from the row.
    """
    known = F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("double"))]) if values else F.create_map().cast("map<string,double>")
    held = bars.select(KEY, TS, F.col(zone).alias("zone"), F.explode(events).alias("_e"), known.alias("_v"), F.col(long).alias("_pl"), F.col(short).alias("_ps"))
    held = held.select(KEY, TS, "zone", "_e.level", "_e.event", "_v", "_pl", "_ps")
    met = held.join(rules, ["zone", "level", "event"])
    passes = F.forall("filters", lambda f: F.coalesce(F.when(f["above"], F.element_at("_v", f["name"]) > f["threshold"]).otherwise(F.element_at("_v", f["name"]) <= f["threshold"]), F.lit(False)))
    first = F.min_by(F.struct("rule", "direction", "_pl", "_ps"), F.struct("priority", "rule"))
    best = met.where(F.coalesce(passes, F.lit(True))).groupBy(KEY, TS).agg(first.alias("m"))
    best = best.select(KEY, TS, "m.rule", "m.direction", F.when(F.col("m.direction") > 0, F.col("m._pl")).otherwise(F.col("m._ps")).alias("confidence"))
    return best.withColumn("decision", F.when(F.col("confidence") >= least_confidence, F.col("direction")).otherwise(0))
