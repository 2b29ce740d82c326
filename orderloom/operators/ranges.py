"""Signals at the boundaries of a range: reversal votes and boundaries by windows, then a small state machine over each symbol's bars."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.spec import KEY, TS, by_time, trailing

# Shares of the largest flow and sizes of imbalance that a flip must pass.
FLOW_FLIP, IMBALANCE_FLIP = 0.3, 0.15
TREND, RANGE, UNCERTAIN = "TRENDING", "RANGING", "UNCERTAIN"
REGIMES = {"Trending": TREND, "Volatile": TREND, "Ranging": RANGE, "Low_Liquidity": RANGE}


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def reversal_votes(bars: DataFrame, flow: str, imbalance: str, intensity: str, flow_window: int = 8, imbalance_window: int = 5, intensity_window: int = 10, rise: float = 1.4) -> DataFrame:
    """Adds flow_flipped, imbalance_flipped, intensity_spike, reversal_score (their number) and reversal_side, from twice the windows.

    Flow flips when the mean of its newest half window has another sign than that of its oldest one and they differ by a share of the
    largest flow; imbalance by its newest three values against its oldest half window; intensity spikes when its newest three
    stand above the ones before. No vote before the first flow window is full.
    """
    last = lambda c, n: F.collect_list(F.coalesce(c, F.lit(0.0))).over(trailing(2 * n))
    b = bars.withColumns({"_f": last(flow, flow_window), "_o": last(imbalance, imbalance_window), "_h": last(intensity, intensity_window)})
    tail = lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)
    half = flow_window // 2
    b = b.withColumns({"_f0": _mean(F.slice("_f", 1, half)), "_f1": _mean(tail("_f", half)), "_fm": F.greatest(F.array_max(F.transform("_f", F.abs)), F.lit(1e-10))})
    b = b.withColumns({"_o0": _mean(F.slice("_o", 1, imbalance_window // 2)), "_o1": _mean(tail("_o", 3))})
    b = b.withColumns({"_h0": _mean(F.slice("_h", 1, F.greatest(F.size("_h") - 3, F.lit(1)))), "_h1": _mean(tail("_h", 3))})
    full = F.size("_f") >= flow_window
    ready = lambda c, n: full & (F.size(c) >= n)
    turned = lambda a, c: F.signum(a) != F.signum(c)
    b = b.withColumn("flow_flipped", full & (F.abs(F.col("_f1") - F.col("_f0")) / F.col("_fm") > FLOW_FLIP) & turned("_f0", "_f1"))
    b = b.withColumn("imbalance_flipped", ready("_o", imbalance_window) & (F.abs("_o1") > IMBALANCE_FLIP) & turned("_o0", "_o1") & (F.abs(F.col("_o1") - F.col("_o0")) > IMBALANCE_FLIP))
    b = b.withColumn("intensity_spike", ready("_h", intensity_window) & (F.col("_h1") > F.col("_h0") * rise) & (F.col("_h1") > F.col("_h0") + 0.05))
    score = sum((F.col(c).cast("double") for c in ("flow_flipped", "imbalance_flipped", "intensity_spike")), F.lit(0.0))
    side = F.when(full, F.signum(F.signum("_f1") + F.when(F.size("_o") >= imbalance_window, F.signum("_o1")).otherwise(0.0))).otherwise(0.0)
    return b.withColumn("reversal_score", score).withColumn("reversal_side", side.cast("int")).drop("_f", "_o", "_h", "_f0", "_f1", "_fm", "_o0", "_o1", "_h0", "_h1")


def range_boundaries(bars: DataFrame, atr: str, price: str = "close", window: int = 14, near: float = 1.5, beyond: float = 2.5, middle: float = 0.5, tick: float = 0.0001) -> DataFrame:
    """Adds smooth_atr, near_bottom, near_top, in_middle, broke_out, range_place.

    The range is that of the last three windows of prices, from five prices on. Width is the given one, or where that is no more than a tick the 80th
    percentile of the last window's price steps; the median of a window smooths it.
    """
    p = F.col(price)
    b = bars.withColumn("_d", F.abs(p - F.lag(price).over(by_time()))).withColumn("_n", F.count(price).over(trailing(3 * window)))
    own = F.when(F.col(atr) > tick, F.col(atr)).when(F.col("_n") >= 3, F.greatest(F.percentile("_d", F.lit(0.8)).over(trailing(window)), F.lit(2 * tick))).otherwise(5 * tick)
    b = b.withColumn("_a", own).withColumn("smooth_atr", F.percentile("_a", F.lit(0.5)).over(trailing(window)))
    high, low = (F.when(F.col("_n") >= 5, f(price).over(trailing(3 * window))).otherwise(0.0) for f in (F.max, F.min))
    b = b.withColumns({"_h": high, "_l": low})
    s, h, lo = F.col("smooth_atr"), F.col("_h"), F.col("_l")
    place = F.least(F.greatest((p - lo) / F.greatest(h - lo, 2 * s, F.lit(1e-10)), F.lit(0.0)), F.lit(1.0))
    return b.withColumns({
        "near_bottom": p <= lo + near * s, "near_top": p >= h - near * s, "in_middle": F.abs(p - (h + lo) / 2) <= middle * s,
        "broke_out": (p > h + beyond * s) | (p < lo - beyond * s), "range_place": F.round(place, 3),
    }).drop("_d", "_n", "_a", "_h", "_l")


@dataclass
class RangeFilter:
    """Lets a signal pass once enough of the last bars confirm it, with a lock while a trade is held and a pause after entries.

    `step` gives (action, direction, reason). In a range only signals away from the near boundary count; in a trend any, unless
    the last trade was the same one at about the same price.
    """

    confirmations: int = 3
    window: int = 8
    least_confidence: float = 0.55
    pause: int = 4
    lock: int = 8
    votes: float = 2.0
    early_confidence: float = 0.78
    early_place: float = 0.85
    early_votes: float = 1.0
    market: str = UNCERTAIN
    bar: int = 0
    locked: bool = False
    gathering: int = 0
    last_side: int = 0
    last_bar: int = -999
    last_price: float = 0.0
    recent: deque = field(default_factory=deque)

    def __post_init__(self) -> None:
        self.recent = deque(self.recent, maxlen=self.window)

    def confirmed(self) -> int:
        return sum(x == self.gathering for x in self.recent) if self.gathering else 0

    def forget(self) -> None:
        self.recent.clear()
        self.gathering = 0

    def enter(self, side: int, price: float, reason: str) -> tuple[str, int, str]:
        self.last_side, self.last_bar, self.last_price, self.locked = side, self.bar, price, True
        self.forget()
        return "ENTER", side, reason

    def hold(self, reason: str, note: int | None = None) -> tuple[str, int, str]:
        if note is not None:
            self.recent.append(note)
        return "HOLD", 0, reason

    def step(self, r) -> tuple[str, int, str]:
        """r: one bar with price, signal, confidence, regime and the columns of votes and boundaries."""
        self.bar += 1
        known = REGIMES.get(r.regime)
        if known:
            self.market = known
        elif r.broke_out and self.market == RANGE:
            self.market = TREND
            self.forget()
        elif self.market == UNCERTAIN:
            self.market = RANGE
        if r.signal and r.confidence < self.least_confidence:
            return self.hold("low_confidence", 0)
        if self.locked:
            if r.reversal_score >= self.votes:
                self.locked = False
                self.forget()
                return "CLOSE", 0, "reversal"
            if self.bar - self.last_bar < self.lock:
                return self.hold("locked")
            self.locked = False
            self.forget()
        if self.bar - self.last_bar < self.pause:
            return self.hold("pause", 0)
        return self.in_range(r) if self.market == RANGE else self.in_trend(r)

    def in_range(self, r) -> tuple[str, int, str]:
        if r.in_middle and not (r.near_bottom or r.near_top):
            self.gathering = 0
            return self.hold("middle", 0)
        allowed = 1 if r.near_bottom else -1 if r.near_top else 0
        if allowed and r.signal == -allowed:
            return self.hold("against_boundary", 0)
        self.recent.append(r.signal)
        self.gathering = r.signal or self.gathering
        if self.confirmed() >= self.confirmations:
            return self.enter(self.gathering, r.price, "range")
        return self.hold("gathering")

    def in_trend(self, r) -> tuple[str, int, str]:
        if r.reversal_score >= self.votes and self.gathering and r.reversal_side == -self.gathering:
            self.forget()
            return self.hold("trend_reversal")
        if not r.signal:
            return self.hold("no_signal", 0)
        if r.signal == self.last_side and abs(r.price - self.last_price) < 2 * r.smooth_atr:
            return self.hold("same_place")
        self.recent.append(r.signal)
        self.gathering = r.signal
        at_edge = r.range_place >= self.early_place if r.signal < 0 else r.range_place <= 1 - self.early_place
        early = at_edge and r.confidence >= self.early_confidence and r.reversal_score >= self.early_votes
        if self.confirmed() >= (1 if early else max(2, self.confirmations - 1)):
            return self.enter(r.signal, r.price, "trend_early" if early else "trend")
        return self.hold("gathering")


INPUTS = ["reversal_score", "reversal_side", "near_bottom", "near_top", "in_middle", "broke_out", "smooth_atr", "range_place"]


def range_state_filter(
    bars: DataFrame, signal: Column, confidence: Column, regime: Column, *, flow: str = "cvd_delta", imbalance: str = "ofi", intensity: str = "intensity", atr: str = "atr", price: str = "close", **limits
) -> DataFrame:
    """Adds the votes, the boundaries and action (ENTER, CLOSE, HOLD), direction, reason, market and confirmations of each bar.

    The state machine goes over a symbol's bars in order: one group a symbol, of small columns. signal is 1, -1 or 0.
    """
    b = range_boundaries(reversal_votes(bars, flow, imbalance, intensity), atr, price)
    b = b.withColumns({"_s": F.coalesce(signal, F.lit(0)).cast("int"), "_c": F.coalesce(confidence, F.lit(0.5)).cast("double"), "_r": F.coalesce(regime, F.lit("")).cast("string")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TS, ignore_index=True)
        state, rows = RangeFilter(**limits), []
        for r in pdf.itertuples(index=False):
            action, side, reason = state.step(r)
            rows.append((action, side, reason, state.market, state.confirmed()))
        return pdf[[KEY, TS]].join(pd.DataFrame(rows, columns=["action", "direction", "reason", "market", "confirmations"]))

    slim = b.select(KEY, TS, F.col(price).alias("price"), F.col("_s").alias("signal"), F.col("_c").alias("confidence"), F.col("_r").alias("regime"), *[F.round(c, 9).alias(c) if c in ("smooth_atr", "range_place") else F.col(c) for c in INPUTS])
    decided = slim.groupBy(KEY).applyInPandas(run, f"{KEY} string, {TS} timestamp_ntz, action string, direction int, reason string, market string, confirmations int")
    return b.drop("_s", "_c", "_r").join(decided, [KEY, TS])
