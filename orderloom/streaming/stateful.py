"""Stateful jobs on `transformWithStateInPandas`: tracked trades with timers, and tick features from ring buffers.

State lives in the RocksDB store (`replay(..., rocksdb=True)`, or spark.sql.streaming.stateStore.providerClass of the session).
Rows of a symbol come in order of time from batch to batch; within a batch they are put in order here.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderloom.spec import KEY, TS, is_trade, signed_size
from orderloom.streaming.jobs import zoned

CLOSED = (
    f"{KEY} string, trade_no bigint, opened timestamp, closed timestamp, direction int, entry double, exit double, reason string, favourable double, adverse double, pnl double, closed_trades bigint, win_rate double"
)
OPEN = "no bigint, opened bigint, direction int, entry double, target double, stop double, high double, low double"
COUNTS = "signals bigint, closed bigint, wins bigint, price double"


class Tracker(StatefulProcessor):
    """Open trades as a list, counters as a value, and a timer for each trade's timeout.

    A trade reacts to rows of later time. In effect each row first ends the trades whose time is over, at the price before it, then moves
    the extremes of the others and ends those whose target or stop it reaches, then opens its own.
    """

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.counts = handle.getListState("open", OPEN), handle.getValueState("counts", COUNTS)

    def _read(self) -> tuple[list[list], list]:
        return [list(t) for t in self.open.get()], list(self.counts.get()) if self.counts.exists() else [0, 0, 0, None]

    def _write(self, trades: list[list], counts: list) -> None:
        self.open.put([tuple(t) for t in trades]) if trades else self.open.clear()
        self.counts.update(tuple(counts))

    def _end(self, t: list, at: int, price: float, reason: str, counts: list) -> tuple:
        no, opened, direction, entry, _, _, high, low = t
        gain = direction * (price - entry)
        counts[1] += 1
        counts[2] += gain > 0
        best, worst = (high - entry, entry - low) if direction > 0 else (entry - low, high - entry)
        return no, opened, at, direction, entry, price, reason, best, worst, gain, counts[1], counts[2] / counts[1]

    def _expired(self, trades: list[list], until: int, counts: list) -> tuple[list[list], list[tuple]]:
        over = sorted((t for t in trades if t[1] + self.timeout < until), key=lambda t: t[:2][::-1])
        return [t for t in trades if t[1] + self.timeout >= until], [self._end(t, t[1] + self.timeout, counts[3], "timeout", counts) for t in over]

    def _frame(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = ["trade_no", "opened", "closed", "direction", "entry", "exit", "reason", "favourable", "adverse", "pnl", "closed_trades", "win_rate"]
            out = pd.DataFrame(rows, columns=names)
            out["opened"], out["closed"] = (pd.to_datetime(out[c], unit="us", utc=True) for c in ("opened", "closed"))
            out.insert(0, KEY, key[0])
            yield out

    def handleInputRows(self, key, rows, timerValues):
        batch = unpacked(rows, timerValues.getCurrentWatermarkInMs() * 1000)  # one symbol's rows of one micro-batch
        kept, counts = self._read()
        seen = counts[0]
        trades, out = tracked(batch, kept, counts, self.timeout, self._end)
        for ms in sorted({(t[1] + self.timeout) // 1000 + 1 for t in trades if t[0] > seen}):  # timers go off between batches: only new trades that stay open need one
            self.handle.registerTimer(ms)
        self._write(trades, counts)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        trades, counts = self._read()
        trades, over = self._expired(trades, expiredTimerInfo.getExpiryTimeInMs() * 1000, counts)
        if over:
            self._write(trades, counts)
        yield from self._frame(key, over)

    def close(self) -> None:
        pass


#: Numbers of a row in order of the bytes that `packed` makes of them.
PACKED = {"us": np.int64, "seq": np.int64, "price": np.float64, "direction": np.int8}
LEVELS = ("target", "stop")  # of signals only
PACK = f"{KEY} string, {TS} timestamp, " + ", ".join(f"{c} binary" for c in (*PACKED, *LEVELS))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: of each Arrow batch a row a symbol, with the latest time and the symbol's numbers as arrays in bytes.

    So a row of the feed takes 25 bytes in the shuffle and in the state's worker, and no object of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(KEY).dictionary_encode("encode")
        key = keys.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        ends = [*(np.flatnonzero(np.diff(key[order])) + 1).tolist(), len(order)]
        numbers = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(PACKED.get(c, np.float64))[order] for c in (*PACKED, *LEVELS)}
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        columns = [pa.array([numbers[c][a:b].tobytes() for a, b in spans], pa.binary()) for c in PACKED]
        signals = numbers["direction"] != 0
        columns += [pa.array([numbers[c][a:b][signals[a:b]].tobytes() for a, b in spans], pa.binary()) for c in LEVELS]
        latest = pa.array([int(numbers["us"][a:b].max()) for a, b in spans], pa.timestamp("us", "UTC"))
        symbols = keys.dictionary.take(pa.array(key[order][[a for a, _ in spans]])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([symbols, latest, *columns], [KEY, TS, *PACKED, *LEVELS])


def unpacked(parts: Iterator[pd.DataFrame], late: int) -> pd.DataFrame:
    """One symbol's rows of a micro-batch in order of time from what `packed` made of them, without those up to the time `late`."""
    held = {c: [] for c in (*PACKED, *LEVELS)}
    for part in parts:
        for c, arrays in held.items():
            arrays += part[c].tolist()
    rows = {c: np.frombuffer(b"".join(held.pop(c)), kind) for c, kind in PACKED.items()}
    for c in LEVELS:
        levels = np.zeros(len(rows["us"]))
        levels[rows["direction"] != 0] = np.frombuffer(b"".join(held.pop(c)))
        rows[c] = levels
    order = np.lexsort((rows["seq"], rows["us"]))
    order = order[rows["us"][order] > late]
    return pd.DataFrame({c: rows.pop(c)[order] for c in list(rows)})


class Extremes:
    """Largest (sign 1) or smallest (sign -1) value from a row on up to the newest one: only values that no later one passes are held."""

    def __init__(self, sign: int):
        self.sign, self.at, self.v = sign, [], []

    def push(self, i: int, value: float) -> None:
        value *= self.sign
        while self.v and self.v[-1] <= value:
            self.v.pop()
            self.at.pop()
        self.v.append(value)
        self.at.append(i)

    def since(self, i: int) -> float | None:
        k = bisect_left(self.at, i)
        return self.v[k] * self.sign if k < len(self.at) else None


def tracked(batch: pd.DataFrame, kept: list[list], counts: list, timeout: int, end) -> tuple[list[list], list[tuple]]:
    """The trades that stay open and those that closed, in order, over rows sorted by time. kept: open trades so far.

    Open trades wait in heaps by target and by stop, and in order of their time for the timeout, so that a row looks at
    the trades it ends only; their extremes are looked up when they close.
    """
    waiting, by_age, gone = deque(sorted((list(t) for t in kept), key=lambda t: (t[1], t[0]))), deque(), set()
    above, below = [], []  # (price, number, trade): ended by a price of at least, at most that
    begun, high, low, out = {}, Extremes(1), Extremes(-1), []

    def close(t: list, at: int, price: float, reason: str) -> None:
        gone.add(t[0])
        stretched(t)
        out.append(end(t, at, price, reason, counts))

    def stretched(t: list) -> None:
        i = begun.pop(t[0], None)
        if i is not None and (top := high.since(i)) is not None:
            t[6], t[7] = max(t[6], top), min(t[7], low.since(i))

    i, now = 0, None
    for start in range(0, len(batch), 1 << 16):
        part = batch.iloc[start : start + (1 << 16)]
        for us, price, direction, target, stop in zip(*(part[c].tolist() for c in ("us", "price", "direction", "target", "stop")), strict=True):
            if us != now:
                now = us
                while waiting and waiting[0][1] < us:  # trades of earlier rows begin to react
                    t = waiting.popleft()
                    begun[t[0]] = i
                    by_age.append(t)
                    up, down = (t[4], t[5]) if t[2] > 0 else (t[5], t[4])
                    if up == up:
                        heappush(above, (up, t[0], t))
                    if down == down:
                        heappush(below, (-down, t[0], t))
                while by_age and (by_age[0][0] in gone or by_age[0][1] + timeout < us):
                    t = by_age.popleft()
                    if t[0] not in gone:
                        close(t, t[1] + timeout, counts[3], "timeout")
                    gone.discard(t[0])
            if price == price:
                high.push(i, price)
                low.push(i, price)
                hit = {}
                while above and above[0][0] <= price:
                    t = heappop(above)[2]
                    hit[t[0]] = t
                while below and -below[0][0] >= price:
                    t = heappop(below)[2]
                    hit[t[0]] = t
                for no in sorted(hit):
                    t = hit[no]
                    if no in begun:
                        won = price >= t[4] if t[2] > 0 else price <= t[4]
                        close(t, us, t[4] if won else t[5], "target" if won else "stop")
            if direction:
                counts[0] += 1
                t = [counts[0], us, int(direction), price, price + target, price - stop, price, price]
                waiting.append(t) if not waiting or waiting[-1][1] <= us else insort(waiting, t, key=lambda x: (x[1], x[0]))
            counts[3] = price
            i += 1
    still = [t for t in by_age if t[0] in begun]
    for t in still:
        stretched(t)
    return sorted([*still, *waiting], key=lambda t: t[0]), out


def book_levels(book: DataFrame, factor: float = 1.5, tick: float = 0.01, least_target: float = 3.0, most_stop: float = 30.0) -> tuple[Column, Column]:
    """(up, down): from a snapshot the price distances of its first ask wall and of one tick behind its first bid wall, within limits.

    A wall is a level of at least `factor` times the snapshot's mean size; without one the distances are ten and twelve ticks.
    """
    both = F.concat("bid_sz", "ask_sz")
    wall = factor * F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both)
    at = lambda side: F.get(F.transform(F.array(wall), lambda w: F.array_position(F.transform(side, lambda x: x >= w), F.lit(True)) - 1), F.lit(0))  # noqa: E731  (the wall's size is worked out once a row, not once a level)
    ask, bid = at("ask_sz"), at("bid_sz")
    up = F.greatest(F.when(ask >= 0, ask + 1.0).otherwise(10.0), F.lit(least_target)) * tick
    down = F.least(F.when(bid >= 0, bid + 2.0).otherwise(12.0), F.lit(most_stop)) * tick
    return up, down


def tracked_trades(book: DataFrame, direction: Column, timeout_seconds: int = 6 * 3600, late: str = "10 minutes", factor: float = 1.5, tick: float = 0.01) -> DataFrame:
    """Closed trades of the signals in a stream of book snapshots with prices: direction is 1, -1 or 0 for each row.

    Target and stop come from the walls of the signal's own snapshot (for a sale mirrored). win_rate: of the symbol's trades closed so far.
    """
    up, down = book_levels(book, factor, tick)
    x = zoned(book).where(F.col(TS).isNotNull()).withColumn("direction", F.coalesce(direction, F.lit(0)).cast("int")).withColumns({"_u": F.when(F.col("direction") != 0, up).otherwise(0.0), "_d": F.when(F.col("direction") != 0, down).otherwise(0.0)})
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(2**63 - 1))  # last among rows of one time
    x = x.select(KEY, F.unix_micros(TS).alias("us"), seq.alias("seq"), F.col("price").cast("double").alias("price"), "direction", (F.col("direction") * F.col("_u")).alias("target"), (F.col("direction") * F.col("_d")).alias("stop"))
    x = x.mapInArrow(packed, PACK).withWatermark(TS, late)
    return x.groupBy(KEY).transformWithStateInPandas(Tracker(timeout_seconds * 1_000_000), CLOSED, "Append", "EventTime")


FEATURES = f"{KEY} string, {TS} timestamp, seq bigint, tape_speed bigint, micro_range double, burst double, trade_gap_ms double, impact double, intensity double, net_signed double, session_vwap double, vwap_z double, vwap_slope double"
#: Values held of each series; 0: by time.
RINGS = {"us": 0, "price": 1, "size": 500, "signed": 100, "weight": 100, "move": 100, "gap": 50, "ratio": 30, "away": 500, "vwap": 20}
STATE = "day bigint, " + ", ".join(f"{k} array<double>" for k in RINGS) + ", pv double, v double, impact double, intensity double"
DAY_US = 86_400_000_000


def rolling(x: np.ndarray, n: int, f, fill: float = 0.0, rows: int = 4096) -> np.ndarray:
    """f of (windows of the last n values padded with `fill`, numbers of values in them), a row a value, in pieces of bounded size."""
    padded, out = np.concatenate([np.full(n - 1, fill), x]), np.empty(len(x))
    for at in range(0, len(x), rows):
        w = np.lib.stride_tricks.sliding_window_view(padded[at : at + rows + n - 1], n)[: len(x) - at]
        out[at : at + rows] = f(w, np.minimum(np.arange(at, at + len(w)) + 1, n))
    return out


def sums(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(x, n, lambda w, _: w.sum(1))


def means(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(x, n, lambda w, k: w.sum(1) / k)


def deviations(x: np.ndarray, n: int) -> np.ndarray:
    def of(w: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = w - (w.sum(1) / k)[:, None]
        if k[0] < n:
            d[np.arange(n) < n - k[:, None]] = 0
        return np.sqrt((d * d).sum(1) / k)

    return rolling(x, n, of)


def medians(x: np.ndarray, n: int) -> np.ndarray:
    """Of the positive values; 0 without any."""

    def of(w: np.ndarray, _: np.ndarray) -> np.ndarray:
        s, c = np.sort(np.where(w > 0, w, np.inf), 1), (w > 0).sum(1)
        row = np.arange(len(s))
        return np.where(c > 0, (s[row, np.maximum(c - 1, 0) // 2] + s[row, np.minimum(c // 2, n - 1)]) / 2, 0.0)

    with np.errstate(invalid="ignore"):
        return rolling(x, n, of)


def smoothed(start: float, keep: list[float], add: list[float]) -> list[float]:
    out = []
    for k, a in zip(keep, add, strict=True):
        start = k * start + a
        out.append(start)
    return out


def figures(day: int, state: tuple | None, us: np.ndarray, price: np.ndarray, size: np.ndarray, signed: np.ndarray, speed_us: int = 600_000_000) -> tuple[dict[str, np.ndarray], tuple]:
    """The figures of one symbol's trades of one day in order, and the state after them. state: that before them, of the same day.

    The state's rings are the last values of each series, as many as its figure looks back; us holds the times of the last ten minutes.
    """
    kept = {k: np.asarray(v, float) for k, v in zip(RINGS, state[1 : 1 + len(RINGS)], strict=True)} if state else {k: np.zeros(0) for k in RINGS}
    pv, v, impact, intensity = state[1 + len(RINGS) :] if state else (0.0, 0.0, 0.0, 0.0)
    fresh = not len(kept["price"])
    price, size, signed = (np.asarray(x, float) for x in (price, size, signed))
    us = np.asarray(us, np.int64)
    series, out = dict(kept), {}

    def grown(name: str, values: np.ndarray) -> tuple[np.ndarray, int]:
        series[name] = np.concatenate([kept[name], values])
        return series[name], len(kept[name])

    def new(values: np.ndarray, old: int) -> np.ndarray:
        """Without the old ones; the day's first trade has no move and no gap."""
        return np.concatenate([[np.nan], values[old:]]) if fresh and len(values) - old < len(us) else values[old:]

    before, at_before = np.concatenate([kept["price"], price]), np.concatenate([kept["us"][-1:].astype(np.int64), us])
    move, gap = np.abs(np.diff(before[-len(price) - 1 :])), np.diff(at_before)
    size_all, old = grown("size", size)
    past = np.concatenate([[0.0], means(size_all, 500)[:-1]])[old:]
    burst = size / np.maximum(past, 1e-9)
    moves, o = grown("move", np.round(move * 1e6))
    out["micro_range"] = new(rolling(moves, 100, lambda w, k: w.sum(1) / (k * 1e6)), o)
    gaps, o = grown("gap", gap.astype(float))
    trade_gap = new(rolling(gaps, 50, lambda w, k: w.sum(1) / (k * 1000.0)), o)
    ratio = move / np.maximum(size[-len(move) :] if len(move) else size[:0], 1e-9)
    ratios, o = grown("ratio", np.concatenate([[0.0], ratio]) if fresh else ratio)
    m = medians(ratios, 30)[o:]
    share = np.where(m > 0, 0.18, 0.05)
    out["impact"] = np.array(smoothed(impact, (1 - share).tolist(), (share * m).tolist()))
    left = np.exp(-0.05 * (np.maximum(gap, 0) / 1e6) / 60)
    left = np.concatenate([[0.0], left]) if fresh else left
    out["intensity"] = np.array(smoothed(intensity, left.tolist(), [0.175] * len(left)))
    weight = np.where(size > 2.0 * means(size_all, 100)[old:], 2.0, 1.0)
    weights, o = grown("weight", weight)
    signs, _ = grown("signed", signed)
    near = size_all[-len(weights) :]
    net = sums(signs * weights, 100)[o:] / np.maximum(sums(near * weights, 100)[o:], 1e-9)
    total_pv, total = np.cumsum(np.concatenate([[pv], price * size]))[1:], np.cumsum(np.concatenate([[v], size]))[1:]
    vwap = total_pv / total
    away, o = grown("away", price - vwap)
    sd = deviations(away, 500)[o:]
    vwaps, o = grown("vwap", vwap)
    lagged = np.concatenate([np.full(19, np.nan), vwaps])[: len(vwaps)][o:]
    grown("price", price)
    times, o = grown("us", us.astype(float))
    speed = np.searchsorted(times, us, "right") - np.searchsorted(times, us - speed_us, "left")  # trades of one time count each other
    named = {
        "tape_speed": speed, "micro_range": out["micro_range"], "burst": burst, "trade_gap_ms": trade_gap, "impact": out["impact"], "intensity": out["intensity"], "net_signed": net,
        "session_vwap": vwap, "vwap_z": np.where(sd > 1e-6, (price - vwap) / np.where(sd > 1e-6, sd, 1.0), 0.0), "vwap_slope": np.where(np.isnan(lagged), 0.0, vwap - lagged),
    }
    series["us"] = times[np.searchsorted(times, us[-1] - speed_us, "left") :]
    rings = [(series[k][-n:] if n else series[k]).tolist() for k, n in RINGS.items()]
    return named, (int(day), *rings, float(total_pv[-1]), float(total[-1]), float(named["impact"][-1]), float(named["intensity"][-1]))


class FlowFeatures(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getValueState("rings", STATE)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["us", "seq"])  # one symbol's trades of one micro-batch
        state = tuple(self.rings.get()) if self.rings.exists() else None
        us, seq, price, size, signed = (batch[c].to_numpy() for c in ("us", "seq", "price", "size", "signed"))
        day = us // DAY_US
        edges = [0, *(np.flatnonzero(np.diff(day)) + 1).tolist(), len(us)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found, state = figures(day[a], state if state is not None and state[0] == day[a] else None, us[a:b], price[a:b], size[a:b], signed[a:b])
            yield pd.DataFrame({KEY: key[0], TS: pd.to_datetime(us[a:b], unit="us", utc=True), "seq": seq[a:b], **found})
        self.rings.update(state)

    def close(self) -> None:
        pass


def flow_features(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The tick features of a trade as it arrives: speed, range, burst, gap, impact, intensity, signed share, session price; reset each day."""
    t = zoned(ticks).withWatermark(TS, late).where(is_trade())
    t = t.select(KEY, TS, "seq", "price", "size", signed_size().alias("signed"), F.unix_micros(TS).alias("us"))
    return t.groupBy(KEY).transformWithStateInPandas(FlowFeatures(), FEATURES, "Append", "None")
