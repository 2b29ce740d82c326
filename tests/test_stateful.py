"""Tracked trades and tick figures against plain loops, over any cut into batches, and their work on rows of one time."""

import random
import time

import numpy as np
import pandas as pd

from orderloom.streaming import stateful as S

HOUR = 3600 * 1_000_000


def feed(n, same=1, seed=3):
    rnd = random.Random(seed)
    rows, us = [], 0
    for i in range(n):
        us += 0 if i % same else rnd.randint(1, HOUR // 2)
        rows.append((us, i, round(100 + rnd.gauss(0, 0.2), 2), rnd.choice([0, 0, 1, -1])))
    out = pd.DataFrame(rows, columns=["us", "seq", "price", "direction"])
    out["target"], out["stop"] = out["direction"] * 0.3, out["direction"] * 0.25
    return out


def loop(batch, timeout, end, counts):
    """Each row looks at every open trade."""
    trades, out = [], []
    for us, price, direction, target, stop in zip(*(batch[c].tolist() for c in ("us", "price", "direction", "target", "stop")), strict=True):
        for t in sorted((t for t in trades if t[1] + timeout < us), key=lambda t: (t[1], t[0])):
            out.append(end(t, t[1] + timeout, counts[3], "timeout", counts))
        still = []
        for t in (t for t in trades if t[1] + timeout >= us):
            if t[1] < us:
                t[6], t[7] = max(t[6], price), min(t[7], price)
                won, lost = ((price >= t[4], price <= t[5]) if t[2] > 0 else (price <= t[4], price >= t[5]))
                if won or lost:
                    out.append(end(t, us, t[4] if won else t[5], "target" if won else "stop", counts))
                    continue
            still.append(t)
        trades = still
        if direction:
            counts[0] += 1
            trades.append([counts[0], us, int(direction), price, price + target, price - stop, price, price])
        counts[3] = price
    return trades, out


def test_tracked_trades_equal_a_plain_loop():
    tracker = S.Tracker(6 * HOUR)
    for same in (1, 7):
        batch = feed(3000, same)
        batch.loc[::97, "price"] = np.nan
        want, counts = loop(batch, 6 * HOUR, tracker._end, [0, 0, 0, None]), [0, 0, 0, None]
        cuts, kept, got = [0, 700, 1400, 2100, 3000], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            kept, closed = S.tracked(batch.iloc[a:b], kept, counts, 6 * HOUR, tracker._end)
            got += closed
        assert repr(got) == repr(want[1]) and repr(kept) == repr(want[0])
        assert len(got) > 500 and {r[6] for r in got} == {"target", "stop", "timeout"}


def test_many_rows_of_one_time_cost_no_pass_over_open_trades():
    tracker, batch = S.Tracker(6 * HOUR), feed(40_000, same=20_000)
    began = time.process_time()
    S.tracked(batch, [], [0, 0, 0, None], 6 * HOUR, tracker._end)
    assert time.process_time() - began < 10  # each row against every open trade: 100 million looks


def test_figures_do_not_depend_on_the_cut_and_equal_plain_windows():
    rnd = np.random.default_rng(1)
    n = 1500
    us, price, size = np.sort(rnd.integers(0, 20 * HOUR, n)), 100 + np.round(rnd.normal(0, 1, n), 2), rnd.integers(1, 100, n).astype(float)
    us[700:720] = us[700]
    signed = size * rnd.choice([-1, 1], n)
    whole, last = S.figures(0, None, us, price, size, signed)
    state, parts = None, []
    for a, b in ((0, 1), (1, 30), (30, 700), (700, 1200), (1200, n)):
        found, state = S.figures(0, state, us[a:b], price[a:b], size[a:b], signed[a:b])
        parts.append(found)
    for k in whole:
        assert np.allclose(np.concatenate([p[k] for p in parts]), whole[k], atol=1e-9, equal_nan=True), k
    assert state[:2] == last[:2] and np.allclose(state[-4:], last[-4:])
    vwap = np.cumsum(price * size) / np.cumsum(size)
    for i in (0, 1, 5, 50, 400, 710, 1499):
        w = lambda x, k: x[max(0, i - k + 1) : i + 1]  # noqa: E731, B023
        assert whole["tape_speed"][i] == ((us <= us[i]) & (us >= us[i] - 600_000_000)).sum()
        sd = np.std(w(price - vwap, 500))
        assert abs(whole["vwap_z"][i] - ((price[i] - vwap[i]) / sd if sd > 1e-6 else 0)) < 1e-9
        if i:
            moves = np.abs(np.diff(price))[max(0, i - 100) : i]
            assert abs(whole["micro_range"][i] - moves.mean()) < 1e-6 and abs(whole["burst"][i] - size[i] / size[max(0, i - 500) : i].mean()) < 1e-9
    assert np.isnan(whole["micro_range"][0]) and np.isnan(whole["trade_gap_ms"][0]) and whole["intensity"][0] == 0.175
