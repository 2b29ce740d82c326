"""The rate-controlled event gate: an excess-weighted score against an exact causal quantile of the symbol's earlier scores."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scan import CHUNK, chunk_of, numbered
from orderloom.functions.stage import staged
from orderloom.operators.stats import in_ranges
from orderloom.spec import KEY, TS, trailing

# Weights of the excesses over their limits, and of each trigger after the first.
VOLUME_WEIGHT, IMBALANCE_WEIGHT, WALL_WEIGHT, SHIFT_WEIGHT, TRIGGER_WEIGHT = 0.30, 0.30, 0.20, 0.20, 0.50
LEAST_RATE, LEAST_PAST = 0.05, 10


def _place(counts: np.ndarray, k: int) -> tuple[int, int]:
    """The range of the k-th smallest (from 0) and its place within the range."""
    total = np.cumsum(counts)
    r = int(np.searchsorted(total, k, side="right"))
    return r, k - int(total[r] - counts[r])


def _rows(table: pa.Table, before: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A chunk's rows in order of time, and for each range the values of earlier chunks."""
    counts = np.array(before.column("_before")[0].as_py() if before.num_rows else [], np.int64)
    table = table.sort_by(TS)
    most = int(np.max(table.column("_r").to_numpy(), initial=-1)) + 1
    return table, np.concatenate([counts, np.zeros(max(0, most - len(counts)), np.int64)])


def expanding_quantile(df: DataFrame, value: str, share: str, out: str, ranges: int = 64, seconds: int = CHUNK) -> DataFrame:
    """Adds the interpolated quantile at `share`, a column, of the values of the symbol's earlier rows; null without such rows or share.

    Exact, and no task holds a symbol. Values are cut into ranges, time into chunks. Counts by range, added up over earlier chunks,
    tell each row in which range its order statistics lie; a chunk then gets the earlier values of those ranges only, which are
    few as quantiles move slowly. Within the chunk rows go one after the other. Value is not null; (symbol, time) is the key.
    """
    rows = in_ranges(df, [value], KEY, buckets=ranges).withColumnRenamed("_b0", "_r").withColumn("_c", chunk_of(seconds))
    rows = staged(rows, "quantile-rows")
    counts = rows.groupBy(KEY, "_c", "_r").agg(F.count(F.lit(1)).alias("_n"))

    def added(table: pa.Table) -> pa.Table:
        c, r, n = (table.column(x).to_numpy() for x in ("_c", "_r", "_n"))
        chunks, at = np.unique(c, return_inverse=True)
        grid = np.zeros((len(chunks), int(r.max()) + 1), np.int64)
        grid[at, r] = n
        before = np.cumsum(grid, axis=0) - grid
        return pa.table({KEY: pa.array([table.column(KEY)[0].as_py()] * len(chunks)), "_c": pa.array(chunks), "_before": pa.array(list(before), pa.list_(pa.int64()))})

    before = staged(counts.groupBy(KEY).applyInArrow(added, f"{KEY} string, _c bigint, _before array<bigint>"), "quantile-counts")  # a row a chunk

    def asked(table: pa.Table, earlier: pa.Table) -> pa.Table:
        table, n = _rows(table, earlier)
        wanted, total = set(), int(n.sum())
        for r, q in zip(table.column("_r").to_pylist(), table.column(share).to_pylist(), strict=True):
            if total and q is not None:
                at = q * (total - 1)
                wanted |= {_place(n, int(np.floor(at)))[0], _place(n, int(np.ceil(at)))[0]}
            n[r] += 1
            total += 1
        key, chunk = (table.column(c)[0].as_py() if table.num_rows else None for c in (KEY, "_c"))
        return pa.table({KEY: pa.array([key] * len(wanted), pa.string()), "_c": pa.array([chunk] * len(wanted), pa.int64()), "_r": pa.array(sorted(wanted), pa.int32())})

    slim = rows.select(KEY, TS, "_c", "_r", share)
    wanted = slim.groupBy(KEY, "_c").cogroup(before.groupBy(KEY, "_c")).applyInArrow(asked, f"{KEY} string, _c bigint, _r int")
    past = rows.select(KEY, F.col("_c").alias("_from"), "_r", F.col(value).alias("_old")).join(wanted, [KEY, "_r"]).where("_from < _c").drop("_from")
    every = rows.unionByName(past, allowMissingColumns=True)
    names = df.columns

    def answered(table: pa.Table, earlier: pa.Table) -> pa.Table:
        new = table.filter(pc.is_null(table.column("_old")))
        old = table.filter(pc.is_valid(table.column("_old")))
        new, n = _rows(new, earlier)
        held: dict[int, list[float]] = {}
        for r, v in zip(old.column("_r").to_pylist(), old.column("_old").to_pylist(), strict=True):
            held.setdefault(r, []).append(v)
        for own in held.values():
            own.sort()
        seen: dict[int, list[float]] = {}
        result, total = [], int(n.sum())
        for v, r, q in zip(new.column(value).to_pylist(), new.column("_r").to_pylist(), new.column(share).to_pylist(), strict=True):
            found = None
            if total and q is not None:
                at = q * (total - 1)
                ends = []
                for k in (int(np.floor(at)), int(np.ceil(at))):
                    where, place = _place(n, k)
                    if where not in held:  # its values so far are of this chunk
                        held[where] = sorted(seen.get(where, []))
                    ends.append(held[where][place])
                found = ends[0] + (ends[1] - ends[0]) * (at - np.floor(at))
            result.append(found)
            seen.setdefault(r, []).append(v)
            if r in held:
                insort(held[r], v)
            n[r] += 1
            total += 1
        return new.select(names).append_column(out, pa.array(result, pa.float64()))



    schema = df.schema.add(out, "double")
    return every.groupBy(KEY, "_c").cogroup(before.groupBy(KEY, "_c")).applyInArrow(answered, schema)


def excess_score(df: DataFrame, window: int, vol_mult: float, obi_thr: float, wall_thr: float, shift_z_thr: float, obi: str, walls: list[str], shifts: list[str]) -> DataFrame:
    """Adds score and triggers: by how much volume, imbalance, wall strength and the largest shift (rolling z) pass their limits."""
    w = trailing(window)
    zero = F.lit(0.0)
    peak = zero
    for c in shifts:
        sd = F.stddev_samp(c).over(w)
        peak = F.greatest(peak, F.coalesce(F.abs((F.col(c) - F.avg(c).over(w)) / F.when(sd == 0, 1e-9).otherwise(sd)), zero))
    parts = {
        "_v": (F.col("volume") / F.greatest(F.avg("volume").over(w), F.lit(1e-9)), vol_mult, VOLUME_WEIGHT),
        "_o": (F.abs(F.coalesce(obi, zero)), obi_thr, IMBALANCE_WEIGHT),
        "_w": (F.greatest(zero, *[F.coalesce(c, zero) for c in walls]) if walls else zero, wall_thr, WALL_WEIGHT),
        "_s": (peak, shift_z_thr, SHIFT_WEIGHT),
    }
    df = df.withColumns({k: F.round(v, 9) for k, (v, _, _) in parts.items()})
    limits = {k: max(limit, 1e-6) for k, (_, limit, _) in parts.items()}
    count = sum(((F.col(k) > limits[k]).cast("int") for k in parts), F.lit(0))
    excess = sum((weight * F.greatest(F.col(k) / limits[k] - 1, zero) for k, (_, _, weight) in parts.items()), zero)
    df = df.withColumn("triggers", count)
    return df.withColumn("score", F.round(excess + TRIGGER_WEIGHT * F.greatest(F.col("triggers") - 1, F.lit(0)), 9)).drop(*parts)


def training_gate(
    df: DataFrame, base: Column, *, window: int = 20, vol_mult: float = 1.2, obi_thr: float = 0.3, wall_thr: float = 3.0, shift_z_thr: float = 0.75, target_rate: float = 0.25,
    obi: str = "ofi", walls: list[str] | None = None, shifts: list[str] | None = None,
) -> DataFrame:
    """Adds score, triggers, threshold and kept: of the base rows those whose score reaches the quantile of the symbol's earlier base
    scores that would keep `target_rate` of all rows; any score does before max(window, 10) base rows.

    A symbol of which nothing is kept falls back to its base rows of two triggers or more, or else to all of them.
    """
    x = excess_score(df.withColumn("_base", F.coalesce(base, F.lit(False))), window, vol_mult, obi_thr, wall_thr, shift_z_thr, obi, walls or [], shifts or [])
    x = numbered(x, "_n")
    some = numbered(x.where("_base").select(KEY, TS, "score", "_n"), "_m")
    rate = (F.col("_m") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    keep = F.least(F.greatest(F.lit(target_rate), F.lit(LEAST_RATE)), rate) / F.greatest(rate, F.lit(1e-9))
    share = F.when(F.col("_m") > max(window, LEAST_PAST), F.when(keep >= 0.999, 0.0).otherwise(F.least(F.greatest(1 - keep, F.lit(0.0)), F.lit(1.0))))
    gated = expanding_quantile(some.withColumn("_q", share), "score", "_q", "_t").withColumn("threshold", F.greatest(F.coalesce("_t", F.lit(0.0)), F.lit(0.0)))
    x = x.join(gated.select(KEY, TS, "threshold"), [KEY, TS], "left").withColumn("_k", F.coalesce(F.col("score") >= F.round("threshold", 9), F.lit(False)))
    whole = Window.partitionBy(KEY)
    two = F.col("_base") & (F.col("triggers") >= 2)
    any_of = lambda c: F.max(c).over(whole)
    kept = F.when(any_of("_k"), F.col("_k")).when(any_of(two), two).otherwise(F.col("_base"))
    return x.withColumn("kept", kept.cast("int")).drop("_base", "_n", "_k")
