"""Permutation nulls, bootstrap intervals and the grid scan of edges, without copying a row once a repetition.

Each row's draws for all repetitions come at once from a counter-based hash of (seed, row): bits as signs, or uniform numbers as Poisson(1)
weights. Tasks add them up for each group in numpy and give one array of sums a group; Spark adds the arrays.
A result depends on the seed and the rows alone, not on how rows lie in partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.stage import staged
from orderloom.operators.stats import edge_statistics, fdr_adjust, in_ranges, percentiles
from orderloom.operators.windows import forward_return
from orderloom.spec import KEY, TS, by_time

#: Poisson(1) distribution function from 0 to 10.
POISSON_1 = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(11)])
ROWS_AT_ONCE = 2048


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: distinct inputs give distinct, well-spread outputs."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def words(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words for each key."""
    with np.errstate(over="ignore"):
        lane = mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return mixed(mixed(keys.view(np.uint64) if keys.dtype == np.int64 else keys)[:, None] + lane[None])


def signs(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """1 or -1 for each key and repetition: a bit each, 64 of a word."""
    bits = np.unpackbits(words(keys, -(-reps // 64), seed).view(np.uint8), axis=1, count=reps)
    return bits.astype(np.float64) * 2 - 1


def uniform(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    return (words(keys, reps, seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson_one(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    return np.searchsorted(POISSON_1, uniform(keys, reps, seed), side="right").astype(np.float64)


def poisson(counts: np.ndarray, keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Poisson(count) for each key: by the distribution function up to 60, by the rounded normal from there on."""
    u = uniform(keys, reps, seed)
    out = np.zeros_like(u)
    few = counts <= 60
    n = counts[few][:, None].astype(np.float64)
    if few.any():
        p = np.exp(-n)
        total, k, mine = p.copy(), 0, np.zeros((len(n), reps))
        while (more := u[few] >= total).any() and k < 200:
            k += 1
            p = p * n / k
            mine[more] += 1
            total = total + p
        out[few] = mine
    if not few.all():
        from statistics import NormalDist

        m = counts[~few][:, None].astype(np.float64)
        normal = np.vectorize(NormalDist().inv_cdf)(np.clip(u[~few], 1e-16, 1 - 1e-16))
        out[~few] = np.maximum(np.rint(m + np.sqrt(m) * normal), 0)
    return out


def group_sums(df: DataFrame, by: list[str], values: list[str], draws: Callable[[np.ndarray], np.ndarray], parts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """by, sums: of each group the array of parts(values, draws) added over its rows. df has the columns by, values and _k, the row's hash.

    parts gets (row, value) and (row, repetition) and gives (row, number). A task keeps one array for each group that it meets.
    """
    keys = df.select(*by, "_k", *[F.col(v).cast("double").alias(v) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
                code = {g: i for i, g in enumerate(dict.fromkeys(rows))}
                own = np.array([code[g] for g in rows])
                order = np.argsort(own, kind="stable")
                v = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in values], 1)
                each = parts(v, draws(batch.column("_k").to_numpy(zero_copy_only=False)))[order]
                total = np.add.reduceat(each, np.searchsorted(own[order], np.arange(len(code))), axis=0)
                for g, i in code.items():
                    held[g] = held[g] + total[i] if g in held else total[i]
        if held:
            columns = [pa.array([g[i] for g in held], batch.schema.field(c).type) for i, c in enumerate(by)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], [*by, "sums"])

    kinds = dict(keys.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "sums array<double>"])
    partial = keys.mapInArrow(run, schema)

    def added(table: pa.Table) -> pa.Table:  # a row for each task that met the group
        flat = table.column("sums").combine_chunks()
        total = flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(0)
        return pa.table([*(table.column(c).slice(0, 1) for c in by), pa.array([total], pa.list_(pa.float64()))], names=[*by, "sums"])

    return partial.groupBy(*by).applyInArrow(added, schema)


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def permutation_null(pairs: DataFrame, reps: int = 200, seed: int = 7) -> DataFrame:
    """feature, observed, p: the mean of sign(x) * y, and the share of random signs whose mean is as large, the observed one among them."""
    rows = pairs.select("feature", row_hash(KEY, TS).alias("_k"), (F.signum("x") * F.col("y")).alias("s"))
    sums = group_sums(rows, ["feature"], ["s"], lambda k: signs(k, reps, seed), lambda v, d: np.concatenate([np.ones_like(v), v, v * d], 1))
    n, observed, drawn = F.get("sums", F.lit(0)), F.get("sums", F.lit(1)), F.slice("sums", 3, reps)
    as_large = F.size(F.filter(drawn, lambda x: F.abs(x) >= F.abs(observed) * (1 - 1e-12)))
    return sums.select("feature", (observed / n).alias("observed"), ((as_large + 1) / (reps + 1)).alias("p"))


def interval(statistics: Column, ci: float) -> list[Column]:
    """Interpolated percentiles of an array of repetitions (NaN and nulls left out): low, high."""
    some = F.array_sort(F.filter(statistics, lambda x: x.isNotNull() & ~F.isnan(x)))

    def at(p: float) -> Column:
        place = (F.size(some) - 1) * F.lit(p)
        low, high = F.get(some, F.floor(place).cast("int")), F.get(some, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return [at((1 - ci) / 2).alias("low"), at((1 + ci) / 2).alias("high")]


def bootstrap_mean(df: DataFrame, column: str, *by: str, reps: int = 200, ci: float = 0.9, seed: int = 7) -> DataFrame:
    """by, low, high of the mean: each row has a Poisson(1) weight in each repetition. Nulls are left out."""
    rows = df.where(F.col(column).isNotNull()).select(*by, row_hash(KEY, TS).alias("_k"), F.col(column).alias("v"))
    sums = group_sums(rows, list(by), ["v"], lambda k: poisson_one(k, reps, seed), lambda v, d: np.concatenate([d, v * d], 1))
    means = F.zip_with(F.slice("sums", 1, reps), F.slice("sums", reps + 1, reps), lambda w, s: F.when(w > 0, s / w))
    return sums.withColumn("_r", means).select(*by, *interval(F.col("_r"), ci))


def bootstrap_sharpe(df: DataFrame, column: str, *by: str, reps: int = 200, ci: float = 0.9, seed: int = 7, year: float = 252.0) -> DataFrame:
    """by, low, high of the yearly Sharpe ratio of day means: whole days are drawn, so what hangs together within a day stays together."""
    days = df.where(F.col(column).isNotNull()).groupBy(*by, F.to_date(TS).alias("_d")).agg(F.avg(column).alias("v"))
    days = days.select(*by, row_hash(*by, "_d").alias("_k"), "v")
    sums = group_sums(days, list(by), ["v"], lambda k: poisson_one(k, reps, seed), lambda v, d: np.concatenate([d, v * d, v * v * d], 1))
    part = lambda i: F.slice("sums", i * reps + 1, reps)
    ratio = lambda w, z: F.when((w > 1) & (z["q"] - z["s"] * z["s"] / w > 1e-18), z["s"] / w / F.sqrt((z["q"] - z["s"] * z["s"] / w) / (w - 1)) * F.sqrt(F.lit(year)))
    both = F.zip_with(part(1), part(2), lambda s, q: F.struct(s.alias("s"), q.alias("q")))
    return sums.withColumn("_r", F.zip_with(part(0), both, ratio)).select(*by, *interval(F.col("_r"), ci))


def bootstrap_auc(df: DataFrame, score: str, label: str, reps: int = 200, ci: float = 0.9, seed: int = 7, buckets: int = 64) -> DataFrame:
    """auc, low, high: area under the curve of the rows and of repetitions, in which the rows of one score and label together have a Poisson weight.

    Rows are counted by score first. Scores are cut into ranges; a task gives a range's weights and the pairs in order
    within it, three arrays, and ranges, a few dozen, are put together at the end.
    """
    some = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(F.col(score).cast("double").alias("v"), (F.col(label) == 1).alias("l"))
    n = some.groupBy("v").agg(F.sum(F.col("l").cast("bigint")).alias("p"), F.sum((~F.col("l")).cast("bigint")).alias("q"))
    n = in_ranges(staged(n, "scores"), ["v"], buckets=buckets).select("_b0", "v", "p", "q", F.xxhash64("v").alias("_k"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        k = table.column("_k").to_numpy()
        weights = []
        for side, column in enumerate(("p", "q")):
            c = table.column(column).to_numpy()
            weights.append(np.concatenate([c[:, None].astype(np.float64), poisson(c, k, reps, seed * 2 + side)], 1))
        p, q = weights
        below = np.cumsum(q, axis=0) - q
        arrays = [p.sum(0), q.sum(0), (p * (below + q / 2)).sum(0)]
        return pa.table({"_b0": table.column("_b0").slice(0, 1), **{c: pa.array([a], pa.list_(pa.float64())) for c, a in zip("pqw", arrays, strict=True)}})

    ranges = n.groupBy("_b0").applyInArrow(run, "_b0 int, p array<double>, q array<double>, w array<double>").orderBy("_b0").collect()
    if not ranges:
        return df.sparkSession.createDataFrame([], "auc double, low double, high double")
    p, q, w = (np.array([r[c] for r in ranges]) for c in "pqw")
    below = np.cumsum(q, axis=0) - q
    area = (w + p * below).sum(0)
    pairs = p.sum(0) * q.sum(0)
    values = np.divide(area, pairs, out=np.full(reps + 1, np.nan), where=pairs > 0)
    drawn = values[1:][~np.isnan(values[1:])]
    low, high = (float(np.quantile(drawn, x)) if len(drawn) else None for x in ((1 - ci) / 2, (1 + ci) / 2))
    return df.sparkSession.createDataFrame([(None if np.isnan(values[0]) else float(values[0]), low, high)], "auc double, low double, high double")


CELL = ["zone", "event", "filter", "horizon"]


def grid_trades(df: DataFrame, zone: str, events: dict[str, Column], filters: dict[str, tuple[Column, int]], horizons: list[int], train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """zone, event, filter, horizon, split, symbol, time, ret: a row for each cell that a bar belongs to, ret in the filter's direction.

    split is train, validation or holdout by time; bars whose longest horizon ends in a later split are left out.
    """
    for h in horizons:
        df = forward_return(df, h)
    df = df.withColumn("_u", F.unix_micros(F.col(TS).cast("timestamp"))).withColumn("_end", F.lead("_u", max(horizons)).over(by_time()))
    df = staged(df.select(KEY, TS, "_u", "_end", F.col(zone).alias("zone"), *[c.alias(f"_e_{n}") for n, c in events.items()], *[c.alias(f"_f_{n}") for n, (c, _) in filters.items()], *[f"fwd_ret_{h}" for h in horizons]), "grid")
    cuts = percentiles(df, "_u", [train, train + validation]).select(F.col("p0").alias("_c0"), F.col("p1").alias("_c1"))
    x = df.crossJoin(F.broadcast(cuts))  # one row
    split = F.when(F.col("_u") < F.col("_c0"), "train").when(F.col("_u") < F.col("_c1"), "validation").otherwise("holdout")
    x = x.withColumn("split", split).where(~((F.col("_u") < F.col("_c0")) & (F.col("_end") >= F.col("_c0"))) & ~((F.col("_u") < F.col("_c1")) & (F.col("_end") >= F.col("_c1"))))
    cells = [F.when(F.col(f"_e_{e}") & F.col(f"_f_{f}"), F.struct(F.lit(e).alias("event"), F.lit(f).alias("filter"), F.lit(side).alias("side"))) for e in events for f, (_, side) in filters.items()]
    returns = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_ret_{h}").alias("r")) for h in horizons])
    x = x.where("zone is not null").select(KEY, TS, "zone", "split", returns.alias("_r"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("_c"))
    x = x.select(KEY, TS, "zone", "split", "_c.*", F.explode("_r").alias("_r")).where("_r.r is not null")
    return x.select("zone", "event", "filter", F.col("_r.horizon").alias("horizon"), "split", KEY, TS, (F.col("_r.r") * F.col("side")).alias("ret"))


def edge_grid(trades: DataFrame, least: int = 20, least_days: int = 5, reps: int = 200, alpha: float = 0.05, permuted: float = 0.10, least_t: float = 1.0, seed: int = 7) -> DataFrame:
    """Of each cell with enough trades in training: its statistics, adjusted p, permutation p, family p, t of validation and holdout, and
    the last stage it passes: none, fdr, permutation, validation, holdout.

    The permutation signs whole bars, the same in all cells: p_permutation compares a cell with itself, p_family with the
    largest of all cells, each cell's sum over the root of its sum of squares, which signs leave as it is.
    """
    trades = staged(trades, "grid-trades")
    stats = staged(edge_statistics(trades, *CELL, "split"), "grid-statistics")
    train = stats.where((F.col("split") == "train") & (F.col("n") >= least) & (F.col("days") >= least_days)).drop("split", "stable", "t_first", "t_second")
    train = fdr_adjust(train.withColumn("p", F.coalesce("p_value", F.lit(1.0))).withColumn("name", F.concat_ws("|", *CELL)), alpha).drop("name", "p")
    rows = trades.where("split = 'train'").join(train.select(*CELL), CELL, "left_semi").select(*CELL, row_hash(KEY, TS).alias("_k"), "ret")
    sums = group_sums(rows, CELL, ["ret"], lambda k: signs(k, reps, seed), lambda v, d: np.concatenate([v, v * v, v * d], 1))
    root = F.greatest(F.sqrt(F.get("sums", F.lit(1))), F.lit(1e-300))
    z = sums.select(*CELL, (F.abs(F.get("sums", F.lit(0))) / root).alias("z"), F.transform(F.slice("sums", 3, reps), lambda x: F.abs(x) / root).alias("_z"))
    z = staged(z, "grid-permuted")
    most = z.select(F.posexplode("_z").alias("rep", "x")).groupBy("rep").agg(F.max("x").alias("m")).agg(F.collect_list("m").alias("_m"))  # reps numbers
    share = lambda drawn: (F.size(F.filter(drawn, lambda x: x >= F.col("z") * (1 - 1e-12))) + 1) / F.lit(reps + 1)
    z = z.crossJoin(F.broadcast(most)).select(*CELL, share(F.col("_z")).alias("p_permutation"), share(F.col("_m")).alias("p_family"))
    out = train.join(z, CELL)
    for split in ("validation", "holdout"):
        out = out.join(stats.where(F.col("split") == split).select(*CELL, F.col("t_value").alias(f"t_{split}"), F.col("mean_units").alias(f"mean_{split}")), CELL, "left")
    holds = lambda s: F.coalesce((F.signum(f"mean_{s}") == F.signum("mean_units")) & (F.abs(f"t_{s}") >= least_t), F.lit(False))
    steps = [F.col("rejected"), F.col("p_permutation") < permuted, holds("validation"), holds("holdout")]
    names = ["fdr", "permutation", "validation", "holdout"]
    stage = reduce(lambda done, i: F.when(reduce(lambda a, b: a & b, steps[: i + 1]), names[i]).otherwise(done), range(4), F.lit("none"))
    return out.withColumn("stage", stage)
