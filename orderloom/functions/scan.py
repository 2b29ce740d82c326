"""Linear recurrences y_t = A_t y_(t-1) + b_t over bars, for numbers or small vectors, as a scan of affine maps.

Affine maps compose associatively, so a symbol is cut into chunks of time. Within its chunk each row gets the map from the
chunk's beginning up to itself, by doubling steps in numpy over whole Arrow batches, whatever chunks they hold. One row a chunk, its whole map,
goes through the symbol's chunks in order; what comes out is what each chunk starts from. No task sorts or numbers a symbol's
rows: one shuffle by (symbol, chunk), and one of a row for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from orderloom.spec import KEY, TS

#: Seconds of a chunk: a week, 168 rows of hourly bars and 10,080 of one-minute bars.
CHUNK = 7 * 86400
Entry = Column | float


@dataclass
class Recurrence:
    """y = A y + b for the columns `out`. Entries are columns or constants; start is y before a symbol's first row."""

    out: list[str]
    a: list[list[Entry]]
    b: list[Entry]
    start: list[Entry]

    @property
    def size(self) -> int:
        return len(self.out)


def chunk_of(seconds: int = CHUNK) -> Column:
    return F.floor(F.unix_micros(F.col(TS).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def composed(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
    """In place: row by row (a, b) becomes the map of all rows of its run up to itself. place: rows of the run before it."""
    step, most = 1, int(place.max(initial=0))
    while step <= most:
        at = np.flatnonzero(place >= step)
        b[at] = (a[at] @ b[at - step][..., None])[..., 0] + b[at]
        a[at] = a[at] @ a[at - step]
        step *= 2


def _entries(batch: pa.RecordBatch, names: list, shape: tuple[int, ...]) -> np.ndarray:
    """An array (row, *shape) of entries, each a column's name or a constant. Nulls become NaN, which stays."""
    flat = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.float64) if isinstance(x, str) else np.full(batch.num_rows, x) for x in names]
    return np.stack(flat, 1).reshape(batch.num_rows, *shape)


def _local(systems: list[tuple[int, list, list]], entries: set[str], whole: bool):
    """For mapInArrow over rows sorted by (symbol, chunk, time): each row's map from its chunk's beginning, in place of the columns of
    entries; or of each chunk the last row only, with the whole map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carried = None, None
        held, held_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(KEY).to_pylist(), batch.column("_c").to_pylist(), strict=True))
            new = np.array([True, *(p != q for p, q in zip(keys[:-1], keys[1:], strict=True))])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            maps, columns = [], []
            for d, a_names, b_names in systems:
                a, b = _entries(batch, a_names, (d, d)), _entries(batch, b_names, (d,))
                composed(a, b, np.arange(len(new)) - first)
                maps.append((a, b))
            if keys[0] == last_key:  # the chunk began in the batch before
                at = np.flatnonzero(first == 0)
                for (a, b), (ca, cb) in zip(maps, carried, strict=True):
                    b[at] += a[at] @ cb
                    a[at] = a[at] @ ca
            last_key, carried = keys[-1], [(a[-1].copy(), b[-1].copy()) for a, b in maps]
            for (d, _, _), (a, b) in zip(systems, maps, strict=True):
                columns += [a[:, i, j] for i in range(d) for j in range(d)] + [b[:, i] for i in range(d)]
            plain = [c for c in batch.schema.names if c not in entries]
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [pa.array(c) for c in columns], [*plain, *(f"_m{k}" for k in range(len(columns)))])
            if not whole:
                yield out
                continue
            ends = np.flatnonzero(np.append(new[1:], True))
            if held is not None and keys[0] != held_key:
                yield held
            held, held_key = out.slice(len(new) - 1, 1), keys[-1]
            if len(ends) > 1:
                yield out.take(pa.array(ends[:-1]))
        if held is not None:
            yield held

    return run


def _brought(sizes: list[int]):
    """For applyInArrow by symbol: from the maps of its chunks in order, what each chunk starts from."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_c")
        column = lambda x: table.column(x).to_numpy(zero_copy_only=False).astype(np.float64)
        out, k, s = [], 0, 0
        for d in sizes:
            a = np.stack([column(f"_m{k + i}") for i in range(d * d)], 1).reshape(-1, d, d)
            b = np.stack([column(f"_m{k + d * d + i}") for i in range(d)], 1)
            y, rows = np.array([column(f"_s{s + i}")[0] for i in range(d)]), np.empty((len(a), d))
            for i in range(len(a)):
                rows[i] = y
                y = a[i] @ y + b[i]
            out += [rows[:, i] for i in range(d)]
            k, s = k + d * d + d, s + d
        return pa.table([table.column(KEY), table.column("_c"), *(pa.array(c) for c in out)], names=[KEY, "_c", *(f"_y{i}" for i in range(len(out)))])

    return run


def scan(df: DataFrame, recurrences: list[Recurrence], seconds: int = CHUNK, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds the columns of all recurrences; they share the passes over the rows. Rows of one time go by `order`. Where an entry is null, y
    is null from there on.
    """
    x, systems, n_a, n_b, starts = df.withColumn("_c", chunk_of(seconds)), [], 0, 0, {}
    added: dict[str, Column] = {}
    for r in recurrences:
        a_names, b_names = [], []
        for e in (e for row in r.a for e in row):
            if isinstance(e, Column):
                added[f"_a{n_a}"] = e.cast("double")
            a_names.append(f"_a{n_a}" if isinstance(e, Column) else float(e))
            n_a += 1
        for e in r.b:
            if isinstance(e, Column):
                added[f"_b{n_b}"] = e.cast("double")
            b_names.append(f"_b{n_b}" if isinstance(e, Column) else float(e))
            n_b += 1
        for e in r.start:
            starts[f"_s{len(starts)}"] = e.cast("double") if isinstance(e, Column) else F.lit(float(e))
        systems.append((r.size, a_names, b_names))
    x = x.withColumns(added | starts).repartition(KEY, "_c").sortWithinPartitions(KEY, "_c", TS, *order)
    sizes = [d for d, _, _ in systems]
    n_maps = sum(d * d + d for d in sizes)
    plain = [f for f in x.schema.fields if f.name not in added]
    schema = StructType(list(plain))
    for k in range(n_maps):
        schema = schema.add(f"_m{k}", DoubleType())
    local = x.mapInArrow(_local(systems, set(added), False), schema).drop(*starts)
    slim = x.select(KEY, "_c", TS, *order, *added)
    head_schema = StructType([f for f in slim.schema.fields if f.name not in added])
    for k in range(n_maps):
        head_schema = head_schema.add(f"_m{k}", DoubleType())
    heads = slim.mapInArrow(_local(systems, set(added), True), head_schema)
    begun = x.groupBy(KEY, "_c").agg(*[F.min_by(c, F.struct(TS, *order)).alias(c) for c in starts])
    in_schema = StructType([f for f in heads.schema.fields if f.name == KEY]).add("_c", LongType())
    for k in range(sum(sizes)):
        in_schema = in_schema.add(f"_y{k}", DoubleType())
    brought = heads.join(begun, [KEY, "_c"]).groupBy(KEY).applyInArrow(_brought(sizes), in_schema)
    out, k, s = [], 0, 0
    for r in recurrences:
        d = r.size
        for i, name in enumerate(r.out):
            y = sum((F.col(f"_m{k + i * d + j}") * F.col(f"_y{s + j}") for j in range(d)), F.col(f"_m{k + d * d + i}"))
            out.append(F.when(F.isnan(y), None).otherwise(y).alias(name))
        k, s = k + d * d + d, s + d
    return local.join(brought, [KEY, "_c"]).select(*df.columns, *out)


def affine_scans(df: DataFrame, steps: dict[str, tuple[Entry, Entry]], seconds: int = CHUNK) -> DataFrame:
    """Adds for each name y of its (a, b), y before the first row being 0."""
    return scan(df, [Recurrence([name], [[a]], [b], [0.0]) for name, (a, b) in steps.items()], seconds)


def affine_scan(df: DataFrame, a: Entry, b: Entry, out: str, seconds: int = CHUNK) -> DataFrame:
    """Adds `out`: y of each row, y before the first row being 0."""
    return affine_scans(df, {out: (a, b)}, seconds)


def ewms(df: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Exponential means (column, alpha) that start at the first value."""
    return scan(df, [Recurrence([out], [[1 - alpha]], [alpha * F.col(c)], [F.col(c)]) for out, (c, alpha) in means.items()])


def ewm(df: DataFrame, column: str, alpha: float, out: str) -> DataFrame:
    """Exponential mean that starts at the first value."""
    return ewms(df, {out: (column, alpha)})


def numbered(df: DataFrame, out: str, seconds: int = CHUNK, by: tuple[str, ...] = (KEY,), order: tuple[str, ...] = ()) -> DataFrame:
    """Adds the number of each row of its group in time (and `order`), from 1: counts of chunks are added up, rows are numbered within theirs."""
    x = df.withColumn("_c", chunk_of(seconds))
    counts = x.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*by, "_c", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    return x.join(before, [*by, "_c"]).withColumn(out, F.col("_p") + F.row_number().over(Window.partitionBy(*by, "_c").orderBy(TS, *order))).drop("_c", "_p")


#: Rows of a block of `in_blocks`.
BLOCK_ROWS = 8192


def in_blocks(df: DataFrame, back: int, by: tuple[str, ...] = (KEY,), order: tuple[str, ...] = ("seq",), rows: int | None = None) -> tuple[DataFrame, object, Column]:
    """(rows, window, own): windows that look at most `back` rows back, without a task that holds a group.

    A group's rows are numbered and cut into blocks; the last `back` rows of a block also stand before the next one. The
    window orders a block; figures over it count where `own` holds, which leaves each row once. Adds _block and _i.
    """
    rows = max(rows or BLOCK_ROWS, back)
    x = numbered(df, "_i", 86400, by, order)
    at, block = (F.col("_i") - 1) % rows, F.floor((F.col("_i") - 1) / rows)
    x = x.withColumn("_own", block).withColumn("_block", F.explode(F.when(at >= rows - back, F.array(block, block + 1)).otherwise(F.array(block))))
    return x, Window.partitionBy(*by, "_block").orderBy("_i"), F.col("_own") == F.col("_block")
