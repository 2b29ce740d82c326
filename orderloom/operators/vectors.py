"""Anomalies among vectors: distance under the full covariance, and exact distance to the k-th nearest other vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.stage import staged
from orderloom.operators.stats import percentiles

#: A block, what one task holds of either side: a share of the rows, so that the shuffle of all pairs of blocks is so many copies of
#: the rows at most; not under so many rows, and not over so many numbers, beyond which the number of blocks grows.
BLOCKS, BLOCK_ROWS, BLOCK_NUMBERS = 16, 512, 1 << 23
#: Rows of either side whose distances are worked out at once.
TILE = 1024, 4096
#: Candidates a row of a tile up to which each one is worked out by itself.
FEW = 16


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column, none null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def whole_vectors(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """_row (a number of its own for each row), key, x: vectors of the most frequent dimension without null or non-finite components."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite)
    d = good.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    good = good.where(F.size(column) == (d.d if d else 0))
    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"  # floats stay as small as they are
    return staged(good.select(F.monotonically_increasing_id().alias("_row"), key, F.col(column).cast(kind).alias("x")), "vectors")


def summed(rows: DataFrame, d: int, part) -> np.ndarray:
    """The sum of part(matrix), an array of a fixed size, over all rows: added up in tasks, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix_of(batch.column("x"), d)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    found = rows.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # one number a place
    out = np.zeros(len(found))
    for at, v in found:
        out[at] = v
    return out


def whitening(cov: np.ndarray, regularization: float) -> np.ndarray:
    """W with W' W = inverse of the regularised covariance (its pseudo-inverse if it is not positive)."""
    cov = cov + regularization * np.eye(len(cov))
    try:
        return np.linalg.inv(np.linalg.cholesky(cov))
    except np.linalg.LinAlgError:
        values, axes = np.linalg.eigh(cov)
        some = values > 1e-12 * max(values.max(), 1e-300)
        return (axes[:, some] / np.sqrt(values[some])).T


def smallest(d: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of each row in order (fewer if there are fewer)."""
    k = min(k, d.shape[1])
    return np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1) if k else np.zeros((len(d), 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b; equal rows have exactly 0."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    near = square < 1e-6 * ((a * a).sum(1)[:, None] + 1e-300)  # cancelled: worked out from the differences
    out = np.sqrt(np.maximum(square, 0))
    i, j = np.nonzero(near)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(1))
    return out


def closest(a: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray, same: bool = False) -> np.ndarray:
    """For each row of a its k smallest distances to rows of b, infinite where those are not below its bound; a tile at a time.

    same: b is a, and no row is its own neighbour.
    """
    best, limit = np.full((len(a), k), np.inf), bound.astype(np.float64)
    aa, bb, twice = (a * a).sum(1), (b * b).sum(1), (-2 * b).T
    for i in range(0, len(a), TILE[0]):
        here = slice(i, min(i + TILE[0], len(a)))
        for j in range(0, len(b), TILE[1]):
            there = slice(j, min(j + TILE[1], len(b)))
            square = a[here] @ twice[:, there]
            square += bb[there]
            if same:
                at = np.arange(max(here.start, j), min(here.stop, there.stop))
                square[at - i, at - j] = np.inf
            # squares under the limit's, without aa; what cancels may be off by so much
            row, other = np.nonzero(square < (limit[here] ** 2 * (1 + 1e-9) - aa[here] + 1e-12 * (aa[here] + bb[there].max()))[:, None])
            if len(row) <= FEW * len(square):  # worked out from the differences
                d = np.sqrt(((a[i + row] - b[j + other]) ** 2).sum(1))
                order = np.lexsort((d, row))
                row, d = row[order], d[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                some = np.unique(row)
                new = np.full((len(square), k), np.inf)
                new[row[rank < k], rank[rank < k]] = d[rank < k]
                new = new[some]
            else:
                some = np.unique(row)
                new = distances(a[i + some], b[there])
                new[np.isinf(square[some])] = np.inf
            best[i + some] = smallest(np.hstack([best[i + some], new]), k)
            limit[i + some] = np.minimum(limit[i + some], best[i + some, k - 1])
    best[best >= bound[:, None]] = np.inf
    return best


def nearest(rows: DataFrame, mean: np.ndarray, k: int = 5, block_rows: int | None = None) -> DataFrame:
    """_row, near: the k smallest distances to other rows, exactly.

    Blocks are ranges of the distance from the mean, those of many rows cut by a hash. Within its block each row finds a bound
    on its k-th distance; as two distances from the mean differ by no more than the rows' own distance, a block meets only blocks
    of ranges within its largest bound. Each pair of blocks is one task, and gives only distances below a row's bound. All pairs take
    rows^2 distances where bounds exclude nothing; the shuffle is 2 * BLOCKS times the rows until a block has BLOCK_NUMBERS numbers.
    """
    spark, d, kind = rows.sparkSession, len(mean), dict(rows.dtypes)["x"]
    n = rows.count()
    block_rows = block_rows or max(1, min(max(BLOCK_ROWS, -(-n // BLOCKS)), BLOCK_NUMBERS // max(d, 1)))

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.sqrt(((matrix_of(batch.column("x"), d) - mean) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("x"), pa.array(r)], ["_row", "x", "r"])

    x = rows.select("_row", "x").mapInArrow(radius, f"_row bigint, x {kind}, r double")
    ranges = max(1, -(-n // block_rows))
    edges = [] if ranges == 1 else sorted(set(x.agg(F.percentile_approx("r", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]))  # a number a block
    shared = F.broadcast(spark.createDataFrame([(edges,)], "e array<double>"))
    place = lambda v, strict: F.size(F.filter("e", (lambda t: t < v) if strict else (lambda t: t <= v)))
    x = x.crossJoin(shared).withColumn("range", place(F.col("r"), True)).drop("e")
    parts = staged(x.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")), "vector-ranges")
    x = x.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int"))  # a row a range
    x = x.select("_row", "x", "r", "range", "part")

    def own(table: pa.Table) -> pa.Table:
        m = matrix_of(table.column("x").combine_chunks(), d)
        best = closest(m, m, k, np.full(len(m), np.inf), same=True)
        near = best[:, : max(0, min(k, len(m) - 1))]
        return pa.table({"_row": table.column("_row"), "x": table.column("x"), "range": table.column("range"), "part": table.column("part"), "r": table.column("r"), "near": pa.array(list(near), pa.list_(pa.float64())), "bound": pa.array(best[:, k - 1])})

    first = staged(x.groupBy("range", "part").applyInArrow(own, f"_row bigint, x {kind}, range int, part int, r double, near array<double>, bound double"), "vector-near")
    blocks = first.groupBy("range", "part").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.max("bound").alias("bound")).crossJoin(shared)
    slack = F.col("bound") * 1.000001 + 1e-12
    reach = F.explode(F.sequence(place(F.col("low") - slack, True), place(F.col("high") + slack, False))).alias("other_range")
    meets = blocks.select("range", "part", reach).join(F.broadcast(parts.select(F.col("range").alias("other_range"), "parts")), "other_range")
    meets = meets.select("range", "part", "other_range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    meets = staged(meets.where("range <> other_range or part <> other_part"), "vector-meets")
    if meets.isEmpty():
        return first.select("_row", "near")
    key = ["range", "part", "other_range", "other_part"]
    pairs = F.broadcast(meets)  # a row a pair of blocks
    asking = first.join(pairs, ["range", "part"]).select(*key, "_row", "x", "bound")
    asked = first.select(F.col("range").alias("other_range"), F.col("part").alias("other_part"), F.col("x").alias("y")).join(pairs, ["other_range", "other_part"]).select(*key, "y")

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, near = [], []
        if left.num_rows and right.num_rows:
            a, b = matrix_of(left.column("x").combine_chunks(), d), matrix_of(right.column("y").combine_chunks(), d)
            best = closest(a, b, k, left.column("bound").to_numpy())
            some = np.flatnonzero(np.isfinite(best).any(1))
            ids = left.column("_row").to_numpy()[some]
            near = [row[np.isfinite(row)] for row in best[some]]
        return pa.table({"_row": pa.array(ids, pa.int64()), "near": pa.array(near, pa.list_(pa.float64()))})

    more = asking.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(across, "_row bigint, near array<double>")
    every = first.select("_row", "near").unionByName(more)
    return every.groupBy("_row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def vector_anomaly(vectors: DataFrame, k: int = 5, sigma: float = 3.0, quantile: float = 0.99, regularization: float = 1e-6, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, distance, anomaly, knn_distance, knn_anomaly of each whole vector.

    distance: from the mean under the regularised full covariance; anomaly: over the mean distance by sigma deviations.
    knn_distance: to the k-th nearest other vector (the last one if there are fewer, null if there is none); knn_anomaly: over
    the quantile of these. Vectors that are null, of another dimension than most, or hold null or non-finite
    components take no part; repeated rows are neighbours of each other.
    """
    rows = whole_vectors(vectors, column, key)
    kind = dict(vectors.dtypes)[key]
    one = rows.select(F.size("x").alias("d")).first()
    if one is None:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, distance double, anomaly boolean, knn_distance double, knn_anomaly boolean")
    d, n = one.d, rows.count()
    mean = summed(rows, d, lambda m: m.sum(0)) / n
    cov = summed(rows, d, lambda m: (m - mean).T @ (m - mean)).reshape(d, d) / max(n - 1, 1)
    w = whitening(cov, regularization)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.sqrt((((matrix_of(batch.column("x"), d) - mean) @ w.T) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column(key), pa.array(own)], ["_row", key, "distance"])

    far = rows.mapInArrow(whitened, f"_row bigint, {key} {kind}, distance double")
    near = nearest(rows, mean, k).select("_row", F.element_at("near", F.when(F.size("near") > 0, F.size("near"))).alias("knn_distance"))
    both = staged(far.join(near, "_row", "left"), "vector-distances")
    limit = both.agg((F.avg("distance") + sigma * F.stddev_pop("distance")).alias("_l"))
    cut = percentiles(both, "knn_distance", [quantile]).select(F.col("p0").alias("_q"))
    out = both.crossJoin(F.broadcast(limit)).crossJoin(F.broadcast(cut))  # one row each
    return out.select(key, "distance", (F.col("distance") > F.col("_l")).alias("anomaly"), "knn_distance", F.coalesce(F.col("knn_distance") > F.col("_q"), F.lit(False)).alias("knn_anomaly"))
