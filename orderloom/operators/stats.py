"""Feature evaluation statistics and data-quality monitors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.stage import staged
from orderloom.operators.windows import forward_return
from orderloom.spec import KEY, TS, by_time


def cumulated(df: DataFrame, value: str, *by: str, buckets: int = 64) -> DataFrame:
    """by, value, _n (rows with the value), _before (rows of the group below it), for each distinct value.

    Rows are counted by value first. Approximate percentiles of the distinct values, a few numbers a group, cut them into
    ranges: totals of ranges add up over groups, counts within a range over its values. So no task holds a whole group, and
    the result is exact.
    """
    by = by or ("_all",)
    rows = df.withColumn("_all", F.lit(0)) if by == ("_all",) else df
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    edges = n.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000)).alias("_e"))
    n = n.join(edges, list(by)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    totals = n.groupBy(*by, "_b").agg(F.sum("_n").alias("_t"))
    ranges = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", F.coalesce(F.sum("_t").over(ranges), F.lit(0)).alias("_p"))
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_p") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return n.join(totals, [*by, "_b"]).withColumn("_before", before).drop("_b", "_p")


def in_ranges(df: DataFrame, columns: list[str], *by: str, buckets: int = 64) -> DataFrame:
    """Adds _b0, _b1, ...: for each column the range of its value within the group.

    Approximate percentiles of each group, one small row, are the edges. Ranges between two edges are even numbers; a value
    equal to an edge has the odd one of its own, so a value that many rows share is alone in its range.
    """
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.groupBy(*by).agg(*[F.array_distinct(F.percentile_approx(c, cuts, F.lit(1000))).alias(f"_e{i}") for i, c in enumerate(columns)])
    # a row for each group of the result, some kilobytes each: groups are features, horizons and the like
    out = df.join(F.broadcast(edges), list(by)) if by else df.crossJoin(F.broadcast(edges))
    place = lambda e, v: 2 * F.size(F.filter(e, lambda x: x < F.col(v))) + F.array_contains(e, F.col(v)).cast("int")
    return out.withColumns({f"_b{i}": place(f"_e{i}", c) for i, c in enumerate(columns)}).drop(*[f"_e{i}" for i in range(len(columns))])


def with_ranks(df: DataFrame, columns: dict[str, str], *by: str, buckets: int = 64) -> DataFrame:
    """Adds for each column (the key, none null) its rank within the groups under another name, ties sharing their mean rank.

    Rows are ordered within ranges only; rows below a range are counts. The rows of a value that is an edge need no order, so
    they are dealt over tasks however many they are.
    """
    values = list(columns)
    rows = in_ranges(df, values, *by, buckets=buckets)
    each = range(len(values))
    counts = rows.groupBy(*by, *[f"_b{i}" for i in each]).agg(F.count(F.lit(1)).alias("_n"))  # some thousands of rows a group at most
    out = rows
    for i, value in enumerate(values):
        key = [*by, f"_b{i}"]
        total = counts.groupBy(*key).agg(F.sum("_n").alias(f"_t{i}"))
        below = Window.partitionBy(*by).orderBy(f"_b{i}").rowsBetween(Window.unboundedPreceding, -1)
        total = total.withColumn(f"_p{i}", F.coalesce(F.sum(f"_t{i}").over(below), F.lit(0)))
        out = out.join(F.broadcast(total), key)
        alone = F.col(f"_b{i}") % 2 == 1
        part = [*key, F.when(alone, F.pmod(F.xxhash64(*df.columns), F.lit(buckets))).otherwise(F.lit(0))]
        inside = F.rank().over(Window.partitionBy(*part).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, value)) - 1) / 2
        rank = F.col(f"_p{i}") + F.when(alone, (F.col(f"_t{i}") + 1) / 2).otherwise(inside)
        out = out.withColumn(columns[value], rank.cast("double")).drop(f"_t{i}", f"_p{i}")
    return out.select(*df.columns, *columns.values())


def with_places(df: DataFrame, value: str, ties: list[str], out: str, *by: str, buckets: int = 64) -> DataFrame:
    """Adds the number of each row in its group by (value, ties), from 1, and _size, the rows of the group. ties[0] is a time.

    As with_ranks; the rows of a value that is an edge are cut further by weeks of the time.
    """
    week = F.floor(F.unix_micros(F.col(ties[0]).cast("timestamp")) / F.lit(7 * 86_400_000_000))
    rows = in_ranges(df, [value], *by, buckets=buckets).withColumn("_w", F.when(F.col("_b0") % 2 == 1, week).otherwise(F.lit(0)))
    counts = rows.groupBy(*by, "_b0", "_w").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_b0", "_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_b0", "_w", before.alias("_p"), F.sum("_n").over(whole).alias("_size"))
    rows = rows.join(counts, [*by, "_b0", "_w"])
    inside = F.row_number().over(Window.partitionBy(*by, "_b0", "_w").orderBy(value, *ties))
    return rows.withColumn(out, F.col("_p") + inside).select(*df.columns, out, "_size")


def in_time_order(df: DataFrame, out: str, *by: str) -> DataFrame:
    """Adds the number of each row in its group by (time, symbol), from 1, and _size: weeks are counted, rows numbered within theirs."""
    x = df.withColumn("_w", F.floor(F.unix_micros(F.col(TS).cast("timestamp")) / F.lit(7 * 86_400_000_000)))
    counts = x.groupBy(*by, "_w").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_w", before.alias("_p"), F.sum("_n").over(whole).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(*by, "_w").orderBy(TS, KEY))
    return x.join(counts, [*by, "_w"]).withColumn(out, F.col("_p") + inside).drop("_w", "_p")


def percentiles_of(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, n, p0, p1, ...: the interpolated percentiles of each column (nulls and NaN left out), from counts by value; no row for a column of nulls."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null and not isnan(value)")
    c = cumulated(long, "value", "column")
    total = c.groupBy("column").agg(F.sum("_n").alias("_all"))
    c = c.join(F.broadcast(total), "column")  # a row a column
    out = [F.max("_all").alias("n")]
    for i, p in enumerate(shares):
        place = (F.col("_all") - 1) * p
        at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("value")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(f"p{i}"))
    return c.groupBy("column").agg(*out)


def percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: p0, p1, ... the interpolated percentiles of a column (nulls left out), n, from counts by value."""
    return percentile_row(df, {value: shares}).select(F.col(f"{value}_n").alias("n"), *[F.col(f"{value}_p{i}").alias(f"p{i}") for i in range(len(shares))])


def percentile_row(df: DataFrame, wanted: dict[str, list[float]]) -> DataFrame:
    """One row: of each column its percentiles as <column>_p0, ... and <column>_n (0 without values)."""
    shares = sorted({p for own in wanted.values() for p in own})
    rows = percentiles_of(df, list(wanted), shares)
    pick = lambda c, x: F.max(F.when(F.col("column") == c, F.col(x)))
    out = [pick(c, f"p{shares.index(p)}").alias(f"{c}_p{i}") for c, own in wanted.items() for i, p in enumerate(own)]
    return rows.agg(*out, *[F.coalesce(pick(c, "n"), F.lit(0)).alias(f"{c}_n") for c in wanted])


def long_pairs(df: DataFrame, features: list[str], horizons: list[int], extra: list[str] | None = None) -> DataFrame:
    """A row for each (feature, horizon, bar) with x and the forward return y, nulls left out."""
    extra = extra or []
    for h in horizons:
        df = forward_return(df, h)
    x = df.select(KEY, TS, *extra, *[F.col(f).cast("double").alias(f) for f in features], *[f"fwd_ret_{h}" for h in horizons])
    x = x.unpivot([KEY, TS, *extra, *[f"fwd_ret_{h}" for h in horizons]], features, "feature", "x")
    y = x.unpivot([KEY, TS, *extra, "feature", "x"], [f"fwd_ret_{h}" for h in horizons], "horizon", "y")
    y = y.where("x is not null and y is not null").withColumn("horizon", F.regexp_extract("horizon", r"([0-9]+)$", 1).cast("int"))
    return staged(y, "pairs")  # edges, counts and ranks each read them


def rank_correlation(pairs: DataFrame, *by: str, least: int = 30) -> DataFrame:
    """Spearman and Pearson of x and y in each group; 0 where either is constant, no row below `least` pairs."""
    r = with_ranks(pairs, {"x": "rx", "y": "ry"}, *by)
    flat = (F.stddev_pop("x") == 0) | (F.stddev_pop("y") == 0)
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(flat, 0.0).otherwise(F.corr("rx", "ry")).alias("spearman"), F.when(flat, 0.0).otherwise(F.corr("x", "y")).alias("pearson"))
    return out.where(F.col("n") >= least)


def block_stability(pairs: DataFrame, blocks: int = 8) -> DataFrame:
    """Spearman on consecutive blocks of each (feature, horizon): mean, deviation and share of one sign."""
    b = in_time_order(pairs, "_i", "feature", "horizon")
    b = staged(b.withColumn("block", F.floor((F.col("_i") - 1) * blocks / F.col("_size")).cast("int")).drop("_i", "_size"), "blocks")
    ic = rank_correlation(b, "feature", "horizon", "block")
    return ic.groupBy("feature", "horizon").agg(F.avg("spearman").alias("mean_ic"), F.stddev_samp("spearman").alias("std_ic"), F.avg((F.col("spearman") > 0).cast("double")).alias("positive_share"))


def walk_forward(pairs: DataFrame, windows: int = 8, least: int = 30) -> DataFrame:
    """Spearman on each window after the first, of equal numbers of rows in time order: mean, deviation, share of windows with
    the mean's sign (0.5 for a mean of nothing), number of windows; no row with fewer than three.
    """
    b = in_time_order(pairs, "_i", "feature", "horizon")
    step = F.greatest(F.floor(F.col("_size") / windows), F.lit(1))
    b = staged(b.withColumn("block", F.floor((F.col("_i") - 1) / step).cast("int")).drop("_i", "_size"), "windows")
    ic = rank_correlation(b.where((F.col("block") > 0) & (F.col("block") < windows)), "feature", "horizon", "block", least=least)
    m = ic.withColumn("_m", F.avg("spearman").over(Window.partitionBy("feature", "horizon")))
    same = F.when(F.abs("_m") <= 1e-9, 0.5).otherwise((F.signum("spearman") == F.signum("_m")).cast("double"))
    out = m.groupBy("feature", "horizon").agg(F.avg("spearman").alias("mean_ic"), F.stddev_samp("spearman").alias("std_ic"), F.avg(same).alias("same_sign"), F.count(F.lit(1)).alias("windows"))
    return out.where("windows >= 3")


def cost_adjusted(pairs: DataFrame, cost: float) -> DataFrame:
    return pairs.withColumn("y", F.when(F.abs("y") <= 2 * cost, 0.0).otherwise(F.col("y")))


def horizon_decay(ic: DataFrame) -> DataFrame:
    """Fall of |IC| from the shortest to the longest horizon."""
    return ic.groupBy("feature").agg((F.abs(F.min_by("spearman", "horizon")) - F.abs(F.max_by("spearman", "horizon"))).alias("decay"))


def fdr_adjust(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p and the rejection set, over the small table of tests."""
    n = p.agg(F.count(F.lit(1)).alias("_n"))
    r = p.crossJoin(F.broadcast(n)).withColumn("_r", F.row_number().over(Window.orderBy("p", "name")))
    adj = F.min(F.col("p") * F.col("_n") / F.col("_r")).over(Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("p_adjusted", F.least(adj, F.lit(1.0))).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_n", "_r")


def mutual_information(pairs: DataFrame, bins: int = 20, *by: str) -> DataFrame:
    """Information in nats between quantile bins of x and y in each group."""
    by = by or ("feature", "horizon")
    q = pairs
    for c in ("x", "y"):
        q = with_places(q, c, [TS, KEY], "_i", *by)
        large, short = F.col("_size") % bins, F.floor(F.col("_size") / bins)  # the first bins are one row larger
        at = F.when(F.col("_i") <= large * (short + 1), F.ceil(F.col("_i") / (short + 1))).otherwise(large + F.ceil((F.col("_i") - large * (short + 1)) / F.greatest(short, F.lit(1))))
        q = q.withColumn(f"b{c}", at).drop("_i", "_size")
    n = q.groupBy(*by, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    total, nx, ny = F.sum("n").over(w), F.sum("n").over(Window.partitionBy(*by, "bx")), F.sum("n").over(Window.partitionBy(*by, "by"))
    return n.withColumn("t", F.col("n") / total * F.log(F.col("n") * total / (nx * ny))).groupBy(*by).agg(F.sum("t").alias("mutual_information"))


def lag_autocorrelation(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(KEY, TS, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([KEY, TS], columns, "feature", "x")
    w = Window.partitionBy("feature", KEY).orderBy(TS)
    return long.withColumn("p", F.lag("x").over(w)).where("p is not null").groupBy("feature").agg(F.corr("x", "p").alias("autocorrelation"))


def shift_leak(df: DataFrame, features: list[str], horizon: int, shifts: tuple[int, ...] = (-1, 0, 1, 5)) -> DataFrame:
    """IC of each feature moved by some bars: one that gains from looking back is causal, one that gains from looking ahead leaks."""
    df = forward_return(df, horizon)
    moved = []
    for f in features:
        for s in shifts:
            value = F.lag(f, s).over(by_time()) if s >= 0 else F.lead(f, -s).over(by_time())
            moved.append((f"{f}@{s}", value.cast("double")))
    wide = df.select(KEY, TS, F.col(f"fwd_ret_{horizon}").alias("y"), *[v.alias(n) for n, v in moved])
    long = wide.unpivot([KEY, TS, "y"], [n for n, _ in moved], "feature", "x").where("x is not null and y is not null")
    ic = rank_correlation(staged(long, "shifted"), "feature")
    return ic.select(F.regexp_extract("feature", r"^(.*)@", 1).alias("feature"), F.regexp_extract("feature", r"@(-?[0-9]+)$", 1).cast("int").alias("shift"), "n", "spearman")


# The limits of the verdict on shifted correlations.
NOISE, STRONG, FUTURE_LEAST, LOW_RHO, HIGH_RHO = 0.03, 0.10, 0.05, 0.10, 0.7


def shift_verdict(shifts: DataFrame, rho: DataFrame) -> DataFrame:
    """A verdict on each feature from the sizes of its correlations at shifts 0, 1, 5 and -1 and its own lag-1 correlation."""
    at = lambda s: F.max(F.when(F.col("shift") == s, F.abs("spearman")))
    w = shifts.groupBy("feature").agg(at(0).alias("now"), at(1).alias("past_1"), at(5).alias("past_5"), at(-1).alias("ahead_1")).join(rho, "feature", "left")
    now, one, five, ahead, r = F.col("now"), F.col("past_1"), F.col("past_5"), F.col("ahead_1"), F.abs(F.coalesce("autocorrelation", F.lit(0.0)))
    strong = (
        F.when(r < LOW_RHO, "pass_low_autocorrelation").when(one < 0.4 * now * r, "leak_past_alignment").when(one < 0.7 * now * r, "suspect_high_decay")
        .when(five > one + 0.02, "suspect_not_monotonic").otherwise("pass")
    )
    verdict = (
        F.when(now.isNull() | (now < NOISE), "noise")
        .when((ahead > FUTURE_LEAST) & (ahead > now * 1.3 + 0.01), "leak_future")
        .when((ahead > FUTURE_LEAST) & (ahead > now * 1.1 + 0.005) & (now > 0.04), "suspect_future")
        .when((one > now + 0.03) & (one > 0.1), "leak_past_peak")
        .when(now >= STRONG, strong)
        .when((r > HIGH_RHO) & (one < 0.3 * now), "suspect")
        .otherwise("pass")
    )
    return w.withColumn("verdict", verdict)


def student_p(t: float | None, freedom: float | None) -> float | None:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    import math

    if t is None or freedom is None or freedom < 1 or math.isnan(t):
        return None
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def edge_statistics(trades: DataFrame, *by: str, least: int = 2, unit: float = 10_000.0) -> DataFrame:
    """n, win rate, mean in units; from the means of days of `least` trades or more their number, t, its p, the yearly Sharpe
    ratio, t of either half of the days, and whether both halves have one sign and reach 1.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def p_of(t, n):  # on one row a group
        return t.combine(n, lambda a, k: student_p(a, k - 1)).astype("float64")

    day = trades.groupBy(*by, F.to_date(TS).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ret") > 0).cast("bigint")).alias("w"), F.avg("ret").alias("m"), F.sum("ret").alias("s"))
    whole = day.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("w") / F.sum("n")).alias("win_rate"), (F.sum("s") / F.sum("n") * unit).alias("mean_units"))
    some = day.where(F.col("n") >= least)
    w = Window.partitionBy(*by)
    some = some.withColumn("_half", F.row_number().over(w.orderBy("day")) <= F.floor(F.count(F.lit(1)).over(w) / 2))
    t = lambda c: F.coalesce(F.when(F.stddev_samp(c) > 0, F.avg(c) / (F.stddev_samp(c) / F.sqrt(F.count(c)))), F.lit(0.0))
    part = lambda first: F.when(F.col("_half") == first, F.col("m"))
    sd = F.stddev_samp("m")
    daily = some.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), t("m").alias("t_value"), (F.avg("m") / sd * F.sqrt(F.lit(252.0))).alias("sharpe"),
        t(part(True)).alias("t_first"), t(part(False)).alias("t_second"),
    ).where("days >= 3")
    out = whole.join(daily, list(by)).withColumn("p_value", p_of("t_value", F.col("days").cast("double")))
    both = (F.abs("t_first") >= 1) & (F.abs("t_second") >= 1) & (F.floor(F.col("days") / 2) >= 3)
    return out.withColumn("stable", (F.signum("t_first") == F.signum("t_second")) & both)


def signal_overlap(df: DataFrame, signals: list[str]) -> DataFrame:
    """Jaccard overlap of each two flags, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    both = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sum((F.col(a) & F.col(b)).cast("bigint")).alias("i"), F.sum((F.col(a) | F.col(b)).cast("bigint")).alias("u")) for a, b in pairs]
    return df.agg(F.array(*both).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b", (F.col("p.i") / F.greatest("p.u", F.lit(1))).alias("jaccard"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of each two columns, from one aggregate over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]
    return df.agg(F.array(*each).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b", "p.r")


def correlation_clusters(df: DataFrame, columns: list[str], threshold: float = 0.9) -> list[list[str]]:
    """Columns joined by |r| at or over the threshold: the matrix is made in Spark, its few cells are joined here."""
    parent = {c: c for c in columns}

    def find(c: str) -> str:
        while parent[c] != c:
            c = parent[c]
        return c

    for r in correlation_matrix(df, columns).collect():
        if r.r is not None and abs(r.r) >= threshold:
            parent[find(r.b)] = find(r.a)
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(find(c), []).append(c)
    return list(groups.values())


def spearman_sizes(df: DataFrame, columns: list[str]) -> dict[frozenset, float]:
    """|Spearman| of each two columns over the rows without nulls: ranks by ranges, one aggregate, its few cells here."""
    rows = staged(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna(), "spearman")
    ranked = with_ranks(rows, {c: f"_r_{c}" for c in columns}).select(*[F.col(f"_r_{c}").alias(c) for c in columns])
    return {frozenset((x.a, x.b)): abs(x.r) if x.r is not None and x.r == x.r else 0.0 for x in correlation_matrix(ranked, columns).collect()}


def redundancy_filter(df: DataFrame, columns: list[str], target: str | None = None, threshold: float = 0.85, protected: tuple[str, ...] = ()) -> list[str]:
    """Columns kept: protected ones first, then by |Spearman| with the target, each unless it correlates over the threshold with a kept one.

    Protected columns always stay. Without a target the order given counts.
    """
    r = spearman_sizes(df, [*columns, *([target] if target else [])])
    order = sorted(columns, key=lambda c: (c not in protected, -r[frozenset((c, target))] if target else 0.0))
    kept: list[str] = []
    for c in order:
        if c in protected or all(r[frozenset((c, k))] <= threshold for k in kept):
            kept.append(c)
    return kept


def mrmr(df: DataFrame, columns: list[str], target: str, n: int = 20, protected: tuple[str, ...] = ()) -> list[str]:
    """Columns in the order of choice: protected ones, then always the one with the largest relevance less mean redundancy with those chosen.

    Both are |Spearman|; the first choice is by relevance alone, ties go to the column given first.
    """
    r = spearman_sizes(df, [*columns, target])
    chosen = [c for c in columns if c in protected][:n]
    while len(chosen) < min(n, len(columns)):
        gain = {c: r[frozenset((c, target))] - (sum(r[frozenset((c, k))] for k in chosen) / len(chosen) if chosen else 0.0) for c in columns if c not in chosen}
        chosen.append(max(gain, key=gain.get))
    return chosen


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null share, min, max, mean, deviation of each column in one aggregate, and exact percentiles from counts by value."""
    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.avg(x.isNull().cast("double")).alias("null_share"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))

    plain = df.agg(F.array(*[one(c) for c in columns]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    ranks = percentiles_of(df, columns, [0.01, 0.5, 0.99]).select("column", F.col("p0").alias("p01"), F.col("p1").alias("p50"), F.col("p2").alias("p99"))
    return plain.join(F.broadcast(ranks), "column", "left")  # a row a column


def value_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, number of distinct values, share of the most frequent one: counted by (column, value)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy("column").agg(F.count(F.lit(1)).alias("values"), (F.max("_n") / F.sum("_n")).alias("top_share"))


def dead_features(profile: DataFrame, values: DataFrame, low_std: float = 1e-3, null_limit: float = 0.5, few: int = 3, near: float = 0.95) -> DataFrame:
    """The first of null_heavy, dead, weak, few_values, near_constant that a column is, else alive."""
    p = profile.join(values, "column", "left")
    verdict = (
        F.when(F.col("null_share") > null_limit, "null_heavy").when(F.col("std") == 0, "dead").when(F.col("std") < low_std, "weak")
        .when(F.coalesce("values", F.lit(0)) < few, "few_values").when(F.col("top_share") > near, "near_constant").otherwise("alive")
    )
    return p.select("column", "values", "top_share", verdict.alias("verdict"))


def chi_square(table: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and Cramer's V of a contingency table (a, b, n)."""
    t = table.select(F.sum("n").over(Window.partitionBy()).alias("t"), F.sum("n").over(Window.partitionBy(a)).alias("ra"), F.sum("n").over(Window.partitionBy(b)).alias("rb"), a, b, "n")
    e = F.col("ra") * F.col("rb") / F.col("t")
    # cells that do not occur add their expectation: t - sum of the expectations of those that do
    s = t.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("s"), F.first("t").alias("t"), F.sum(e).alias("e"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    chi = F.col("s") + F.col("t") - F.col("e")
    return s.select(chi.alias("chi_square"), F.sqrt(chi / F.col("t") / F.greatest(F.least(F.col("ka"), F.col("kb")) - 1, F.lit(1))).alias("cramers_v"))


def quantile_spread(df: DataFrame, column: str, target: str, buckets: int = 5) -> DataFrame:
    """Mean target of the top less the bottom value-quantile, in basis points, and the Spearman correlation of both columns."""
    both = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    cuts = percentiles(both, column, [i / buckets for i in range(1, buckets)]).select(F.array(*[f"p{i}" for i in range(buckets - 1)]).alias("_c"))
    b = both.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_c", lambda c: c < F.col(column))))
    m = b.groupBy("_b").agg(F.avg(target).alias("m"))
    spread = m.agg(((F.max_by("m", "_b") - F.min_by("m", "_b")) * 10_000).alias("spread_bp"))
    xy = both.select(F.col(column).alias("x"), F.col(target).alias("y"))
    ic = with_ranks(xy, {"x": "rx", "y": "ry"}).agg(F.corr("rx", "ry").alias("ic"))
    return spread.crossJoin(F.broadcast(ic))


def hit_rate(df: DataFrame, direction: str, horizon: int) -> DataFrame:
    f = forward_return(df, horizon).where(F.col(f"fwd_ret_{horizon}").isNotNull() & (F.col(direction) != 0))
    return f.agg(F.count(F.lit(1)).alias("n"), F.avg((F.signum(direction) == F.signum(f"fwd_ret_{horizon}")).cast("double")).alias("hit_rate"))


def auc(df: DataFrame, score: str, label: str, threshold: float | None = None) -> DataFrame:
    """Area under the curve by rank sums; with a threshold also the accuracy of scores from it on."""
    pos, neg = F.sum((F.col(label) == 1).cast("bigint")), F.sum((F.col(label) != 1).cast("bigint"))
    out = [((F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc")]
    if threshold is not None:
        out.append(F.avg(((F.col(score) >= threshold) == (F.col(label) == 1)).cast("double")).alias("accuracy"))
    return with_ranks(df.select(score, label), {score: "_r"}).agg(*out)


def tick_quality(ticks: DataFrame) -> DataFrame:
    p = percentiles(ticks, "price", [0.01, 0.5, 0.99]).select(F.col("p0").alias("p01"), F.col("p1").alias("p50"), F.col("p2").alias("p99"))
    counts = ticks.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("price").isNull()).cast("bigint")).alias("null_price"), F.sum((F.col("price") <= 0).cast("bigint")).alias("bad_price"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))
    return counts.crossJoin(F.broadcast(p))


def event_gate_audit(df: DataFrame, flag: str, by: str, parts: dict[str, Column] | None = None, inputs: tuple[str, ...] = (), warm_up: Column | None = None, low: float = 0.01, high: float = 0.6) -> DataFrame:
    """By group and overall: rows, event rate, share of rows that fail each part of the gate, share with a null input, share of
    warm-up, and a verdict: empty, null_inputs (over a twentieth), rare, frequent or ok.
    """
    null = F.lit(False)
    for c in inputs:
        null = null | F.col(c).isNull()
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = [F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("event_rate"), share(null).alias("null_share"), share(warm_up if warm_up is not None else F.lit(False)).alias("warm_up_share")]
    out += [share(~F.coalesce(c, F.lit(False))).alias(f"{name}_fails") for name, c in (parts or {}).items()]
    r = df.groupingSets([[], [F.col(by)]], by).agg(*out)
    verdict = F.when(F.col("event_rate") == 0, "empty").when(F.col("null_share") > 0.05, "null_inputs").when(F.col("event_rate") < low, "rare").when(F.col("event_rate") > high, "frequent").otherwise("ok")
    return r.withColumn("verdict", verdict)


def feature_drift(now: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Shift of each column's mean in units of the base deviation."""
    stat = lambda df, s: df.agg(*[f(c).alias(f"{n}_{c}_{s}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    w = stat(now, "n").crossJoin(F.broadcast(stat(base, "b")))
    rows = [F.struct(F.lit(c).alias("column"), (F.abs(F.col(f"m_{c}_n") - F.col(f"m_{c}_b")) / F.greatest(F.col(f"s_{c}_b"), F.lit(1e-9))).alias("drift")) for c in columns]
    return w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def coverage_stats(df: DataFrame, column: str, low: float) -> DataFrame:
    plain = df.agg(F.avg(column).alias("mean"), F.avg((F.col(column) < low).cast("double")).alias("low_share"))
    ranks = percentiles(df, column, [0.5, 0.25, 0.75]).select(F.col("p0").alias("median"), F.col("p1").alias("q25"), F.col("p2").alias("q75"))
    return plain.crossJoin(F.broadcast(ranks))  # one row each


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One aggregate to a row (gate, ok) for each rule on the whole table."""
    return df.agg(F.array(*[F.struct(F.lit(n).alias("gate"), r.alias("ok")) for n, r in rules.items()]).alias("g")).select(F.explode("g").alias("g")).select("g.*")


def robust_scale(df: DataFrame, columns: list[str], train: str = "true", clip: float = 10.0) -> DataFrame:
    """(x - median) / interquartile range of the training rows; where that is 0, by the range; else 0. Clipped."""
    learn = df.where(train)
    fit = percentile_row(learn, {c: [0.5, 0.25, 0.75] for c in columns}).select(*[x for c in columns for x in (F.col(f"{c}_p0").alias(f"_m_{c}"), (F.col(f"{c}_p2") - F.col(f"{c}_p1")).alias(f"_q_{c}"))])
    span = learn.agg(*[(F.max(c) - F.min(c)).alias(f"_r_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(span))  # one row each
    for c in columns:
        z = F.when(F.col(f"_q_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_q_{c}")).when(F.col(f"_r_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_r_{c}")).otherwise(0.0)
        out = out.withColumn(f"{c}_scaled", F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "mqr"])


def parameter_grid_rates(df: DataFrame, score: str, scales: list[float], shifts: list[float], threshold: float) -> DataFrame:
    """Event rate of the gate for each (scale, shift), by session and overall: the small grid is exploded on each row."""
    grid = F.array(*[F.struct(F.lit(a).alias("scale"), F.lit(b).alias("shift")) for a in scales for b in shifts])
    g = df.select("session", score, F.explode(grid).alias("g")).select("session", "g.*", (F.col(score) >= threshold * F.col("g.scale") + F.col("g.shift")).cast("double").alias("e"))
    return g.groupingSets([[F.col("scale"), F.col("shift")], [F.col("scale"), F.col("shift"), F.col("session")]], "scale", "shift", "session").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("event_rate"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
