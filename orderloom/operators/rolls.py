"""Futures rolls and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.spec import KEY, TS, by_time, median

# The month letters of futures codes, January to December.
MONTH_LETTERS = "FGHJKMNQUVXZ"


def codes(contracts: DataFrame, root: str = "ES") -> DataFrame:
    """A contract code for each month that trades."""
    letter = F.substring(F.lit(MONTH_LETTERS), F.month(TS), F.lit(1))
    return contracts.select(F.concat(F.lit(root), letter, (F.year(TS) % 10).cast("string")).alias("code")).distinct()


def parse_contract_code(df: DataFrame, code: str) -> DataFrame:
    """root, letter, month (1 to 12) and year digit(s) of a code such as ESH4."""
    part = lambda i: F.regexp_extract(code, r"^([A-Z0-9]+?)([FGHJKMNQUVXZ])([0-9]{1,2})$", i)
    return df.select(code, part(1).alias("root"), part(2).alias("letter"), F.instr(F.lit(MONTH_LETTERS), part(2)).cast("bigint").alias("month"), part(3).cast("int").alias("year"))


def roll_day_by_volume(ticks: DataFrame) -> DataFrame:
    """One row: the first day on which the far contract trades more than the near one (null if none)."""
    of = lambda c: F.sum(F.when(F.col("contract") == c, F.col("size")).otherwise(0.0))
    daily = ticks.groupBy(F.to_date(TS).alias("day")).agg(of("near").alias("near"), of("far").alias("far"))
    return daily.where(F.col("far") > F.col("near")).agg(F.min("day").alias("roll_day"))


def roll_offset(ticks: DataFrame, roll: DataFrame, days: int = 3) -> DataFrame:
    """roll_day and add_to_old: median far price less median near price in the days around the roll."""
    near = ticks.crossJoin(F.broadcast(roll)).where((F.to_date(TS) >= F.date_sub("roll_day", days)) & (F.to_date(TS) < F.date_add("roll_day", days)))
    mid = lambda c: median(F.when(F.col("contract") == c, F.col("price")))
    return near.agg(F.first("roll_day").alias("roll_day"), (mid("far") - mid("near")).alias("add_to_old"))


def continuous_series(ticks: DataFrame, roll: DataFrame) -> DataFrame:
    """Near rows before the roll, shifted by the offset, far rows from it on."""
    t = ticks.crossJoin(F.broadcast(roll)).withColumn("_d", F.to_date(TS))
    old = (F.col("contract") == "near") & (F.col("_d") < F.col("roll_day"))
    new = (F.col("contract") == "far") & (F.col("_d") >= F.col("roll_day"))
    return t.where(old | new).withColumn("price", F.when(old, F.col("price") + F.col("add_to_old")).otherwise(F.col("price"))).withColumn("is_roll", F.col("_d") == F.col("roll_day")).drop("_d")


def apply_offsets_to_book(book: DataFrame, offset: float) -> DataFrame:
    for c in ("bid_px", "ask_px"):
        book = book.withColumn(c, F.transform(c, lambda x: x + offset))
    return book.withColumn("price", F.col("price") + offset)


def combine_raw_files(parts: list[DataFrame]) -> DataFrame:
    """Union on shared columns; of rows with equal (symbol, time) that of the latest part stays."""
    from orderloom.operators.clean import keep_last

    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = None
    for i, p in enumerate(parts):
        p = p.select(*shared).withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return keep_last(out, KEY, TS, order="_part").drop("_part")


def roll_continuity_check(bars: DataFrame, tick: float, limit: float) -> DataFrame:
    """Jumps between a bar's open and the close before it of more than `limit` ticks, by symbol."""
    gap = F.abs(F.col("open") - F.lag("close").over(by_time())) / tick
    return bars.withColumn("_g", gap).where(F.col("_g") > limit).groupBy(KEY).agg(F.count(F.lit(1)).alias("jumps"))


def key_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of keys in one table only and in both."""
    x, y = a.select(KEY, TS), b.select(KEY, TS)
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(x.exceptAll(y), "only_a").unionByName(n(y.exceptAll(x), "only_b")).unionByName(n(x.intersect(y), "both"))
