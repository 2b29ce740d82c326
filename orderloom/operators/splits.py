"""Splits and folds that keep labels from reaching over their edges."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.spec import KEY, TS, by_time


def numbered(df: DataFrame) -> DataFrame:
    """_i (from 1) and _n, the rows of the symbol."""
    return df.withColumn("_i", F.row_number().over(by_time())).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY)))


def purged_split(df: DataFrame, train: float = 0.8) -> DataFrame:
    """train, test, or purged: a training row whose label ends at or after the first test row."""
    d = numbered(df).withColumn("_test", F.col("_i") > F.floor(train * F.col("_n")))
    edge = F.min(F.when(F.col("_test"), F.col(TS))).over(Window.partitionBy(KEY))
    d = d.withColumn("_t", edge)
    return d.withColumn("part", F.when(F.col("_test"), "test").when(F.col("label_end") >= F.col("_t"), "purged").otherwise("train")).drop("_i", "_n", "_test", "_t")


def three_way_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, purge: int = 0) -> DataFrame:
    d = numbered(df)
    a, b = F.floor(train * F.col("_n")), F.floor((train + validation) * F.col("_n"))
    i = F.col("_i")
    part = F.when(i <= a - purge, "train").when((i > a) & (i <= b - purge), "validation").when(i > b, "test").otherwise("gap")
    return d.withColumn("part", part).drop("_i", "_n")


def expanding_walk_forward(df: DataFrame, folds: int = 5, embargo: int = 0) -> DataFrame:
    """A row for each fold it is in: consecutive tests, all earlier rows but the last `embargo` for training."""
    d = numbered(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    a, b = (F.floor(F.col("_n") * (F.col("fold") + k) / (folds + 1)) for k in (1, 2))
    i = F.col("_i")
    part = F.when((i > a) & (i <= b), "test").when(i <= a - embargo, "train")
    return d.withColumn("part", part).where("part is not null").drop("_i", "_n")


def combinatorial_cv(df: DataFrame, groups: int = 5, tests: int = 2) -> DataFrame:
    """Rows for test and training of every choice of two test groups; groups are counted once, choices are made of counts."""
    g = numbered(df).groupBy(F.least(F.floor((F.col("_i") - 1) * groups / F.col("_n")), F.lit(groups - 1)).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    choices = df.sparkSession.createDataFrame(list(combinations(range(groups), tests)), "test_a int, test_b int")
    hit = (F.col("g") == F.col("test_a")) | (F.col("g") == F.col("test_b"))
    return g.crossJoin(F.broadcast(choices)).groupBy("test_a", "test_b").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_test"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("n_train"))


def month_folds(df: DataFrame, first: int = 12, step: int = 6, test: int = 6) -> DataFrame:
    """Calendar folds from the first month of the data: test windows of `test` months, moved by `step`, after `first` months."""
    span = df.agg(F.trunc(F.min(TS), "month").alias("a"), F.max(TS).alias("b"))
    rows = span.withColumn("fold", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.months_between("b", "a") / step), F.lit(0)).cast("int"))))
    start, end = F.add_months("a", first + step * F.col("fold")), F.add_months("a", first + test + step * F.col("fold"))
    return rows.where(end <= F.col("b")).select("fold", start.alias("test_start"), end.alias("test_end"))
