"""The market views over the driver's tables, and readers for files of ticks and book snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 10


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events from `events`: ts_event, symbol, seq, order_id, action, side, price, size."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.expr("CASE event_type WHEN 'purchase' THEN 'T' WHEN 'click' THEN 'A' WHEN 'error' THEN 'C' WHEN 'view' THEN 'M' WHEN 'signup' THEN 'T' END")
    return e.select(
        F.col("ts").alias("ts_event"),
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("order_id"),
        action.alias("action"),
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("side"),
        (F.col("value") / 100 + 100).alias("price"),
        (F.regexp_extract("props", r"([0-9]+)", 1).cast("double") + 1).alias("size"),
    )


TICKS_SQL = """ticks AS (
  SELECT ts AS ts_event, 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, event_id AS seq, user_id AS order_id,
         CASE event_type WHEN 'purchase' THEN 'T' WHEN 'click' THEN 'A' WHEN 'error' THEN 'C' WHEN 'view' THEN 'M' WHEN 'signup' THEN 'T' END AS action,
         CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side, value / 100 + 100 AS price,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 1 AS size
  FROM events)"""


def dirty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks as a feed with faults: every tenth comes again with another size (`ingest` 1), some fields are wrong."""
    t = ticks(spark, sf_dir)
    again = t.where("seq % 10 = 0").withColumn("size", F.col("size") + 1).withColumn("ingest", F.lit(1))
    return t.withColumn("ingest", F.lit(0)).unionByName(again).select(
        "ts_event", "symbol", "seq", "order_id", F.when(F.col("seq") % 89 == 0, "Z").otherwise(F.col("action")).alias("action"),
        F.when(F.col("seq") % 83 == 0, "Q").otherwise(F.col("side")).alias("side"), F.when(F.col("seq") % 97 != 0, F.col("price")).alias("price"),
        F.when(F.col("seq") % 79 == 0, 0.0).otherwise(F.col("size")).alias("size"), "ingest",
    )


DIRTY_SQL = (
    TICKS_SQL
    + """, dirty AS (
  SELECT ts_event, symbol, seq, order_id, CASE WHEN seq % 89 = 0 THEN 'Z' ELSE action END AS action,
         CASE WHEN seq % 83 = 0 THEN 'Q' ELSE side END AS side, CASE WHEN seq % 97 <> 0 THEN price END AS price,
         CASE WHEN seq % 79 = 0 THEN 0.0 ELSE size END AS size, ingest
  FROM (SELECT *, 0 AS ingest FROM ticks UNION ALL SELECT * REPLACE (size + 1 AS size), 1 FROM ticks WHERE seq % 10 = 0))"""
)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ten-level snapshot for each event: bid_px, bid_sz, ask_px, ask_sz arrays, best first."""
    t = ticks(spark, sf_dir)
    level = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    return t.select(
        "ts_event", "symbol", "seq", "action", "side", "price", "size",
        F.transform(level, lambda i: F.col("price") - (i + 1) * 0.01).alias("bid_px"),
        F.transform(level, lambda i: ((F.col("seq") * 7 + i * 13) % 50).cast("double")).alias("bid_sz"),
        F.transform(level, lambda i: F.col("price") + (i + 1) * 0.01).alias("ask_px"),
        F.transform(level, lambda i: ((F.col("seq") * 11 + i * 17) % 50).cast("double")).alias("ask_sz"),
    )


BOOK_SQL = (
    TICKS_SQL
    + """, book AS (
  SELECT ts_event, symbol, seq, action, side, price, size,
         list_transform(range(10), lambda i: price - (i + 1) * 0.01) AS bid_px,
         list_transform(range(10), lambda i: CAST((seq * 7 + i * 13) % 50 AS DOUBLE)) AS bid_sz,
         list_transform(range(10), lambda i: price + (i + 1) * 0.01) AS ask_px,
         list_transform(range(10), lambda i: CAST((seq * 11 + i * 17) % 50 AS DOUBLE)) AS ask_sz
  FROM ticks)"""
)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contracts from `lineitem`: contract (near, far), ts_event, price, size, seq."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.when(F.col("l_linestatus") == "F", "near").otherwise("far").alias("contract"),
        F.col("l_shipdate").alias("ts_event"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


CONTRACTS_SQL = """contracts AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'near' ELSE 'far' END AS contract, l_shipdate AS ts_event,
         l_extendedprice / l_quantity AS price, l_quantity AS size, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem)"""

TICK_ALIASES = {"size": ("size", "qty", "volume"), "symbol": ("symbol", "instrument_id"), "seq": ("seq", "sequence")}


def tick_source(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Ticks of one file or a folder of shards, in parquet or (compressed) csv, with usual other names of columns made ours."""
    reader = spark.read.schema(schema) if schema else spark.read
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    for name, others in TICK_ALIASES.items():
        there = [c for c in others if c in raw.columns]
        if there:
            raw = raw.withColumn("_" + name, F.coalesce(*[F.col(c) for c in there])).drop(*there).withColumnRenamed("_" + name, name)
    return raw


def book_source(spark: SparkSession, path: str, levels: int = LEVELS) -> DataFrame:
    """Snapshots with the wanted levels that exist; only those columns are read."""
    raw = spark.read.parquet(path)
    wanted = ["ts_event", "symbol", *[f"{s}_{v}_{i:02d}" for s in ("bid", "ask") for v in ("px", "sz") for i in range(levels)]]
    return raw.select(*[c for c in wanted if c in raw.columns])


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """Raw csv ticks to parquet, partitioned by symbol and day."""
    raw = spark.read.schema(schema).option("header", True).csv(source)
    raw.withColumn("day", F.to_date("ts_event")).repartition("symbol", "day").write.partitionBy("symbol", "day").parquet(target)


def feature_table_sink(df: DataFrame, features: list[str], metadata: list[str], path: str | None = None) -> DataFrame:
    """The ordered metadata and feature columns; absent features are 0. Written by symbol and day when a path is given."""
    out = df.select(*[F.col(c) for c in metadata if c in df.columns], *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])
    if path:
        out.withColumn("day", F.to_date("ts_event")).write.partitionBy("symbol", "day").parquet(path)
    return out


def execution_log_sink(fills: DataFrame, path: str) -> None:
    """One json line a fill."""
    fills.write.json(path)


def parquet_shards(df: DataFrame, path: str, rows_per_shard: int, ts: str = "ts_event") -> None:
    df.repartitionByRange(ts).sortWithinPartitions(ts).write.option("maxRecordsPerFile", rows_per_shard).parquet(path)
