"""Bars from ticks, and bars of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import without_nan

BAR_COLUMNS = ["ticker", "ts", "open", "high", "low", "close", "volume"]


KEY_BITS = 72


def tick_order(time: Column, ties: list[tuple[Column, int]]) -> Column:
    """Time, then whole numbers of so many bits each (72 in all at most), as one number of fixed width, by which partial aggregates can be kept in a hash table.

    A null tie counts as 0. A number below 0 or beyond its bits would put ticks out of order, so it is an error.
    """
    if sum(bits for _, bits in ties) > KEY_BITS:
        raise ValueError(f"ties of {sum(bits for _, bits in ties)} bits: {KEY_BITS} fit")
    key = F.unix_micros(time.cast("timestamp"))
    if not ties:
        return key
    key = key.cast("decimal(38,0)")
    for column, bits in ties:
        tie = F.coalesce(column.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
        wrong = F.raise_error(F.concat(F.lit(f"a tie is not in {bits} bits: "), tie.cast("string"))).cast("decimal(20,0)")
        tie = F.when((tie >= 0) & (tie < F.lit(str(1 << bits)).cast("decimal(20,0)")), tie).otherwise(wrong)
        key = (key * F.lit(str(1 << bits)).cast("decimal(20,0)")).cast("decimal(38,0)") + tie
    return key.cast("decimal(38,0)")


def bars_from_ticks(ticks: DataFrame, ticker: Column, time: Column, bucket: Column, price: Column, volume: Column, ties: list[tuple[Column, int]] | None = None) -> DataFrame:
    """First, greatest, least and last price and the summed volume per ticker and bucket; ``ties`` order ticks of one time, as ``tick_order`` takes them.

    A tick without a price (null or NaN) counts with its volume alone. Ticks without a ticker or bucket are left out; of ticks that tie in all, any
    may be first. Partial results are combined before the shuffle, in hash tables and without sorting ticks, so a hot ticker sends one row per bucket and task.
    """
    rows = ticks.select(ticker.alias("ticker"), bucket.alias("ts"), tick_order(time, ties or []).alias("at"), price.cast("double").alias("price"), volume.cast("double").alias("v")).where("ticker is not null and ts is not null")
    rows = without_nan(rows, ["price", "v"])
    at = F.when(F.col("price").isNotNull(), F.col("at"))
    return rows.groupBy("ticker", "ts").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("v").alias("volume"),
    )


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, a ticker per event type; the volume is the number of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_from_ticks(e, F.col("event_type"), F.col("ts"), F.date_trunc("hour", "ts").cast(dict(e.dtypes)["ts"]), F.col("value"), F.lit(1.0), [(F.col("event_id"), 63)])


def bars_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values, a ticker per user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_from_ticks(e, F.col("user_id").cast("string"), F.col("ts"), F.date_trunc("day", "ts").cast(dict(e.dtypes)["ts"]), F.col("value"), F.lit(1.0), [(F.col("event_id"), 63)])


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of unit prices, a ticker per supplier; the volume is the quantity."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ties = [(F.col("l_orderkey"), 36), (F.col("l_linenumber"), 4), (F.col("l_partkey"), 32)]
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    return bars_from_ticks(li, F.col("l_suppkey").cast("string"), F.col("l_shipdate"), F.date_trunc("month", "l_shipdate").cast(dict(li.dtypes)["l_shipdate"]), price, F.col("l_quantity"), ties)


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, a folder per ticker, so that a filter on the ticker reads its folder only."""
    bars.repartition("ticker", F.date_trunc("month", "ts")).sortWithinPartitions("ticker", "ts").write.mode(mode).partitionBy("ticker").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*BAR_COLUMNS)


def write_features(table: DataFrame, name: str | None = None, buckets: int | None = None) -> str:
    """A table of the session's catalog (its name is returned) with rows of one ticker in one bucket, sorted by time, so that windows by ticker read it without an exchange.

    ``buckets`` are as many as the session's shuffle partitions if None. A table of that name is replaced.
    """
    spark = table.sparkSession
    name = name or f"features_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table.repartition(n, "ticker").sortWithinPartitions("ticker", "ts").write.mode("overwrite").format("parquet").bucketBy(n, "ticker").sortBy("ticker", "ts").saveAsTable(name)
    return name
