"""Structured Streaming forms of the operators: minute bars, features on the last bars, entries with a cooldown.

Bars roll by event time, at second 55 of each minute, and carry the next whole minute as their label; quotes that come later than the
watermark are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.scratch import join_same

WATERMARK = "2 minutes"
LEAD_SECONDS = 5
"""A bar starts so long before the minute of its label."""
DUE = "due__"
"""The millisecond that a watermark must reach for a position to have expired; Spark renames columns with a leading underscore on the way to a processor."""


def minute_bars(quotes: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Bars of quotes (symbol, ts, close, volume): first, greatest, least and last close per minute from second 55 on.

    The quotes' volume grows over the day; a bar's is its last less its first. The same plan runs on a table and on a stream; a stream in
    append mode gives a bar when the watermark has passed it, in update mode whenever it changes.
    """
    rows = quotes.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close", F.col("volume").cast("long").alias("v")).where("symbol is not null AND ts is not null")
    if quotes.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    at = F.struct("ts", "v")
    bars = rows.groupBy("symbol", F.window("ts", "1 minute", "1 minute", f"{60 - LEAD_SECONDS} seconds").alias("w")).agg(
        F.min_by("close", at).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", at).alias("close"),
        (F.max_by("v", at) - F.min_by("v", at)).cast("double").alias("volume"),
    )
    label = F.col("w.start") + F.expr(f"INTERVAL {LEAD_SECONDS} SECONDS")
    return bars.select(F.col("symbol").alias("ticker"), label.alias("ts"), "open", "high", "low", "close", "volume")


class LastBars(StatefulProcessor):
    """A ring of the last ``size`` bars of each ticker: a place holds the bars whose number leaves its remainder.

    Gives a batch's new bars with those before them that their windows read (``size`` - 1 at most), told apart by is_new. Bars are taken in the order of their times; one that isn't
    later than the ticker's last is left out, as a window of it has been given already. Only new bars are written to the state.
    """

    def __init__(self, schema: StructType, size: int):
        self.names, self.fields, self.size = schema.names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "place int", self.fields)
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        held = pd.DataFrame([self.ring.getValue((i % self.size,)) for i in range(max(0, n - self.size), n)], columns=self.names)
        new = pd.concat(list(rows)).sort_values("ts", kind="stable").drop_duplicates("ts", keep="last")[self.names]
        if len(held):
            last = pd.Timestamp(held["ts"].iloc[-1])
            new = new[new["ts"] > (last.tz_localize(None) if last.tzinfo else last)]
        if not len(new):
            return
        for i, bar in enumerate(new.tail(self.size).itertuples(index=False), n + max(0, len(new) - self.size)):
            self.ring.updateValue((i % self.size,), tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if pd.isna(x) else x for x in bar))
        self.count.update((n + len(new),))
        held = held.tail(self.size - 1) if self.size > 1 else held.iloc[:0]
        if len(held):
            yield held.assign(is_new=False)
        yield new.assign(is_new=True)

    def close(self) -> None:
        pass


def start_stateful(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query whose operators hold state of several kinds, which needs the RocksDB store; the session's own setting is put back."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def live_features(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, size: int = 250) -> DataFrame:
    """Runs a stream of bars over what is there now: the features of each new bar on the last ``size`` bars of its ticker, one row per bar and in all.

    ``compute`` gets the new bars with those their windows read and must keep the columns it doesn't know, such as ``plans.features.frame_values`` with
    that size does. What is kept from batch to batch is ``LastBars``. The batch's number is part of what is written, so a batch that runs again
    replaces its own rows.
    """
    spark = bars.sparkSession
    schema = bars.schema
    seen = bars.groupBy("ticker").transformWithStateInPandas(LastBars(schema, size), StructType(list(schema.fields)).add("is_new", "boolean"), "append", "none")

    def each(batch: DataFrame, number: int) -> None:
        compute(batch).where("is_new").drop("is_new").write.mode("overwrite").parquet(f"{path}/batch={number}")

    start_stateful(seen.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def upsert(rows: DataFrame, path: str, by: str = "hour") -> None:
    """Puts rows (ticker, ts, ...) in place of those that the table at ``path`` has for their tickers and times.

    The table is cut by time, and only the parts with new rows are read and written anew, so that what a batch costs follows its own span of time. Done
    again, it changes nothing.
    """
    spark = rows.sparkSession
    new = rows.withColumn("part", F.date_format(F.date_trunc(by, "ts"), "yyyy-MM-dd-HH-mm"))
    spark.createDataFrame([], new.schema).write.mode("append").partitionBy("part").parquet(path)  # so that there is a table
    parts = new.select("part").distinct()
    # in order of parts, of which a batch has few
    touched = spark.read.schema(new.schema).parquet(path).join(F.broadcast(parts), "part", "left_semi")
    there = join_same(touched, new.select("ticker", "ts"), ["ticker", "ts"], "left_anti")
    there.select(*new.columns).unionByName(new).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def latest_updates(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream in update mode over what is there now into a table of (ticker, ts, ...), as each row was last given, those in progress too."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        upsert(held, path)
        held.unpersist()

    stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(StructType(list(stream.schema.fields)).add("part", "string")).parquet(path).drop("part")


def cooled_entries(signals: DataFrame, seconds: float = 45, watermark: str = WATERMARK) -> DataFrame:
    """Signals (ticker, ts, and more) that come at least ``seconds`` behind the ticker's last one that was let through.

    A ticker's state is one time, dropped when the watermark has passed it by the cooldown.
    """
    schema = signals.schema
    state = StructType().add("ready", "long")
    stamped = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        ready = held.get[0] if held.exists else -1
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        taken = []
        for micros in rows["ts"].astype("datetime64[us]").astype("int64"):
            take = micros >= ready
            if take:
                ready = int(micros + seconds * 1e6)
            taken.append(take)
        held.update((ready,))
        held.setTimeoutTimestamp(max(ready // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield rows[taken]

    out = StructType([f if f.name != "ts" else type(f)("ts", stamped.schema["ts"].dataType) for f in schema.fields])
    return stamped.groupBy("ticker").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


class Maturing(StatefulProcessor):
    """Positions of one ticker and span of maturities, held until the watermark has passed each; those that come later than that go at once.

    What a batch brings is one element of the list, as pickled columns, so that a state call doesn't cost a row but a batch. The timer stands at the first
    maturity held; when it fires, the positions that are due go, and it moves on to the first of the others.
    """

    def __init__(self, schema: StructType):
        self.names = schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.first = handle.getValueState("first", "due bigint")

    def packed(self, rows: pd.DataFrame) -> tuple[bytes]:
        return (pickle.dumps([rows[c].to_numpy() for c in (*self.names, DUE)]),)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for part in rows:
            late = part[DUE] <= passed
            if late.any():
                yield part.loc[late, self.names]
            if not late.all():
                waiting = part[~late]
                self.held.appendValue(self.packed(waiting))
                least = int(waiting[DUE].min())
                first = least if first is None else min(first, least)
        if first is not None and (not self.first.exists() or first < self.first.get()[0]):
            self.handle.registerTimer(first)
            self.first.update((first,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.first.exists() or self.first.get()[0] > passed:
            return  # an earlier timer of this batch has seen to it
        waiting: list[pd.DataFrame] = []
        for (packed,) in self.held.get():
            part = pd.DataFrame(dict(zip((*self.names, DUE), pickle.loads(packed), strict=True)))
            late = part[DUE] <= passed
            if late.any():
                yield part.loc[late, self.names]
            if not late.all():
                waiting.append(part[~late])
        self.held.clear()
        self.first.clear()
        if waiting:
            self.held.put([self.packed(part) for part in waiting])
            first = min(int(part[DUE].min()) for part in waiting)
            self.handle.registerTimer(first)
            self.first.update((first,))

    def close(self) -> None:
        pass


def expired_positions(positions: DataFrame, watermark: str = WATERMARK, span: int = 3600) -> DataFrame:
    """Positions (ticker, ts, maturity, and more) of a stream, given out once the watermark has passed their maturity; start it with ``start_stateful``.

    The state is a list for each ticker and ``span`` seconds of maturities with a timer at the first of them (to the millisecond, as watermarks are), so a ticker with many open positions
    has many tasks, and a batch touches the lists that it adds to or that have positions due. A span that is short beside the time between a ticker's positions makes a list of each;
    one that is long beside the time between batches writes the rest of a list anew in each. Positions without a maturity never expire and are left out.
    """
    stamped = positions.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "maturity")}).withWatermark("ts", watermark)
    dated = stamped.where("maturity IS NOT NULL").withColumn(DUE, F.unix_millis("maturity") + 1)
    spans = dated.withColumn("__span", F.floor(F.col(DUE) / (span * 1000)))
    return spans.groupBy("ticker", "__span").transformWithStateInPandas(Maturing(positions.schema), stamped.schema, "append", "eventTime")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", stateful: bool = False) -> DataFrame:
    """Runs a stream over what is there now into Parquet, and reads the result."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (start_stateful(writer, stream.sparkSession) if stateful else writer.start()).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, with the table's own schema, ``files`` files a batch. A stream reads folders, so a file is one that its folder is searched for."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def in_pieces(table: DataFrame, path: str, pieces: int = 6, order: str = "ts") -> str:
    """Writes a table as one file after another, each with a later part of ``order`` (nulls in the first), as a stream's source would get it."""
    at = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    cuts = table.select(at.alias("at")).approxQuantile("at", [i / pieces for i in range(1, pieces)], 0.01)
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        later = F.lit(True) if low is None else at >= low
        earlier = F.lit(True) if high is None else at < high
        part = later & earlier if low is not None else earlier | F.col(order).isNull()
        table.where(part).coalesce(1).write.mode("append").parquet(path)
    return path
