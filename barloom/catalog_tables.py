"""Registered queries of sources, cleaning, features, signals, evaluation and streams, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BARS_SQL, USER_BARS_SQL, parameters
from .functions.safe import clean_double, clean_zero
from .operators import cleaning, evaluate, indicators, scans, signals
from .plans import duck, features
from .plans.graph import Graph
from .sources import bars as B
from .sources import payloads, specs
from .sources.scratch import scratch
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
PRICES = ["open", "high", "low", "close"]
SHOWN = [*PRICES, "volume"]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[clean_zero(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def rounded_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole numbers that may be null as doubles, which engines hand out alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# Sources


def payload_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as intraday payloads, one JSON text per ticker and day, and read again as bars."""
    b = B.bars_events(spark, sf_dir)
    entry = F.struct(F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), payloads.ZONE), "yyyy-MM-dd HH:mm:ss").alias("k"), F.struct(*[F.col(c).cast("string").alias(f) for c, f in payloads.BAR_FIELDS.items()]).alias("v"))
    days = b.groupBy("ticker", F.date_trunc("day", "ts").alias("d")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    texts = days.select("ticker", F.to_json(F.struct(F.col("m").alias(payloads.INTRADAY_KEY))).alias("payload"))
    return rounded(payloads.intraday_bars(texts).withColumn("ts", F.col("ts").cast("timestamp_ntz")), SHOWN)


PAYLOAD_SQL = f"SELECT ticker, ts, {rounded_sql(SHOWN)} FROM ({BARS_SQL})"


def payload_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series written as an indicator payload under its published name, and read again."""
    s = indicators.series(B.bars_events(spark, sf_dir), {"value": ("AD", {})})
    entry = F.struct(F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "US/Eastern"), "yyyy-MM-dd HH:mm").alias("k"), F.create_map(F.lit("Chaikin A/D"), F.round("value", 4).cast("string")).alias("v"))
    texts = s.groupBy("ticker").agg(F.map_from_entries(F.collect_list(entry)).alias("m")).select("ticker", F.to_json(F.struct(F.col("m").alias("Technical Analysis: AD"))).alias("payload"))
    return payloads.indicator_series(texts, "AD")


def payload_indicator_sql() -> str:
    return f"SELECT ticker, epoch(ts)::BIGINT AS uts, 'AD' AS name, value FROM ({duck.sql(BARS_SQL, {'value': indicators.build(Graph(), 'AD', {})}, 4)})"


def raw_quotes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as quotes in text columns, some of them blank or broken, by event number."""
    e = events if events is not None else spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 10
    local = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), payloads.ZONE), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    price = F.col("value").cast("string")
    return e.select(
        F.when(n == 9, F.lit(" ")).otherwise(F.col("event_type")).alias("symbol"), local.alias("timestamp"),
        F.when(n == 1, F.lit("")).otherwise(price).alias("open"), F.when(n == 2, F.lit("abc")).otherwise(price).alias("high"), F.when(n == 3, F.lit(None)).otherwise(price).alias("low"), F.when(n == 4, F.lit("  ")).otherwise(price).alias("close"),
        F.when(n == 5, F.lit("")).otherwise((F.col("event_id") + 1).cast("string")).alias("volume"), F.when(n == 4, F.lit("x")).otherwise((F.col("value") - 1).cast("string")).alias("previous_close"),
        F.when(n == 6, F.lit("-")).otherwise(F.lit("1.0")).alias("change"), F.lit("1.5%").alias("change_percent"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payloads.normal_quotes(raw_quotes(spark, sf_dir), F.lit("2000-01-01").cast("timestamp"))
    out = out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(out, [*PRICES, "previous_close"])


QUOTES_SQL = """SELECT event_type AS symbol, ts, round(CASE event_id % 10 WHEN 1 THEN value - 1 ELSE value END, 6) AS open, round(CASE event_id % 10 WHEN 2 THEN value - 1 ELSE value END, 6) AS high,
round(CASE event_id % 10 WHEN 3 THEN value - 1 ELSE value END, 6) AS low, round(CASE event_id % 10 WHEN 4 THEN 0.0 ELSE value END, 6) AS close, CASE event_id % 10 WHEN 5 THEN 0 ELSE event_id + 1 END::BIGINT AS volume,
round(CASE event_id % 10 WHEN 4 THEN 0.0 ELSE value - 1 END, 6) AS previous_close, CASE event_id % 10 WHEN 6 THEN 0.0 ELSE 1.0 END AS change, 1.5::DOUBLE AS change_percent,
0.0::DOUBLE AS extended_hours_quote, 0.0::DOUBLE AS extended_hours_change, 0.0::DOUBLE AS extended_hours_change_percent FROM events WHERE event_id % 10 <> 9"""


def local_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.safe import epoch_of_local_minute

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", epoch_of_local_minute(F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "US/Eastern"), "yyyy-MM-dd HH:mm:ss")).alias("uts"))


def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec texts, one per event type and period, some broken; parsed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit("ticker="), "event_type", F.when(F.col("n") == 4, "").otherwise("&function=SMA"), F.lit("&time_period="), F.when(F.col("n") == 3, "x").otherwise(F.col("n").cast("string")), F.lit("&series_type=CLOSE"))
    rows = e.select("event_type", (F.col("event_id") % 5).alias("n")).distinct().select(text.alias("spec"))
    return specs.parse_specs(rows).select("spec", "ticker", "function", F.try_element_at("params", F.lit("time_period")).alias("time_period"), F.try_element_at("params", F.lit("series_type")).alias("series_type"), "error")


SPECS_SQL = """SELECT 'ticker=' || event_type || CASE n WHEN 4 THEN '' ELSE '&function=SMA' END || '&time_period=' || p || '&series_type=CLOSE' AS spec, event_type AS ticker, CASE n WHEN 4 THEN NULL ELSE 'SMA' END AS function,
p AS time_period, 'CLOSE' AS series_type, CASE n WHEN 4 THEN 'no function' WHEN 3 THEN 'a period is no whole number' END AS error
FROM (SELECT DISTINCT event_type, event_id % 5 AS n, CASE event_id % 5 WHEN 3 THEN 'x' ELSE (event_id % 5)::VARCHAR END AS p FROM events)"""


def tracked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the users that a table of tickers names: those with an event of over 200."""
    named = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 200").select(F.col("user_id").cast("string").alias("ticker"))
    return rounded(payloads.tracked(B.bars_users(spark, sf_dir), named), SHOWN)


TRACKED_SQL = f"SELECT ticker, ts, {rounded_sql(SHOWN)} FROM ({USER_BARS_SQL}) WHERE ticker IN (SELECT user_id::VARCHAR FROM events WHERE value > 200)"


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written to folders per ticker, and read again."""
    path = scratch(spark)
    B.write_bars(B.bars_events(spark, sf_dir), path)
    return rounded(B.read_bars(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz")), SHOWN)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written to a table in buckets by ticker, and a moving average of one of them over the table as it is stored."""
    table, _ = features.wide(B.bars_events(spark, sf_dir), [("RSI", {"time_period": 10, "series_type": "CLOSE"}), ("OBV", {})])
    name = B.write_features(table.withColumnsRenamed({"f0": "close", "f1": "volume"}))
    out = indicators.series(spark.table(name), {"smooth": ("SMA", {"time_period": 5, "series_type": "CLOSE"})})
    shown = out.select("ticker", "ts", F.col("close").alias("rsi"), F.col("volume").alias("obv"), "smooth")
    return rounded(shown, ["rsi", "obv", "smooth"])


def stored_features_sql() -> str:
    g = Graph()
    made = duck.sql(BARS_SQL, {"rsi": indicators.build(g, "RSI", {"time_period": 10, "series_type": "CLOSE"}), "obv": indicators.build(g, "OBV", {})}, 12)
    return f"""SELECT ticker, ts, round(rsi, 6) + 0.0 AS rsi, round(obv, 6) + 0.0 AS obv, round(CASE WHEN count(rsi) OVER w = 5 THEN avg(rsi) OVER w END, 6) + 0.0 AS smooth FROM ({made}) WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 4 PRECEDING)"""


def written_json(spark: SparkSession, rows: DataFrame) -> str:
    """One JSON object, from rows of (k, v), as a file in a folder of its own."""
    path = scratch(spark)
    rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(path)
    return path


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of event types: what each is asked with and what it gives, from two JSON files; one type in each file only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    kinds = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("u"))
    asked = kinds.where("event_type <> 'error'").select(F.col("event_type").alias("k"), F.create_map(F.lit("interval"), F.lit("1min"), F.lit("size"), F.col("n").cast("string")).alias("v"))
    given = kinds.where("event_type <> 'view'").select(F.col("event_type").alias("k"), F.when(F.col("event_type") == "click", F.array(F.lit("A"), F.col("u").cast("string"))).otherwise(F.array("event_type")).alias("v"))
    found = specs.indicator_catalog(spark, written_json(spark, asked), written_json(spark, given))
    at = lambda k: F.try_element_at("request", F.lit(k))
    return found.select("function", at("interval").alias("interval"), at("size").alias("size"), F.concat_ws(",", "outputs").alias("outputs"))


CATALOG_SQL = """SELECT event_type AS function, CASE WHEN event_type <> 'error' THEN '1min' END AS interval, CASE WHEN event_type <> 'error' THEN count(*)::VARCHAR END AS size,
CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'A,' || min(user_id)::VARCHAR ELSE event_type END AS outputs FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""


def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with one number per event type, written as JSON and read again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    path = written_json(spark, e.groupBy("event_type").agg(F.count("*").alias("v")).select(F.col("event_type").alias("k"), "v"))
    row = specs.report(spark, path)
    return row.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("long").alias("v")) for c in row.columns]))).alias("name", "n"))


# Cleaning


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.repair_anomalies(B.bars_events(spark, sf_dir), periods=100, max_move=0.5, volume_below=3)
    return rounded(out.select("ticker", "ts", *PRICES), PRICES)


def repaired_sql() -> str:
    nodes = cleaning.anomaly_outputs(Graph(), 100, 0.5, 3)
    made = duck.sql(BARS_SQL, {f"r_{c}": nodes[c] for c in PRICES})
    return f"SELECT ticker, ts, {', '.join(f'r_{c} AS {c}' for c in PRICES)} FROM ({made})"


def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.anomaly_counts(cleaning.repair_anomalies(B.bars_events(spark, sf_dir), periods=100, max_move=0.5, volume_below=3))


def dropped_sql() -> str:
    nodes = cleaning.anomaly_outputs(Graph(), 100, 0.5, 3)
    made = duck.sql(BARS_SQL, {f"d_{c}": nodes[f"{c}_dropped"] for c in PRICES})
    return f"SELECT ticker, {', '.join(f'sum(d_{c})::BIGINT AS {c}_dropped' for c in PRICES)} FROM ({made}) GROUP BY ticker"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.regular_grid(B.bars_events(spark, sf_dir), size=250, step="1 hour"), SHOWN)


GRID_SQL = f"""WITH b AS ({BARS_SQL}), g AS (SELECT ticker, unnest(generate_series(last - INTERVAL 249 HOUR, last, INTERVAL 1 HOUR)) AS ts FROM (SELECT ticker, max(ts) AS last FROM b GROUP BY 1)),
j AS (SELECT ticker, ts, open, high, low, close, volume FROM g LEFT JOIN b USING (ticker, ts))
SELECT ticker, ts, {', '.join(f'round(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0), 6) AS {c}' for c in PRICES)}, coalesce(volume, 0.0) AS volume FROM j"""


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.where(cleaning.in_session(F.col("ts"))).select("event_id", "ts")


SESSION_SQL = """SELECT event_id, ts FROM (SELECT *, timezone('US/Eastern', timezone('UTC', ts)) AS l FROM events) WHERE isodow(l) <= 5 AND l::TIME BETWEEN TIME '09:30:00' AND TIME '16:00:00'"""


def latest_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.latest(B.bars_users(spark, sf_dir), "close"), ["close"])


def chunked_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.bars_events(spark, sf_dir)
    out = scans.ewm_chunked(b, "close", 2 / 16, "value", ["ticker"], chunk=F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86400 * 3)))
    return rounded(out.select("ticker", "ts", "value"), ["value"])


def chunked_ema_sql() -> str:
    return duck.sql(BARS_SQL, {"value": indicators.build(Graph(), "EMA", {"time_period": 15, "series_type": "CLOSE"})})


ONE_TICKER_SQL = BARS_SQL.replace("event_type AS ticker", "'all' AS ticker").replace("event_type IS NOT NULL AND ", "")
LONG = ["RSI", "T3", "STOCH_SLOWK", "VWAP", "OBV", "AROONOSC", "CMO", "ADXR", "SAR", "ADOSC"]


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of all events as one ticker, in blocks of 64 bars: no task holds the whole of it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = B.bars_from_ticks(e, F.lit("all"), F.col("ts"), F.date_trunc("hour", "ts").cast(dict(e.dtypes)["ts"]), F.col("value"), F.lit(1.0), [(F.col("event_id"), 63)])
    wanted = {n.lower(): (n, parameters(n)) for n in LONG}
    return rounded(indicators.series(bars, wanted, block=64).select("ticker", "ts", *wanted), list(wanted), 4)


def long_series_sql() -> str:
    g = Graph()
    return duck.sql(ONE_TICKER_SQL, {n.lower(): indicators.build(g, n, parameters(n)) for n in LONG}, 4)


HILBERT = [n for n in indicators.INDICATORS if n.startswith("HT_")]


def long_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight Hilbert series of all events as one ticker, transformed in chunks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = B.bars_from_ticks(e, F.lit("all"), F.col("ts"), F.date_trunc("hour", "ts").cast(dict(e.dtypes)["ts"]), F.col("value"), F.lit(1.0), [(F.col("event_id"), 63)])
    wanted = {n.lower(): (n, parameters(n)) for n in HILBERT}
    return indicators.series(bars, wanted, block=128).select("ticker", "ts", *[clean_double(F.col(c), 4).alias(c) for c in wanted])


def long_hilbert_sql() -> str:
    g = Graph()
    return duck.sql(ONE_TICKER_SQL, {n.lower(): indicators.build(g, n, parameters(n)) for n in HILBERT}, 4)


STOPS = {"slow": {"acceleration": 0.0101234567, "maximum": 0.1}, "fast": {"acceleration": 0.0512345679, "maximum": 0.4}}
"""Paces of many digits: with few, stops of prices in cents lie halfway between two rounded numbers, where two engines round differently."""


def long_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parabolic stops of all events as one ticker, each block started from the end of the one before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = B.bars_from_ticks(e, F.lit("all"), F.col("ts"), F.date_trunc("hour", "ts").cast(dict(e.dtypes)["ts"]), F.col("value"), F.lit(1.0), [(F.col("event_id"), 63)])
    out = indicators.series(bars, {name: ("SAR", p) for name, p in STOPS.items()}, block=64)
    return rounded(out.select("ticker", "ts", *STOPS), list(STOPS))


def long_stops_sql() -> str:
    g = Graph()
    return duck.sql(ONE_TICKER_SQL, {name: indicators.build(g, "SAR", p) for name, p in STOPS.items()})


YEAR = 250
WIDE_SERIES = ["SMA", "BBANDS_RUB", "WILLR", "MIDPRICE", "AROON_AU", "AROON_AD"]


def wide_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators over the last 250 minutes of all events as one ticker: windows in pieces, not folded anew for each row."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = B.bars_from_ticks(e, F.lit("all"), F.col("ts"), F.date_trunc("minute", "ts").cast(dict(e.dtypes)["ts"]), F.col("value"), F.lit(1.0), [(F.col("event_id"), 63)])
    wanted = {n.lower(): (n, {"time_period": YEAR, "series_type": "CLOSE", "matype": 0, "nbdevup": 2}) for n in WIDE_SERIES}
    return rounded(indicators.series(bars, wanted, block=4096).select("ticker", "ts", *wanted), list(wanted))


WIDE_SQL = f"""WITH bars AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM ({ONE_TICKER_SQL.replace("'hour'", "'minute'")})),
w AS (SELECT ticker, ts, close, rn, avg(close) OVER w AS mean, stddev_samp(close) OVER w AS dev, max(high) OVER w AS top, min(low) OVER w AS bottom,
  max({{'v': high, 'r': -rn}}) OVER w AS oldest_top, min({{'v': low, 'r': rn}}) OVER w AS oldest_bottom FROM bars WINDOW w AS (ORDER BY rn ROWS {YEAR - 1} PRECEDING))
SELECT ticker, ts, {', '.join(f"CASE WHEN rn >= {YEAR} THEN round({x}, 6) + 0.0 END AS {name}" for name, x in {
    "sma": "mean", "bbands_rub": "mean + 2 * dev", "willr": "(top - close) / (top - bottom) * -100", "midprice": "(top + bottom) / 2",
    "aroon_au": f"({YEAR} - (rn + oldest_top.r)) / {YEAR}.0 * 100", "aroon_ad": f"({YEAR} - (rn - oldest_bottom.r)) / {YEAR}.0 * 100"}.items())} FROM w"""


# Features

CHOSEN = ["CLOSE", "SMA", "RSI", "MACD_SIGNAL", "BOP", "OBV", "AROONOSC", "WILLR", "VWAP", "ULTOSC"]
DEPTH = 60


def chosen_specs() -> list[tuple[str, dict]]:
    return [(n, dict(parameters(n))) for n in CHOSEN]


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, plan = features.wide(B.bars_events(spark, sf_dir), chosen_specs())
    held = features.last_contexts(table, plan, DEPTH)
    cells = held.select("ticker", "feature", F.posexplode("context").alias("pos", "value"))
    return rounded(cells.withColumn("value", F.col("value").cast("double")), ["value"], 3)


def chosen_wide_sql(base: str = BARS_SQL) -> str:
    g = Graph()
    return duck.sql(base, {f"f{i}": indicators.build(g, n, p) for i, (n, p) in enumerate(chosen_specs())}, 12)


def contexts_sql() -> str:
    long = " UNION ALL ".join(f"SELECT ticker, 'f{i}' AS feature, n, f{i} AS v, {indicators.scale_of(name)!r} AS s FROM r" for i, name in enumerate(CHOSEN))
    return f"""WITH w AS ({chosen_wide_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS n FROM w), l AS ({long}),
t AS (SELECT * FROM l WHERE n <= {DEPTH}), z AS (SELECT ticker, feature, arg_min_null(v, n) AS last FROM t GROUP BY ALL),
p AS (SELECT ticker, feature, unnest(range({DEPTH})) AS pos, last FROM z)
SELECT p.ticker, p.feature, pos::INTEGER AS pos, round(((v - last) / s)::FLOAT::DOUBLE, 3) + 0.0 AS value FROM p LEFT JOIN t ON t.ticker = p.ticker AND t.feature = p.feature AND t.n = {DEPTH} - pos"""


def every_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context window of every bar and feature, told by its number of values, its oldest and next to last value, and its mean."""
    table, plan = features.wide(B.bars_events(spark, sf_dir), chosen_specs())
    held = features.contexts(table, plan, DEPTH)
    valid = F.filter("context", lambda x: x.isNotNull())
    mean = F.aggregate(valid, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(F.size(valid), F.lit(0))
    out = held.select("ticker", "ts", "feature", F.size(valid).cast("double").alias("n_values"), F.col("context")[0].cast("double").alias("oldest"), F.col("context")[DEPTH - 2].cast("double").alias("before"), mean.alias("mean"))
    return rounded(out, ["oldest", "before", "mean"], 3)


def every_context_sql() -> str:
    part = "PARTITION BY ticker ORDER BY ts"
    long = " UNION ALL ".join(
        f"SELECT ticker, ts, 'f{i}' AS feature, f{i} AS last, {indicators.scale_of(name)!r} AS s, list(f{i}) OVER ({part} ROWS {DEPTH - 1} PRECEDING) AS v, lag(f{i}, {DEPTH - 1}) OVER ({part}) AS a, lag(f{i}, 1) OVER ({part}) AS b FROM w" for i, name in enumerate(CHOSEN)
    )
    value = lambda x: f"round((({x} - last) / s)::FLOAT::DOUBLE, 3) + 0.0"
    return f"""WITH w AS ({chosen_wide_sql()}), l AS ({long}), c AS (SELECT *, list_filter(list_transform(v, lambda x: ((x - last) / s)::FLOAT::DOUBLE), lambda x: x IS NOT NULL) AS held FROM l)
SELECT ticker, ts, feature, len(held)::DOUBLE AS n_values, {value('a')} AS oldest, {value('b')} AS before, round(list_sum(held) / nullif(len(held), 0), 3) + 0.0 AS mean FROM c"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of each time at which a last context ends: its columns' names and values, one row per value."""
    table, plan = features.wide(B.bars_events(spark, sf_dir), chosen_specs())
    m = features.context_matrix(features.last_contexts(table, plan, DEPTH))
    columns = m.select("ts", F.posexplode(F.arrays_zip("features", "matrix")).alias("place", "c"))
    cells = columns.select("ts", "place", F.col("c.features").alias("feature"), F.posexplode("c.matrix").alias("pos", "value"))
    return rounded(cells.withColumn("value", F.col("value").cast("double")), ["value"], 3)


def matrix_sql() -> str:
    return f"""WITH k AS ({contexts_sql()}), e AS (SELECT ticker, max(ts) AS ts FROM ({BARS_SQL}) GROUP BY 1), p AS (SELECT ts, ticker, feature, (row_number() OVER (PARTITION BY ts ORDER BY feature, ticker) - 1)::INTEGER AS place FROM e, (SELECT DISTINCT feature FROM k))
SELECT ts, place, feature, pos, value FROM k JOIN p USING (ticker, feature)"""


TICKERS = ["click", "error", "purchase", "signup", "view"]


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and SMA of all five tickers side by side by time."""
    table = indicators.series(B.bars_events(spark, sf_dir), {"sma": ("SMA", {"time_period": 10, "series_type": "CLOSE"})})
    out = features.aligned(table, TICKERS, ["close", "sma"])
    return rounded(out, [f"{t}_{c}" for t in TICKERS for c in ("close", "sma")])


ALIGNED_SQL = f"""WITH b AS (SELECT ticker, ts, close, CASE WHEN count(*) OVER w = 10 THEN avg(close) OVER w END AS sma FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 9 PRECEDING))
SELECT ts, {', '.join(f"round(max({c}) FILTER (ticker = '{t}'), 6) + 0.0 AS {t}_{c}" for t in TICKERS for c in ("close", "sma"))} FROM b GROUP BY ts"""


def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of parsed specs, each for its ticker, summed up per feature."""
    b = B.bars_events(spark, sf_dir)
    text = lambda n, p: F.concat(F.lit("ticker="), "ticker", F.lit(f"&function={n}" + "".join(f"&{k}={v}" for k, v in p.items())))
    rows = b.select("ticker").distinct().select(F.explode(F.array(*[text(n, p) for n, p in chosen_specs()])).alias("spec"))
    out = features.quality_report(features.features(b, specs.parse_specs(rows)))
    return rounded(out, ["mean", "deviation"], 3)


def feature_report_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT 'ticker=' || ticker || '&function={n}{''.join(f'&{k}={v}' for k, v in p.items())}' AS feature, f{i} AS value FROM w" for i, (n, p) in enumerate(chosen_specs())
    )
    return f"WITH w AS ({chosen_wide_sql()}), l AS ({long}) SELECT feature, count(*) AS n_rows, count(value) AS n_values, round(avg(value), 3) + 0.0 AS mean, round(stddev_pop(value), 3) + 0.0 AS deviation, count(value) = 0 AS all_null FROM l GROUP BY 1"


FRAMED = {"rsi": "RSI", "ema": "EMA"}
FRAME_FEATURES = {n.lower(): n for n in ("EMA", "RSI", "DEMA", "TEMA", "T3", "MACD_SIGNAL", "ATR", "PLUS_DI", "WILLR", "OBV")}


def framed(spark: SparkSession, sf_dir: str, size: int, names: dict[str, str] = FRAMED) -> DataFrame:
    wanted = {c: (n, parameters(n) | {"time_period": 15, "series_type": "CLOSE"}) for c, n in names.items()}
    return rounded(features.frame_values(B.bars_events(spark, sf_dir), wanted, size).select("ticker", "ts", *names), list(names))


def frame_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI and EMA of each bar, started anew over the 100 bars that end there."""
    return framed(spark, sf_dir, 100)


def frame_mode_every_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI and EMA of each bar, started anew over the 250 bars that end there."""
    return framed(spark, sf_dir, 250)


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features of each bar, started anew over the 60 bars that end there."""
    return framed(spark, sf_dir, 60, FRAME_FEATURES)


def frame_mode_sql(size: int, names: dict[str, str] = FRAMED, period: int = 15) -> str:
    g = Graph()
    base = f"""SELECT b.* REPLACE (b.ticker || '@' || a.ts::VARCHAR AS ticker), a.ts AS anchor, b.ticker AS t FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM ({BARS_SQL})) b
JOIN (SELECT ticker, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM ({BARS_SQL})) a ON a.ticker = b.ticker AND b.i BETWEEN a.i - {size - 1} AND a.i"""
    made = duck.sql(base, {c: indicators.build(g, n, parameters(n) | {"time_period": period, "series_type": "CLOSE"}) for c, n in names.items()})
    return f"SELECT split_part(ticker, '@', 1) AS ticker, ts, {', '.join(names)} FROM ({made}) WHERE split_part(ticker, '@', 2) = ts::VARCHAR"


# Signals and trades: hourly bars, so horizons are hours

SCORES_SQL = f"""SELECT ticker, ts, close, close - lag(close, 3) OVER (PARTITION BY ticker ORDER BY ts) AS profit, CASE WHEN high = low THEN 0.0 ELSE (close - open) / (high - low) END AS accuracy FROM ({BARS_SQL})"""
TP, SL, HORIZON = 0.5, 0.4, "6 hours"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.series(B.bars_events(spark, sf_dir), {"profit": ("MOM", {"time_period": 3, "series_type": "CLOSE"}), "accuracy": ("BOP", {})})
    return out.select("ticker", "ts", "profit", "accuracy")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.bars_events(spark, sf_dir)
    priced = signals.priced(signals.agreeing(scores(spark, sf_dir)), b)
    return signals.brackets(priced, take_profit=TP, stop_loss=SL, horizon=HORIZON).select("ticker", "ts", "entry", "tp", "sl", "sl_limit", "maturity")


ENTRIES_SQL = f"""SELECT ticker, ts, entry, entry * {1 + TP} AS tp, entry * {1 - SL} AS sl, entry * {1 - SL} - 0.03 AS sl_limit, ts + INTERVAL 6 HOUR AS maturity
FROM (SELECT *, round(close + 0.05, 2) AS entry FROM ({SCORES_SQL}) WHERE profit > 0 AND accuracy > 0)"""


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.first_exits(entries(spark, sf_dir), B.bars_events(spark, sf_dir))


EXITS_SQL = f"""SELECT ticker, ts, entry, tp, sl, sl_limit, maturity, x.at AS exit_ts, CASE WHEN x.close >= tp THEN tp WHEN x.close <= sl THEN sl ELSE x.close END AS exit_price,
CASE WHEN x.close >= tp THEN 'tp' WHEN x.close <= sl THEN 'sl' WHEN x.close IS NOT NULL THEN 'maturity' END AS exit_type
FROM ({ENTRIES_SQL}) e LEFT JOIN (SELECT e.ticker, e.ts, arg_min({{'at': b.ts, 'close': b.close}}, b.ts) AS x FROM ({ENTRIES_SQL}) e JOIN ({BARS_SQL}) b ON b.ticker = e.ticker AND b.ts > e.ts AND (b.close >= e.tp OR b.close <= e.sl OR b.ts >= e.maturity) GROUP BY ALL) h USING (ticker, ts)"""

IDS = ["parent_id", "child_tp_id", "child_sl_id", "child_maturity_id"]
LEVELS = ["entry", "tp", "sl", "sl_limit"]
COOLDOWN = 2 * 3600


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.thinned(exits(spark, sf_dir), cooldown_seconds=COOLDOWN)


TAKEN_SQL = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM ({EXITS_SQL})),
r AS (SELECT ticker, i, true AS take, ts + INTERVAL {COOLDOWN} SECOND AS ready, coalesce(exit_ts, TIMESTAMP '9999-01-01') AS free FROM x WHERE i = 1
UNION ALL SELECT x.ticker, x.i, x.ts >= r.ready AND x.ts >= r.free, CASE WHEN x.ts >= r.ready THEN x.ts + INTERVAL {COOLDOWN} SECOND ELSE r.ready END, CASE WHEN x.ts >= r.ready AND x.ts >= r.free THEN coalesce(x.exit_ts, TIMESTAMP '9999-01-01') ELSE r.free END
FROM r JOIN x ON x.ticker = r.ticker AND x.i = r.i + 1)
SELECT x.* EXCLUDE (i) FROM x JOIN r USING (ticker, i) WHERE take"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.transactions(taken(spark, sf_dir)), ["current_price", "child_tp_price", "child_sl_price"])


LEDGER_SQL = f"""WITH t AS (SELECT *, (row_number() OVER (ORDER BY ts, ticker) - 1) * 4 + 1 AS id FROM ({TAKEN_SQL}))
SELECT id AS transaction_id, ts AS "time_UTC", ticker, round(entry, 6) AS current_price, 'buy' AS transaction_type, 2 AS quantity, 'entry' AS order_type, NULL::BIGINT AS parent_id, round(tp, 6) AS child_tp_price, id + 1 AS child_tp_id, round(sl, 6) AS child_sl_price, id + 2 AS child_sl_id, id + 3 AS child_maturity_id, maturity AS "child_maturity_UTC" FROM t
UNION ALL SELECT id + CASE exit_type WHEN 'tp' THEN 1 WHEN 'sl' THEN 2 ELSE 3 END, exit_ts, ticker, round(exit_price, 6), 'sell', 2, exit_type, id, NULL, NULL, NULL, NULL, NULL, NULL FROM t WHERE exit_ts IS NOT NULL"""


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger appended to a CSV folder in two parts, and read again."""
    path, rows = scratch(spark), signals.transactions(taken(spark, sf_dir))
    specs.append_ledger(rows.where("transaction_type = 'buy'"), path)
    specs.append_ledger(rows.where("transaction_type <> 'buy'"), path)
    back = specs.read_ledger(spark, path).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_UTC", "child_maturity_UTC")})
    return as_doubles(rounded(back, ["current_price", "child_tp_price", "child_sl_price"]), IDS)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir)
    side = F.when(F.col("transaction_type") == "buy", "BOT").otherwise("SLD")
    return t.select(F.col("transaction_id").alias("order_id"), F.col("time_UTC").alias("ts"), F.col("ticker").alias("symbol"), side.alias("side"), F.col("quantity").cast("double").alias("shares"), F.col("current_price").alias("price"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.average_cost(fills(spark, sf_dir)), ["shares_held", "cost_held", "exposure"], 4)


POSITIONS_SQL = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT transaction_id AS order_id, "time_UTC" AS ts, ticker AS symbol, CASE transaction_type WHEN 'buy' THEN 'BOT' ELSE 'SLD' END AS side, quantity::DOUBLE AS shares, current_price AS price,
row_number() OVER (PARTITION BY ticker ORDER BY "time_UTC", transaction_id) AS i FROM ({LEDGER_SQL})),
r AS (SELECT symbol, i, CASE side WHEN 'BOT' THEN shares ELSE 0 END AS held, CASE side WHEN 'BOT' THEN shares * price ELSE 0 END AS cost, CASE side WHEN 'BOT' THEN shares * price ELSE 0 END AS exposure FROM f WHERE i = 1
UNION ALL SELECT f.symbol, f.i, CASE WHEN f.side = 'BOT' THEN f.shares ELSE greatest(held - f.shares, 0) END, CASE WHEN f.side = 'BOT' THEN f.shares * f.price WHEN held - f.shares <= 0 THEN 0 ELSE cost - f.shares * cost / held END,
CASE WHEN f.side = 'BOT' THEN exposure + f.shares * f.price WHEN held > 0 THEN exposure - f.shares * cost / held ELSE exposure END FROM r JOIN f ON f.symbol = r.symbol AND f.i = r.i + 1)
SELECT order_id, ts, symbol, side, shares, price, nullif(held, 0) AS shares_held, CASE WHEN held > 0 THEN round(cost, 4) END AS cost_held, round(exposure, 4) + 0.0 AS exposure FROM f JOIN r USING (symbol, i)"""


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.exposure_timeline(taken(spark, sf_dir), limit=300), ["change", "exposure"], 4)


EXPOSURE_SQL = f"""WITH t AS ({TAKEN_SQL}), e AS (SELECT ts, 2 * entry AS c FROM t UNION ALL SELECT exit_ts, -2 * entry FROM t WHERE exit_ts IS NOT NULL), s AS (SELECT ts, sum(c) AS change, bool_or(c > 0) AS bought FROM e GROUP BY ts)
SELECT ts, round(change, 4) + 0.0 AS change, round(sum(change) OVER (ORDER BY ts), 4) + 0.0 AS exposure, bought AND sum(change) OVER (ORDER BY ts) > 300 AS breach FROM s"""


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = taken(spark, sf_dir)
    return signals.expired(t, F.lit("2024-01-15").cast("timestamp_ntz")).select("ticker", "ts", "maturity")


# Evaluation

EVALUATION_SQL = f"""SELECT ticker, ts, CASE WHEN profit > 0 AND accuracy > 0 THEN 1 ELSE 0 END AS pred, ret, (ret > 0)::INT AS truth FROM (SELECT *, (lead(close, 15) OVER (PARTITION BY ticker ORDER BY ts) / close - 1) * 100 AS ret FROM ({SCORES_SQL}))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = evaluate.forward_returns(B.bars_events(spark, sf_dir))
    pred = F.when((F.col("profit") > 0) & (F.col("accuracy") > 0), 1).otherwise(0)
    return labelled.join(scores(spark, sf_dir), ["ticker", "ts"]).select("ticker", "ts", pred.alias("pred"), "ret", "truth")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.forward_returns(B.bars_events(spark, sf_dir)).select("ticker", "ts", "ret", "truth"), ["ret"])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.confusion(judged(spark, sf_dir), ["ticker"]), ["accuracy", "win_rate", "profitability", "profit_factor"], 4)


CONFUSION_SQL = f"""WITH j AS (SELECT * FROM ({EVALUATION_SQL}) WHERE truth IS NOT NULL), s AS (SELECT ticker, count(*) FILTER (pred = 1 AND truth = 1) AS tp, count(*) FILTER (pred = 1 AND truth = 0) AS fp, count(*) FILTER (pred = 0 AND truth = 1) AS fn, count(*) FILTER (pred = 0 AND truth = 0) AS tn,
coalesce(sum(ret) FILTER (pred = 1), 0.0) AS p, coalesce(sum(ret) FILTER (pred = 1 AND ret > 0), 0.0) AS g, coalesce(-sum(ret) FILTER (pred = 1 AND ret < 0), 0.0) AS l FROM j GROUP BY ticker)
SELECT ticker, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / nullif(tp + fp, 0), 4) AS win_rate, round(p, 4) + 0.0 AS profitability, round(CASE WHEN l = 0 THEN 999 ELSE g / l END, 4) AS profit_factor, tp + fp AS trades, 2 * (tp + fp) AS turnover FROM s"""


def class_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_returns(judged(spark, sf_dir)), ["mean", "median", "deviation"], 4)


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.equity(taken(spark, sf_dir)), ["pnl", "total", "drawdown"], 4)


EQUITY_SQL = f"""WITH d AS (SELECT exit_ts::DATE AS day, sum((exit_price - entry) * 2) AS pnl FROM ({TAKEN_SQL}) WHERE exit_ts IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(pnl) OVER (ORDER BY day) AS total FROM d)
SELECT day, pnl, total, greatest(max(total) OVER (ORDER BY day), 0.0) - total AS drawdown FROM r"""


def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.equity_metrics(evaluate.equity(taken(spark, sf_dir))), ["net", "max_drawdown", "sharpe", "sortino"], 4)


EQUITY_METRICS_SQL = f"""WITH e AS ({EQUITY_SQL}), p AS (SELECT *, sum((drawdown <= 0)::INT) OVER (ORDER BY day) AS peak FROM e)
SELECT round(sum(pnl), 4) + 0.0 AS net, count(*) AS days, round(max(drawdown), 4) AS max_drawdown, round(avg(pnl) / stddev_samp(pnl), 4) AS sharpe, round(avg(pnl) / sqrt(avg(least(pnl, 0.0) ** 2)), 4) AS sortino,
(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM p WHERE drawdown > 0 GROUP BY peak)) AS drawdown_days FROM e"""


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.walk_forward(judged(spark, sf_dir))
    return out.groupBy("roll", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


WALK_SQL = f"""WITH j AS ({EVALUATION_SQL}), t AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1) / count(*) OVER () AS share FROM (SELECT DISTINCT ts FROM j)),
r AS (SELECT ts, roll, CASE WHEN share < round(0.2 + roll * 0.04, 9) THEN 'train' WHEN share < round(0.2 + roll * 0.04 + 0.04, 9) THEN 'validation' END AS role FROM t, range(20) x(roll))
SELECT roll::INTEGER AS roll, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r JOIN j USING (ts) WHERE role IS NOT NULL GROUP BY ALL"""


# Streams over the tables


def pieces(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Events as a stream of six files, one a batch."""
    return live.read_stream(spark, live.in_pieces(spark.read.parquet(f"{sf_dir}/events.parquet"), f"{at}/in"), 1)


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of raw quotes, normalised, folded to minute bars."""
    at = scratch(spark)
    typed = payloads.normal_quotes(raw_quotes(spark, sf_dir, pieces(spark, sf_dir, at)), F.lit("2000-01-01").cast("timestamp"))
    out = live.run_once(live.minute_bars(typed), f"{at}/bars", f"{at}/checkpoint")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), SHOWN)


MINUTE_BARS_SQL = f"""WITH q AS ({QUOTES_SQL}), b AS (SELECT symbol AS ticker, date_trunc('minute', ts + INTERVAL 5 SECOND)::TIMESTAMP AS ts, arg_min(close, (ts, volume)) AS open, max(close) AS high, min(close) AS low, arg_max(close, (ts, volume)) AS close, (arg_max(volume, (ts, volume)) - arg_min(volume, (ts, volume)))::DOUBLE AS volume, max(ts) AS t FROM q GROUP BY ALL)
SELECT ticker, ts, open, high, low, close, volume FROM b"""


def batch_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = payloads.normal_quotes(raw_quotes(spark, sf_dir), F.lit("2000-01-01").cast("timestamp"))
    return rounded(live.minute_bars(typed).withColumn("ts", F.col("ts").cast("timestamp_ntz")), SHOWN)


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of high value as a stream of signals, one per ticker and two hours let through."""
    at = scratch(spark)
    e = pieces(spark, sf_dir, at).where("value > 5").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    out = live.run_once(live.cooled_entries(e, COOLDOWN), f"{at}/out", f"{at}/checkpoint")
    return out.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


COOLDOWN_SQL = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT event_type AS ticker, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events WHERE value > 5),
r AS (SELECT ticker, i, true AS take, ts + INTERVAL {COOLDOWN} SECOND AS ready FROM x WHERE i = 1
UNION ALL SELECT x.ticker, x.i, x.ts >= r.ready, CASE WHEN x.ts >= r.ready THEN x.ts + INTERVAL {COOLDOWN} SECOND ELSE r.ready END FROM r JOIN x ON x.ticker = r.ticker AND x.i = r.i + 1)
SELECT ticker, ts, event_id FROM x JOIN r USING (ticker, i) WHERE take"""


def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars in update mode: each bar as it was last seen, those in progress too."""
    at = scratch(spark)
    typed = payloads.normal_quotes(raw_quotes(spark, sf_dir, pieces(spark, sf_dir, at)), F.lit("2000-01-01").cast("timestamp"))
    out = live.latest_updates(live.minute_bars(typed), f"{at}/bars", f"{at}/checkpoint")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), SHOWN)


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a stream of six files: SMA, EMA and RSI of each bar on the last 250 bars of its ticker, as a live buffer of that size gives them."""
    at = scratch(spark)
    live.in_pieces(B.bars_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), f"{at}/in")
    wanted = {c: (n, {"time_period": 10, "series_type": "CLOSE"}) for c, n in LIVE.items()}
    out = live.live_features(live.read_stream(spark, f"{at}/in", 1), lambda b: features.frame_values(b, wanted, 250), f"{at}/features", f"{at}/checkpoint")
    return rounded(out.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), *wanted), list(wanted))


LIVE = {"sma": "SMA", "ema": "EMA", "rsi": "RSI"}


def stream_features_sql() -> str:
    return frame_mode_sql(250, LIVE, 10)


def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of high value as positions that mature after an hour, given out when the watermark has passed that."""
    at = scratch(spark)
    e = pieces(spark, sf_dir, at).where("value > 5").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("maturity"), "event_id")
    out = live.run_once(live.expired_positions(e), f"{at}/out", f"{at}/checkpoint", stateful=True)
    return out.select("ticker", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("ts", "maturity")], "event_id")


EXPIRY_SQL = """SELECT event_type AS ticker, ts, ts + INTERVAL 1 HOUR AS maturity, event_id FROM events WHERE value > 5 AND ts + INTERVAL 1 HOUR < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM events WHERE value > 5)"""

_QUERIES: dict[str, tuple[Query, str | Callable[[], str]]] = {
    "payload_bars": (payload_bars, PAYLOAD_SQL), "payload_indicator": (payload_indicator, payload_indicator_sql), "quotes": (quotes, QUOTES_SQL),
    "local_epochs": (local_epochs, "SELECT event_id, epoch(date_trunc('minute', ts))::BIGINT AS uts FROM events"), "spec_table": (spec_table, SPECS_SQL),
    "anomaly_repair": (repaired, repaired_sql), "anomaly_counts": (dropped, dropped_sql), "regular_grid": (grid, GRID_SQL), "market_session": (session, SESSION_SQL),
    "latest_close": (latest_close, f"SELECT ticker, round(arg_max(close, ts), 6) AS close FROM ({USER_BARS_SQL}) GROUP BY ticker"), "chunked_ema": (chunked_ema, chunked_ema_sql), "long_series": (long_series, long_series_sql), "long_hilbert": (long_hilbert, long_hilbert_sql), "long_stops": (long_stops, long_stops_sql), "wide_series": (wide_series, WIDE_SQL),
    "context_windows": (contexts, contexts_sql), "feature_report": (feature_report, feature_report_sql), "frame_mode": (frame_mode, lambda: frame_mode_sql(100)), "frame_mode_every_bar": (frame_mode_every_bar, lambda: frame_mode_sql(250)), "frame_features": (frame_features, lambda: frame_mode_sql(60, FRAME_FEATURES)),
    "agreement_entries": (lambda s, d: rounded(entries(s, d), LEVELS), f"SELECT ticker, ts, {rounded_sql(LEVELS)}, maturity FROM ({ENTRIES_SQL})"),
    "first_exits": (lambda s, d: rounded(exits(s, d), [*LEVELS, "exit_price"]), f"SELECT ticker, ts, {rounded_sql([*LEVELS, 'exit_price'])}, maturity, exit_ts, exit_type FROM ({EXITS_SQL})"),
    "thinned_entries": (lambda s, d: rounded(taken(s, d), [*LEVELS, "exit_price"]), f"SELECT ticker, ts, {rounded_sql([*LEVELS, 'exit_price'])}, maturity, exit_ts, exit_type FROM ({TAKEN_SQL})"),
    "transactions": (lambda s, d: as_doubles(ledger(s, d), IDS), f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in IDS)}) FROM ({LEDGER_SQL})"), "average_cost": (positions, POSITIONS_SQL), "exposure_timeline": (exposure, EXPOSURE_SQL),
    "expired_positions": (expired, f"SELECT ticker, ts, maturity FROM ({TAKEN_SQL}) WHERE maturity < TIMESTAMP '2024-01-15'"),
    "forward_returns": (lambda s, d: as_doubles(labels(s, d), ["truth"]), f"SELECT ticker, ts, round(ret, 6) + 0.0 AS ret, truth::DOUBLE AS truth FROM ({EVALUATION_SQL})"), "confusion_metrics": (confusion, CONFUSION_SQL),
    "class_returns": (class_returns, f"SELECT truth, pred, count(*) AS n, round(avg(ret), 4) + 0.0 AS mean, round(quantile_cont(ret, 0.5), 4) + 0.0 AS median, round(stddev_samp(ret), 4) AS deviation FROM ({EVALUATION_SQL}) WHERE ret IS NOT NULL GROUP BY ALL"),
    "equity_days": (lambda s, d: equity(s, d).withColumn("day", F.col("day").cast("string")), f"SELECT day::VARCHAR AS day, {rounded_sql(['pnl', 'total', 'drawdown'], 4)} FROM ({EQUITY_SQL})"), "equity_metrics": (equity_metrics, EQUITY_METRICS_SQL), "walk_forward": (walk_forward, WALK_SQL),
    "tracked_bars": (tracked_bars, TRACKED_SQL), "stored_bars": (stored_bars, PAYLOAD_SQL), "stored_features": (stored_features, stored_features_sql), "catalog_scan": (catalog_scan, CATALOG_SQL), "report_scan": (report_scan, "SELECT event_type AS name, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1"),
    "context_windows_every_bar": (every_context, every_context_sql), "context_matrix": (matrix, matrix_sql), "aligned_features": (aligned, ALIGNED_SQL),
    "stored_ledger": (stored_ledger, f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in IDS)}) FROM ({LEDGER_SQL})"),
    "stream_updates": (stream_updates, MINUTE_BARS_SQL), "stream_features": (stream_features, stream_features_sql), "stream_expiry": (stream_expiry, EXPIRY_SQL),
    "minute_bars": (batch_bars, MINUTE_BARS_SQL), "stream_minute_bars": (stream_bars, f"{MINUTE_BARS_SQL} WHERE ts + INTERVAL 55 SECOND <= (SELECT max(ts) FROM q) - INTERVAL 2 MINUTE"), "stream_cooldown": (stream_cooldown, COOLDOWN_SQL),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s if isinstance(s, str) else s() for name, (_, s) in _QUERIES.items()}
