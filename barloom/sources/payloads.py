"""Raw payload and quote tables, as text, to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import epoch_of_local_minute, number, utc_from_local

ZONE = "America/New_York"
# Field names of the payloads: fixed values.
INTRADAY_KEY = "Time Series (1min)"
BAR_FIELDS = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
INDICATOR_KEY = "Technical Analysis: {}"
PUBLISHED_NAMES = {"AD": "Chaikin A/D"}
QUOTE_PRICES = ["open", "high", "low", "close"]
QUOTE_CHANGES = ["change", "change_percent", "extended_hours_quote", "extended_hours_change", "extended_hours_change_percent"]


def intraday_bars(payloads: DataFrame, *, zone: str = ZONE) -> DataFrame:
    """Bars of (ticker, payload), a JSON text with a map from local time to price texts.

    Fields that are no numbers, or missing, are null; times that can't be read, payloads without the map and null payloads give no row.
    """
    fields = ", ".join(f"`{f}`: STRING" for f in BAR_FIELDS.values())
    parsed = payloads.select("ticker", F.from_json("payload", f"`{INTRADAY_KEY}` MAP<STRING, STRUCT<{fields}>>")[INTRADAY_KEY].alias("m"))
    rows = parsed.select("ticker", F.explode("m").alias("at", "bar"))
    return rows.select("ticker", utc_from_local(F.col("at"), zone).alias("ts"), *[number(F.col("bar")[f]).alias(n) for n, f in BAR_FIELDS.items()]).where("ts is not null")


def indicator_series(payloads: DataFrame, function: str) -> DataFrame:
    """(ticker, uts, name, value) of (ticker, payload): a map from local minute to a map of outputs; a value that is no number is null.

    Some outputs are published under another name than the function's. A payload with an empty or missing map gives no row.
    """
    key = INDICATOR_KEY.format(function)
    parsed = payloads.select("ticker", F.from_json("payload", f"`{key}` MAP<STRING, MAP<STRING, STRING>>")[key].alias("m"))
    rows = parsed.select("ticker", F.explode("m").alias("at", "outputs")).select("ticker", epoch_of_local_minute(F.col("at")).alias("uts"), F.explode_outer("outputs").alias("name", "text"))
    ours = {v: k for k, v in PUBLISHED_NAMES.items()}
    name = F.coalesce(*[F.when(F.col("name") == p, F.lit(o)) for p, o in ours.items()], F.col("name"))
    return rows.select("ticker", "uts", name.alias("name"), number(F.col("text")).alias("value")).where("uts is not null")


def normal_quotes(quotes: DataFrame, received: Column, *, zone: str = ZONE) -> DataFrame:
    """Typed quotes of text columns: rows without a symbol go; a price that is no number is the previous close, else 0; a volume
    that is none is 0, as are the changes; a time that can't be read is ``received``. Columns that are missing count as null.
    """
    text = lambda c: F.col(c) if c in quotes.columns else F.lit(None).cast("string")
    zero = F.lit(0.0)
    before = number(text("previous_close"))
    return quotes.where(F.length(F.trim("symbol")) > 0).select(
        F.trim("symbol").alias("symbol"), F.coalesce(utc_from_local(text("timestamp"), zone), received).alias("ts"),
        *[F.coalesce(number(text(c)), before, zero).alias(c) for c in QUOTE_PRICES], F.coalesce(number(text("volume")), zero).cast("long").alias("volume"),
        F.coalesce(before, zero).alias("previous_close"), *[F.coalesce(number(F.rtrim(text(c), F.lit("% "))), zero).alias(c) for c in QUOTE_CHANGES],
    )


def tracked(rows: DataFrame, tickers: DataFrame, column: str = "ticker") -> DataFrame:
    """Rows whose ticker is in ``tickers`` (a column ticker)."""
    return rows.join(tickers.select(F.col("ticker").alias(column)).distinct(), column, "left_semi")
