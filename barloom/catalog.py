"""The registered queries of the analytics library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.safe import clean_zero
from .operators import indicators
from .plans import duck
from .plans.graph import Graph
from .sources import bars as B

Query = Callable[[SparkSession, str], DataFrame]

BARS_SQL = """SELECT event_type AS ticker, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL"""
USER_BARS_SQL = BARS_SQL.replace("event_type", "user_id::VARCHAR", 1).replace("event_type", "user_id").replace("'hour'", "'day'")
PRICES = ["OPEN", "HIGH", "LOW", "CLOSE"]
SINGLE: dict[str, object] = {
    "time_period": 10, "fastperiod": 8, "slowperiod": 21, "signalperiod": 6, "fastkperiod": 9, "slowkperiod": 4, "slowdperiod": 4, "fastdperiod": 4, "timeperiod1": 6, "timeperiod2": 12, "timeperiod3": 24,
    "fastlimit": 0.4, "slowlimit": 0.06, "acceleration": 0.03, "maximum": 0.25, "nbdevup": 1.5, "nbdevdn": 2.5,
}
"""Values of all parameters; an indicator reads those it has."""
CUMULATIVE = {"AD", "ADOSC", "OBV", "HT_DCPERIOD", "HT_DCPHASE"}
"""Rounded to 4 digits: sums over whole series."""


def parameters(name: str) -> dict:
    """What an indicator is registered with: SINGLE, and by its place among all the price and the kinds of average, so that each of these has its turn."""
    place = list(indicators.INDICATORS).index(name)
    kinds = {kind: (place + i) % 9 for i, kind in enumerate(("matype", "slowkmatype", "slowdmatype", "fastdmatype"))}
    return SINGLE | {"series_type": PRICES[place % 4]} | kinds


def digits(name: str) -> int:
    return 4 if name in CUMULATIVE else 6


def indicator_query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = indicators.series(B.bars_events(spark, sf_dir), {"value": (name, parameters(name))})
        return out.select("ticker", "ts", clean_zero(F.col("value"), digits(name)).alias("value"))

    return query


def indicator_sql(name: str) -> str:
    g = Graph()
    return duck.sql(BARS_SQL, {"value": indicators.build(g, name, parameters(name))}, digits(name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMA(15) and RSI(15) on the close of hourly event bars."""
    wanted = {n.lower(): (n, {"series_type": "CLOSE", "time_period": 15}) for n in ("SMA", "RSI")}
    out = indicators.series(B.bars_events(spark, sf_dir), wanted)
    return out.select("ticker", "ts", *[clean_zero(F.col(c), 6).alias(c) for c in wanted])


def flagship_sql() -> str:
    g = Graph()
    return duck.sql(BARS_SQL, {n.lower(): indicators.build(g, n, {"series_type": "CLOSE", "time_period": 15}) for n in ("SMA", "RSI")})


def rounded_bars(make: Query, n: int = 6) -> Query:
    return lambda spark, sf_dir: make(spark, sf_dir).select("ticker", "ts", *[clean_zero(F.col(c), n).alias(c) for c in B.BAR_COLUMNS[2:]])


def rounded_bars_sql(base: str, n: int = 6) -> str:
    return f"SELECT ticker, ts, {', '.join(f'round({c}, {n}) + 0.0 AS {c}' for c in B.BAR_COLUMNS[2:])} FROM ({base})"


LINEITEM_BARS_SQL = """SELECT l_suppkey::VARCHAR AS ticker, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS p, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey, 'f': l_extendedprice, 'g': l_quantity} AS k FROM lineitem) GROUP BY 1, 2"""


def queries() -> dict[str, Query]:
    from . import catalog_tables

    out: dict[str, Query] = {"flagship": flagship, "bars_events": rounded_bars(B.bars_events), "bars_users": rounded_bars(B.bars_users), "bars_lineitem": rounded_bars(B.bars_lineitem, 9)}
    out |= {f"ind_{name.lower()}": indicator_query(name) for name in indicators.INDICATORS}
    return out | catalog_tables.queries()


def oracle_sql() -> dict[str, str]:
    from . import catalog_tables

    out = {"flagship": flagship_sql(), "bars_events": rounded_bars_sql(BARS_SQL), "bars_users": rounded_bars_sql(USER_BARS_SQL), "bars_lineitem": rounded_bars_sql(LINEITEM_BARS_SQL, 9)}
    out |= {f"ind_{name.lower()}": indicator_sql(name) for name in indicators.INDICATORS}
    return out | catalog_tables.oracle_sql()
