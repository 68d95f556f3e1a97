"""Registered queries against their SQL in another engine."""

import pytest

from barloom import catalog, catalog_tables
from barloom.operators import indicators

from .conftest import SF
from .oracle import compare

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
SOME = [n for n in QUERIES if not n.startswith("ind_")] + [f"ind_{n}" for n in "sma wma t3 rsi adx sar stoch_slowd obv ht_dcphase aroon_au vwap bbands_rub".split()]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert len([n for n in QUERIES if n.startswith("ind_")]) == 73
    assert set(catalog_tables.queries()) <= set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    compare(spark, name, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", [n for n in indicators.INDICATORS if n.startswith("HT_")])
def test_hilbert_queries_cover_every_bar(spark, name):
    """Tickers of over 250 bars."""
    compare(spark, name, QUERIES[f"ind_{name.lower()}"], SQL[f"ind_{name.lower()}"], SF.replace("0.001", "0.01"))


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
