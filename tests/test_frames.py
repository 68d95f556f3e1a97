"""Frame values against each frame computed by itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import catalog
from barloom.operators import indicators
from barloom.plans import features, frames
from barloom.plans.graph import Graph

DIRECT = "EMA DEMA TEMA T3 FAMA MACD_MACD MACD_SIGNAL MACD_HIST RSI ATR NATR PLUS_DI MINUS_DI DX PLUS_DM SMA WMA TRIMA WILLR AROONOSC MFI ULTOSC CCI BBANDS_RUB MIDPRICE OBV AD ROC BOP".split()


def some_bars(spark, n, holes, tickers=("a", "b"), seed=4):
    rng = np.random.default_rng(seed)
    parts = []
    for t in tickers:
        close = 50 + rng.normal(size=n).cumsum()
        high, low = close + rng.random(n), close - rng.random(n)
        part = pd.DataFrame({"ticker": t, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "open": close + 0.1, "high": high, "low": low, "close": close, "volume": rng.integers(0, 9, n).astype(float)})
        for c in ("open", "high", "low", "close", "volume"):
            part.loc[rng.random(n) < holes, c] = np.nan
        parts.append(part)
    rows = [tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in pd.concat(parts).itertuples(index=False)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_frames_without_copies(spark, holes, monkeypatch):
    """Each of DIRECT equals the series of the copied frames, also with nulls, over blocks shorter than the series."""
    bars = some_bars(spark, 90, holes)
    wanted = {n.lower(): (n, catalog.parameters(n) | {"time_period": 5, "fastperiod": 3, "slowperiod": 6}) for n in DIRECT}
    g = Graph()
    nodes = {c: indicators.build(g, n, p) for c, (n, p) in wanted.items()}
    got, rest = frames.frame_series(bars, nodes, g, 30, ["ticker"], block=40)
    assert not rest
    copies = indicators.series(features.frames(bars, 30), wanted, ["ticker", "anchor_ts"]).where("ts = anchor_ts")
    a = got.orderBy("ticker", "ts").toPandas()
    b = copies.orderBy("ticker", "ts").toPandas()
    assert len(a) == len(b) == 180
    for c in wanted:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_other_series_are_copied(spark):
    bars = some_bars(spark, 40, 0.0, ("a",))
    wanted = {"adx": ("ADX", {"time_period": 5}), "sar": ("SAR", {}), "ema": ("EMA", {"time_period": 5, "series_type": "CLOSE"})}
    out = features.frame_values(bars, wanted, 20).orderBy("ts").toPandas()
    copies = indicators.series(features.frames(bars, 20), wanted, ["ticker", "anchor_ts"]).where("ts = anchor_ts").orderBy("ts").toPandas()
    for c in wanted:
        np.testing.assert_allclose(out[c], copies[c], rtol=1e-9, err_msg=c)


def test_frame_ends_with_infinities_and_late_starts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    x[:40] = np.nan
    x[150] = np.inf
    x[200:230] = np.nan
    first = np.where(np.arange(300) % 7 == 0, 1.5, np.nan)
    first[::2] = x[::2]
    runs = [frames.Run(0.2, None), frames.Run(0.3, ((0, 1.0),)), frames.Run(0.9, ((0, 1.0), (1, -1.0))), frames.Run(1.0, ((2, 2.0),))]
    got = frames.frame_ends(x, first, runs, 25, np.arange(1, 301))
    for t in range(300):
        s = max(0, t - 24)
        want = frames.one_frame(x[s : t + 1], first[s], runs)
        np.testing.assert_allclose(got[t], want, rtol=1e-9, atol=1e-12)


def test_empty_and_single(spark):
    bars = some_bars(spark, 1, 0.0, ("a",))
    wanted = {"ema": ("EMA", {"time_period": 5, "series_type": "CLOSE"}), "rsi": ("RSI", {"time_period": 5, "series_type": "CLOSE"})}
    assert features.frame_values(bars.limit(0), wanted, 20).count() == 0
    row = features.frame_values(bars, wanted, 20).first()
    assert row["ema"] == row["close"] and row["rsi"] is None
    assert features.frame_values(bars.withColumn("x", F.lit(1)), wanted, 20).columns == [*bars.columns, "x", "ema", "rsi"]


def test_a_null_ticker_is_a_ticker(spark):
    """It has frames, copied or not, a grid, and upserts in place, as any other has."""
    from barloom.operators import cleaning

    wanted = {"ema": ("EMA", {"time_period": 5, "series_type": "CLOSE"}), "sar": ("SAR", {})}
    named = some_bars(spark, 30, 0.0, ("a",))
    nameless = named.withColumn("ticker", F.lit(None).cast("string"))
    for make in (lambda b: features.frame_values(b, wanted, 8), lambda b: cleaning.regular_grid(b, size=40)):
        one, other = (make(b).drop("ticker").orderBy("ts").toPandas() for b in (named, nameless))
        assert len(one) > 0
        pd.testing.assert_frame_equal(one, other)


def test_upserts_of_a_null_ticker(spark, tmp_path):
    from barloom.streaming import live

    path = str(tmp_path / "table")
    rows = some_bars(spark, 5, 0.0, ("a",))
    for close in (1.0, 2.0):
        live.upsert(rows.withColumn("ticker", F.lit(None).cast("string")).unionByName(rows).withColumn("close", F.lit(close)), path)
    assert [(r["close"], r["count"]) for r in spark.read.parquet(path).groupBy("close").count().collect()] == [(2.0, 10)]
