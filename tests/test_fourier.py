"""The quadrature in chunks against the transform of the whole series."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom import catalog_tables as T
from barloom.functions.safe import clean_double
from barloom.operators import fourier, scans

from .oracle import compare


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 97, 100, 128])
def test_kernel(n):
    size = 1 << max(1, (2 * n - 2).bit_length())
    x = np.random.default_rng(n).normal(size=n)
    h = fourier.kernel(np.arange(size), n, size)
    got = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(h)).real[:n]
    np.testing.assert_allclose(got, scans.quadrature(x), atol=1e-12)


@pytest.mark.parametrize("cells", [16, 256, 1 << 18])
def test_quadrature_in_chunks(spark, cells):
    """Even, odd and prime lengths, one to several chunks; a key with a null has no value."""
    rng = np.random.default_rng(3)
    series = {str(n): rng.normal(size=n) * 50 + 100 for n in (1, 2, 3, 7, 64, 97, 180, 251)}
    rows = [(k, "x", i + 1, float(v)) for k, values in series.items() for i, v in enumerate(values)] + [("gap", "x", 1, 1.0), ("gap", "x", 2, None), (None, "x", 1, 4.0), (None, "x", 2, 5.0), (None, "x", 3, 9.0)]
    df = spark.createDataFrame(rows, "ticker string, other string, place long, close double")
    out = fourier.quadrature_blocks(df, "q", "close", ["ticker", "other"], "place", cells).orderBy("ticker", "place").toPandas()
    assert len(out) == len(rows)
    for k, values in {**series, None: np.array([4.0, 5.0, 9.0])}.items():
        got = out[out.ticker == k] if k else out[out.ticker.isna()]
        np.testing.assert_allclose(got.q.to_numpy(float), scans.quadrature(values), atol=1e-8, err_msg=str(k))
    assert out[out.ticker == "gap"].q.isna().all()


@pytest.mark.parametrize("cells", [16, 1 << 17])
def test_quadrature_keeps_all_digits(spark, cells):
    """Sums of products, rounded once, next to values a million times as large."""
    rng = np.random.default_rng(4)
    series = {str(n): np.where(rng.random(n) < 0.1, 1e6, 1.0) * rng.integers(1, 56000, n) / 100 for n in (64, 97, 300)}
    rows = [(k, i + 1, float(v)) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, place long, close double")
    out = fourier.quadrature_blocks(df, "q", "close", ["ticker"], "place", cells).orderBy("ticker", "place").toPandas()
    for k, x in series.items():
        n = len(x)
        h = fourier.kernel(np.arange(n), n, 2 * n).astype(np.longdouble)
        expected = np.array([np.sum(h[(i - np.arange(n)) % n] * x) for i in range(n)])
        error = np.abs(out[out.ticker == k].q.to_numpy(float) - expected)
        assert (error <= np.spacing(np.abs(expected).astype(float)) / 2 + 1e-17 * np.abs(x).max()).all(), k


def test_doubles_are_rounded_as_in_sql(spark):
    """Halves of all kinds, of both signs, beside large and special numbers."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.arange(1, 8001, 2) / 800, -np.arange(1, 4001, 2) / 800, rng.normal(size=2000) * 10.0 ** rng.integers(-6, 12, 2000), [0.0, -0.0, -1e-9, np.inf, -np.inf]])
    f = pd.DataFrame({"i": np.arange(len(x)), "x": x})
    got = spark.createDataFrame(f).select("i", clean_double(T.F.col("x"), 4).alias("y")).orderBy("i").toPandas().y
    np.testing.assert_array_equal(got, duckdb.sql("SELECT CASE WHEN isinf(x) THEN x ELSE round(x, 4) + 0.0 END AS y FROM f ORDER BY i").df().y)
    assert not np.signbit(got[got == 0]).any()


def test_long_hilbert_with_a_mean_beside_a_half(spark, tmp_path):
    """The mean of the first eight lows is the double below 0.08625."""
    value = np.random.default_rng(63).integers(1, 40, (12, 4)) / 100
    hours = [dt.datetime(2024, 1, 1, h, 10 * i) for h in range(12) for i in range(4)]
    events = pd.DataFrame({"event_id": range(48), "ts": hours, "user_id": 1, "event_type": "view", "value": value.ravel(), "props": "{}"})
    duckdb.sql(f"COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM events) TO '{tmp_path}/events.parquet'")
    compare(spark, "long_hilbert", T.long_hilbert, T.long_hilbert_sql(), str(tmp_path))
