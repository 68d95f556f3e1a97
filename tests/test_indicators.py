"""Indicators against pandas formulas of our own, on small bars with nulls, flat stretches, ties and short series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as I
from barloom.operators import scans
from barloom.plans import features

NULL = np.nan


def bars(close, ticker="A", high=None, low=None, open_=None, volume=None):
    close = [float(x) for x in close]
    n = len(close)
    up = lambda x, d: [c + d for c in close] if x is None else [float(v) for v in x]
    return pd.DataFrame({"ticker": ticker, "ts": [dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=i) for i in range(n)], "open": up(open_, -0.25), "high": up(high, 1), "low": up(low, -1), "close": close, "volume": up(volume if volume is not None else [100.0 + i for i in range(n)], 0)})


def walk(n=80, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    return bars(close, high=close + rng.random(n), low=close - rng.random(n), open_=close + rng.normal(0, 0.3, n), volume=rng.integers(1, 1000, n))


def to_spark(spark, frame):
    clean = frame.astype(object).where(frame.notna(), None)
    schema = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"
    return spark.createDataFrame([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in clean.itertuples(index=False)], schema)


def run(spark, frame, name, **params):
    out = I.series(to_spark(spark, frame), {"value": (name, params)}).orderBy("ticker", "ts").toPandas()
    return out["value"].astype(float).to_numpy()


def near(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def ew(x, alpha):
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean()


def test_averages(spark):
    f = walk()
    c = f.close
    e = lambda x, n=5: ew(x, 2 / (n + 1))
    expected = {
        "SMA": c.rolling(5).mean(), "EMA": e(c), "WMA": c.rolling(5).apply(lambda w: np.dot(w, [1, 2, 3, 4, 5]) / 15, raw=True), "DEMA": 2 * e(c) - e(e(c)), "TEMA": 3 * e(c) - 3 * e(e(c)) + e(e(e(c))),
        "TRIMA": c.rolling(5).mean().rolling(5).mean(),
    }
    out = I.series(to_spark(spark, f), {n: (n, {"time_period": 5, "series_type": "CLOSE"}) for n in expected} | {"FAMA": ("FAMA", {"series_type": "CLOSE"}), "MAMA": ("MAMA", {"series_type": "CLOSE"})}).orderBy("ts").toPandas()
    for n, x in expected.items():
        near(out[n], x)
    near(out["FAMA"], ew(c, 0.03))
    near(out["MAMA"], ew(c, 0.05))


def test_average_codes(spark):
    f = walk(30)
    for code in range(9):
        assert np.isfinite(run(spark, f, "BBANDS_RMB", time_period=3, series_type="CLOSE", matype=code)[-1])
    with pytest.raises(ValueError):
        run(spark, f, "BBANDS_RMB", time_period=3, series_type="CLOSE", matype=9)
    assert np.isnan(run(spark, f, "APO", series_type="CLOSE", fastperiod=3, slowperiod=5, matype=9)).all()


def test_rsi(spark):
    d = walk().close.diff()
    up, down = ew(d.clip(lower=0), 1 / 5), ew(-d.clip(upper=0), 1 / 5)
    expected = 100 - 100 / (1 + up / down)
    expected[:5] = NULL
    near(run(spark, walk(), "RSI", time_period=5, series_type="CLOSE"), expected)
    near(run(spark, bars([1, 2, 3, 4, 5]), "RSI", time_period=2, series_type="CLOSE"), [NULL, NULL, 100, 100, 100])
    assert np.isnan(run(spark, bars([3] * 6), "RSI", time_period=2, series_type="CLOSE")).all()


def test_flat_windows(spark):
    flat = bars([5] * 6, high=[5] * 6, low=[5] * 6, open_=[5] * 6)
    assert np.isnan(run(spark, flat, "WILLR", time_period=3)).all()
    near(run(spark, flat, "STOCHF_FASTK", fastkperiod=3), [0] * 6)
    near(run(spark, flat, "BOP"), [0] * 6)
    near(run(spark, flat, "CMO", time_period=3, series_type="CLOSE"), [0] * 6)
    near(run(spark, flat, "AD"), [0] * 6)


def test_gap_rule_of_averages(spark):
    f = bars([1, 2, NULL, NULL, 5, NULL, 7], high=range(7), low=range(7), open_=range(7))
    near(run(spark, f, "EMA", time_period=3, series_type="CLOSE"), ew(f.close, 0.5))
    near(run(spark, bars([NULL, NULL, 3, 4], high=range(4), low=range(4), open_=range(4)), "EMA", time_period=3, series_type="CLOSE"), [NULL, NULL, 3, 3.5])


def test_aroon_ties_take_the_oldest(spark):
    f = bars([1] * 5, high=[3, 3, 2, 3, 1], low=[1, 0, 0, 2, 0])
    near(run(spark, f, "AROON_AU", time_period=3), [NULL, NULL, 100 / 3, 100 / 3, 200 / 3])
    near(run(spark, f, "AROON_AD", time_period=3), [NULL, NULL, 200 / 3, 100 / 3, 100 / 3])
    near(run(spark, f, "AROONOSC", time_period=3), run(spark, f, "AROON_AU", time_period=3) - run(spark, f, "AROON_AD", time_period=3))


def test_true_ranges_differ_in_the_first_row(spark):
    f = walk()
    near(run(spark, f, "TRANGE")[0], f.high[0] - f.low[0])
    tr = pd.concat([f.high - f.low, (f.high - f.close.shift()).abs(), (f.low - f.close.shift()).abs()], axis=1).max(axis=1)
    near(run(spark, f, "ATR", time_period=5), ew(tr, 1 / 5))
    up, down = f.high.diff(), -f.low.diff()
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    late = tr.copy()
    late[0] = NULL
    dip, dim = 100 * ew(plus, 1 / 5) / ew(late, 1 / 5), 100 * ew(minus, 1 / 5) / ew(late, 1 / 5)
    near(run(spark, f, "ADX", time_period=5), ew(100 * (dip - dim).abs() / (dip + dim), 1 / 5))
    dip, dim = 100 * ew(plus, 1 / 5) / ew(tr, 1 / 5), 100 * ew(minus, 1 / 5) / ew(tr, 1 / 5)
    dx = 100 * (dip - dim).abs() / (dip + dim)
    dx[:4] = NULL
    near(run(spark, f, "DX", time_period=5), dx)
    near(run(spark, f, "PLUS_DI", time_period=5), dip)


def test_volume_lines(spark):
    f = walk()
    near(run(spark, f, "OBV"), (np.sign(f.close.diff()).fillna(0) * f.volume).cumsum())
    ad = (((f.close - f.low) - (f.high - f.close)) / (f.high - f.low) * f.volume).cumsum()
    near(run(spark, f, "AD"), ad)
    near(run(spark, f, "ADOSC", fastperiod=3, slowperiod=5), ew(ad, 0.5) - ew(ad, 1 / 3))
    tp = (f.high + f.low + f.close) / 3
    near(run(spark, f, "VWAP"), (tp * f.volume).cumsum() / f.volume.cumsum())
    zero = bars([1, 2, 3], volume=[0, 0, 5])
    near(run(spark, zero, "VWAP"), [NULL, NULL, 3])


def test_sar_reverses(spark):
    f = bars([1, 2, 3, 4, 3, 1, 0], high=[1, 2, 3, 4, 3.5, 2, 1], low=[0, 1, 2, 3, 2, 0.05, 0])
    out = run(spark, f, "SAR", acceleration=0.02, maximum=0.2)
    # up: the second step is held back by the lows before it; the crossing at the sixth bar jumps to the top, then falls towards the new low
    near(out, [0, 0, 0, out[3], out[4], 4, 4 + 0.02 * (0.05 - 4)])
    assert 0 < out[3] <= 1 and out[3] < out[4] <= 2
    assert np.isnan(run(spark, bars([1]), "SAR")).all()


@pytest.mark.parametrize("n", [7, 60])
def test_quadrature(spark, n):
    x = 10 + np.sin(np.arange(n) / 3)
    q = run(spark, bars(x), "HT_PHASOR_QUADRATURE", series_type="CLOSE")
    m = (np.arange(n)[:, None] - np.arange(n)[None, :]) % n
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.where(m % 2 == 1, 2 / n / np.tan(np.pi * m / n), 0) if n % 2 == 0 else np.where(m == 0, 0, (1 / np.tan(np.pi * m / n) - np.cos(np.pi * m) / np.sin(np.pi * m / n)) / n)
    near(q, k @ x, 1e-8)
    phase = run(spark, bars(x), "HT_DCPHASE", series_type="CLOSE")
    near(phase, np.unwrap(np.arctan2(k @ x, x)), 1e-8)
    near(run(spark, bars(x), "HT_PHASOR_PHASE", series_type="CLOSE"), x)


def zeros_between(n=90):
    """Mostly zeros, so that angles go from a quarter turn to its opposite: by half a turn to the last bit."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(n) < 0.3, rng.integers(1, 9, n) / 100, 0.0)
    angle = np.arctan2(scans.quadrature(x), x)
    assert {np.pi, -np.pi} <= set(np.diff(angle))
    return x, np.unwrap(angle)


def test_steps_of_half_a_turn_are_no_jumps(spark):
    x, expected = zeros_between()
    near(run(spark, bars(x), "HT_DCPHASE", series_type="CLOSE"), expected, 1e-8)


def test_steps_of_half_a_turn_in_blocks(spark):
    x, expected = zeros_between()
    out = I.series(to_spark(spark, bars(x)), {"value": ("HT_DCPHASE", {"series_type": "CLOSE"})}, block=16).orderBy("ts").toPandas()
    near(out["value"], expected, 1e-8)


def test_short_and_empty_tables(spark):
    for name in I.INDICATORS:
        params = {"time_period": 5, "series_type": "CLOSE", "fastperiod": 3, "slowperiod": 5, "signalperiod": 2, "matype": 1, "fastkperiod": 3, "slowkperiod": 2, "slowdperiod": 2, "fastdperiod": 2, "slowkmatype": 1, "slowdmatype": 1, "fastdmatype": 1, "nbdevup": 2, "nbdevdn": 2, "timeperiod1": 2, "timeperiod2": 3, "timeperiod3": 4}
        I.build(__import__("barloom.plans.graph", fromlist=["Graph"]).Graph(), name, params)
    wanted = {n.lower(): (n, {"time_period": 5, "series_type": "CLOSE"}) for n in ("SMA", "RSI", "SAR", "OBV", "HT_TRENDMODE")}
    one = to_spark(spark, bars([3]))
    assert I.series(one, wanted).count() == 1
    assert I.series(one.limit(0), wanted).count() == 0


def test_bad_parameters():
    from barloom.plans.graph import Graph

    for name, params in (("NOPE", {}), ("SMA", {"time_period": 2.5}), ("SMA", {"time_period": 0})):
        with pytest.raises(ValueError):
            I.build(Graph(), name, params)


def test_order_of_rows_and_tickers_does_not_matter(spark):
    f = pd.concat([walk(40, 1), walk(40, 2).assign(ticker="B")])
    g = f.sample(frac=1, random_state=3)
    for name in ("SMA", "RSI", "SAR"):
        near(run(spark, f, name, time_period=5, series_type="CLOSE"), run(spark, g, name, time_period=5, series_type="CLOSE"))


def test_identities(spark):
    f = walk()
    p = {"series_type": "CLOSE", "fastperiod": 3, "slowperiod": 6, "signalperiod": 4}
    out = I.series(to_spark(spark, f), {n: (n, p) for n in ("MACD_MACD", "MACD_SIGNAL", "MACD_HIST", "MACDEXT_HIST")}).toPandas()
    near(out.MACD_HIST, out.MACD_MACD - out.MACD_SIGNAL)
    near(out.MACDEXT_HIST, out.MACD_HIST)
    b = {"time_period": 5, "series_type": "CLOSE", "nbdevup": 2, "nbdevdn": 2, "matype": 0}
    out = I.series(to_spark(spark, f), {n: (n, b) for n in ("BBANDS_RMB", "BBANDS_RUB", "BBANDS_RLB")}).toPandas()
    near(out.BBANDS_RUB + out.BBANDS_RLB, 2 * out.BBANDS_RMB)


def test_chunks_equal_the_plain_scan(spark):
    from pyspark.sql import functions as F

    f = walk(60)
    f.loc[[0, 1, 9, 10, 11, 30, 31, 47], "close"] = NULL
    f.loc[20:34, "close"] = NULL
    out = scans.ewm_chunked(to_spark(spark, f), "close", 0.3, "y", ["ticker"], chunk=F.floor(F.unix_timestamp("ts") / 600)).orderBy("ts").toPandas()
    near(out.y, ew(f.close, 0.3))


def test_frame_mode_starts_anew(spark):
    f = walk(60)
    framed = features.frames(to_spark(spark, f), 20, 10)
    out = I.series(framed, {"ema": ("EMA", {"time_period": 5, "series_type": "CLOSE"})}, ["ticker", "anchor_ts"]).where("ts = anchor_ts").orderBy("ts").toPandas()
    expected = [ew(f.close[max(0, i - 20) : i].reset_index(drop=True), 1 / 3).iloc[-1] for i in range(10, 61, 10)]
    near(out.ema, expected)


def test_blocks_equal_the_plain_plan(spark):
    """All 73 series in blocks shorter than the series, two keys of different length, with nulls that reach over blocks."""
    from barloom import catalog

    f = pd.concat([walk(170, 1), walk(45, 2).assign(ticker="B")], ignore_index=True)
    f.loc[[0, 1, 39, 40, 41, 100], "close"] = NULL
    f.loc[60:95, "high"] = NULL
    wanted = {n: (n, catalog.parameters(n)) for n in I.INDICATORS}
    plain = I.series(to_spark(spark, f), wanted).orderBy("ticker", "ts").toPandas()
    blocks = I.series(to_spark(spark, f), wanted, block=40).orderBy("ticker", "ts").toPandas()
    assert list(plain.columns) == list(blocks.columns) and len(blocks) == 215
    for n in wanted:
        near(blocks[n].astype(float), plain[n].astype(float), 1e-8)
    assert I.series(to_spark(spark, f).limit(0), {"x": ("EMA", {"time_period": 3})}, block=40).count() == 0
    with pytest.raises(ValueError, match="too short"):
        I.series(to_spark(spark, f), {"x": ("SMA", {"time_period": 60})}, block=40)
