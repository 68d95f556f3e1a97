"""Wide windows and the stop in blocks, against plain loops and frames of one row after the other."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as I
from barloom.operators import scans
from barloom.plans import wide
from barloom.plans.graph import Graph, compute

from .test_indicators import NULL, near, to_spark, walk

WHAT = ["max", "min", "sum", "avg", "stddev_samp", "count"]


def rough(n, seed):
    """A walk with nulls, ties, flat stretches and one huge value."""
    f = walk(n, seed)
    f["close"] = f.close.round(0)
    f.loc[n // 3 : n // 3 + 12, "close"] = 100.0
    f.loc[[2, n // 2, n // 2 + 1], "close"] = NULL
    f.loc[n // 4, "close"] = 1e12
    return f


@pytest.mark.parametrize("length", [2, 7, 16, 300])
def test_wide_windows_equal_frames(spark, length, monkeypatch):
    """All kinds over three keys, one shorter than the window, one all null; the huge value leaves nothing behind."""
    f = pd.concat([rough(90, 1), rough(65, 2).assign(ticker="B"), rough(12, 3).assign(ticker="C", close=NULL)], ignore_index=True)
    monkeypatch.setattr(wide, "WIDE", 1)
    g = Graph()
    outputs = {w: g.over(w, g.col("close"), length) for w in WHAT}
    got = compute(to_spark(spark, f), outputs, ["ticker"]).orderBy("ticker", "ts").toPandas()
    assert len(got) == len(f)
    rolled = f.groupby("ticker").close.rolling(length, min_periods=1)
    plain = lambda how: np.concatenate([[how(x) for x in (c.to_numpy()[max(0, i + 1 - length) : i + 1] for i in range(len(c)))] for _, c in f.groupby("ticker").close])
    seen = lambda how, least=1: plain(lambda x: how(x[~np.isnan(x)]) if (~np.isnan(x)).sum() >= least else NULL)
    near(got["max"].astype(float), rolled.max())
    near(got["min"].astype(float), rolled.min())
    near(got["sum"].astype(float), seen(np.sum))
    near(got["avg"].astype(float), seen(np.mean))
    near(got["stddev_samp"].astype(float), seen(lambda x: x.std(ddof=1), 2))
    near(got["count"], plain(lambda x: (~np.isnan(x)).sum()))
    assert compute(to_spark(spark, f).limit(0), outputs, ["ticker"]).count() == 0


def test_wide_ages_take_the_oldest_of_equals(spark, monkeypatch):
    monkeypatch.setattr(wide, "WIDE", 1)
    f = walk(80, 4)
    f["close"] = (f.close * 2).round(0)
    g = Graph()
    outputs = {w: g.age_of_extreme(w, g.col("close"), 9) for w in ("max", "min")}
    got = compute(to_spark(spark, f), outputs, ["ticker"]).orderBy("ts").toPandas()
    for w, how in (("max", np.argmax), ("min", np.argmin)):
        windows = [f.close.to_numpy()[max(0, i - 8) : i + 1] for i in range(len(f))]
        near(got[w], [len(x) - 1 - how(x) for x in windows])


def test_wide_indicators_in_blocks(spark, monkeypatch):
    """The same series with folded frames, in pieces, and in pieces within blocks; null keys are a key."""
    f = pd.concat([walk(150, 5), walk(40, 6).assign(ticker=None)], ignore_index=True)
    f.loc[60:62, "high"] = NULL
    p = {"time_period": 12, "series_type": "CLOSE", "fastkperiod": 12, "nbdevup": 2, "matype": 0}
    wanted = {n: (n, p) for n in ("WILLR", "AROONOSC", "MIDPRICE", "CCI", "SMA", "WMA", "BBANDS_RUB", "STOCHF_FASTK", "MFI", "SAR", "EMA")}
    plain = I.series(to_spark(spark, f), wanted).orderBy("ticker", "ts").toPandas()
    monkeypatch.setattr(wide, "WIDE", 1)
    for block in (None, 40):
        out = I.series(to_spark(spark, f), wanted, block=block).orderBy("ticker", "ts").toPandas()
        assert len(out) == 190
        for n in wanted:
            near(out[n].astype(float), plain[n].astype(float))


def test_wide_windows_share_one_exchange(spark):
    g = Graph()
    outputs = {w: g.over(w, g.col("close"), 500) for w in WHAT}
    plan = compute(to_spark(spark, walk(5)), outputs, ["ticker"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def stopped(spark, frame, block):
    """Per ticker and place the stop in blocks."""
    f = frame.assign(place=frame.groupby("ticker", dropna=False).cumcount())
    rows = [(None if pd.isna(t) else t, int(p), int(p) // block, *(None if np.isnan(v) else float(v) for v in x)) for t, p, *x in f[["ticker", "place", "high", "low", "close"]].itertuples(index=False)]
    df = spark.createDataFrame(rows, "ticker string, place long, block long, high double, low double, close double")
    out = scans.stop_blocks(df, "y", ["high", "low", "close"], {"step": 0.02, "limit": 0.2}, ["ticker"], "place", "block").toPandas()
    assert len(out) == len(f)
    return {t: r.sort_values("place").y.astype(float).to_numpy() for t, r in out.groupby("ticker", dropna=False)}


def plain_stop(f):
    return scans.stop_and_reverse(*(f[c].to_numpy(float) for c in ("high", "low", "close")), 0.02, 0.2)


def test_stop_in_blocks_is_the_plain_stop(spark, monkeypatch):
    """To the last bit: walks, a null key, a key of nulls, single bars, a last block of one bar; nothing is gone along in one task."""
    monkeypatch.setattr(scans, "stop_along", None)
    parts = [walk(1001, 7), walk(333, 8).assign(ticker=None), walk(120, 9).assign(ticker="N", high=NULL), walk(1, 10).assign(ticker="one"), walk(101, 11).assign(ticker="last")]
    got = stopped(spark, pd.concat(parts, ignore_index=True), 100)
    assert len(got) == 5
    for part in parts:
        t = part.ticker.iloc[0]
        y = next(v for k, v in got.items() if k == t or (pd.isna(k) and t is None))
        np.testing.assert_array_equal(y, plain_stop(part))


def test_stop_keeps_what_flat_markets_do_not_forget(spark):
    """A pace that goes through 40 flat blocks, one steady rise, and a market without any move."""
    rise = walk(400, 12)
    rise[["high", "low", "close"]] = np.arange(400)[:, None] + np.array([1.0, -1.0, 0.5])
    flat = walk(500, 13)
    for c, to in (("high", 4.0), ("low", 1.0), ("close", 2.0)):
        flat.loc[40:440, c] = flat[c].iloc[:40].max() if c == "high" else flat[c].iloc[:40].max() - to
    still = walk(200, 14).assign(high=5.0, low=5.0, close=5.0)
    parts = [rise.assign(ticker="rise"), flat.assign(ticker="flat"), still.assign(ticker="still"), walk(300, 15).assign(ticker="walk")]
    got = stopped(spark, pd.concat(parts, ignore_index=True), 10)
    for part in parts:
        np.testing.assert_array_equal(got[part.ticker.iloc[0]], plain_stop(part))
