"""All 73 indicators, with the parameters they are registered with, against formulas in pandas and numpy that share nothing with the graph."""

import numpy as np
import pandas as pd
import pytest

from barloom import catalog
from barloom.operators import indicators as I

from .test_indicators import near, to_spark, walk

N = 150


def frame():
    """A walk with a flat stretch, bars without a range, and bars without volume."""
    f = walk(N, 7)
    f.loc[60:75, ["open", "high", "low", "close"]] = f.close[60]
    f.loc[[0, 1, 90], "volume"] = 0.0
    return f


def ew(x, alpha, least=0):
    out = pd.Series(x).ewm(alpha=alpha, adjust=False).mean()
    out[pd.Series(x).notna().cumsum() < least] = np.nan
    return out


def ema(x, n):
    return ew(x, 2 / (n + 1))


def times(f, k, x):
    for _ in range(k):
        x = f(x)
    return x


def t3(x, n, v=0.7):
    gd = lambda y: (1 + v) * ema(y, n) - v * ema(ema(y, n), n)
    return times(gd, 3, x)


def average(code, x, n, slow=0.03, fast=0.05):
    e = lambda y: ema(y, n)
    return [
        lambda: x.rolling(n).mean(), lambda: e(x), lambda: x.rolling(n).apply(lambda w: np.average(w, weights=np.arange(1, n + 1)), raw=True), lambda: 2 * e(x) - e(e(x)), lambda: 3 * (e(x) - e(e(x))) + times(e, 3, x),
        lambda: x.rolling(n).mean().rolling(n).mean(), lambda: t3(x, n), lambda: ew(x, slow), lambda: ew(x, fast),
    ][code]()


def div(a, b):
    """By the rules of floating point, but null for 0 / 0."""
    with np.errstate(all="ignore"):
        return pd.Series(np.asarray(a, float) / np.asarray(b, float))


def stochastic(h, low, c, n):
    top, bottom = h.rolling(n).max(), low.rolling(n).min()
    return div(100 * (c - bottom), top - bottom)


def tame(x):
    return x.where(np.isfinite(x), 0.0)


def wilder_rsi(x, n):
    d = x.diff()
    return 100 - 100 / (1 + div(ew(d.clip(lower=0), 1 / n, n), ew(-d.clip(upper=0), 1 / n, n)))


def movements(f):
    up, down = f.high.diff().fillna(0).to_numpy(), -f.low.diff().fillna(0).to_numpy()
    return pd.Series(np.where((up > down) & (up > 0), up, 0.0)), pd.Series(np.where((down > up) & (down > 0), down, 0.0))


def true_range(f, first):
    tr = np.maximum(f.high, f.close.shift(fill_value=np.nan).fillna(f.high)) - np.minimum(f.low, f.close.shift().fillna(f.low))
    return tr if first else tr.where(f.index > 0)


def directional(f, n, first, least):
    tr = ew(true_range(f, first), 1 / n, least)
    return [div(100 * ew(m, 1 / n, least), tr) for m in movements(f)]


def spread(a, b):
    return div(100 * (a - b).abs(), a + b)


def extreme_age(x, n, pick):
    return x.rolling(n).apply(lambda w: (pick(w) + 1) / n * 100, raw=True)


def stop(f, step, limit):
    """The published rules of the parabolic stop, long and short apart."""
    h, low, out = f.high.to_numpy(), f.low.to_numpy(), []
    long = f.close[1] >= f.close[0]
    sar, ep, af = (low[0], h[0], step) if long else (h[0], low[0], step)
    for i in range(len(f)):
        if i >= 2:
            sar += af * (ep - sar)
            if long:
                sar = min(sar, low[i - 1], low[i - 2])
                if low[i] < sar:
                    long, sar, ep, af = False, ep, low[i], step
                elif h[i] > ep:
                    ep, af = h[i], min(af + step, limit)
            else:
                sar = max(sar, h[i - 1], h[i - 2])
                if h[i] > sar:
                    long, sar, ep, af = True, ep, h[i], step
                elif low[i] < ep:
                    ep, af = low[i], min(af + step, limit)
        out.append(sar)
    return out


def quadrature(x):
    """The discrete Hilbert transform by its sum over sines of every frequency."""
    n, t = len(x), np.arange(len(x))
    out = np.zeros(n)
    for k in range(1, (n + 1) // 2):
        a, b = (x * np.cos(2 * np.pi * k * t / n)).sum(), (x * np.sin(2 * np.pi * k * t / n)).sum()
        out += 2 / n * (a * np.sin(2 * np.pi * k * t / n) - b * np.cos(2 * np.pi * k * t / n))
    return out


def expected(name, f, p):
    o, h, low, c, v = (f[k] for k in ("open", "high", "low", "close", "volume"))
    x, n = f[p["series_type"].lower()], p["time_period"]
    tp, span = (h + low + c) / 3, lambda k: p[k]
    macd = lambda: ema(x, p["fastperiod"]) - ema(x, p["slowperiod"])
    signal = lambda: ema(macd(), p["signalperiod"])
    slow_k = lambda: average(p["slowkmatype"], stochastic(h, low, c, p["fastkperiod"]), p["slowkperiod"])
    fast_k = lambda: tame(stochastic(h, low, c, p["fastkperiod"]))
    rsi_k = lambda: tame(stochastic(*[wilder_rsi(x, n)] * 3, p["fastkperiod"]))
    two = lambda: [average(p["matype"], x, p[k], p["slowlimit"], p["fastlimit"]) for k in ("fastperiod", "slowperiod")]
    middle = lambda: average(p["matype"], x, n, p["slowlimit"], p["fastlimit"])
    adx = lambda: ew(spread(*directional(f, n, False, 0)), 1 / n)
    flow = div((c - low) - (h - c), (h - low).where(h != low)) * v
    analytic = lambda: np.arctan2(quadrature(x.to_numpy()), x.to_numpy())
    phase = lambda: pd.Series(np.unwrap(analytic()))

    def money():
        signed = tp.diff()
        plus, minus = (tp * v).where(signed > 0, 0.0).rolling(n).sum(), (tp * v).where(signed < 0, 0.0).rolling(n).sum()
        return div(100 * plus, plus + minus)

    def chande():
        d = x.diff()
        up, down = d.clip(lower=0).fillna(0).rolling(n).sum(), -d.clip(upper=0).fillna(0).rolling(n).sum()
        return div(100 * (up - down), (up + down).where(up + down != 0)).ffill().fillna(0)

    def ultimate():
        pressure, tr = c - np.minimum(low, c.shift().fillna(low)), true_range(f, True)
        a, b, d = (div(pressure.rolling(k).sum(), tr.rolling(k).sum()) for k in map(span, ("timeperiod1", "timeperiod2", "timeperiod3")))
        return 100 * (4 * a + 2 * b + d) / 7

    def trix():
        e = times(lambda y: ema(y, n), 3, x)
        return div(100 * e.diff(), e.shift())

    formulas = {
        **{k: lambda k=k: f[k.lower()] for k in ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME")}, "PREVCLOSE": lambda: c.shift(), "CHANGE": lambda: c.diff(), "PCTCHANGE": lambda: c.pct_change(),
        **{k: lambda i=i: average(i, x, n) for i, k in enumerate(("SMA", "EMA", "WMA", "DEMA", "TEMA", "TRIMA", "T3"))}, "FAMA": lambda: ew(x, p["slowlimit"]), "MAMA": lambda: ew(x, p["fastlimit"]),
        "VWAP": lambda: div((tp * v).cumsum(), v.cumsum()).replace([np.inf, -np.inf], np.nan).ffill(),
        "MACD_MACD": macd, "MACD_SIGNAL": signal, "MACD_HIST": lambda: macd() - signal(), "MACDEXT_MACD": macd, "MACDEXT_SIGNAL": signal, "MACDEXT_HIST": lambda: macd() - signal(),
        "STOCH_SLOWK": slow_k, "STOCH_SLOWD": lambda: average(p["slowdmatype"], slow_k(), p["slowdperiod"]), "STOCHF_FASTK": fast_k, "STOCHF_FASTD": lambda: average(p["fastdmatype"], fast_k(), p["fastdperiod"]).fillna(0),
        "RSI": lambda: wilder_rsi(x, n), "STOCHRSI_FASTK": rsi_k, "STOCHRSI_FASTD": lambda: average(p["fastdmatype"], rsi_k(), p["fastdperiod"]),
        "WILLR": lambda: -100 * div(h.rolling(n).max() - c, h.rolling(n).max() - low.rolling(n).min()), "ADX": adx, "ADXR": lambda: (adx() + adx().shift(n)) / 2,
        "APO": lambda: two()[0] - two()[1], "PPO": lambda: (two()[0] / two()[1] - 1) * 100, "MOM": lambda: x - x.shift(n), "BOP": lambda: div(c - o, (h - low).where(h != low)).fillna(0),
        "CCI": lambda: div(tp - tp.rolling(n).mean(), 0.015 * tp.rolling(n).max()), "CMO": chande, "ROC": lambda: (x / x.shift(n) - 1) * 100, "ROCR": lambda: x / x.shift(n),
        "AROON_AU": lambda: extreme_age(h, n, np.argmax), "AROON_AD": lambda: extreme_age(low, n, np.argmin), "AROONOSC": lambda: extreme_age(h, n, np.argmax) - extreme_age(low, n, np.argmin),
        "MFI": money, "TRIX": trix, "ULTOSC": ultimate, "PLUS_DM": lambda: movements(f)[0], "MINUS_DM": lambda: movements(f)[1],
        "PLUS_DI": lambda: directional(f, n, True, 0)[0], "MINUS_DI": lambda: directional(f, n, True, 0)[1], "DX": lambda: spread(*directional(f, n, True, n)),
        "BBANDS_RMB": middle, "BBANDS_RUB": lambda: middle() + p["nbdevup"] * x.rolling(n).std(), "BBANDS_RLB": lambda: middle() - p["nbdevdn"] * x.rolling(n).std(),
        **{k: lambda: (h.rolling(n).max() + low.rolling(n).min()) / 2 for k in ("MIDPRICE", "MIDPOINT")}, "SAR": lambda: stop(f, p["acceleration"], p["maximum"]),
        "TRANGE": lambda: true_range(f, True), "ATR": lambda: ew(true_range(f, True), 1 / n), "NATR": lambda: 100 * ew(true_range(f, True), 1 / n) / c,
        "AD": lambda: flow.fillna(0).cumsum(), "ADOSC": lambda: ema(flow.fillna(0).cumsum(), p["fastperiod"]) - ema(flow.fillna(0).cumsum(), p["slowperiod"]), "OBV": lambda: (np.sign(c.diff()).fillna(0) * v).cumsum(),
        "HT_PHASOR_PHASE": lambda: x, "HT_TRENDLINE": lambda: x.rolling(10, min_periods=1).mean(), "HT_PHASOR_QUADRATURE": lambda: quadrature(x.to_numpy()), "HT_SINE_SINE": lambda: np.sin(analytic()),
        "HT_SINE_LEAD_SINE": lambda: np.sin(analytic() + np.pi / 4), "HT_DCPHASE": phase, "HT_DCPERIOD": lambda: 2 * np.pi / phase().diff(), "HT_TRENDMODE": lambda: (np.abs(x) > np.abs(quadrature(x.to_numpy()))).astype(float),
    }
    assert set(formulas) == set(I.INDICATORS)
    return formulas[name]()


@pytest.fixture(scope="module")
def computed(spark):
    """All 73 series of one plan."""
    wanted = {n: (n, catalog.parameters(n)) for n in I.INDICATORS}
    return I.series(to_spark(spark, frame()), wanted).orderBy("ts").toPandas()


@pytest.mark.parametrize("name", list(I.INDICATORS))
def test_formula(computed, name):
    near(computed[name].astype(float), expected(name, frame(), catalog.parameters(name)), 1e-6)
