"""The 73 named series over bars (open, high, low, close, volume).

Each takes the graph and its parameters and gives a node; ``series`` computes any set of them over one bars table. Quirks are kept as the
feature definitions have them and are named in the docstrings. Divisions by zero follow ``safe.fdiv``: signed infinity, null for 0 / 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import without_nan
from ..plans.graph import Graph, Node, compute

Params = Mapping[str, object]
INDICATORS: dict[str, Callable[[Graph, Params], Node]] = {}

PRICES_AND_VOLUME = ("open", "high", "low", "close", "volume")
PI = repr(math.pi)
INF, NEG_INF = "CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"


def indicator(f: Callable[[Graph, Params], Node]) -> Callable[[Graph, Params], Node]:
    INDICATORS[f.__name__] = f
    return f


# Building blocks


def fdiv(g: Graph, a: Node, b: Node) -> Node:
    return g.expr("CASE WHEN {1} = 0 THEN CASE WHEN {0} > 0 THEN " + INF + " WHEN {0} < 0 THEN " + NEG_INF + " END ELSE {0} / nullif({1}, 0.0) END", a, b)


def source(g: Graph, p: Params) -> Node:
    return g.col(str(p.get("series_type", "CLOSE")).lower())


def ohlc(g: Graph) -> tuple[Node, Node, Node, Node]:
    return g.col("open"), g.col("high"), g.col("low"), g.col("close")


def period(p: Params, name: str = "time_period") -> int:
    n = p.get(name)
    if not isinstance(n, int) or isinstance(n, bool):
        raise ValueError(f"{name} must be a whole number, not {n!r}")
    if n < 1:
        raise ValueError(f"{name} must be at least 1, not {n}")
    return n


def rolling(g: Graph, what: str, x: Node, n: int) -> Node:
    """An aggregate of the last n rows; null unless all n have values."""
    return g.expr("CASE WHEN {1} = " + str(n) + " THEN {0} END", g.over(what, x, n), g.over("count", x, n))


def ewm(g: Graph, x: Node, alpha: float, least: int = 0) -> Node:
    y = g.scan("ewm", x, alpha=alpha)
    return g.expr("CASE WHEN {1} >= " + str(least) + " THEN {0} END", y, g.over("count", x)) if least else y


def span(n: int) -> float:
    return 2 / (n + 1)


def filled(g: Graph, x: Node) -> Node:
    """Forward filled, then what leads filled backward."""
    return g.expr("coalesce({0}, {1})", g.ffill(x), g.first_valid(x))


def finite(g: Graph, x: Node) -> Node:
    return g.expr("CASE WHEN abs({0}) < " + INF + " THEN {0} END", x)


def sma(g, x, n, p):
    return rolling(g, "avg", x, n)


def ema(g, x, n, p):
    return ewm(g, x, span(n))


ANCHOR = 1 << 16
"""Row numbers start anew after so many, so that they don't take digits from what they are multiplied with."""


def wma(g, x, n, p):
    """Weights 1..n, the newest heaviest, from the sums of x and of x times its row number; null where the window has a null.

    Row numbers are taken modulo ANCHOR from two starts, half of that apart; a window takes the one whose numbers don't start anew within it.
    """
    if n > ANCHOR // 2:
        raise ValueError(f"a window of {n} rows: {ANCHOR // 2} at most")
    plain, total = g.row_number(), rolling(g, "sum", x, n)
    at, beside = g.expr(f"{{0}} % {ANCHOR}", plain), g.expr(f"({{0}} + {ANCHOR // 2}) % {ANCHOR}", plain)
    one = lambda rn: g.expr("({0} - ({2} - " + str(n) + ") * {1}) / " + str(n * (n + 1) / 2), rolling(g, "sum", g.expr("{0} * {1}", x, rn), n), total, rn)
    return g.expr("CASE WHEN {0} >= " + str(n) + " THEN {1} ELSE {2} END", at, one(at), one(beside))


def dema(g, x, n, p):
    e1 = ema(g, x, n, p)
    return g.expr("2 * {0} - {1}", e1, ema(g, e1, n, p))


def tema(g, x, n, p):
    e1 = ema(g, x, n, p)
    e2 = ema(g, e1, n, p)
    return g.expr("3 * {0} - 3 * {1} + {2}", e1, e2, ema(g, e2, n, p))


def trima(g, x, n, p):
    return sma(g, sma(g, x, n, p), n, p)


def t3(g, x, n, p, v=0.7):
    e = [x]
    for _ in range(6):
        e.append(ema(g, e[-1], n, p))
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2
    return g.expr(f"({c1!r}) * {{0}} + ({c2!r}) * {{1}} + ({c3!r}) * {{2}} + ({c4!r}) * {{3}}", e[6], e[5], e[4], e[3])


def fama(g, x, n, p):
    return ewm(g, x, float(p.get("slowlimit", 0.03)))


def mama(g, x, n, p):
    return ewm(g, x, float(p.get("fastlimit", 0.05)))


MOVING_AVERAGES = {0: sma, 1: ema, 2: wma, 3: dema, 4: tema, 5: trima, 6: t3, 7: fama, 8: mama}


def average(g: Graph, code: object, x: Node, n: int, p: Params = {}) -> Node:  # noqa: B006
    """The moving average with a code from 0 to 8."""
    if int(code) not in MOVING_AVERAGES:
        raise ValueError(f"no moving average has the code {code}")
    return MOVING_AVERAGES[int(code)](g, x, n, p)


def directional(g: Graph) -> tuple[Node, Node]:
    """Plus and minus directional movement; 0 on the first row."""
    _, high, low, _ = ohlc(g)
    up, down = g.expr("{0} - {1}", high, g.lag(high)), g.expr("{0} - {1}", g.lag(low), low)
    rule = "CASE WHEN {0} > {1} AND {0} > 0 THEN {0} ELSE 0.0 END"
    return g.expr(rule, up, down), g.expr(rule, down, up)


def true_range(g: Graph) -> Node:
    """Nulls are skipped, so the first row has high - low."""
    _, high, low, close = ohlc(g)
    return g.expr("greatest({0} - {1}, abs({0} - {2}), abs({1} - {2}))", high, low, g.lag(close))


def strict_true_range(g: Graph) -> Node:
    """Null on the first row and wherever a part is null."""
    return g.expr("CASE WHEN {1} IS NOT NULL AND {2} IS NOT NULL AND {3} IS NOT NULL THEN {0} END", true_range(g), g.col("high"), g.col("low"), g.lag(g.col("close")))


def typical(g: Graph) -> Node:
    return g.expr("({0} + {1} + {2}) / 3", g.col("high"), g.col("low"), g.col("close"))


# Prices and changes


def _column(name: str) -> None:
    INDICATORS[name] = lambda g, p: g.col(name.lower())


for _name in ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME"):
    _column(_name)


@indicator
def PREVCLOSE(g, p):
    """The last close before the row that isn't null; series_type is ignored."""
    return g.lag(g.ffill(g.col("close")))


@indicator
def CHANGE(g, p):
    return g.expr("{0} - {1}", g.col("close"), PREVCLOSE(g, p))


@indicator
def PCTCHANGE(g, p):
    """A fraction, not percent."""
    return g.expr("({0} - {1}) / nullif({1}, 0.0)", g.col("close"), PREVCLOSE(g, p))


# Moving averages


def _average(name: str, f: Callable, needs_period: bool = True) -> None:
    INDICATORS[name] = lambda g, p: f(g, source(g, p), period(p) if needs_period else 1, p)


for _name, _f in (("SMA", sma), ("EMA", ema), ("WMA", wma), ("DEMA", dema), ("TEMA", tema), ("TRIMA", trima), ("T3", t3)):
    _average(_name, _f)
_average("FAMA", fama, False)
_average("MAMA", mama, False)


@indicator
def VWAP(g, p):
    """Over the whole series, without a daily reset."""
    high, low, close, volume = (filled(g, g.col(c)) for c in ("high", "low", "close", "volume"))
    volume = g.expr("coalesce({0}, 0.0)", volume)
    money = g.expr("({0} + {1} + {2}) / 3 * {3}", high, low, close, volume)
    return g.ffill(finite(g, fdiv(g, g.over("sum", money), g.over("sum", volume))))


# Oscillators


@indicator
def MACD_MACD(g, p):
    x = source(g, p)
    return g.expr("{0} - {1}", ema(g, x, period(p, "fastperiod"), p), ema(g, x, period(p, "slowperiod"), p))


@indicator
def MACD_SIGNAL(g, p):
    return ema(g, MACD_MACD(g, p), period(p, "signalperiod"), p)


@indicator
def MACD_HIST(g, p):
    return g.expr("{0} - {1}", MACD_MACD(g, p), MACD_SIGNAL(g, p))


# Their kinds of average are ignored: always exponential.
INDICATORS["MACDEXT_MACD"], INDICATORS["MACDEXT_SIGNAL"], INDICATORS["MACDEXT_HIST"] = MACD_MACD, MACD_SIGNAL, MACD_HIST


def percent_k(g: Graph, high: Node, low: Node, close: Node, n: int) -> Node:
    top, bottom = rolling(g, "max", high, n), rolling(g, "min", low, n)
    return fdiv(g, g.expr("100 * ({0} - {1})", close, bottom), g.expr("{0} - {1}", top, bottom))


@indicator
def STOCH_SLOWK(g, p):
    _, high, low, close = ohlc(g)
    return average(g, p["slowkmatype"], percent_k(g, high, low, close, period(p, "fastkperiod")), period(p, "slowkperiod"))


@indicator
def STOCH_SLOWD(g, p):
    return average(g, p["slowdmatype"], STOCH_SLOWK(g, p), period(p, "slowdperiod"))


@indicator
def STOCHF_FASTK(g, p):
    """On filled prices; 0 where there is no value, the first rows included."""
    high, low, close = (filled(g, g.col(c)) for c in ("high", "low", "close"))
    return g.expr("coalesce({0}, 0.0)", finite(g, percent_k(g, high, low, close, period(p, "fastkperiod"))))


@indicator
def STOCHF_FASTD(g, p):
    return g.expr("coalesce({0}, 0.0)", average(g, p.get("fastdmatype", 0), STOCHF_FASTK(g, p), period(p, "fastdperiod")))


@indicator
def RSI(g, p):
    """Wilder's; 100 where nothing fell, null where nothing moved."""
    x, n = source(g, p), period(p)
    delta = g.expr("{0} - {1}", x, g.lag(x))
    up = ewm(g, g.expr("CASE WHEN {0} IS NOT NULL THEN greatest({0}, 0.0) END", delta), 1 / n, n)
    down = ewm(g, g.expr("CASE WHEN {0} IS NOT NULL THEN -least({0}, 0.0) END", delta), 1 / n, n)
    return g.expr("100 - 100 / (1 + {0})", fdiv(g, up, down))


@indicator
def STOCHRSI_FASTK(g, p):
    rsi = RSI(g, p)
    return g.expr("coalesce({0}, 0.0)", finite(g, percent_k(g, rsi, rsi, rsi, period(p, "fastkperiod"))))


@indicator
def STOCHRSI_FASTD(g, p):
    return average(g, p.get("fastdmatype", 0), STOCHRSI_FASTK(g, p), period({"fastdperiod": 3, **p}, "fastdperiod"))


@indicator
def WILLR(g, p):
    _, high, low, close = ohlc(g)
    top, bottom = rolling(g, "max", high, period(p)), rolling(g, "min", low, period(p))
    return g.expr("{0} * -100", fdiv(g, g.expr("{0} - {1}", top, close), g.expr("{0} - {1}", top, bottom)))


def spread(g: Graph, plus: Node, minus: Node) -> Node:
    return fdiv(g, g.expr("100 * abs({0} - {1})", plus, minus), g.expr("{0} + {1}", plus, minus))


def directional_index(g: Graph, movement: Node, tr: Node, n: int, least: int = 0) -> Node:
    return fdiv(g, g.expr("100 * {0}", ewm(g, movement, 1 / n, least)), ewm(g, tr, 1 / n, least))


@indicator
def ADX(g, p):
    """Its true range starts on the second row, its movements on the first."""
    n, (plus, minus), tr = period(p), directional(g), strict_true_range(g)
    return ewm(g, spread(g, directional_index(g, plus, tr, n), directional_index(g, minus, tr, n)), 1 / n)


@indicator
def ADXR(g, p):
    adx = ADX(g, p)
    return g.expr("({0} + {1}) / 2", adx, g.lag(adx, period(p)))


def two_averages(g: Graph, p: Params) -> tuple[Node, Node] | None:
    """Fast and slow averages of the forward-filled source; None where a period or the kind of average is no valid one."""
    x = g.ffill(source(g, p))
    try:
        return tuple(average(g, p.get("matype", 0), x, period(p, name), p) for name in ("fastperiod", "slowperiod"))
    except ValueError:
        return None


@indicator
def APO(g, p):
    both = two_averages(g, p)
    return g.expr("{0} - {1}", *both) if both else g.expr("CAST(NULL AS DOUBLE)")


@indicator
def PPO(g, p):
    both = two_averages(g, p)
    return g.expr("({0} - {1}) * 100 / nullif({1}, 0.0)", *both) if both else g.expr("CAST(NULL AS DOUBLE)")


@indicator
def MOM(g, p):
    x = source(g, p)
    return g.expr("{0} - {1}", x, g.lag(x, period(p)))


@indicator
def BOP(g, p):
    """0 where the range is 0 or anything is null."""
    return g.expr("coalesce(({3} - {0}) / nullif({1} - {2}, 0.0), 0.0)", *ohlc(g))


@indicator
def CCI(g, p):
    """Divides by the rolling maximum, where the usual definition has the mean deviation."""
    tp, n = typical(g), period(p)
    return fdiv(g, g.expr("{0} - {1}", tp, rolling(g, "avg", tp, n)), g.expr("0.015 * {0}", rolling(g, "max", tp, n)))


@indicator
def CMO(g, p):
    x, n = source(g, p), period(p)
    delta = g.expr("{0} - {1}", x, g.lag(x))
    gains = rolling(g, "sum", g.expr("CASE WHEN {0} > 0 THEN {0} ELSE 0.0 END", delta), n)
    losses = rolling(g, "sum", g.expr("CASE WHEN {0} < 0 THEN -{0} ELSE 0.0 END", delta), n)
    return g.expr("coalesce({0}, 0.0)", g.ffill(g.expr("100 * ({0} - {1}) / nullif({0} + {1}, 0.0)", gains, losses)))


@indicator
def ROC(g, p):
    x = source(g, p)
    before = g.lag(x, period(p))
    return fdiv(g, g.expr("100 * ({0} - {1})", x, before), before)


@indicator
def ROCR(g, p):
    x = source(g, p)
    return fdiv(g, x, g.lag(x, period(p)))


def aroon(g: Graph, what: str, column: str, n: int) -> Node:
    x = g.col(column)
    return g.expr("CASE WHEN {1} = " + str(n) + " THEN (" + str(n) + " - {0}) / CAST(" + str(n) + " AS DOUBLE) * 100 END", g.age_of_extreme(what, x, n), g.over("count", x, n))


@indicator
def AROON_AU(g, p):
    """The oldest of equal highs counts."""
    return aroon(g, "max", "high", period(p))


@indicator
def AROON_AD(g, p):
    return aroon(g, "min", "low", period(p))


@indicator
def AROONOSC(g, p):
    return g.expr("{0} - {1}", AROON_AU(g, p), AROON_AD(g, p))


@indicator
def MFI(g, p):
    tp, n = typical(g), period(p)
    flow, before = g.expr("{0} * {1}", tp, g.col("volume")), g.lag(tp)
    rising = rolling(g, "sum", g.expr("CASE WHEN {1} > {2} THEN {0} ELSE 0.0 END", flow, tp, before), n)
    falling = rolling(g, "sum", g.expr("CASE WHEN {1} < {2} THEN {0} ELSE 0.0 END", flow, tp, before), n)
    return fdiv(g, g.expr("100 * {0}", rising), g.expr("{0} + {1}", rising, falling))


@indicator
def TRIX(g, p):
    x, n = source(g, p), period(p)
    e3 = ema(g, ema(g, ema(g, x, n, p), n, p), n, p)
    before = g.lag(e3)
    return fdiv(g, g.expr("100 * ({0} - {1})", e3, before), before)


@indicator
def ULTOSC(g, p):
    _, _, low, close = ohlc(g)
    pressure, tr = g.expr("{0} - least({1}, {2})", close, low, g.lag(close)), true_range(g)
    ratios = [fdiv(g, rolling(g, "sum", pressure, n), rolling(g, "sum", tr, n)) for n in (period(p, f"timeperiod{i}") for i in (1, 2, 3))]
    return g.expr("100 * (4 * {0} + 2 * {1} + {2}) / 7", *ratios)


# Directional movement, volatility and bands


@indicator
def PLUS_DM(g, p):
    """Not smoothed; the period is ignored."""
    return directional(g)[0]


@indicator
def MINUS_DM(g, p):
    return directional(g)[1]


@indicator
def PLUS_DI(g, p):
    return directional_index(g, directional(g)[0], true_range(g), period(p))


@indicator
def MINUS_DI(g, p):
    return directional_index(g, directional(g)[1], true_range(g), period(p))


@indicator
def DX(g, p):
    """Unlike in ADX, the true range starts on the first row, and the averages need as many rows as the period."""
    n, (plus, minus), tr = period(p), directional(g), true_range(g)
    return spread(g, directional_index(g, plus, tr, n, n), directional_index(g, minus, tr, n, n))


@indicator
def BBANDS_RMB(g, p):
    return average(g, p["matype"], source(g, p), period(p), p)


def band(g: Graph, p: Params, sign: str, width: object) -> Node:
    return g.expr("{0} " + sign + " " + repr(float(width)) + " * {1}", BBANDS_RMB(g, p), rolling(g, "stddev_samp", source(g, p), period(p)))


@indicator
def BBANDS_RUB(g, p):
    return band(g, p, "+", p["nbdevup"])


@indicator
def BBANDS_RLB(g, p):
    return band(g, p, "-", p["nbdevdn"])


@indicator
def MIDPRICE(g, p):
    _, high, low, _ = ohlc(g)
    return g.expr("({0} + {1}) / 2", rolling(g, "max", high, period(p)), rolling(g, "min", low, period(p)))


INDICATORS["MIDPOINT"] = MIDPRICE  # its series_type is ignored


@indicator
def SAR(g, p):
    return g.scan("sar", *(filled(g, g.col(c)) for c in ("high", "low", "close")), step=float(p.get("acceleration", 0.02)), limit=float(p.get("maximum", 0.2)))


@indicator
def TRANGE(g, p):
    return true_range(g)


@indicator
def ATR(g, p):
    return ewm(g, true_range(g), 1 / period(p))


@indicator
def NATR(g, p):
    return fdiv(g, g.expr("{0} * 100", ATR(g, p)), g.col("close"))


# Volume


@indicator
def AD(g, p):
    _, high, low, close = ohlc(g)
    flow = g.expr("(({2} - {1}) - ({0} - {2})) / nullif({0} - {1}, 0.0) * {3}", high, low, close, g.col("volume"))
    return g.expr("coalesce({0}, 0.0)", g.over("sum", flow))


@indicator
def ADOSC(g, p):
    ad = AD(g, p)
    return g.expr("{0} - {1}", ema(g, ad, period(p, "fastperiod"), p), ema(g, ad, period(p, "slowperiod"), p))


@indicator
def OBV(g, p):
    """Null where the volume is; the sum goes on behind it."""
    close, volume = g.col("close"), g.col("volume")
    signed = g.expr("coalesce(sign({0} - {1}), 0.0) * {2}", close, g.lag(close), volume)
    return g.expr("CASE WHEN {1} IS NOT NULL THEN {0} END", g.over("sum", signed), signed)


# Cycles, from the analytic signal of a whole frame


def analytic(g: Graph, p: Params) -> tuple[Node, Node]:
    x = filled(g, source(g, p))
    return x, g.scan("quadrature", x)


def unwrapped(g: Graph, p: Params) -> Node:
    """The angle without jumps: steps of over half a turn are corrected by whole turns, summed up."""
    x, q = analytic(g, p)
    angle = g.expr("atan2({1}, {0})", x, q)
    step = g.expr("{0} - {1}", angle, g.lag(angle))
    near = g.expr("{0} - 2 * " + PI + " * floor(({0} + " + PI + ") / (2 * " + PI + "))", step)
    fix = g.expr("CASE WHEN abs({0}) >= " + PI + " THEN CASE WHEN {1} = -" + PI + " AND {0} > 0 THEN " + PI + " ELSE {1} END - {0} ELSE 0.0 END", step, near)
    return g.expr("{0} + {1}", angle, g.over("sum", fix))


@indicator
def HT_PHASOR_PHASE(g, p):
    """The real part is the filled source itself."""
    return filled(g, source(g, p))


@indicator
def HT_TRENDLINE(g, p):
    return g.over("avg", filled(g, source(g, p)), 10)


@indicator
def HT_PHASOR_QUADRATURE(g, p):
    return analytic(g, p)[1]


@indicator
def HT_SINE_SINE(g, p):
    return g.expr("sin(atan2({1}, {0}))", *analytic(g, p))


@indicator
def HT_SINE_LEAD_SINE(g, p):
    return g.expr("sin(atan2({1}, {0}) + " + PI + " / 4)", *analytic(g, p))


@indicator
def HT_DCPHASE(g, p):
    return unwrapped(g, p)


@indicator
def HT_DCPERIOD(g, p):
    phase = unwrapped(g, p)
    return g.expr("2 * " + PI + " / nullif({0} - {1}, 0.0)", phase, g.lag(phase))


@indicator
def HT_TRENDMODE(g, p):
    return g.expr("CASE WHEN {0} IS NULL THEN NULL WHEN abs({0}) > abs({1}) THEN 1.0 ELSE 0.0 END", *analytic(g, p))


# How a context window is scaled behind the last value's subtraction: fixed values.
LEVELS = "OPEN HIGH LOW CLOSE PREVCLOSE SMA EMA WMA DEMA TEMA TRIMA FAMA MAMA VWAP T3 BBANDS_RUB BBANDS_RMB BBANDS_RLB MIDPOINT MIDPRICE SAR HT_TRENDLINE HT_PHASOR_PHASE".split()
PERCENTS = "STOCH_SLOWK STOCH_SLOWD STOCHF_FASTK STOCHF_FASTD RSI STOCHRSI_FASTK STOCHRSI_FASTD WILLR ADX ADXR CMO AROON_AD AROON_AU AROONOSC MFI ULTOSC DX MINUS_DI PLUS_DI".split()
HUGE = "VOLUME MACD_SIGNAL MACD_HIST AD ADOSC OBV HT_DCPERIOD HT_DCPHASE".split()


def scale_of(name: str) -> float:
    """1 for levels and changes, 100 for percents, 1e7 for the eight that count as huge (two of MACD among them)."""
    return 100.0 if name in PERCENTS else 1e7 if name in HUGE else 1.0


def build(g: Graph, name: str, params: Params) -> Node:
    if name not in INDICATORS:
        raise ValueError(f"unknown indicator {name!r}")
    return INDICATORS[name](g, params)


def series(bars: DataFrame, wanted: Mapping[str, tuple[str, Params]], keys: list[str] | None = None, order: str = "ts", *, block: int | None = None) -> DataFrame:
    """``bars`` with a column for each of ``wanted`` (column name -> indicator and parameters), per ``keys`` in the order of ``order``.

    Bars have open, high, low, close and volume as doubles, null where missing (NaN is taken, and given back, as null), and one row per key and time. An empty table gives
    an empty one; one row gives null where more are needed. A key is held by one task, unless ``block`` gives the rows of the
    blocks that long keys are cut into (``plans.blocks``); results are the same.
    """
    g = Graph()
    outputs = {name: build(g, f, p) for name, (f, p) in wanted.items()}
    bars = without_nan(bars, PRICES_AND_VOLUME)
    if block:
        from ..plans import blocks

        out = blocks.compute(bars, outputs, keys or ["ticker"], order, block=block)
    else:
        out = compute(bars, outputs, keys or ["ticker"], order)
    return out.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) if c in outputs else F.col(f"`{c}`") for c in out.columns])
