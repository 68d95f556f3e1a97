"""Ticks with gaps, exact medians, ledgers and thinning against plain loops."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate, indicators, signals
from barloom.sources.bars import bars_from_ticks

from .test_indicators import to_spark, walk

T0 = dt.datetime(2024, 1, 2, 14, 30)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


TICKS = "t string, ts timestamp, price double, volume double, tie long"


def folded(spark, rows, bits=36):
    out = bars_from_ticks(spark.createDataFrame(rows, TICKS), F.col("t"), F.col("ts"), F.date_trunc("hour", "ts"), F.col("price"), F.col("volume"), [(F.col("tie"), bits)])
    return [tuple(r)[2:] for r in out.orderBy("ticker", "ts").collect()]


def test_ticks_without_price_or_tie(spark):
    assert folded(spark, [("A", at(0), None, 1.0, 1), ("A", at(0), 5.0, 2.0, None), ("A", at(0), 6.0, 4.0, 2), ("A", at(5), 7.0, None, 0), ("A", at(6), math.nan, 8.0, 0)]) == [(5.0, 7.0, 5.0, 7.0, 15.0)]
    assert folded(spark, [("A", at(0), None, 1.0, 1), (None, at(0), 5.0, 2.0, None)]) == [(None, None, None, None, 1.0)]
    assert folded(spark, [("A", at(0), 1.0, 1.0, 2**36 - 1), ("A", at(1), 2.0, 1.0, 0)]) == [(1.0, 2.0, 1.0, 2.0, 2.0)]


@pytest.mark.parametrize("tie", [-1, 2**36])
def test_ties_out_of_range(spark, tie):
    with pytest.raises(Exception, match="is not in 36 bits"):
        folded(spark, [("A", at(0), 5.0, 2.0, tie)])


def test_too_many_bits(spark):
    with pytest.raises(ValueError, match="73 bits"):
        folded(spark, [("A", at(0), 5.0, 2.0, 1)], 73)


def test_nan_bars_are_missing(spark):
    f = walk(30)
    f.loc[7, "volume"] = math.nan
    rows = to_spark(spark, f)
    nan = rows.withColumn("volume", F.coalesce("volume", F.lit(math.nan)))
    wanted = {"obv": ("OBV", {}), "vwap": ("VWAP", {}), "mfi": ("MFI", {"time_period": 5})}
    a, b = (indicators.series(x, wanted).orderBy("ts").collect() for x in (rows, nan))
    assert a == b and a[-1]["obv"] is not None


def test_stored_features_need_no_exchange(spark):
    from barloom.sources.bars import write_features

    name = write_features(to_spark(spark, walk(30)), buckets=3)
    out = indicators.series(spark.table(name), {"sma": ("SMA", {"time_period": 3, "series_type": "CLOSE"})})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert out.where("sma is not null").count() == 28
    spark.sql(f"DROP TABLE {name}")


def test_weighted_average_far_along_a_series(spark, monkeypatch):
    """Over windows in which row numbers start anew, of either start."""
    monkeypatch.setattr(indicators, "ANCHOR", 40)
    f = walk(200)
    out = indicators.series(to_spark(spark, f), {"wma": ("WMA", {"time_period": 7, "series_type": "CLOSE"})}).orderBy("ts").toPandas()
    want = f.close.rolling(7).apply(lambda x: (x * range(1, 8)).sum() / 28, raw=True)
    assert out.wma.isna().sum() == 6 and (out.wma - want.to_numpy()).abs().max() < 1e-12


# Medians


def test_medians(spark):
    rng = random.Random(6)
    inf = math.inf
    classes = {
        (1, 1): [2.0, 5.0, 6.0, inf, math.nan, None], (1, 0): [0.25] * 90 + [rng.uniform(-1, 1) for _ in range(10)], (0, 1): [rng.gauss(0, 1e-9) for _ in range(501)] + [-inf, 1e300, -1e300, 5e-324, -5e-324, 0.0, -0.0],
        (0, 0): [-3.0], (2, 2): [math.nan, None], (3, 3): [rng.gauss(0, 1) for _ in range(1000)], (4, 4): [-2.0, -1.0],
    }
    rows = spark.createDataFrame([(t, p, r) for (t, p), values in classes.items() for r in values], "truth int, pred int, ret double")
    got = {(r["truth"], r["pred"]): r for r in evaluate.class_returns(rows).collect()}
    want = {k: [x for x in v if x is not None and not math.isnan(x)] for k, v in classes.items()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, r in got.items():
        assert (r["n"], r["median"]) == (len(want[k]), statistics.median(want[k])), k


def test_keys_are_in_the_order_of_numbers(spark):
    rng = random.Random(7)
    values = [rng.choice([1, -1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)] + [math.inf, -math.inf, 0.0, 5e-324, -5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", evaluate.ordered_key(F.col("v")))
    assert [r["v"] for r in rows.orderBy("k").collect()] == sorted(values)


# Average cost


def plain_ledger(fills):
    state, out = {}, []
    for symbol, _, order, side, shares, price in sorted(fills, key=lambda f: (f[1], f[2])):
        held, cost, exposure = state.get(symbol, (0.0, 0.0, 0.0))
        if side == "BOT":
            held, cost = shares, shares * price
            exposure += cost
        elif side == "SLD" and held > 0:
            part = shares * cost / held
            held, cost, exposure = held - shares, cost - part, exposure - part
            if held <= 0:
                held = cost = 0.0
        state[symbol] = held, cost, exposure
        out.append((order, held or None, cost if held else None, exposure))
    return sorted(out)


def test_average_cost_over_days(spark):
    rng = random.Random(8)
    fills = [(rng.choice(["A", "A", "A", "B", None]), at(97 * (i // 2)), i, rng.choice(["BOT", "SLD", "SLD", "OTHER"]), float(rng.randrange(0, 9)), rng.uniform(1, 9)) for i in range(400)]
    out = signals.average_cost(spark.createDataFrame(fills, "symbol string, ts timestamp, order_id long, side string, shares double, price double"))
    assert out.columns[-3:] == ["shares_held", "cost_held", "exposure"]
    got = sorted((r["order_id"], r["shares_held"], r["cost_held"], r["exposure"]) for r in out.collect())
    for a, b in zip(got, plain_ledger(fills), strict=True):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x or 0 for x in a] == pytest.approx([x or 0 for x in b], rel=1e-9, abs=1e-7)


def test_average_cost_runs_without_python(spark):
    out = signals.average_cost(spark.createDataFrame([("A", at(0), 1, "BOT", 2.0, 3.0)], "symbol string, ts timestamp, order_id long, side string, shares double, price double"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


# Thinning


def plain_thinning(rows, cooldown, restart):
    out, state = [], {}
    for ticker, ts, leave in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        ready, free = state.get(ticker, (dt.datetime.min, dt.datetime.min))
        take = ts >= ready and ts >= free
        if take or (ts >= ready and restart):
            ready = ts + dt.timedelta(seconds=cooldown)
        if take:
            free = leave or dt.datetime.max
            out.append((ticker, ts))
        state[ticker] = ready, free
    return sorted(out, key=str)


@pytest.mark.parametrize(("restart", "block", "cooldown"), [(True, "day", 45), (True, "hour", 5400), (False, "day", 5400), (False, "month", 45)])
def test_thinning_over_blocks(spark, restart, block, cooldown):
    rng = random.Random(9)
    rows = [(t, at(m), at(m + rng.choice([1, 5, 90, 3000])) if rng.random() < 0.99 else None) for t in ("A", "B", None) for m in sorted(rng.sample(range(30000), 500))]
    entries = spark.createDataFrame(rows, "ticker string, ts timestamp, exit_ts timestamp").withColumn("n", F.lit(None).cast("long"))
    out = signals.thinned(entries, cooldown_seconds=cooldown, restart_on_skip=restart, block=block)
    assert out.columns == ["ticker", "ts", "exit_ts", "n"]
    got = sorted(((r["ticker"], r["ts"]) for r in out.collect()), key=str)
    assert got == plain_thinning(rows, cooldown, restart) and len(got) > 20


def test_thinning_of_nothing(spark):
    assert signals.thinned(spark.createDataFrame([], "ticker string, ts timestamp, exit_ts timestamp")).count() == 0


# Exits


@pytest.mark.parametrize(("fan", "horizon"), [(4, 20000), (64, 3), (3, 400)])
def test_first_exits_over_levels(spark, monkeypatch, fan, horizon):
    """Long and short horizons over several months, prices with gaps and nulls, entries between, before and behind them, against a plain search."""
    monkeypatch.setattr(signals, "FAN", fan)
    rng = random.Random(fan)
    prices, entries = [], []
    for ticker in ("A", "B"):
        level, minute = 100.0, 0
        for _ in range(700):
            minute += rng.choice([1, 1, 2, 500])
            level *= math.exp(rng.gauss(0, 0.01))
            prices.append((ticker, at(minute), None if rng.random() < 0.05 else level))
        for m in sorted(rng.sample(range(-5, minute + 5), 60)):
            entries.append((ticker, at(m), 100.0 * rng.uniform(1.01, 1.4), 100.0 * rng.uniform(0.7, 0.99), at(m + horizon)))
    entries.append(("C", at(0), 1.0, 0.5, at(5)))
    out = signals.first_exits(spark.createDataFrame(entries, "ticker string, ts timestamp, tp double, sl double, maturity timestamp"), spark.createDataFrame(prices, "ticker string, ts timestamp, close double"))
    got = {(r["ticker"], r["ts"]): (r["exit_ts"], r["exit_price"], r["exit_type"]) for r in out.collect()}
    assert len(got) == len(entries)
    kinds = set()
    for ticker, ts, tp, sl, maturity in entries:
        later = [(t, p) for x, t, p in prices if x == ticker and t > ts and p is not None]
        hit = next(((t, p) for t, p in later if p >= tp or p <= sl or t >= maturity), None)
        want = (None, None, None) if hit is None else (hit[0], tp, "tp") if hit[1] >= tp else (hit[0], sl, "sl") if hit[1] <= sl else (*hit, "maturity")
        assert got[ticker, ts] == want
        kinds.add(want[2])
    assert len(kinds) >= 3


def test_no_exits(spark):
    entries = spark.createDataFrame([], "ticker string, ts timestamp, tp double, sl double, maturity timestamp")
    prices = spark.createDataFrame([("A", at(0), 1.0)], "ticker string, ts timestamp, close double")
    assert signals.first_exits(entries, prices).count() == 0
    one = spark.createDataFrame([("A", at(0), 1.0, 0.5, at(9))], entries.schema)
    assert signals.first_exits(one, prices.limit(0)).first()["exit_type"] is None
