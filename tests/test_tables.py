"""Sources, cleaning, features, signals and evaluation on small hand-made tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import catalog, catalog_tables
from barloom.functions import safe
from barloom.operators import cleaning, evaluate, indicators, signals
from barloom.plans import features
from barloom.sources import bars as B
from barloom.sources import payloads, specs
from barloom.sources.bars import read_bars, write_bars
from barloom.streaming import live

from .conftest import SF
from .test_indicators import bars, to_spark, walk

T0 = dt.datetime(2024, 1, 2, 14, 30)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_fdiv(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(safe.fdiv(F.col("a"), F.col("b"))).collect()] == [float("inf"), float("-inf"), None, 0.25, None]


def test_local_minute(spark):
    row = spark.createDataFrame([("2025-05-16 15:59",), ("broken",), (None,)], "t string").select(safe.epoch_of_local_minute(F.col("t"))).collect()
    assert [r[0] for r in row] == [1747425540, None, None]


def test_payloads(spark):
    rows = spark.createDataFrame(
        [
            ("A", '{"Time Series (1min)": {"2024-03-10 03:30:00": {"1. open": "1", "2. high": "x", "3. low": "0.5", "4. close": "1.5", "5. volume": "10"}, "2024-03-08 15:59:00": {"1. open": "2"}}}'),
            ("B", '{"Time Series (1min)": {}}'), ("C", None), ("D", "{}"),
        ],
        "ticker string, payload string",
    )
    out = [tuple(r) for r in payloads.intraday_bars(rows).orderBy("ts").collect()]
    assert out == [("A", dt.datetime(2024, 3, 8, 20, 59), 2.0, None, None, None, None), ("A", dt.datetime(2024, 3, 10, 7, 30), 1.0, None, 0.5, 1.5, 10.0)]
    series = spark.createDataFrame([("A", '{"Technical Analysis: AD": {"2025-05-16 15:59": {"Chaikin A/D": "3.5"}, "2025-05-16 15:58": {"Chaikin A/D": "-"}}}')], "ticker string, payload string")
    assert [tuple(r) for r in payloads.indicator_series(series, "AD").orderBy("uts").collect()] == [("A", 1747425480, "AD", None), ("A", 1747425540, "AD", 3.5)]


def test_quotes(spark):
    rows = spark.createDataFrame([("A", "2024-01-02 09:30:00.5", "", "abc", None, "7", "  ", "5", "x"), (None, "2024-01-02 09:30:00", "1", "1", "1", "1", "1", "1", "1"), ("B", "when", "", "", "", "", "3", "bad", "2%")], "symbol string, timestamp string, open string, high string, low string, close string, volume string, previous_close string, change_percent string")
    out = {r["symbol"]: r for r in payloads.normal_quotes(rows, F.lit("2000-01-01").cast("timestamp")).collect()}
    assert set(out) == {"A", "B"}
    a, b = out["A"], out["B"]
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"], a["change_percent"]) == (5, 5, 5, 7, 0, 0) and a["ts"] == dt.datetime(2024, 1, 2, 14, 30, 0, 500000)
    assert (b["open"], b["previous_close"], b["volume"], b["change_percent"]) == (0, 0, 3, 2) and b["ts"].year == 2000


def test_specs(spark):
    rows = spark.createDataFrame([("ticker=A&function=SMA&time_period=15&series_type=LOW",), ("ticker=A",), ("function=SMA&time_period=1.5",), (None,), ("ticker=A&ticker=B&function=OBV",)], "spec string")
    out = {r["spec"]: r for r in specs.parse_specs(rows).collect()}
    assert len(out) == 4 and out["ticker=A"]["error"] == "no function" and out["function=SMA&time_period=1.5"]["error"] and out["ticker=A&ticker=B&function=OBV"]["ticker"] == "B"
    assert specs.typed({"time_period": "15", "fastlimit": "0.1", "series_type": "LOW"}) == {"time_period": 15, "fastlimit": 0.1, "series_type": "LOW"}
    with pytest.raises(ValueError):
        features.features(to_spark(spark, walk(5)), specs.parse_specs(rows))


def test_catalog_and_report_files(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"SMA": {"interval": "1min", "time_period": "5"}, "KAMA": {"interval": "1min"}}')
    (tmp_path / "out.json").write_text('{"SMA": "SMA", "MACD": ["MACD", "MACD_Hist"]}')
    out = {r["function"]: r for r in specs.indicator_catalog(spark, f"{tmp_path}/in.json", f"{tmp_path}/out.json").collect()}
    assert out["SMA"]["outputs"] == ["SMA"] and out["MACD"]["request"] is None and out["KAMA"]["outputs"] is None and len(out["MACD"]["outputs"]) == 2
    assert specs.report(spark, f"{tmp_path}/in.json").count() == 1


def test_anomaly_repair(spark):
    n = 130
    close = [100.0] * n
    close[110] = 103.0
    volume = [10.0] * n
    volume[120], close[120] = 900_000.0, 103.0
    out = cleaning.repair_anomalies(to_spark(spark, bars(close, volume=volume))).orderBy("ts").toPandas()
    assert out.close[110] == 100 and out.close_dropped[110] == 1 and out.close[120] == 103 and out.close_dropped.sum() == 1
    assert cleaning.anomaly_counts(cleaning.repair_anomalies(to_spark(spark, bars(close, volume=volume)))).first()["close_dropped"] == 1


def test_regular_grid(spark):
    f = bars([1, 2, 3]).drop(index=1)
    out = cleaning.regular_grid(to_spark(spark, f), size=5).orderBy("ts").toPandas()
    assert out.close.tolist() == [1, 1, 1, 1, 3] and out.volume.tolist() == [0, 0, 100, 0, 102]
    assert cleaning.regular_grid(to_spark(spark, f).limit(0)).count() == 0


def test_session(spark):
    times = ["2024-07-01 13:29:59", "2024-07-01 13:30:00", "2024-07-01 20:00:00", "2024-07-01 20:00:01", "2024-07-06 15:00:00", "2024-01-02 14:30:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(cleaning.in_session(F.col("t").cast("timestamp")))
    assert [r[0] for r in rows.collect()] == [False, True, True, False, False, True]


def test_contexts(spark):
    f = walk(10)
    plan_specs = [("CLOSE", {}), ("WILLR", {"time_period": 3}), ("OBV", {})]
    table, plan = features.wide(to_spark(spark, f), plan_specs)
    out = {r["feature"]: r["context"] for r in features.last_contexts(table, plan, 12).collect()}
    assert out["f0"][:2] == [None, None] and len(out["f0"]) == 12
    np.testing.assert_allclose(out["f0"][2:], (f.close - f.close.iloc[-1]).astype(np.float32), atol=1e-6)
    assert out["f1"][2:4] == [None, None] and abs(out["f2"][-1]) == 0
    assert features.context_matrix(features.last_contexts(table, plan, 12)).first()["features"] == ["f0", "f1", "f2"]
    specs_110 = features.standard_specs(catalog.parameters)
    assert len(specs_110) == 110 == len({(n, tuple(sorted(p.items()))) for n, p in specs_110}) and {n for n, _ in specs_110} == set(indicators.INDICATORS)
    assert [sum(indicators.scale_of(n) == s for n in indicators.INDICATORS) for s in (1.0, 100.0, 1e7)] == [46, 19, 8]


def test_contexts_of_every_bar(spark):
    close, other = [1.0, 2.0, None, 4.0, 7.0], [5.0, 3.0, 9.0, 9.5, 1.0]
    rows = [(k, at(i), v) for k, values in (("A", close), ("B", other[:2])) for i, v in enumerate(values)]
    df, plan = spark.createDataFrame(rows, "ticker string, ts timestamp, f0 double"), {"f0": ("CLOSE", {})}
    every = features.contexts(df, plan, 3).select("ticker", "ts", "feature", "context").collect()
    got = {(r["ticker"], r["ts"]): r["context"] for r in every}
    assert len(got) == len(every) == 7
    for k, values in (("A", close), ("B", other[:2])):
        for i, last in enumerate(values):
            want = ([None] * 3 + values[: i + 1])[-3:]
            assert got[k, at(i)] == [None if v is None or last is None else v - last for v in want]
    assert sorted(map(str, features.last_contexts(df, plan, 3).collect())) == sorted(str(r) for r in every if r["ts"] == at(4 if r["ticker"] == "A" else 1))


def test_frame_mode_of_every_bar(spark):
    """Each bar's EMA from the 250 bars that end there, and from none before."""
    sf = SF.replace("0.001", "0.01")
    got = {(r["ticker"], r["ts"]): r["ema"] for r in catalog_tables.frame_mode_every_bar(spark, sf).collect()}
    bars = B.bars_events(spark, sf).select("ticker", "ts", "close").toPandas().sort_values(["ticker", "ts"])
    assert len(got) == len(bars) == 3385
    for ticker, rows in bars.groupby("ticker"):
        for i, ts in enumerate(rows.ts):
            want = rows.close.iloc[max(0, i - 249) : i + 1].ewm(span=15, adjust=False).mean().iloc[-1]
            assert abs(got[ticker, ts] - want) < 1e-5


def entry_rows(spark, prices, **levels):
    b = spark.createDataFrame([("A", at(i), float(p)) for i, p in enumerate(prices)], "ticker string, ts timestamp, close double")
    e = signals.brackets(b.where(F.col("ts") == at(0)), **levels)
    return e, b


def test_brackets_have_the_known_levels(spark):
    e, _ = entry_rows(spark, [138.36])
    r = e.first()
    assert (r["entry"], round(r["tp"], 5), round(r["sl"], 4)) == (138.41, 139.51728, 137.0259) and r["maturity"] == at(15)


@pytest.mark.parametrize(("prices", "kind", "minute"), [([100, 100, 102, 90], "tp", 2), ([100, 98, 105], "sl", 1), ([100] * 20, "maturity", 15), ([100] * 10, None, None), ([100] * 15 + [105], "tp", 15)])
def test_first_exit(spark, prices, kind, minute):
    e, b = entry_rows(spark, prices)
    r = signals.first_exits(e, b).first()
    assert r["exit_type"] == kind and r["exit_ts"] == (None if minute is None else at(minute))


def test_exit_at_a_late_price(spark):
    b = spark.createDataFrame([("A", at(0), 100.0), ("A", at(60 * 24 * 40), 120.0)], "ticker string, ts timestamp, close double")
    r = signals.first_exits(signals.brackets(b.where(F.col("ts") == at(0))), b).first()
    assert r["exit_type"] == "tp" and r["exit_ts"] == at(60 * 24 * 40)


def test_an_exit_many_buckets_behind_its_entry(spark):
    b = spark.createDataFrame([("A", at(0), 10.0), ("A", at(180), 12.0), ("A", at(600), 10.0), ("A", at(700), 10.0)], "ticker string, ts timestamp, close double")
    e = signals.brackets(b.where(F.col("ts") == at(0)), take_profit=0.1, horizon="10 hours")
    r = signals.first_exits(e, b).first()
    assert (r["exit_type"], r["exit_ts"], round(r["exit_price"], 3)) == ("tp", at(180), 11.055)


def test_medians_by_counting(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(j), float(x)) for k in (0, 1) for j in (0, 1) for x in np.round(rng.normal(0, 0.01 if k else 30, 40 + k + j), 3)] + [(1, None, 5.0)]
    out = {(r["truth"], r["pred"]): r for r in evaluate.class_returns(spark.createDataFrame(rows, "truth int, pred int, ret double")).collect()}
    assert len(out) == 4
    for (k, j), r in out.items():
        own = [x for a, b, x in rows if (a, b) == (k, j)]
        assert r["n"] == len(own) and abs(r["median"] - np.median(own)) < 1e-12 and abs(r["deviation"] - np.std(own, ddof=1)) < 1e-9


def test_ticks_of_one_time_have_an_order(spark):
    rows = [("A", at(0), 2, 5.0), ("A", at(0), 1, 7.0), ("A", at(1), 2**40, 1.0), ("A", at(1), 2**40 + 1, 3.0), ("A", at(-60 * 24 * 365 * 60), 1, 9.0)]
    t = spark.createDataFrame(rows, "k string, t timestamp, n long, p double")
    out = B.bars_from_ticks(t, F.col("k"), F.col("t"), F.lit(T0), F.col("p"), F.lit(1.0), [(F.col("n"), 63)])
    assert [tuple(r) for r in out.select("open", "high", "low", "close", "volume").collect()] == [(9.0, 9.0, 1.0, 3.0, 5.0)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_shared_folder_is_asked_for():
    from barloom.sources.scratch import scratch

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch(Session())


def test_thinning(spark):
    rows = [("A", at(0), at(5)), ("A", at(0.5), at(3)), ("A", at(2), at(4)), ("A", at(2.5), at(4)), ("A", at(6), None), ("A", at(60), None), ("B", at(0), at(1))]
    e = spark.createDataFrame(rows, "ticker string, ts timestamp, exit_ts timestamp")
    assert [(r[0], r[1]) for r in signals.thinned(e).orderBy("ticker", "ts").collect()] == [("A", at(0)), ("A", at(6)), ("B", at(0))]


def test_agreement(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, -1.0), (0.0, 1.0), (None, 1.0)], "profit double, accuracy double")
    assert signals.agreeing(rows).count() == 1


def test_transactions_and_ledger(spark, tmp_path):
    e, b = entry_rows(spark, [100, 102])
    t = signals.transactions(signals.first_exits(e, b))
    rows = t.orderBy("transaction_id").collect()
    assert [(r["transaction_id"], r["order_type"], r["parent_id"]) for r in rows] == [(1, "entry", None), (2, "tp", 1)] and rows[0]["child_maturity_id"] == 4
    specs.append_ledger(t, f"{tmp_path}/ledger")
    specs.append_ledger(t, f"{tmp_path}/ledger")
    assert specs.read_ledger(spark, f"{tmp_path}/ledger").count() == 4


def test_average_cost(spark):
    rows = [("A", at(0), 1, "BOT", 2.0, 10.0), ("A", at(1), 2, "SLD", 1.0, 12.0), ("A", at(2), 3, "BOT", 2.0, 20.0), ("A", at(3), 4, "SLD", 2.0, 20.0), ("B", at(0), 5, "SLD", 1.0, 1.0)]
    f = spark.createDataFrame(rows, "symbol string, ts timestamp, order_id long, side string, shares double, price double")
    out = [(r["order_id"], r["shares_held"], r["cost_held"], r["exposure"]) for r in signals.average_cost(f).orderBy("order_id").collect()]
    assert out == [(1, 2, 20, 20), (2, 1, 10, 10), (3, 2, 40, 50), (4, None, None, 10), (5, None, None, 0)]


def test_exposure(spark):
    t = spark.createDataFrame([(at(0), at(5), 10.0), (at(1), None, 20.0), (at(60 * 24), None, 5.0)], "ts timestamp, exit_ts timestamp, entry double")
    out = [(r["exposure"], r["breach"]) for r in signals.exposure_timeline(t, quantity=1, limit=25).orderBy("ts").collect()]
    assert out == [(10, False), (30, True), (20, False), (25, False)]


def test_published_metrics_recompute(spark):
    """Counts and class means of a published evaluation give its published scalars."""
    tp, fp, fn, tn = 4163, 1653, 2220, 4644
    rows = spark.range(tp + fp + fn + tn).select(
        (F.col("id") < tp + fp).cast("int").alias("pred"), ((F.col("id") < tp) | ((F.col("id") >= tp + fp) & (F.col("id") < tp + fp + fn))).cast("int").alias("truth"), F.when(F.col("id") < tp, 0.2).otherwise(-0.1).alias("ret"))
    r = evaluate.confusion(rows).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["trades"], r["turnover"]) == (tp, fp, fn, tn, 5816, 11632)
    assert round(r["accuracy"], 7) == 0.6945584 and round(r["win_rate"], 7) == 0.7157840 and abs(r["profit_factor"] - tp * 0.2 / (fp * 0.1)) < 1e-9
    assert evaluate.confusion(rows.where("truth = 1")).first()["profit_factor"] == 999
    assert evaluate.confusion(rows.limit(0)).first()["accuracy"] is None


def test_walk_forward(spark):
    rows = spark.createDataFrame([(at(60 * 12 * i),) for i in range(100)], "ts timestamp")
    out = {(r["roll"], r["role"]): r["count"] for r in evaluate.walk_forward(rows).groupBy("roll", "role").count().collect()}
    assert out[(0, "train")] == 20 and out[(0, "validation")] == 4 and out[(19, "train")] == 96 and out[(19, "validation")] == 4 and len(out) == 40


def test_bars_round_trip(spark, tmp_path):
    f = to_spark(spark, walk(10))
    write_bars(f, f"{tmp_path}/bars")
    assert read_bars(spark, f"{tmp_path}/bars").count() == 10


def quote_table(spark):
    rows = [("A", T0 + dt.timedelta(seconds=s), float(c), v) for s, c, v in ((-5, 1, 10), (10, 3, 15), (54, 2, 30), (55, 5, 31), (500, 6, 40), (900, 6, 50))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume long")


def test_minute_bars_roll_at_second_55(spark):
    out = [tuple(r) for r in live.minute_bars(quote_table(spark)).orderBy("ts").limit(2).collect()]
    assert out == [("A", at(0), 1, 3, 1, 2, 20.0), ("A", at(1), 5, 5, 5, 5, 0.0)]


def test_stream_equals_table(spark, tmp_path):
    quote_table(spark).coalesce(1).write.parquet(f"{tmp_path}/quotes")
    stream = live.minute_bars(live.read_stream(spark, f"{tmp_path}/quotes"))
    out = live.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").orderBy("ts").collect()
    table = live.minute_bars(quote_table(spark)).orderBy("ts").collect()
    assert out == table[: len(out)] and len(out) == len(table) - 1  # the last bar is still open


def test_live_features_over_batches(spark, tmp_path):
    """Six batches, bars of two tickers: one row per bar, each on the last five bars; a late bar and a repeated one are left out."""
    f = walk(40)
    late = f.iloc[[3]].assign(close=-1.0)
    parts = [f.iloc[:7], f.iloc[7:8], pd.concat([late, f.iloc[7:9]]), f.iloc[9:30], f.iloc[30:31], f.iloc[31:]]
    for part in parts:
        every = to_spark(spark, part)
        every.unionByName(every.withColumns({"ticker": F.lit("other"), "close": F.col("close") * 2})).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    compute = lambda b: features.frame_values(b, {"sma": ("SMA", {"time_period": 3, "series_type": "CLOSE"}), "ema": ("EMA", {"time_period": 3, "series_type": "CLOSE"})}, 5)
    stream = live.read_stream(spark, f"{tmp_path}/in", 1)
    out = live.live_features(stream, compute, f"{tmp_path}/features", f"{tmp_path}/checkpoint", 5)
    assert len(list((tmp_path / "features").glob("batch=*"))) == 6
    whole = features.frame_values(to_spark(spark, f), {"sma": ("SMA", {"time_period": 3, "series_type": "CLOSE"}), "ema": ("EMA", {"time_period": 3, "series_type": "CLOSE"})}, 5).orderBy("ts").toPandas()
    for ticker, scale in ((f.ticker.iloc[0], 1), ("other", 2)):
        got = out.where(F.col("ticker") == ticker).orderBy("ts").toPandas()
        assert list(got.ts) == list(whole.ts)
        for c in ("sma", "ema"):
            np.testing.assert_allclose(got[c], whole[c] * scale)


def test_upsert_is_idempotent_and_reads_its_parts_only(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "ticker string, ts timestamp, close double")
    path = f"{tmp_path}/t"
    live.upsert(rows(("A", at(0), 1.0), ("A", at(70), 2.0), ("B", at(0), 3.0)), path)
    before = set((tmp_path / "t").glob("part=*/*.parquet"))
    for _ in range(2):
        live.upsert(rows(("A", at(0), 5.0), ("A", at(1), 6.0)), path)
        got = spark.read.parquet(path).orderBy("ticker", "ts").select("ticker", "ts", "close").collect()
        assert [tuple(r) for r in got] == [("A", at(0), 5.0), ("A", at(1), 6.0), ("A", at(70), 2.0), ("B", at(0), 3.0)]
    assert len(before & set((tmp_path / "t").glob("part=*/*.parquet"))) == 1  # the later hour's file is as it was
    live.upsert(rows(), path)
    assert spark.read.parquet(path).count() == 4


def test_many_open_positions_of_one_ticker(spark, tmp_path):
    """Maturities spread over batches, repeated rows, one that comes when it is due already, and one without maturity."""
    schema = "ticker string, ts timestamp, maturity timestamp, n long"
    piece = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    piece([("A", at(0), at(5 + i % 40), i) for i in range(600)] + [("A", at(0), at(5), 0), ("A", at(0), None, -1)])
    piece([("A", at(20), at(1000), 1000)])
    piece([("A", at(20), at(3), 1001), ("B", at(20), at(18.5), 1002)])
    piece([("B", at(60), at(1000), 1003)])
    done = live.run_once(live.expired_positions(live.read_stream(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/b", f"{tmp_path}/cb", stateful=True)
    assert sorted(r["n"] for r in done.collect()) == sorted([*range(600), 0, 1001, 1002])
    assert done.where("n = 7").first()["maturity"] == at(12)


def test_open_positions_of_many_maturities_are_few_lists(spark, tmp_path):
    schema = "ticker string, ts timestamp, maturity timestamp, n long"
    piece = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    piece([("A", at(0), at(5 + i / 600), i) for i in range(300)])
    piece([("A", at(7.3), at(1000), 1000)])
    stream = live.expired_positions(live.read_stream(spark, f"{tmp_path}/in", 1))
    query = live.start_stateful(stream.writeStream.format("parquet").option("path", f"{tmp_path}/b").option("checkpointLocation", f"{tmp_path}/cb").trigger(availableNow=True), spark)
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 20
    # the watermark is at 5.3 minutes: what is due goes, the rest of its list stays
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/b").collect()) == list(range(180))


def test_stream_of_entries_and_positions(spark, tmp_path):
    rows = spark.createDataFrame([("A", at(0), at(15)), ("A", at(0.5), at(15)), ("A", at(1), at(16)), ("B", at(0), at(600))], "ticker string, ts timestamp, maturity timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = live.read_stream(spark, f"{tmp_path}/in")
    kept = live.run_once(live.cooled_entries(s), f"{tmp_path}/a", f"{tmp_path}/ca").orderBy("ticker", "ts").collect()
    assert [(r["ticker"], r["ts"]) for r in kept] == [("A", at(0)), ("A", at(1)), ("B", at(0))]
    spark.createDataFrame([("C", at(60), at(75))], "ticker string, ts timestamp, maturity timestamp").write.mode("append").parquet(f"{tmp_path}/in")
    done = live.run_once(live.expired_positions(live.read_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/b", f"{tmp_path}/cb", stateful=True).orderBy("ticker", "ts").collect()
    assert [(r["ticker"], r["ts"]) for r in done] == [("A", at(0)), ("A", at(0.5)), ("A", at(1))]
