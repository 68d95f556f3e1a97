"""Bars from raw to regular: repair, grid and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph, Node, compute
from ..sources.scratch import join_same

PRICES = ["open", "high", "low", "close"]


def anomaly_nodes(g: Graph, column: str, periods: int, max_move: float, volume_below: float) -> tuple[Node, Node]:
    """(repaired series, 1 where a value was dropped)."""
    x = g.ffill(g.col(column))
    before = g.lag(x, periods)
    bad = g.expr(
        "CASE WHEN {0} < " + repr(float(volume_below)) + " AND CASE WHEN {2} = 0 THEN {1} <> 0 ELSE abs({1} / nullif({2}, 0.0) - 1) > " + repr(float(max_move)) + " END THEN 1 ELSE 0 END",
        g.col("volume"), x, before,
    )
    return g.ffill(g.expr("CASE WHEN {1} = 0 THEN {0} END", g.col(column), bad)), bad


def anomaly_outputs(g: Graph, periods: int = 100, max_move: float = 0.01, volume_below: float = 800_000) -> dict[str, Node]:
    out = {}
    for c in PRICES:
        out[c], out[f"{c}_dropped"] = anomaly_nodes(g, c, periods, max_move, volume_below)
    return out


def repair_anomalies(bars: DataFrame, *, periods: int = 100, max_move: float = 0.01, volume_below: float = 800_000, keys: list[str] | None = None) -> DataFrame:
    """Each price that moved by more than ``max_move`` over ``periods`` bars on less than ``volume_below`` gives way to the last good one.

    Adds <price>_dropped, 1 where a value was dropped. The four prices are judged apart.
    """
    return compute(bars, anomaly_outputs(Graph(), periods, max_move, volume_below), keys or ["ticker"])


def anomaly_counts(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("ticker").agg(*[F.sum(f"{c}_dropped").cast("long").alias(f"{c}_dropped") for c in PRICES])


def regular_grid(bars: DataFrame, *, size: int = 250, step: str = "1 minute") -> DataFrame:
    """The last ``size`` steps up to each ticker's last bar, one row each: prices filled forward, then backward, then 0; volume 0.

    Nothing before the grid is carried in. A ticker is at most ``size`` rows, so its window is bounded.
    """
    ends = bars.groupBy("ticker").agg(F.max("ts").alias("last"))
    grid = ends.select("ticker", F.explode(F.expr(f"sequence(last - {size - 1} * INTERVAL {step}, last, INTERVAL {step})")).alias("ts"))
    rows = join_same(grid, bars, ["ticker", "ts"], "left")
    w = Window.partitionBy("ticker").orderBy("ts")
    fill = lambda c: F.coalesce(F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(c, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    return rows.select("ticker", "ts", *[fill(c).alias(c) for c in PRICES], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def in_session(ts: Column, zone: str = "US/Eastern") -> Column:
    """Monday to Friday from 09:30 to 16:00, both included, in ``zone``; ``ts`` is UTC."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return (F.weekday(local) < 5) & F.date_format(local, "HH:mm:ss.SSSSSS").between("09:30:00.000000", "16:00:00.000000")


def last_rows(bars: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last n rows per key; each task keeps n per key before the shuffle."""
    w = Window.partitionBy(*(keys or ["ticker"])).orderBy(F.desc("ts"))
    return bars.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """The value at each key's last time; partial results are combined before the shuffle."""
    return rows.groupBy(*(keys or ["ticker"])).agg(F.max_by(column, "ts").alias(column))
