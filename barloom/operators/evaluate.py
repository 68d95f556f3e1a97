"""Labels, confusion and trade metrics, equity and walk-forward splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import join_same

NO_LOSS_FACTOR = 999.0
"""Profit factor where nothing was lost."""


def forward_returns(bars: DataFrame, horizon: int = 15) -> DataFrame:
    """Adds ret, the percent change of the close over the next ``horizon`` bars, and truth (1 if above 0); null at the end of a series."""
    ahead = F.lead("close", horizon).over(Window.partitionBy("ticker").orderBy("ts"))
    ret = (ahead / F.nullif(F.col("close"), F.lit(0.0)) - 1) * 100
    return bars.withColumn("ret", ret).withColumn("truth", (F.col("ret") > 0).cast("int"))


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn of pred and truth, and the metrics that follow from them and from ret; rows with a null in either are left out.

    All are sums, combined before the shuffle.
    """
    hit = lambda p, t: F.sum(((F.col("pred") == p) & (F.col("truth") == t)).cast("long"))
    taken = F.when(F.col("pred") == 1, F.col("ret"))
    sums = rows.where("pred is not null AND truth is not null").groupBy(*(by or [])).agg(
        hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"),
        F.sum(taken).alias("profitability"), F.sum(F.when(taken > 0, taken)).alias("gains"), F.sum(F.when(taken < 0, -taken)).alias("losses"),
    )
    trades, total = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    factor = F.when(F.coalesce("losses", F.lit(0.0)) == 0, NO_LOSS_FACTOR).otherwise(F.coalesce("gains", F.lit(0.0)) / F.nullif(F.col("losses"), F.lit(0.0)))
    return sums.select(
        *(by or []), "tp", "fp", "fn", "tn", F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"), F.try_divide(F.col("tp"), trades).alias("win_rate"),
        F.coalesce("profitability", F.lit(0.0)).alias("profitability"), factor.alias("profit_factor"), trades.alias("trades"), (2 * trades).alias("turnover"),
    )


DIGITS = (48, 32, 16, 0)
"""Bits that are left behind each digit of a number's key: four digits of 16 bits."""


def ordered_key(x: Column) -> Column:
    """A whole number of 64 bits in the order of a double that isn't NaN, infinities included: its bits, those of negative numbers turned over."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def middle_values(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the mean of the one or two middle values of each class, nulls and NaN left out.

    Found digit by digit: values are counted by the first 16 bits of their keys, the digit that holds a middle place is chosen, and so on among those
    with that beginning. Each of the four passes combines its counts before the shuffle, so neither a hot class nor a value that most rows share
    meets in one task; what is joined is one or two rows per class.
    """
    keyed = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("__v")).withColumn("__key", ordered_key(F.col("__v")))
    places = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))
    wanted = keyed.groupBy(*by).agg(F.count("*").alias("n")).select(*by, places.alias("place")).select(*by, "place", F.col("place").alias("rest"), F.lit(None).cast("long").alias("begin"))
    for i, left in enumerate(DIGITS):
        within = join_same(keyed, F.broadcast(wanted), by)
        if i:
            within = within.where(F.shiftright("__key", DIGITS[i - 1]) == F.col("begin"))
        counts = within.groupBy(*by, "place", "rest", F.shiftright("__key", left).alias("next")).agg(F.count("*").alias("c"), F.min("__v").alias("v"))
        upto = F.sum("c").over(Window.partitionBy(*by, "place").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chosen = counts.withColumn("upto", upto).where("upto > rest AND upto - c <= rest")
        wanted = chosen.select(*by, "place", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"), F.col("next").alias("begin"), *(["v"] if left == 0 else []))
    return wanted.groupBy(*by).agg(F.avg("v").alias("median"))


def class_returns(rows: DataFrame) -> DataFrame:
    """Mean, median and sample deviation of ret for each truth and pred; a ret that is null or NaN is no return. The median is exact, as ``middle_values`` has it."""
    by = ["truth", "pred"]
    valid = rows.where("pred is not null AND truth is not null AND ret is not null AND NOT isnan(ret)").select(*by, F.col("ret").cast("double").alias("ret"))
    stats = valid.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("deviation"))
    return join_same(stats, middle_values(valid, by, "ret"), by).select(*by, "n", "mean", "median", "deviation")


def equity(trades: DataFrame, quantity: int = 2) -> DataFrame:
    """(day, pnl, total, drawdown) of exited trades, by the day of the exit; sums over the table of days."""
    pnl = (F.col("exit_price") - F.col("entry")) * quantity
    days = trades.where("exit_ts is not null").groupBy(F.date_trunc("day", F.col("exit_ts").cast("timestamp")).cast("date").alias("day")).agg(F.sum(pnl).alias("pnl"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = days.withColumn("total", F.sum("pnl").over(w))
    return running.withColumn("drawdown", F.greatest(F.max("total").over(w), F.lit(0.0)) - F.col("total"))


def equity_metrics(days: DataFrame) -> DataFrame:
    """One row: net, days, greatest drawdown, its longest run in days, and Sharpe and Sortino ratios of daily results (null without spread)."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peaks = days.withColumn("peak", F.sum((F.col("drawdown") <= 0).cast("int")).over(w))
    under = F.sum((F.col("drawdown") > 0).cast("long")).over(Window.partitionBy("peak").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.sqrt(F.avg(F.pow(F.least(F.col("pnl"), F.lit(0.0)), F.lit(2))))
    return peaks.withColumn("under", under).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("net"), F.count("*").alias("days"), F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"),
                    F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe"), F.try_divide(F.avg("pnl"), below).alias("sortino"), F.coalesce(F.max("under"), F.lit(0)).alias("drawdown_days"))


def walk_forward(rows: DataFrame, *, initial: float = 0.2, step: float = 0.04, rolls: int = 20) -> DataFrame:
    """Adds roll (from 0) and role: per roll the times before initial + roll * step of all are train, those of the next step validation.

    A time's share of all distinct times is counted in two levels, by day; rows meet their rolls in an equi-join on ts, at most ``rolls`` of
    them each.
    """
    times = rows.select("ts").distinct().withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    days = times.groupBy("day").count()
    w = Window.orderBy("day")
    before = days.select("day", F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    placed = times.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("ts"))).join(before, "day")
    share = ((F.col("before") + F.col("n") - 1) / F.col("total")).alias("share")
    every = placed.select("ts", share, F.explode(F.sequence(F.lit(0), F.lit(rolls - 1))).alias("roll"))
    start = F.lit(initial) + F.col("roll") * step
    role = F.when(F.col("share") < F.round(start, 9), "train").when(F.col("share") < F.round(start + step, 9), "validation")
    return rows.join(every.withColumn("role", role).where("role is not null").select("ts", "roll", "role"), "ts")
