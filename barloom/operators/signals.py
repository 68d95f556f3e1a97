"""Signals and trades as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..plans.blocks import BLOCK, PLACE, placed
from ..sources.scratch import join_same, written

TAKE_PROFIT, STOP_LOSS, STOP_GAP, SLIPPAGE = 0.008, 0.01, 0.03, 0.05
HORIZON = "15 minutes"
COOLDOWN_SECONDS = 45


def agreeing(scores: DataFrame) -> DataFrame:
    """Rows where both scores are above 0; a null agrees with nothing."""
    return scores.where("profit > 0 AND accuracy > 0")


def priced(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals with the close of their bar; those without a price go."""
    return signals.join(bars.select("ticker", "ts", "close"), ["ticker", "ts"]).where("close is not null")


def brackets(entries: DataFrame, *, take_profit: float = TAKE_PROFIT, stop_loss: float = STOP_LOSS, horizon: str = HORIZON, rounded: bool = False) -> DataFrame:
    """Adds entry (close plus 0.05), tp, sl, sl_limit and maturity; ``rounded`` gives the levels in cents."""
    cents = (lambda c: F.round(c, 2)) if rounded else (lambda c: c)
    entry = F.round(F.col("close") + SLIPPAGE, 2)
    leveled = entries.withColumn("entry", entry).withColumns({"tp": cents(F.col("entry") * (1 + take_profit)), "sl": cents(F.col("entry") * (1 - stop_loss))})
    return leveled.withColumns({"sl_limit": cents(F.col("sl") - STOP_GAP), "maturity": F.col("ts") + F.expr(f"INTERVAL {horizon}")})


FAN = 64
"""Children of a node of prices."""


def price_nodes(prices: DataFrame) -> list[DataFrame]:
    """Levels of (ticker, node, hi, lo): the greatest and least close of each of a node's FAN children at most, by place; at the lowest, the closes with their times (ats).

    ``prices`` has ticker, at, close and __place, a number from 0 on without gaps per ticker.
    """
    own = F.array_sort(F.collect_list(F.struct("__place", "at", "close")))
    rows = prices.groupBy("ticker", F.floor(F.col("__place") / FAN).alias("node")).agg(own.alias("x"))
    levels = [written(rows.select("ticker", "node", F.col("x.close").alias("hi"), F.col("x.close").alias("lo"), F.col("x.at").alias("ats")))]
    while levels[-1].where("node > 0").limit(1).count():
        last = levels[-1].select("ticker", F.floor(F.col("node") / FAN).alias("up"), F.struct("node", F.array_max("hi").alias("hi"), F.array_min("lo").alias("lo")).alias("x"))
        rows = last.groupBy("ticker", F.col("up").alias("node")).agg(F.array_sort(F.collect_list("x")).alias("x"))
        levels.append(written(rows.select("ticker", "node", F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo"))))
    return levels


def first_crossings(asks: DataFrame, prices: DataFrame) -> DataFrame:
    """(ticker, ts, hit): of each ask (ticker, ts, tp, sl, __from, __to) the first price (place, at, close) from the place __from on, before __to (null: no end), that is at or above tp or at or below sl.

    A walk over the levels of ``price_nodes``: up from the node of __from until a later child crosses, then down to the price. Each step is an equi-join with one
    node per ask, whatever the horizon; asks that are done stand aside under keys that no node has.
    """
    levels = price_nodes(prices)
    apart = -1 - F.pmod(F.xxhash64("ts"), F.lit(1 << 20))
    nothing = F.lit(None).cast("bigint")
    now = asks.where("__from IS NOT NULL").select("ticker", "ts", "tp", "sl", "__to", F.col("__from").cast("long").alias("__pos"), nothing.alias("__level"), nothing.alias("__child"), F.lit(None).cast(f"struct<place:bigint,at:{dict(prices.dtypes)['at']},close:double>").alias("hit"))

    def step(now: DataFrame, level: int, active: Column, node: Column, begin: Column) -> DataFrame:
        """Looks for a crossing child of a node: sets __child to its number in the level and __level, and at the lowest level the hit."""
        at = levels[level].withColumnRenamed("ticker", "__t")
        placed = now.withColumns({"__active": active, "__node": F.when(active, node).otherwise(apart), "__begin": begin})
        met = placed.join(at, [F.col("ticker") == F.col("__t"), F.col("__node") == F.col("node")], "left")
        met = met.withColumn("__c", F.expr("try_element_at(filter(sequence(cast(__begin AS INT), greatest(cast(__begin AS INT), size(hi) - 1)), c -> try_element_at(hi, c + 1) >= tp OR try_element_at(lo, c + 1) <= sl), 1)"))
        found = F.col("__active") & F.col("__c").isNotNull()
        child = F.when(found, F.col("__node") * FAN + F.col("__c")).otherwise(F.col("__child"))
        hit = F.col("hit")
        if level == 0:
            hit = F.when(found, F.struct(child.alias("place"), F.expr("try_element_at(ats, __c + 1)").alias("at"), F.expr("try_element_at(hi, __c + 1)").alias("close"))).otherwise(hit)
        return met.withColumns({"__child": child, "__level": F.when(found, F.lit(level)).otherwise(F.col("__level")), "hit": hit, "__pos": F.when(F.col("__active"), F.col("__node") + 1).otherwise(F.col("__pos"))}).select(*now.columns)

    for level in range(len(levels)):
        pos = F.col("__pos")
        now = step(now, level, F.col("__level").isNull(), F.floor(pos / FAN), pos % FAN)
    for level in range(len(levels) - 2, -1, -1):
        now = step(now, level, F.coalesce(F.col("__level") == level + 1, F.lit(False)), F.col("__child"), F.lit(0))
    return now.where("hit IS NOT NULL AND (__to IS NULL OR hit.place < __to)").select("ticker", "ts", "hit")


def first_exits(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds exit_ts, exit_price and exit_type to bracketed entries: the first later price at or above tp (exit at tp), else at or below sl (at sl),
    else the first at or behind maturity (at that price); in that order within one price. Null where no such price is there yet.

    ``prices`` has ticker, ts and close. The first price behind an entry and the first at its maturity are found by one sorted pass over both tables, bounded per
    ticker and month, with the next months' first price passed on; what crosses a level between them, by ``first_crossings``, so that the work of an entry
    doesn't depend on its horizon. Entries of one ticker and time are taken as one.
    """
    kind = dict(entries.dtypes)["ts"]
    given = prices.where("ticker is not null and ts is not null and close is not null").select("ticker", F.col("ts").cast("timestamp_ntz").alias("at"), F.col("close").cast("double").alias("close"))
    given = written(placed(given, ["ticker"], "at", FAN).withColumn("__place", F.col(PLACE) - 1).drop(PLACE, BLOCK))
    entries = written(entries)

    # the first price at or behind each time asked for: latest first, the last price seen so far
    month = F.date_trunc("month", F.col("at").cast("timestamp"))
    asked = lambda what, at: entries.select("ticker", at.alias("at"), F.lit(0).alias("kind"), F.lit(what).alias("what"), "ts", F.lit(None).cast("struct<place:bigint,at:timestamp_ntz,close:double>").alias("price"))
    gives = given.select("ticker", "at", F.lit(1).alias("kind"), F.lit("").alias("what"), F.lit(None).cast(kind).alias("ts"), F.struct(F.col("__place").alias("place"), "at", "close").alias("price"))
    asks = asked("from", (F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")).unionByName(asked("to", F.col("maturity").cast("timestamp_ntz")))
    both = asks.unionByName(gives).withColumn("m", month)
    opening = gives.withColumn("m", month).groupBy("ticker", "m").agg(F.min_by("price", "at").alias("opening"))
    months = both.select("ticker", "m").distinct().join(opening, ["ticker", "m"], "left")
    onward = months.withColumn("next", F.last("opening", True).over(Window.partitionBy("ticker").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, -1))).select("ticker", "m", "next")
    w = Window.partitionBy("ticker", "m").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("mine", F.last("price", True).over(w)).where("kind = 0").join(onward, ["ticker", "m"], "left").select("ticker", "ts", "what", F.coalesce("mine", "next").alias("p"))
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("p")))
    spans = seen.groupBy("ticker", "ts").agg(of("from").alias("__first"), of("to").alias("due"))

    wanted = written(entries.dropDuplicates(["ticker", "ts"]).select("ticker", "ts", "tp", "sl").join(spans, ["ticker", "ts"]))
    hits = first_crossings(wanted.select("ticker", "ts", "tp", "sl", F.col("__first.place").alias("__from"), F.col("due.place").alias("__to")), given)
    joined = entries.join(wanted.select("ticker", "ts", "due"), ["ticker", "ts"], "left").join(hits, ["ticker", "ts"], "left")
    close = F.col("__e.close")
    kinds = F.when(close >= F.col("tp"), "tp").when(close <= F.col("sl"), "sl").when(close.isNotNull(), "maturity")
    out = joined.withColumn("__e", F.coalesce("hit", "due")).withColumn("exit_type", kinds)
    paid = F.when(F.col("exit_type") == "tp", F.col("tp")).when(F.col("exit_type") == "sl", F.col("sl")).otherwise(close)
    return out.select(*entries.columns, F.when(close.isNotNull(), F.col("__e.at").cast(kind)).alias("exit_ts"), paid.alias("exit_price"), "exit_type")


def chain(rows: DataFrame, key: str, at: str, wait: str, block: Column) -> DataFrame:
    """The rows of each key that a walk from its first row stops at: from each it goes on to the first row whose ``at`` is its ``wait`` or more.

    ``at`` and ``wait`` are numbers (wait above at; null: the walk ends), ``block`` ascends with ``at``. Each block of a key is walked apart, from every row of it at once: where a
    walk leaves the block depends on the row it enters by, and neighbours leave alike, so a block is told by few pairs (last entry of a run, what it
    waits for when it leaves). The pairs of a key's blocks, in order, give what each block is entered with, and then each is walked once more.
    """
    kind = dict(rows.dtypes)[key]
    blocked = rows.withColumn("__block", block)
    table = StructType().add("__key", rows.schema[key].dataType).add("__block", blocked.schema["__block"].dataType).add("entries", ArrayType(LongType())).add("leaves", ArrayType(LongType()))
    end = 2**62

    def successors(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        part = part.sort_values(at, kind="stable").reset_index(drop=True)
        times = part[at].to_numpy("int64")
        waits = np.array([end if pd.isna(w) else int(w) for w in part[wait].tolist()], dtype="int64")
        return part, times, waits

    def told(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, times, waits = successors(part)
        after = np.searchsorted(times, waits, "left")
        leaves = waits.copy()
        for i in range(len(times) - 1, -1, -1):
            if after[i] < len(times):
                leaves[i] = leaves[after[i]]
        last = np.append(np.flatnonzero(leaves[1:] != leaves[:-1]), len(leaves) - 1)
        return pd.DataFrame({"__key": [names[0]], "__block": [names[1]], "entries": [times[last].tolist()], "leaves": [leaves[last].tolist()]})

    def entered(part: pd.DataFrame) -> pd.DataFrame:
        part, now, out = part.sort_values("__block"), -end, []
        for entries, leaves in zip(part["entries"], part["leaves"], strict=True):
            out.append(now)
            i = int(np.searchsorted(entries, now, "left"))
            now = int(leaves[i]) if i < len(entries) else now
        return part[["__key", "__block"]].assign(enter=out)

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        part, times, waits = successors(part)
        now, taken = int(part["enter"].iloc[0]), []
        while (i := int(np.searchsorted(times, now, "left"))) < len(times):
            taken.append(i)
            now = waits[i]
        return part.iloc[taken][columns]

    held = blocked.withColumn("__key", F.col(key).cast(kind))
    tables = held.groupBy("__key", "__block").applyInPandas(told, table)
    enters = tables.groupBy("__key").applyInPandas(entered, StructType(table.fields[:2]).add("enter", "long"))
    columns = rows.columns
    return held.join(enters, [held["__key"].eqNullSafe(enters["__key"]), held["__block"] == enters["__block"]]).select(held["*"], enters["enter"]).groupBy("__key", "__block").applyInPandas(walked, rows.schema)


def thinned(entries: DataFrame, *, cooldown_seconds: float = COOLDOWN_SECONDS, restart_on_skip: bool = True, block: str = "month") -> DataFrame:
    """Entries that are taken, per ticker in time order: none within the cooldown behind the last try, none while a position is open.

    A signal that an open position stops counts as a try if ``restart_on_skip``. A position is open from its entry until exit_ts, and
    without one for good. Entries have a ticker and a time, one each per ticker and time.

    Either rule is a walk along the entries (``chain``), in blocks of time: with ``restart_on_skip`` the tries are those that follow each other by the cooldown, whatever is
    open, and the taken ones those of them that follow each other by their exits; without it, the next one taken waits for both.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.unix_micros(F.date_trunc(block, F.col("ts").cast("timestamp")))
    pause = round(cooldown_seconds * 1_000_000)
    timed = entries.withColumns({"__at": micros("ts"), "__pause": micros("ts") + F.lit(max(pause, 1)), "__free": F.when(F.col("exit_ts").isNotNull(), F.greatest(micros("exit_ts"), micros("ts") + 1))})
    if restart_on_skip:
        timed = chain(chain(timed, "ticker", "__at", "__pause", part), "ticker", "__at", "__free", part)
    else:
        both = F.when(F.col("__free").isNotNull(), F.greatest("__pause", "__free"))
        timed = chain(timed.withColumn("__both", both), "ticker", "__at", "__both", part)
    return timed.select(*entries.columns)


def transactions(trades: DataFrame, quantity: int = 2) -> DataFrame:
    """Ledger rows of exited trades: a buy with four ids (its own and one per way out), and a sell with the id of the way it took.

    Ids ascend by time and ticker: counts per day are summed up (one row per day, so that window without a partition stays small), places
    within a day come from one window per day.
    """
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    dated = trades.withColumn("__day", day)
    before = dated.groupBy("__day").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    placed = dated.withColumn("__n", F.row_number().over(Window.partitionBy("__day").orderBy("ts", "ticker"))).join(before, "__day")
    base = ((F.col("__before") + F.col("__n") - 1) * 4 + 1).cast("long")
    none = lambda t: F.lit(None).cast(t)
    way = F.when(F.col("exit_type") == "tp", 1).when(F.col("exit_type") == "sl", 2).otherwise(3)

    def row(identity, time, price, side, order, parent, children: bool) -> Column:
        child = lambda c, t: (c if children else none(t))
        return F.struct(
            identity.alias("transaction_id"), time.alias("time_UTC"), F.col("ticker").alias("ticker"), price.alias("current_price"), F.lit(side).alias("transaction_type"), F.lit(quantity).alias("quantity"),
            order.alias("order_type"), parent.alias("parent_id"), child(F.col("tp"), "double").alias("child_tp_price"), child(base + 1, "long").alias("child_tp_id"), child(F.col("sl"), "double").alias("child_sl_price"),
            child(base + 2, "long").alias("child_sl_id"), child(base + 3, "long").alias("child_maturity_id"), child(F.col("maturity"), dict(trades.dtypes)["maturity"]).alias("child_maturity_UTC"),
        )

    buy = row(base, F.col("ts"), F.col("entry"), "buy", F.lit("entry"), none("long"), True)
    sell = row(base + way, F.col("exit_ts"), F.col("exit_price"), "sell", F.col("exit_type"), base, False)
    rows = F.when(F.col("exit_ts").isNotNull(), F.array(buy, sell)).otherwise(F.array(buy))
    return placed.select(F.explode(rows).alias("t")).select("t.*")


def running(df: DataFrame, out: str, value: Column, keys: list[str], part: str, order: list[str]) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of ``keys`` up to its own, in two levels: within each ``part`` (which ascends with ``order``), and over a row per part."""
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("__value", value)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = summed.groupBy(*keys, part).agg(F.sum("__value").alias("__sum")).select(*keys, part, F.sum("__sum").over(earlier).alias("__before"))
    joined = join_same(summed.withColumn("__own", F.sum("__value").over(own)), before, [*keys, part])
    return joined.withColumn(out, F.coalesce("__before", F.lit(0)) + F.coalesce("__own", F.lit(0))).drop("__value", "__own", "__before")


def average_cost(fills: DataFrame) -> DataFrame:
    """Adds shares_held, cost_held (null where no position is left) and exposure to fills (symbol, ts, order_id, side BOT or SLD, shares, price).

    A buy adds shares * price to the exposure and makes the position anew, as large as that buy; a sale takes shares at the average cost, and
    the position ends at 0 shares. A sale without a position changes nothing; null shares or prices count as 0, and shares aren't negative. Fills
    without a symbol are one symbol's.

    As a buy makes the position anew, the average cost is its price up to the next one: shares and exposure are sums over the fills since the last buy, and
    over all, each in two levels by day, so that a symbol with many fills has many tasks. Steps are written, as each is read twice by the next.
    """
    order = ["ts", "order_id"]
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rows = fills.withColumns({"__symbol": F.struct("symbol"), "__day": F.coalesce(day, F.lit("0001-01-01").cast("timestamp")), "__shares": F.coalesce(F.col("shares").cast("double"), F.lit(0.0))})
    bought, sold = F.col("side") == "BOT", F.col("side") == "SLD"
    rows = written(rows)
    rows = running(rows, "__buys", F.coalesce(bought.cast("long"), F.lit(0)), ["__symbol"], "__day", order)
    rows = written(rows)
    buys = rows.where(bought).select("__symbol", "__buys", F.col("__shares").alias("__bought"), F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("__cost"))
    rows = written(rows.join(buys, ["__symbol", "__buys"], "left"))
    rows = running(rows, "__sold", F.when(sold, F.col("__shares")).otherwise(0.0), ["__symbol", "__buys"], "__day", order)
    open_before = F.coalesce(sold & (F.col("__bought") - F.col("__sold") + F.col("__shares") > 0), F.lit(False))
    change = F.when(bought, F.col("__shares") * F.col("__cost")).when(open_before, -F.col("__shares") * F.col("__cost")).otherwise(0.0)
    rows = written(rows.withColumn("__change", change))
    rows = running(rows, "exposure", F.col("__change"), ["__symbol"], "__day", order)
    held = F.greatest(F.col("__bought") - F.col("__sold"), F.lit(0.0))
    return rows.select(*fills.columns, F.when(held > 0, held).alias("shares_held"), F.when(held > 0, held * F.col("__cost")).alias("cost_held"), F.col("exposure"))


def exposure_timeline(trades: DataFrame, *, quantity: int = 2, limit: float = 7000.0) -> DataFrame:
    """(ts, change, exposure, breach): the open value behind each entry and exit of all tickers; breach where an entry passes ``limit``.

    A prefix sum over all tickers in two levels: within a day by one window per day, between days over one row per day (few, though in one task).
    """
    value = F.col("entry") * quantity
    events = trades.select("ts", value.alias("change")).unionByName(trades.where("exit_ts is not null").select(F.col("exit_ts").alias("ts"), (-value).alias("change")))
    summed = events.groupBy("ts").agg(F.sum("change").alias("change"), F.max(F.col("change") > 0).alias("bought")).withColumn("__day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    days = summed.groupBy("__day").agg(F.sum("change").alias("d"))
    before = days.select("__day", F.coalesce(F.sum("d").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    w = Window.partitionBy("__day").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = summed.withColumn("__own", F.sum("change").over(w)).join(before, "__day")
    exposure = F.col("__before") + F.col("__own")
    return running.select("ts", "change", exposure.alias("exposure"), (F.col("bought") & (exposure > limit)).alias("breach"))


def expired(positions: DataFrame, now: Column) -> DataFrame:
    """Positions whose maturity lies before ``now``."""
    return positions.where(F.col("maturity") < now)
