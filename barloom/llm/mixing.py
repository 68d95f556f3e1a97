"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, beside, cut, filtered, join_dealt, named, unit_hash

BROADCAST_CELLS = 50_000
"""Up to so many, cells are broadcast to the rows and fitted in one partition; beyond, they are joined and fitted by shuffles, with the same result."""


def word_count(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from how a text is written, for tables that carry none: table, notice, marked or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("!!"), "notice").when(t.contains("***") | t.contains("%%%") | t.contains("&&&"), "marked").otherwise("prose")


def margin(cells: DataFrame, name: str, target: float | Mapping[str, float]) -> DataFrame:
    """(name, share): what each value of a dimension shall have of all tokens.

    A number t gives each value its tokens to the power of t (1 leaves the shares, 0 levels them). A mapping gives weights by value;
    values it doesn't name keep their own share, and the named ones divide the rest.
    """
    sums = cells.groupBy(name).agg(F.sum("tokens").alias("n"))
    if isinstance(target, Mapping):
        total = float(sum(target.values())) or 1.0
        weight = F.coalesce(*[F.when(F.col(name) == k, F.lit(v / total)) for k, v in sorted(target.items())], F.lit(None).cast("double"))
        every, rest = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(weight.isNull(), F.col("n"))), F.lit(0))).first()
        every = every or 1
        return sums.select(name, F.when(weight.isNull(), F.col("n") / every).otherwise(weight * (1 - rest / every)).alias(f"__share_{name}"))
    raised = sums.where("n > 0").select(name, F.pow(F.col("n").cast("double"), F.lit(float(target))).alias("w"))
    every = raised.agg(F.sum("w")).first()[0] or 1.0
    return raised.select(name, (F.col("w") / every).alias(f"__share_{name}"))


def distances(cells: DataFrame, aims: Mapping[str, str], weight: str) -> dict[str, float]:
    """For each dimension, half the sum of differences between its values' sums of ``weight`` and those in its column of aims, as a share of all."""
    out = {}
    for name, aim in aims.items():
        sums = cells.groupBy(name).agg(F.sum(F.expr(weight)).alias("w"), F.first(aim).alias("aim"))
        off, whole = sums.agg(F.sum(F.abs(F.col("w") - F.col("aim"))) / 2, F.sum("aim")).first()
        out[name] = (off or 0.0) / (whole or 1.0)
    return out


def fitted(cells: DataFrame, names: list[str], aims: Mapping[str, str], weight: str, step: Callable[[DataFrame, str], DataFrame], tolerance: float, least_gain: float) -> DataFrame:
    """``step`` for each dimension, round by round, until all margins are within ``tolerance`` of their aims.

    Up to BROADCAST_CELLS, cells stand in one partition, where windows by any dimension need no shuffle. Every fourth round the cells are written, so that plans stay short, and the distance is taken. Margins that contradict each
    other (by cells that no document has) can't all be met: then it ends when four rounds gain less than ``least_gain`` of what is left.
    """
    last, few = float("inf"), cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    while True:
        cells = cells.coalesce(1) if few else cells
        for _ in range(4):
            for name in names:
                cells = step(cells, name)
        cells = cut(cells)
        now = max(distances(cells, aims, weight).values(), default=0.0)
        if now <= tolerance or now > (1 - least_gain) * last:
            return cells
        last = now


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], *, tolerance: float = 1e-9) -> DataFrame:
    """Adds weight to cells (the dimensions of ``targets`` and tokens): token weights whose sums meet each dimension's shares.

    Iterative proportional fitting on one row per cell; a margin is a window over the cells of a value, so plans grow by one step per margin.
    """
    names = list(targets)
    for name, target in targets.items():
        cells = cells.join(margin(cells, name, target), name, "left")
    cells = cut(cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double")))

    def step(now: DataFrame, name: str) -> DataFrame:
        return now.withColumn("weight", F.col("weight") * F.col(f"__share_{name}") / F.sum("weight").over(Window.partitionBy(name)))

    cells = fitted(cells, names, {n: f"__share_{n}" for n in names}, "weight", step, tolerance, 0.02)
    return cells.select(*names, "tokens", "weight")


def sampling_rates(cells: DataFrame, keep: float) -> DataFrame:
    """Adds p, the probability of a cell's documents: in proportion to weight / tokens, at most 1, so that ``keep`` of all tokens are expected.

    Cells that reach 1 give their surplus to the others; one sum over the cells per step, until nothing is left to give.
    """
    total, weight = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    factor = keep * total / weight if weight else 0.0
    full = -1.0
    while True:
        capped = F.col("weight") * factor >= F.col("tokens")
        whole, rest = cells.agg(F.coalesce(F.sum(F.when(capped, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if whole <= full or not rest:
            break
        full = whole
        factor = max(factor, (keep * total - whole) / rest)
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("weight") * factor / F.col("tokens")))


def refit(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], keep: float, *, tolerance: float = 1e-5) -> DataFrame:
    """The cells of ``rake`` with weights whose parts up to tokens (what a sample can hold) sum to each dimension's aims.

    A value's aim is its share of ``keep`` of all tokens; a value that has fewer stays whole, and the others share what it lacks. A cell whose
    weight reaches its tokens is full, and the cells beside it in a margin make up for it.
    """
    total, weight = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    if not weight:
        return cells
    own, names = cells.columns, list(targets)
    cells = cells.withColumn("weight", F.col("weight") * (keep * total / weight))
    for name, target in targets.items():
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("tokens")).join(margin(cells, name, target), name).withColumnRenamed(f"__share_{name}", "weight")
        aims = sampling_rates(cut(sums), keep).select(name, (F.col("p") * F.col("tokens")).alias(f"__aim_{name}"), (F.col("p") >= 1).alias(f"__whole_{name}"))
        cells = cells.join(aims, name)
    cells = cut(cells)

    def step(now: DataFrame, name: str) -> DataFrame:
        by, full, aim = Window.partitionBy(name), F.col("weight") >= F.col("tokens"), F.col(f"__aim_{name}")
        now = now.withColumns({"__full": F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(0.0)).over(by), "__free": F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(by)})
        held = F.col("__full") + F.col("__free")
        factor = F.when(aim < held, aim / held).when(F.col("__free") > 0, (aim - F.col("__full")) / F.col("__free")).otherwise(1.0)
        scaled = F.col("weight") * factor
        raised = F.when(F.col(f"__whole_{name}"), F.greatest(scaled, F.col("tokens").cast("double"))).otherwise(scaled)
        return now.withColumn("weight", raised).drop("__full", "__free")

    cells = fitted(cells, names, {n: f"__aim_{n}" for n in names}, "least(weight, tokens)", step, tolerance, 0.1)
    return cells.select(*own)


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]], *, tokens: str, key: str = "doc_id", keep: float = 0.5, tolerance: float = 1e-9, salt: str = "mix", detail: bool = False, fit_full: bool = False) -> DataFrame:
    """A sample of ``docs`` whose tokens meet ``targets`` per dimension (a column name each); about ``keep`` of all tokens.

    A row stays if a hash of its key is below its cell's rate, so the same rows stay every time. A null in a dimension is a
    value of its own; rows without tokens in cells without tokens go; repeated keys stay or go together. An empty table
    gives an empty one. With ``detail``, probability is added (a column of that name, in any case, gives way); else the columns are those of
    ``docs``. With ``fit_full``, margins are fitted again around the cells that are kept whole (``refit``); else those cells' surplus goes to all others by one factor.

    Tokens are summed per cell before anything is shuffled, so a hot source weighs one row per task and cell. More cells than
    BROADCAST_CELLS are joined by shuffle, the rows of a hot cell dealt to several tasks.
    """
    dims = {f"__d{i}": name for i, name in enumerate(targets)}

    def chosen(df: DataFrame, at: Callable[[str], str]) -> DataFrame:
        value = {d: F.coalesce(F.col(at(n)).cast("string"), F.lit("\x00null")) for d, n in dims.items()}
        cells = cut(df.groupBy(*[v.alias(d) for d, v in value.items()]).agg(F.sum(at(tokens)).alias("tokens")))
        wanted = {d: targets[n] for d, n in dims.items()}
        weighted = rake(cells, wanted, tolerance=tolerance)
        if fit_full:
            weighted = refit(weighted, wanted, keep, tolerance=max(tolerance, 1e-5))
        rates = cut(sampling_rates(weighted, keep).select(*dims, "p"))
        few = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
        rows = df.withColumns(value)
        joined = rows.join(F.broadcast(rates), list(dims)) if few else join_dealt(rows, rates, list(dims))
        return joined.where(unit_hash(F.col(at(key)), salt) < F.col("p")).withColumn("probability", F.col("p"))

    return beside(docs, ["probability"], chosen) if detail else filtered(docs, lambda df, at: chosen(df, lambda c: at(named(docs, c))), F.lit(True))
