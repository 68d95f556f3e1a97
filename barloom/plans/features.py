"""From specs and bars to features and context windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from ..functions.safe import without_nan
from ..operators import indicators
from ..sources.scratch import join_same
from ..sources.specs import typed
from . import blocks
from .frames import frame_series
from .graph import Graph


CONTEXT_ROWS = 512
"""Rows of a block that contexts are cut from."""
MAX_SHAPES = 2000
"""Different functions with parameters that one plan takes."""


def planned(specs: Iterable[tuple[str, Mapping[str, object]]]) -> dict[str, tuple[str, Mapping[str, object]]]:
    """Column name -> indicator and parameters."""
    return {f"f{i}": (function, params) for i, (function, params) in enumerate(specs)}


def wide(bars: DataFrame, specs: list[tuple[str, Mapping[str, object]]], keys: list[str] | None = None) -> tuple[DataFrame, dict[str, tuple[str, Mapping[str, object]]]]:
    """Keys, ts and a column per spec, all from one plan that shares what the specs have in common."""
    keys = keys or ["ticker"]
    plan = planned(specs)
    return indicators.series(bars, plan, keys).select(*keys, "ts", *plan), plan


def features(bars: DataFrame, parsed: DataFrame) -> DataFrame:
    """Long (ticker, ts, feature, value) for parsed specs (a table of ``parse_specs``), each for its own ticker.

    The distinct functions with their parameters, MAX_SHAPES at most, are read by the driver to build one plan for all tickers;
    which ticker has which feature stays a join. A spec with an error raises, as do more shapes than one plan can hold.
    """
    shape = F.concat_ws("&", F.col("function"), F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))))
    keyed = parsed.withColumn("shape", shape)
    if bad := keyed.where("error is not null").select("spec", "error").first():
        raise ValueError(f"{bad['spec']}: {bad['error']}")
    rows = keyed.select("shape", "function", "params").dropDuplicates(["shape"]).orderBy("shape").limit(MAX_SHAPES + 1).collect()
    if len(rows) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} different features: expand them in several plans")
    table, plan = wide(bars.join(parsed.select("ticker").distinct(), "ticker", "left_semi"), [(r["function"], typed(r["params"])) for r in rows])
    name = dict(zip(plan, (r["shape"] for r in rows), strict=True))
    cells = F.explode(F.array(*[F.struct(F.lit(name[c]).alias("shape"), F.col(c).alias("value")) for c in plan])).alias("cell")
    long = table.select("ticker", "ts", cells).select("ticker", "ts", "cell.shape", "cell.value")
    return long.join(keyed.select("ticker", "shape", F.col("spec").alias("feature")).distinct(), ["ticker", "shape"]).select("ticker", "ts", "feature", "value")


def normalised(context: Column, last: Column, scale: Column | float) -> Column:
    """Each value less the last one, over the scale; a null last value makes all null."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return F.transform(context, lambda x: (x - last) / scale)


def last_contexts(table: DataFrame, plan: Mapping[str, tuple[str, Mapping[str, object]]], depth: int = 60, keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, context): for each key and column of ``plan`` the last ``depth`` values as floats, less the last, over the indicator's scale.

    Shorter series have nulls in front. Only the last rows of each key are shuffled.
    """
    keys = keys or ["ticker"]
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    tail = table.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= depth)
    held = tail.groupBy(*keys).agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct(-F.col("__n"), *plan))).alias("rows"))
    return context_cells(held, plan, depth, keys)


def contexts(table: DataFrame, plan: Mapping[str, tuple[str, Mapping[str, object]]], depth: int = 60, keys: list[str] | None = None, block: int = CONTEXT_ROWS) -> DataFrame:
    """(keys, ts, feature, context) for every row of ``table``: the ``depth`` values that end there, as in ``last_contexts``.

    Series are cut into blocks of ``block`` rows with a halo of the ``depth`` - 1 rows before them, so a long key has many tasks; within a block, windows are
    views of one matrix, and each context is written once.
    """
    keys = keys or ["ticker"]
    block = max(block, depth)
    rows = blocks.placed(table.select(*keys, "ts", *plan), keys, "ts", block)
    lent = rows.where(F.col(blocks.PLACE) > (F.col(blocks.BLOCK) + 1) * block - (depth - 1)).withColumn(blocks.BLOCK, F.col(blocks.BLOCK) + 1)
    both = rows.withColumn(blocks.HALO, F.lit(False)).unionByName(lent.withColumn(blocks.HALO, F.lit(True)))
    scales = np.array([float(indicators.scale_of(function)) for function, _ in plan.values()])[None, :, None]
    names = pa.array(list(plan), pa.string())
    schema = StructType([table.schema[c] for c in (*keys, "ts")]).add("feature", "string").add("context", ArrayType(FloatType()))

    def windows(part: pa.Table) -> pa.Table:
        part = part.sort_by(blocks.PLACE)
        own = np.flatnonzero(~part[blocks.HALO].to_numpy())
        n, width = part.num_rows, len(plan)
        values, missing = np.zeros((n + depth - 1, width)), np.ones((n + depth - 1, width), bool)
        for i, c in enumerate(plan):
            cells = part[c].combine_chunks()
            missing[depth - 1 :, i] = cells.is_null().to_numpy(zero_copy_only=False)
            values[depth - 1 :, i] = cells.fill_null(0.0).to_numpy(zero_copy_only=False)
        view, gaps = (sliding_window_view(x, depth, axis=0)[own] for x in (values, missing))
        with np.errstate(all="ignore"):
            context = ((view - view[:, :, -1:]) / scales).astype(np.float32)
        flat = pa.array(context.ravel(), pa.float32(), mask=(gaps | gaps[:, :, -1:]).ravel())
        count = len(own) * width
        kept = part.select([*keys, "ts"]).take(pa.array(np.repeat(own, width)))
        feature = names.take(pa.array(np.tile(np.arange(width), len(own))))
        return kept.append_column("feature", feature).append_column("context", pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * depth, pa.int32()), flat))

    return both.groupBy(*keys, blocks.BLOCK).applyInArrow(windows, schema)


def context_cells(held: DataFrame, plan: Mapping[str, tuple[str, Mapping[str, object]]], depth: int, keys: list[str]) -> DataFrame:
    """A row per feature from rows (at most ``depth`` structs of the columns of ``plan``, in order)."""
    cells = []
    for c, (function, _) in plan.items():
        values = F.col(f"rows.`{c}`")
        padded = F.concat(F.array_repeat(F.lit(None).cast("double"), F.lit(depth) - F.size("rows")), values)
        cells.append(F.struct(F.lit(c).alias("feature"), normalised(padded, F.element_at(values, -1), indicators.scale_of(function)).cast("array<float>").alias("context")))
    return held.select(*keys, "ts", F.explode(F.array(*cells)).alias("cell")).select(*keys, "ts", "cell.feature", "cell.context")


def context_matrix(contexts: DataFrame) -> DataFrame:
    """(ts, features, matrix): all contexts of a time as one array per feature, ordered by feature."""
    held = contexts.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("feature", "ticker", "context"))).alias("m"))
    return held.select("ts", F.transform("m", lambda x: x["feature"]).alias("features"), F.transform("m", lambda x: x["context"]).alias("matrix"))


def frames(bars: DataFrame, size: int = 250, every: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Each ``every``-th bar as an anchor with the ``size`` bars that end there: bars with anchor_ts.

    Indicators with the keys ticker and anchor_ts then start anew in each frame, as a buffer of that size does. Each bar is copied to
    the anchors that follow it within ``size`` bars, by its place, so no range join is needed.
    """
    keys = keys or ["ticker"]
    w = Window.partitionBy(*keys).orderBy("ts")
    placed = bars.withColumn("__i", F.row_number().over(w).cast("long"))
    anchors = placed.where(F.col("__i") % every == 0).select(*keys, F.col("__i").alias("__a"), F.col("ts").alias("anchor_ts"))
    first = F.ceil(F.col("__i") / every) * every
    copies = placed.withColumn("__a", F.explode(F.when(first <= F.col("__i") + size - 1, F.sequence(first, F.col("__i") + size - 1, F.lit(every).cast("long")))))
    return join_same(copies, anchors, [*keys, "__a"]).drop("__i", "__a")


def frame_values(bars: DataFrame, wanted: Mapping[str, tuple[str, Mapping[str, object]]], size: int = 250, keys: list[str] | None = None) -> DataFrame:
    """``bars`` with a column for each of ``wanted``: its value on the ``size`` bars that end at each bar (fewer at the start of a series), started anew there.

    Windows, differences and sums within a frame and exponential weightings of them come from one run per block of bars (``plans.frames``); only
    series that aren't linear in their past (such as ADX or the parabolic stop) are computed on copies of the bars, as ``frames`` makes them.
    """
    keys = keys or ["ticker"]
    g = Graph()
    nodes = {name: indicators.build(g, function, params) for name, (function, params) in wanted.items()}
    bars = without_nan(bars, indicators.PRICES_AND_VOLUME)
    out, rest = frame_series(bars, nodes, g, size, keys)
    if rest:
        copies = indicators.series(frames(bars, size, keys=keys), {name: wanted[name] for name in rest}, [*keys, "anchor_ts"])
        out = join_same(out, copies.where("ts = anchor_ts").select(*keys, "ts", *rest), [*keys, "ts"])
    finished = {name: F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double")) for name in wanted}
    return out.withColumns(finished).select(*[c for c in bars.columns if c not in wanted], *wanted)


def quality_report(long: DataFrame) -> DataFrame:
    """Per feature: rows, values, mean, population deviation, and whether there is no value at all."""
    return long.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), (F.count("value") == 0).alias("all_null"),
    )


def standard_specs(parameters: Callable[[str], Mapping[str, object]], count: int = 110, periods: tuple[int, ...] = (20, 40, 80)) -> list[tuple[str, dict[str, object]]]:
    """The first ``count`` of a grid: each indicator with its ``parameters``, then those that a period changes with each of ``periods``."""
    g = Graph()
    built = lambda n, period: indicators.build(g, n, {**parameters(n), "time_period": period})
    moved = [n for n in indicators.INDICATORS if built(n, 7) != built(n, 8)]
    grid = [(n, dict(parameters(n))) for n in indicators.INDICATORS] + [(n, {**parameters(n), "time_period": p}) for p in periods for n in moved]
    return grid[:count]


def aligned(table: DataFrame, tickers: list[str], columns: list[str]) -> DataFrame:
    """One row per time with a column per ticker and feature (``<ticker>_<column>``), null where a ticker has no row then.

    An outer join of all tickers by time, as one aggregation; ``tickers`` are named by the caller, as they become columns.
    """
    cells = [F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{t}_{c}") for t in tickers for c in columns]
    return table.where(F.col("ticker").isin(tickers)).groupBy("ts").agg(*cells)
