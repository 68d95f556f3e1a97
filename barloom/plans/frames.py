"""Series that start anew in the frame of bars that ends at each bar, without a copy of a bar for each frame it is in.

Two runs of one exponential weighting over the same values differ by what is left of their first difference. So one run along a block of bars, from
the frames' farthest bar on, gives all frames: each takes the run's value less its difference at the frame's start, carried on to the frame's end.
Runs on runs (double, triple averages, signal lines) carry a vector of differences by small matrices, which are composed by doubling.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.scans import ewm
from .blocks import BLOCK, HALO, PLACE, placed
from .graph import Graph, Node, compute

BLOCK_ROWS = 4096
DIFFERENCE = "{0} - {1}"


@dataclass(frozen=True)
class Run:
    """An exponential weighting: of the base series (inputs None), or of earlier runs, each with a factor."""

    alpha: float
    inputs: tuple[tuple[int, float], ...] | None


def reach(node: Node) -> int | None:
    """Rows before its own that a node reads; None where it depends on all rows of its frame."""
    below = [reach(d) for d in node.deps]
    if node.kind == "scan" or None in below:
        return None
    own = 0
    if node.kind == "win" and node.what != "row_number":
        n = node.params[0] if node.params else None
        if n is None:
            return None
        own = n if node.what == "lag" else n - 1
    return max(below, default=0) + own


def at_start(g: Graph, node: Node) -> Node | None:
    """What a node that reads one row back at most gives on a frame's first row; None if it isn't of that kind."""
    if node.kind == "col" or node.what == "row_number":
        return node
    if node.kind == "expr":
        deps = [at_start(g, d) for d in node.deps]
        return None if None in deps else g.expr(node.what, *deps)
    return g.expr("CAST(NULL AS DOUBLE)") if node.kind == "win" and node.what == "lag" and reach(node) == 1 else None


def runs_below(node: Node) -> dict[Node, float] | None:
    """A node as a sum of exponential weightings with factors, if it is one: a weighting or a difference of such."""
    if node.kind == "scan" and node.what == "ewm":
        return {node: 1.0}
    if node.kind == "expr" and node.what == DIFFERENCE:
        a, b = runs_below(node.deps[0]), runs_below(node.deps[1])
        return None if a is None or b is None else {n: a.get(n, 0.0) - b.get(n, 0.0) for n in {**a, **b}}
    return None


def cascade(g: Graph, top: Node) -> tuple[Node, Node, list[Node], list[Run]] | None:
    """(base series, its value on a first row, weightings, runs) of an exponential weighting; None where it isn't linear in one base series."""
    nodes: list[Node] = []
    runs: list[Run] = []
    bases: list[Node] = []

    def add(node: Node) -> int | None:
        if node in nodes:
            return nodes.index(node)
        source, alpha = node.deps[0], dict(node.params)["alpha"]
        below, inputs = runs_below(source), None
        if below is None:
            bases.append(source)
        else:
            places = [(add(n), factor) for n, factor in below.items()]
            if any(p is None for p, _ in places):
                return None
            inputs = tuple(places)
        nodes.append(node)
        runs.append(Run(alpha, inputs))
        return len(nodes) - 1

    if add(top) is None or len(set(bases)) != 1 or reach(bases[0]) not in (0, 1):
        return None
    start = at_start(g, bases[0])
    return None if start is None else (bases[0], start, nodes, runs)


def framed(g: Graph, node: Node, size: int, found: dict[Node, Node]) -> Node | None:
    """The node that gives, on the bars themselves, the value of ``node`` at the end of each bar's frame; None if there is none.

    ``found`` gets a column for each exponential weighting.
    """
    r = reach(node)
    if r is not None:
        return node if r < size else None
    if node.kind == "scan":
        if node.what == "ewm" and cascade(g, node):
            return found.setdefault(node, g.col(f"__frame{len(found)}"))
        return None
    if node.kind == "win":
        x = node.deps[0]
        if node.what not in ("sum", "count") or reach(x) not in (0, 1) or at_start(g, x) is None or size < 2:
            return None
        inside, first = g.over(node.what, x, size - 1), g.lag(at_start(g, x), size - 1)
        return g.expr("{0} + CASE WHEN {1} IS NULL THEN 0 ELSE 1 END" if node.what == "count" else "coalesce({0} + {1}, {0}, {1})", inside, first)
    deps = [framed(g, d, size, found) for d in node.deps]
    return None if None in deps else g.expr(node.what, *deps)


def one_frame(x: np.ndarray, first: float, runs: list[Run]) -> list[float]:
    """The runs' values at the end of one frame, plainly."""
    base = pd.Series(np.concatenate([[first], x[1:]]))
    made: list[pd.Series] = []
    for r in runs:
        made.append(ewm(base if r.inputs is None else sum(made[i] * f for i, f in r.inputs), r.alpha))
    return [float(m.iloc[-1]) for m in made]


def frame_ends(x: np.ndarray, first: np.ndarray, runs: list[Run], size: int, place: np.ndarray) -> np.ndarray:
    """(rows, runs): the runs' values at the end of the frame of ``size`` rows that ends at each row.

    x: the base series; first: what it is on a frame's first row; place: the rows' numbers in their key, from 1 on. Rows whose frame begins before
    the first one given get values of no meaning.
    """
    x, first = (np.where(np.isfinite(v), v, np.nan) for v in (x, first))  # as the weighting takes infinities
    n, m = len(x), len(runs)
    at = np.arange(n)
    begin = np.where(place < size, at - (place - 1), at - size + 1).clip(0)
    series = [None] * m
    for i, r in enumerate(runs):
        series[i] = ewm(pd.Series(x) if r.inputs is None else sum(series[j] * f for j, f in r.inputs), r.alpha)
    along = np.stack([s.to_numpy() for s in series], axis=1)

    valid = ~np.isnan(x)
    ahead = np.minimum.accumulate(np.where(valid, at, n)[::-1])[::-1]  # the next row with a value
    onward = np.append(ahead[1:], n)
    start = np.where(~np.isnan(first[begin]), begin, onward[begin])  # where the frame's first value stands
    seen = start <= at
    start = np.where(seen, start, at)
    value = np.where(start == begin, first[begin], x[start])

    # the difference of the run along the block from the frame's own at its start, where every run of a frame has its input's value
    own = np.zeros((n, m))
    for i, r in enumerate(runs):
        own[:, i] = value if r.inputs is None else sum(own[:, j] * f for j, f in r.inputs)
    apart = along[start] - own

    before = np.maximum.accumulate(np.where(valid, at, -1))
    before = np.concatenate([[-1], before[:-1]])
    gap = np.where(before >= 0, at - before, 1)
    step = np.zeros((n, m, m))
    for i, r in enumerate(runs):
        if r.inputs is None:
            left = (1 - r.alpha) ** gap
            step[:, i, i] = np.where(valid, left / (left + r.alpha), 1.0)
        else:
            for j, f in r.inputs:
                step[:, i, :] += r.alpha * f * step[:, j, :]
            step[:, i, i] += 1 - r.alpha
    reached, distance, length = start.copy(), at - start, 1
    while length < size:
        moved = np.flatnonzero(distance & length)
        reached[moved] += length
        apart[moved] = np.einsum("nij,nj->ni", step[reached[moved]], apart[moved])
        step[length:] = step[length:] @ step[:-length]
        length *= 2
    out = np.where(seen[:, None], along - apart, np.nan)
    # a frame's first row may have a value that the series lacks there, so that gaps differ: such frames are run plainly
    for t in np.flatnonzero((valid < ~np.isnan(first))[begin] & seen):
        out[t] = one_frame(x[begin[t] : t + 1], first[begin[t]], runs)
    return out


def frame_series(bars: DataFrame, outputs: Mapping[str, Node], g: Graph, size: int, keys: list[str], order: str = "ts", block: int = BLOCK_ROWS) -> tuple[DataFrame, list[str]]:
    """(``bars`` with a column for each output that can be had without copies, the names of the others).

    A bar's values are those of the bars that end there, ``size`` at most. Series are cut into blocks of ``block`` rows, each with a halo of the rows before,
    so that a long key has many tasks.
    """
    found: dict[Node, Node] = {}
    made = {name: framed(g, node, size, found) for name, node in outputs.items()}
    direct = {name: node for name, node in made.items() if node is not None}
    block = max(block, size)
    tasks, inputs, held = [], {}, {}
    systems = sorted(((top, cascade(g, top)) for top in found), key=lambda s: -len(s[1][2]))
    for top, (base, start, nodes, runs) in systems:
        if top in held:
            continue
        names = tuple(inputs.setdefault(n, f"__in{len(inputs)}") for n in (base, start))
        shown = [(i, found[n].name) for i, n in enumerate(nodes) if n in found and n not in held]
        held |= {n: True for n in nodes}
        tasks.append((*names, runs, shown))
    if tasks:
        cut = placed(bars, keys, order, block)
        ready = compute(cut, {name: node for node, name in inputs.items()}, keys, PLACE)
        lent = ready.where(F.col(PLACE) > (F.col(BLOCK) + 1) * block - (size - 1)).withColumn(BLOCK, F.col(BLOCK) + 1).withColumn(HALO, F.lit(True))
        both = ready.withColumn(HALO, F.lit(False)).unionByName(lent)
        fields = [f for f in ready.schema.fields if f.name not in inputs.values()]
        schema = StructType(fields + [StructField(name, DoubleType()) for *_, shown in tasks for _, name in shown])
        columns = [f.name for f in schema.fields]

        def ends(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(PLACE).reset_index(drop=True)
            place = rows[PLACE].to_numpy()
            if rows[HALO].all():
                return rows[~rows[HALO]].reindex(columns=columns)
            for x, first, runs, shown in tasks:
                values = frame_ends(rows[x].astype(float).to_numpy(), rows[first].astype(float).to_numpy(), runs, size, place)
                for i, name in shown:
                    rows[name] = values[:, i]
            return rows[~rows[HALO]][columns]

        bars = both.groupBy(*keys, BLOCK).applyInPandas(ends, schema).drop(PLACE, BLOCK)
    temporary = [n.name for n in found.values()]
    out = compute(bars, direct, keys, order)
    return out.drop(*temporary), [name for name in outputs if name not in direct]
