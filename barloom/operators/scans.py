"""Operators with state from row to row: exponential weights, parabolic stop-and-reverse, Hilbert quadrature.

Each runs over the ordered rows of a key in one grouped pandas pass. ``ewm_blocks`` and ``stop_blocks`` are the forms for few, very long keys:
they compute blocks of rows apart, the one passing states along one row per block, the other guessing them until all are right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.scratch import join_same, written


def ewm(x: pd.Series, alpha: float) -> pd.Series:
    """y0 = x0, then y = (w y + a x) / (w + a) with w = (1 - a) ** (rows since the last value); nulls repeat y, leading ones stay."""
    return x.ewm(alpha=alpha, adjust=False, ignore_na=False).mean()


def quadrature(x: np.ndarray) -> np.ndarray:
    """Imaginary part of the analytic signal of a whole frame: each frequency turned by a quarter, without the constant and the alternating part."""
    n = len(x)
    if n == 0 or np.isnan(x).any():
        return np.full(n, np.nan)
    turned = -1j * np.fft.rfft(x)
    turned[0] = 0
    if n % 2 == 0:
        turned[-1] = 0
    return np.fft.irfft(turned, n)


class Stop:
    """A stop that closes in on the trend's extreme and changes sides when a bar crosses it; the first two bars share the first stop."""

    def __init__(self, step: float, limit: float, rising: bool):
        # a falling market is a rising one upside down: `up` is 1 or -1, and prices are seen times `up`
        self.step, self.limit, self.up, self.bars = step, limit, 1.0 if rising else -1.0, 0
        self.before: tuple[tuple[float, float], ...] = ()  # high and low of the last two bars, the latest first

    def advance(self, high: float, low: float) -> float:
        near, far = (low, high) if self.up > 0 else (high, low)  # the side of the stop, and of the extreme
        if self.bars == 0:
            self.stop, self.extreme, self.pace = near, far, self.step
        elif self.bars > 1:
            up, side = self.up, 1 if self.up > 0 else 0
            self.stop = up * min(up * (self.stop + self.pace * (self.extreme - self.stop)), *(up * b[side] for b in self.before))
            if up * near < up * self.stop:
                self.stop, self.extreme, self.pace, self.up = self.extreme, near, self.step, -up
            elif up * far > up * self.extreme:
                self.extreme, self.pace = far, min(self.pace + self.step, self.limit)
        self.bars += 1
        self.before = ((high, low), *self.before[:1])
        return self.stop

    def state(self) -> tuple[float, ...]:
        """What the bars to come depend on, the last two bars aside; of the number of bars, whether there are more than one."""
        return self.stop, self.extreme, self.pace, self.up, float(min(self.bars, 2))

    def saved(self) -> list[float]:
        """``STATE`` as numbers."""
        return [*self.state(), *(v for bar in (*self.before, (np.nan, np.nan))[:2] for v in bar)]

    @classmethod
    def restored(cls, step: float, limit: float, saved: list[float]) -> Stop:
        made = cls(step, limit, saved[3] > 0)
        made.stop, made.extreme, made.pace, made.bars = *saved[:3], int(saved[4])
        made.before = tuple(bar for bar in zip(saved[5::2], saved[6::2], strict=True) if not np.isnan(bar[0]))
        return made


def stop_and_reverse(high: np.ndarray, low: np.ndarray, close: np.ndarray, step: float, limit: float) -> np.ndarray:
    """The stop of a whole series. Series are filled, so they are null throughout or not at all; one bar alone has none."""
    n = len(close)
    if n < 2 or np.isnan(high).any() or np.isnan(low).any() or np.isnan(close).any():
        return np.full(n, np.nan)
    stop = Stop(step, limit, close[1] >= close[0])
    return np.array([stop.advance(h, x) for h, x in zip(high.tolist(), low.tolist(), strict=True)])


def key_runs(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """The number of each row's key among those that follow each other in sorted rows."""
    codes = np.stack([pd.factorize(rows[k], use_na_sentinel=False)[0] for k in keys])
    return np.concatenate([[0], np.cumsum((codes[:, 1:] != codes[:, :-1]).any(axis=0))])


def run(df: DataFrame, nodes: list, keys: list[str], order: str) -> DataFrame:
    """``df`` with a double column per scan node; nodes are in an order in which each comes after those it reads.

    Sorted rows pass by in batches, and all keys that a batch holds whole are computed together, so that many short keys cost little; a key that goes
    on is held until its end.
    """
    plan = [(n.name, n.what, [d.name for d in n.deps], dict(n.params)) for n in nodes]
    schema = StructType(df.schema.fields + [StructField(name, DoubleType()) for name, *_ in plan])

    def computed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        key = key_runs(rows, keys)
        bounds = [*np.flatnonzero(np.diff(key, prepend=-1)), len(rows)]
        made: dict[str, pd.Series] = {}
        for name, what, deps, params in plan:
            series = [made[d] if d in made else rows[d].astype(float) for d in deps]
            if what == "ewm":
                values = ewm(series[0], params["alpha"]).to_numpy() if len(bounds) == 2 else series[0].groupby(key).ewm(alpha=params["alpha"], adjust=False, ignore_na=False).mean().to_numpy()
            elif what in ("sar", "quadrature"):
                columns = [x.to_numpy() for x in series]
                each = [stop_and_reverse(*[c[i:j] for c in columns], params["step"], params["limit"]) if what == "sar" else quadrature(columns[0][i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]
                values = np.concatenate(each)
            else:
                raise ValueError(what)
            made[name] = pd.Series(values)
        return pd.concat([rows, pd.DataFrame(made)], axis=1)

    def run_along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            key = key_runs(rows, keys)
            if key[-1]:
                split = int(np.searchsorted(key, key[-1]))
                yield computed([*held, rows.iloc[:split]])
                held = [rows.iloc[split:]]
            elif held and key_runs(pd.concat([held[-1].iloc[-1:], rows.iloc[:1]]), keys)[-1]:
                yield computed(held)
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield computed(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run_along, schema)


def ewm_chunked(df: DataFrame, source: str, alpha: float, out: str, keys: list[str], order: str = "ts", *, chunk: Column) -> DataFrame:
    """``df`` with the exponentially weighted mean of ``source`` as ``out``; equal to the plain scan, but no task holds more than a chunk.

    ``chunk`` is a number that ascends with ``order``, such as the month of a bar.
    """
    return ewm_blocks(df.withColumn("__chunk", chunk.cast("long")), [(out, source, alpha)], keys, order, "__chunk").drop("__chunk")


def ewm_blocks(df: DataFrame, nodes: list[tuple[str, str, float]], keys: list[str], order: str, block: str) -> DataFrame:
    """``df`` with the exponentially weighted mean of each (name, source, alpha), for blocks (a column that ascends with ``order``) apart.

    First pass: each block's mean as a line over the state it starts with, y = a * y_in + b. The lines of a key compose in order, one
    row per block. Second pass: each block again, from its true start.
    """
    key_fields = [f for f in df.schema.fields if f.name in keys or f.name == block]
    line_schema = StructType(list(key_fields)).add("rows", "long")
    for i in range(len(nodes)):
        for part, kind in (("a", "double"), ("b", "double"), ("first", "double"), ("lead", "long"), ("last", "long")):
            line_schema = line_schema.add(f"{part}{i}", kind)

    def line(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        made = {f.name: [rows[f.name].iloc[0]] for f in key_fields} | {"rows": [len(rows)]}
        for i, (_, source, alpha) in enumerate(nodes):
            x = rows[source].astype(float)
            seen = np.flatnonzero(x.notna().to_numpy())
            if not len(seen):
                made |= {f"a{i}": [1.0], f"b{i}": [0.0], f"first{i}": [0.0], f"lead{i}": [-1], f"last{i}": [-1]}
                continue
            # from the first value on the block is known but for the state before it: weight it with what is left of a unit state
            body = x.iloc[seen[0] :].reset_index(drop=True)
            unit = pd.Series(np.where(body.notna(), 0.0, np.nan))
            unit.iloc[0] = 1.0
            made |= {f"a{i}": [float(ewm(unit, alpha).iloc[-1])], f"b{i}": [float(ewm(body, alpha).iloc[-1])], f"first{i}": [float(body.iloc[0])], f"lead{i}": [int(seen[0])], f"last{i}": [int(seen[-1])]}
        return pd.DataFrame(made)

    state_schema = StructType(list(key_fields))
    for i in range(len(nodes)):
        state_schema = state_schema.add(f"__y{i}", "double").add(f"__gap{i}", "long")

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per block of a key: the state each starts with, and the rows since its last value."""
        rows = rows.sort_values(block).reset_index(drop=True)
        out = rows[[f.name for f in key_fields]].copy()
        for i, (_, _, alpha) in enumerate(nodes):
            y, gap, states = np.nan, 0, []
            for n, a, b, first, lead, last in zip(*[rows[c] for c in ("rows", f"a{i}", f"b{i}", f"first{i}", f"lead{i}", f"last{i}")], strict=True):
                states.append((y, gap))
                if lead < 0:
                    gap += n
                    continue
                if np.isnan(y):
                    y = b
                else:
                    # the first value is b's own start; blending it with y moves the end by a * (start - first)
                    weight = (1 - alpha) ** (gap + lead + 1)
                    y = b + a * (weight * (y - first) / (weight + alpha))
                gap = n - 1 - last
            out[f"__y{i}"], out[f"__gap{i}"] = [s[0] for s in states], [s[1] for s in states]
        return out

    at = [*keys, block]
    lines = df.select(*dict.fromkeys([*at, order, *[source for _, source, _ in nodes]])).groupBy(*at).applyInPandas(line, line_schema)
    states = lines.groupBy(*keys).applyInPandas(carry, state_schema)
    schema = StructType(df.schema.fields + [StructField(name, DoubleType()) for name, _, _ in nodes])
    columns = [f.name for f in schema.fields]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        for i, (name, source, alpha) in enumerate(nodes):
            x, y, gap = rows[source].astype(float), rows[f"__y{i}"].iloc[0], int(rows[f"__gap{i}"].iloc[0])
            if pd.isna(y):
                rows[name] = ewm(x, alpha)
            else:
                seed = pd.Series([y] + [np.nan] * gap)
                rows[name] = ewm(pd.concat([seed, x], ignore_index=True), alpha).iloc[gap + 1 :].to_numpy()
        return rows[columns]

    return join_same(df, states, at).groupBy(*at).applyInPandas(finish, schema)


STATE = ("stop", "extreme", "pace", "up", "bars", "high1", "low1", "high2", "low2")
ROUNDS = 8
"""Rounds of guesses; keys that have wrong ones then are gone along, one task a key."""


def stop_from(entry: list[float], high: np.ndarray, low: np.ndarray, close: np.ndarray, step: float, limit: float) -> Stop | None:
    """The stop before a block's first bar: as it was saved, or a new one; None for series of nulls and single bars."""
    if not np.isnan(entry[0]):
        return Stop.restored(step, limit, entry)
    if len(close) < 2 or np.isnan([high[0], low[0], close[0], close[1]]).any():
        return None
    return Stop(step, limit, close[1] >= close[0])


def stop_blocks(df: DataFrame, out: str, deps: list[str], params: dict, keys: list[str], order: str, block: str) -> DataFrame:
    """``df`` with the parabolic stop of (high, low, close) as ``out``, for blocks of at least two rows (a column that ascends with ``order``) apart.

    Each block first runs from a new stop; the state it ends with is the guess for the next. A block runs again from its guess beside its last run,
    as far as the two differ: what differs in the beginning is mostly forgotten after a few reversals. As the first block of a key is
    right, guesses that equal the ends before them all are, so the result is that of the plain scan to the last bit. A key with a state that goes through
    whole blocks unforgotten (such as a pace through a flat market) for more than ROUNDS of them is gone along in order with a few numbers in memory.
    """
    at, step, limit = [*keys, block], params["step"], params["limit"]
    bars = written(df.select(*dict.fromkeys([*at, order, *deps])))
    key_fields = [f for f in df.schema.fields if f.name in at]
    entries, ends = [f"__from_{s}" for s in STATE], [f"__to_{s}" for s in STATE]
    state_schema = StructType(key_fields + [StructField(c, DoubleType()) for c in (*entries, *ends)])

    def prices(rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows[d].astype(float).to_numpy() for d in deps]

    def state_row(rows: pd.DataFrame, entry: list[float], end: list[float]) -> pd.DataFrame:
        return pd.DataFrame({f.name: [rows[f.name].iloc[0]] for f in key_fields} | dict(zip(entries, [[v] for v in entry], strict=True)) | dict(zip(ends, [[v] for v in end], strict=True)))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        high, low, close = prices(rows.sort_values(order, kind="stable"))
        nothing = [np.nan] * len(STATE)
        stop = stop_from(nothing, high, low, close, step, limit)
        if stop is None:
            return state_row(rows, nothing, nothing)
        for h, x in zip(high.tolist(), low.tolist(), strict=True):
            stop.advance(h, x)
        return state_row(rows, nothing, stop.saved())

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        high, low, close = prices(rows)
        last, entry, end = (rows[c].iloc[0].astype(float).tolist() for c in (entries, [f"__new_{s}" for s in STATE], ends))
        stop, beside = (stop_from(e, high, low, close, step, limit) for e in (entry, last))
        if stop is None:
            return state_row(rows, entry, [np.nan] * len(STATE))
        for i, (h, x) in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
            stop.advance(h, x)
            if beside is not None:
                beside.advance(h, x)
                if i > 0 and stop.state() == beside.state():
                    return state_row(rows, entry, end)
        return state_row(rows, entry, stop.saved())

    ahead = Window.partitionBy(*keys).orderBy(block)
    struct = lambda prefix: F.struct(*[F.col(f"{prefix}{s}").alias(s) for s in STATE])

    def guessed(states: DataFrame) -> DataFrame:
        """One row per block, with the end of the block before it as __new_*."""
        new = {f"__new_{s}": F.lag(f"__to_{s}").over(ahead) for s in STATE}
        return states.withColumns(new).withColumn("__wrong", ~struct("__new_").eqNullSafe(struct("__from_")))

    states = written(guessed(bars.groupBy(*at).applyInPandas(first, state_schema)))
    for _ in range(ROUNDS):
        wrong = states.where("__wrong")
        if wrong.isEmpty():
            break
        redone = join_same(bars, wrong.drop("__wrong"), at).groupBy(*at).applyInPandas(again, state_schema)
        states = written(guessed(states.where("NOT __wrong").select(*state_schema.names).unionByName(redone)))
    open_keys = states.where("__wrong").select(*keys).distinct()
    schema = StructType(df.schema.fields + [StructField(out, DoubleType())])
    columns = [f.name for f in schema.fields]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        high, low, close = prices(rows)
        stop = stop_from(rows[entries].iloc[0].astype(float).tolist(), high, low, close, step, limit)
        rows[out] = np.nan if stop is None else [stop.advance(h, x) for h, x in zip(high.tolist(), low.tolist(), strict=True)]
        return rows[columns]

    if open_keys.isEmpty():
        return join_same(df, states.select(*at, *entries), at).groupBy(*at).applyInPandas(finish, schema)
    settled = join_same(states, open_keys, keys, "left_anti").select(*at, *entries)
    apart = join_same(df, settled, at).groupBy(*at).applyInPandas(finish, schema)
    return apart.unionByName(stop_along(join_same(df, open_keys, keys, "left_semi"), out, deps, params, keys, order))


def stop_along(df: DataFrame, out: str, deps: list[str], params: dict, keys: list[str], order: str) -> DataFrame:
    """``df`` with the parabolic stop of (high, low, close) as ``out``: sorted rows pass by in batches, and what is held is the state of one key."""
    ahead = Window.partitionBy(*keys).orderBy(order)
    seen = df.withColumn("__next", F.lead(deps[2]).over(ahead))
    schema = StructType(df.schema.fields + [StructField(out, DoubleType())])
    columns = [f.name for f in schema.fields]

    def run_along(batches):
        state, last = None, None
        for rows in batches:
            if not len(rows):
                continue
            found = np.full(len(rows), np.nan)
            high, low, close, following = (rows[c].astype(float).to_numpy() for c in (*deps, "__next"))
            key = key_runs(rows, keys)
            starts = np.diff(key, prepend=-1) > 0
            starts[0] = last is None or key_runs(pd.concat([last, rows.iloc[:1]]), keys)[-1] > 0
            for i, starting in enumerate(starts.tolist()):
                if starting:
                    state = Stop(params["step"], params["limit"], following[i] >= close[i]) if not np.isnan([high[i], low[i], close[i], following[i]]).any() else None
                if state is not None:
                    found[i] = state.advance(high[i], low[i])
            last = rows.iloc[-1:]
            rows[out] = found
            yield rows[columns]

    return seen.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run_along, schema)
