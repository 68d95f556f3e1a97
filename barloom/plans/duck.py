"""The same series as DuckDB SQL, for checking results in another engine: scans become recursive queries."""

from __future__ import annotations

from .graph import Node, order_levels


def window(node: Node, keys: str, order: str) -> str:
    part = f"PARTITION BY {keys} ORDER BY {order}"
    x = node.deps[0].name if node.deps else ""
    n = node.params[0] if node.params else None
    rows = f"ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW"
    if node.what == "lag":
        return f"lag({x}, {n}) OVER ({part})"
    if node.what == "row_number":
        return f"row_number() OVER ({part})"
    if node.what == "ffill":
        return f"last_value({x} IGNORE NULLS) OVER ({part} {rows})"
    if node.what == "first_valid":
        return f"first_value({x} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if node.what.startswith("age_"):
        rn, kind = node.deps[1].name, node.what[4:]
        best = f"max({{'v': {x}, 'r': -{rn}}})" if kind == "max" else f"min({{'v': {x}, 'r': {rn}}})"
        return f"({rn} - {'-' if kind == 'max' else ''}(({best} OVER ({part} {rows})).r))"
    return f"{node.what}({x}) OVER ({part} {rows})"


def scan(node: Node, name: str, source: str, key: str) -> list[str]:
    """CTEs that end in one called ``name``: ``source`` with the node's column."""
    p, x = dict(node.params), [d.name for d in node.deps]
    loop, out = f"{name}_r", node.name
    if node.what == "ewm":
        a = repr(p["alpha"])
        left = f"pow(1 - {a}, r.gap + 1)"
        first = f"SELECT {key} AS k, rn__ AS i, {x[0]} AS y, 0::BIGINT AS gap FROM {source} WHERE rn__ = 1"
        step = (
            f"SELECT r.k, s.rn__, CASE WHEN s.{x[0]} IS NULL THEN r.y WHEN r.y IS NULL THEN s.{x[0]} ELSE ({left} * r.y + {a} * s.{x[0]}) / ({left} + {a}) END, "
            f"CASE WHEN s.{x[0]} IS NULL THEN r.gap + 1 ELSE 0 END FROM {loop} r JOIN {source} s ON s.{key} = r.k AND s.rn__ = r.i + 1"
        )
        return [f"{loop} AS ({first} UNION ALL {step})", f"{name} AS MATERIALIZED (SELECT s.*, r.y AS {out} FROM {source} s JOIN {loop} r ON s.{key} = r.k AND s.rn__ = r.i)"]
    if node.what == "sar":
        h, low, c = x
        stop = "r.y + r.af * (r.ep - r.y)"
        first = (
            f"SELECT {key} AS k, rn__ AS i, up, CASE WHEN up THEN {low} ELSE {h} END AS y, CASE WHEN up THEN {h} ELSE {low} END AS ep, {p['step']!r}::DOUBLE AS af, "
            f"{h} AS h1, {low} AS l1, NULL::DOUBLE AS h2, NULL::DOUBLE AS l2 FROM (SELECT *, lead({c}) OVER (PARTITION BY {key} ORDER BY rn__) >= {c} AS up FROM {source}) WHERE rn__ = 1 AND up IS NOT NULL"
        )
        held = f"CASE WHEN r.up THEN least({stop}, r.l1, r.l2) ELSE greatest({stop}, r.h1, r.h2) END"
        moved = f"SELECT r.*, s.rn__ AS j, s.{h} AS h, s.{low} AS l, {held} AS stop FROM {loop} r JOIN {source} s ON s.{key} = r.k AND s.rn__ = r.i + 1"
        turn = "CASE WHEN j = 2 THEN false WHEN up THEN l < stop ELSE h > stop END"
        step = (
            f"SELECT k, j, CASE WHEN turn THEN NOT up ELSE up END, CASE WHEN j = 2 THEN y WHEN turn THEN ep ELSE stop END, "
            f"CASE WHEN j = 2 THEN ep WHEN turn THEN CASE WHEN up THEN l ELSE h END WHEN up THEN greatest(ep, h) ELSE least(ep, l) END, "
            f"CASE WHEN j = 2 THEN af WHEN turn THEN {p['step']!r} WHEN (up AND h > ep) OR (NOT up AND l < ep) THEN least(af + {p['step']!r}, {p['limit']!r}) ELSE af END, "
            f"h, l, h1, l1 FROM (SELECT *, {turn} AS turn FROM ({moved}))"
        )
        return [f"{loop} AS ({first} UNION ALL {step})", f"{name} AS MATERIALIZED (SELECT s.*, r.y AS {out} FROM {source} s LEFT JOIN {loop} r ON s.{key} = r.k AND s.rn__ = r.i)"]
    assert node.what == "quadrature", node.what
    m, angle = "(((a.rn__ - b.rn__) % n + n) % n)", "pi() * (((a.rn__ - b.rn__) % n + n) % n) / n"
    even = f"CASE WHEN {m} % 2 = 1 THEN 2.0 / n / tan({angle}) ELSE 0 END"
    odd = f"CASE WHEN {m} = 0 THEN 0 ELSE (1 / tan({angle}) - cos(pi() * {m}) / sin({angle})) / n END"
    n = f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {source})"
    q = f"SELECT a.{key} AS k, a.rn__ AS i, sum(b.{x[0]} * CASE WHEN n % 2 = 0 THEN {even} ELSE {odd} END) AS y FROM {n} a JOIN (SELECT {key}, rn__, {x[0]} FROM {source}) b USING ({key}) GROUP BY ALL"
    return [f"{loop} AS ({q})", f"{name} AS MATERIALIZED (SELECT s.*, r.y AS {out} FROM {source} s JOIN {loop} r ON s.{key} = r.k AND s.rn__ = r.i)"]


def sql(base: str, outputs: dict[str, Node], digits: int = 6, key: str = "ticker", order: str = "ts") -> str:
    """Key, order and the rounded outputs over the bars that ``base`` selects."""
    nodes, level = order_levels(list(outputs.values()))
    ctes = [f"g0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn__ FROM ({base}))"]
    last = "g0"

    def add(select: str) -> None:
        nonlocal last
        name = f"g{len(ctes)}"
        ctes.append(f"{name} AS MATERIALIZED ({select})")
        last = name

    for depth in range(max(level.values(), default=0) + 1):
        here = [n for n in nodes if level[n] == depth]
        for n in here:
            if n.kind == "scan":
                name = f"g{len(ctes)}"
                ctes.extend(scan(n, name, last, key))
                last = name
        windows = [n for n in here if n.kind == "win"]
        if windows:
            add(f"SELECT *, {', '.join(f'{window(n, key, order)} AS {n.name}' for n in windows)} FROM {last}")
        for n in here:
            if n.kind == "expr":
                ctes.append(f"g{len(ctes)} AS (SELECT *, {n.what.format(*[d.name for d in n.deps])} AS {n.name} FROM {last})")
                last = f"g{len(ctes) - 1}"
    value = lambda n: f"CASE WHEN NOT isnan({n}::DOUBLE) THEN CASE WHEN isinf({n}::DOUBLE) THEN {n}::DOUBLE ELSE round({n}::DOUBLE, {digits}) + 0.0 END END"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {key}, {order}, {', '.join(f'{value(n.name)} AS {name}' for name, n in outputs.items())} FROM {last}"
