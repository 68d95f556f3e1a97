"""Series as a graph of shared nodes, and the Spark plan that computes all of them together.

A node is written once however many series use it, so a set of indicators becomes a few window levels over one
partitioning. Nodes that need state from row to row (scans) of one level run in one grouped pandas pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from .wide import is_wide, with_wide


@dataclass(frozen=True)
class Node:
    kind: str  # col, expr, win or scan
    what: str
    deps: tuple["Node", ...] = ()
    params: tuple = ()
    name: str = field(default="", compare=False)


AGGREGATES = {"avg", "sum", "max", "min", "stddev_samp", "count"}


class Graph:
    """Makes nodes; equal nodes are one."""

    def __init__(self):
        self.nodes: dict[Node, Node] = {}

    def _add(self, node: Node) -> Node:
        if node not in self.nodes:
            name = node.what if node.kind == "col" else f"n{len(self.nodes)}"
            self.nodes[node] = Node(node.kind, node.what, node.deps, node.params, name)
        return self.nodes[node]

    def col(self, name: str) -> Node:
        return self._add(Node("col", name))

    def expr(self, template: str, *deps: Node) -> Node:
        """A SQL expression of other nodes, {0}, {1}, ... being their places."""
        return self._add(Node("expr", template, deps))

    def lag(self, x: Node, n: int = 1) -> Node:
        return self._add(Node("win", "lag", (x,), (n,)))

    def over(self, what: str, x: Node, n: int | None = None) -> Node:
        """An aggregate over the last n rows, or over all rows so far."""
        return self._add(Node("win", what, (x,), (n,)))

    def row_number(self) -> Node:
        return self._add(Node("win", "row_number"))

    def ffill(self, x: Node) -> Node:
        return self._add(Node("win", "ffill", (x,)))

    def first_valid(self, x: Node) -> Node:
        """The first value of the whole series that isn't null."""
        return self._add(Node("win", "first_valid", (x,)))

    def age_of_extreme(self, what: str, x: Node, n: int) -> Node:
        """Rows since the max or min of the last n rows, the oldest of equals."""
        return self._add(Node("win", f"age_{what}", (x, self.row_number()), (n,)))

    def scan(self, what: str, *deps: Node, **params) -> Node:
        return self._add(Node("scan", what, deps, tuple(sorted(params.items()))))


def order_levels(outputs: list[Node]) -> tuple[list[Node], dict[Node, int]]:
    """All nodes below ``outputs``, dependencies first, and the level at which each can be computed."""
    seen: dict[Node, int] = {}
    order: list[Node] = []
    for top in outputs:
        stack = [(top, False)]
        while stack:
            node, ready = stack.pop()
            if node in seen:
                continue
            if not ready:
                stack.append((node, True))
                stack += [(d, False) for d in node.deps if d not in seen]
                continue
            levels = [seen[d] for d in node.deps] or [0]
            if node.kind in ("col", "expr"):
                seen[node] = max(levels)
            elif node.kind == "win":
                seen[node] = max(levels) + 1
            else:  # a scan may feed another of its level
                seen[node] = max([1] + [seen[d] + (d.kind != "scan") for d in node.deps])
            order.append(node)
    return order, seen


def window_sql(node: Node, keys: list[str], order: str) -> str:
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{order}`"
    x = f"`{node.deps[0].name}`" if node.deps else ""
    n = node.params[0] if node.params else None
    rows = f"ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW"
    if node.what == "lag":
        return f"lag({x}, {n}) OVER ({part})"
    if node.what == "row_number":
        return f"row_number() OVER ({part})"
    if node.what == "ffill":
        return f"last({x}, true) OVER ({part} {rows})"
    if node.what == "first_valid":
        return f"first({x}, true) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if node.what in ("age_max", "age_min"):
        rn = f"`{node.deps[1].name}`"
        best = f"max(struct({x} AS v, -{rn} AS r))" if node.what == "age_max" else f"min(struct({x} AS v, {rn} AS r))"
        sign = "-" if node.what == "age_max" else ""
        return f"({rn} - {sign}({best} OVER ({part} {rows})).r)"
    assert node.what in AGGREGATES, node.what
    return f"{node.what}({x}) OVER ({part} {rows})"


def in_doubles(template: str) -> str:
    """``template`` with its fractions as doubles: Spark takes them as decimals, and cuts digits off their products with whole numbers."""
    return re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", r"\g<0>D", template)


def with_expressions(df: DataFrame, nodes: list[Node]) -> DataFrame:
    """Adds expressions, those of one depth in one projection, so that plans of many nodes stay flat."""
    waiting = list(nodes)
    while waiting:
        names = {n.name for n in waiting}
        ready = [n for n in waiting if not any(d.name in names for d in n.deps)]
        df = df.withColumns({n.name: F.expr(in_doubles(n.what).format(*[f"`{d.name}`" for d in n.deps])) for n in ready})
        waiting = [n for n in waiting if n not in ready]
    return df


def compute(df: DataFrame, outputs: dict[str, Node], keys: list[str], order: str = "ts") -> DataFrame:
    """``df`` with a column for each output.

    Each level adds its window columns in one projection (Spark shares one exchange and sort among windows of one partitioning)
    after one grouped pass for its scans. Columns that later levels don't read are dropped before a pass, so that Arrow
    carries what is needed only.
    """
    own = df.columns
    nodes, level = order_levels(list(outputs.values()))
    wanted = {n.name for n in outputs.values()}
    last = max(level.values(), default=0)
    for depth in range(last + 1):
        here = [n for n in nodes if level[n] == depth]
        later = {d.name for n in nodes if level[n] >= depth for d in n.deps} | wanted
        live = [c for c in df.columns if c in own or c in later]
        scanned = [n for n in here if n.kind == "scan"]
        if scanned:
            df = scans.run(df.select(*live), scanned, keys, order)
        windows = [n for n in here if n.kind == "win" and not is_wide(n)]
        if windows:
            df = df.select("*", *[F.expr(window_sql(n, keys, order)).alias(n.name) for n in windows])
        if wide := [n for n in here if is_wide(n)]:
            df = with_wide(df, wide, keys, order)
        df = with_expressions(df, [n for n in here if n.kind == "expr"])
    return df.select(*[F.col(f"`{c}`") for c in own if c.lower() not in {o.lower() for o in outputs}], *[F.col(f"`{n.name}`").alias(name) for name, n in outputs.items()])
