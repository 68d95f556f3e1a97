"""Windows of many rows at a cost per row that doesn't grow with their length.

Spark folds a bounded frame anew for each row. Here rows are cut into pieces as long as the window: a window that ends in a piece is the piece up
to that row, and the end of the piece before from where the window starts. Both are running aggregates, one along the rows and one against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = 128
"""Windows of more rows are computed in pieces; below, folding costs less than the sorts that pieces need."""

AT = "__at"
EXTREMES, SUMS = ("max", "min", "age_max", "age_min"), ("sum", "avg", "stddev_samp")


def is_wide(node) -> bool:
    return node.kind == "win" and node.what in (*EXTREMES, *SUMS, "count") and node.params[0] is not None and node.params[0] > WIDE


def _extreme(node, sign: int) -> Column:
    """The extreme of those rows seen so far that are in the piece seen last, with its row; ``sign`` is 1 along the rows, -1 against them. The oldest of equals, nulls only where there is nothing else."""
    x, piece = F.col(f"`{node.deps[0].name}`"), sign * F.floor((F.col(AT) - 1) / node.params[0])
    if node.what.endswith("max"):
        return F.max(F.struct(piece.alias("piece"), x.isNotNull().alias("there"), x.alias("v"), (-F.col(AT)).alias("r")))
    return F.min(F.struct((-piece).alias("piece"), x.isNull().alias("there"), x.alias("v"), F.col(AT).alias("r")))


def _best(node, own: Column, other: Column) -> Column:
    """The extreme of two, each without its piece; ``other`` may be null."""
    bare = lambda c: F.when(c.isNotNull(), F.struct(c["there"], c["v"], c["r"]))
    best = (F.greatest if node.what.endswith("max") else F.least)(bare(own), bare(other))
    return F.col(AT) - F.abs(best["r"]) if node.what.startswith("age_") else best["v"]


def _moments(node, over) -> Column:
    """Count, mean and squared distances from it, over a window; a sum needs no more than the sum."""
    x = F.col(f"`{node.deps[0].name}`").cast("double")
    n = F.count(x).over(over)
    if node.what == "stddev_samp":
        return F.struct(n.alias("n"), F.avg(x).over(over).alias("m"), (F.var_pop(x).over(over) * n).alias("d"))
    return F.struct(n.alias("n"), F.sum(x).over(over).alias("s"))


def _joined(node, own: Column, other: Column) -> Column:
    """The aggregate of two sets of rows; ``other`` may be null."""
    n, k = own["n"], F.coalesce(other["n"], F.lit(0))
    if node.what != "stddev_samp":
        total = F.coalesce(own["s"] + other["s"], own["s"], other["s"])
        return total if node.what == "sum" else total / F.nullif(n + k, F.lit(0))
    gap = own["m"] - other["m"]
    squares = F.coalesce(own["d"] + other["d"] + gap * gap * n * k / (n + k), own["d"], other["d"])
    return F.when(n + k > 1, F.sqrt(squares / (n + k - 1)))


def with_wide(df: DataFrame, nodes: list, keys: list[str], order: str) -> DataFrame:
    """``df`` with a column per window node, equal to the plain frames (sums up to rounding).

    All extremes and counts share one sort along and one against the rows; sums take one of each per length, in the partitioning by ``keys``, without
    an exchange. Values that have left a window leave nothing behind in its sums. A window with no value but nulls is null (a count 0), shorter ones
    at the start of a key have what there is, and an empty table gives an empty one.
    """
    part = [F.col(f"`{k}`") for k in keys]
    along, against = Window.partitionBy(*part).orderBy(AT), Window.partitionBy(*part).orderBy(F.desc(AT))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    own, other = (lambda n: f"__own_{n.name}"), (lambda n: f"__other_{n.name}")
    columns = df.columns
    out = df.withColumn(AT, F.row_number().over(Window.partitionBy(*part).orderBy(F.col(f"`{order}`"))))
    extremes, sums, counts = ([n for n in nodes if n.what in kinds] for kinds in (EXTREMES, SUMS, ("count",)))
    if extremes:
        out = out.select("*", *[_extreme(n, 1).over(along.rowsBetween(*so_far)).alias(own(n)) for n in extremes])
        out = out.select("*", *[_extreme(n, -1).over(against.rowsBetween(*so_far)).alias(other(n)) for n in extremes])
    for length in sorted({n.params[0] for n in sums}):
        here = [n for n in sums if n.params[0] == length]
        out = out.withColumn("__piece", F.floor((F.col(AT) - 1) / length))
        for name, by in ((own, F.asc(AT)), (other, F.desc(AT))):
            piece = Window.partitionBy(*part, "__piece").orderBy(by).rowsBetween(*so_far)
            out = out.select("*", *[_moments(n, piece).alias(name(n)) for n in here])
    if counts:
        out = out.select("*", *[F.count(F.col(f"`{n.deps[0].name}`")).over(along.rowsBetween(*so_far)).alias(own(n)) for n in counts])
    lagged = [F.lag(other(n), n.params[0] - 1).over(along).alias(f"__lag_{n.name}") for n in [*extremes, *sums]]
    out = out.select("*", *lagged, *[F.lag(own(n), n.params[0]).over(along).alias(f"__lag_{n.name}") for n in counts])

    def result(n) -> Column:
        mine, before = F.col(own(n)), F.col(f"__lag_{n.name}")
        if n in counts:
            return mine - F.coalesce(before, F.lit(0))
        if n in extremes:
            return _best(n, mine, before)
        # a window that ends with its piece is that piece
        return _joined(n, mine, F.when(F.col(AT) % n.params[0] != 0, before))

    return out.select(*[F.col(f"`{c}`") for c in columns], *[result(n).alias(n.name) for n in nodes])
