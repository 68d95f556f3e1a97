"""The series of ``graph.compute`` for few, very long keys: cut into blocks of rows that are computed apart.

Windows of a bounded length see the rows in front of their block as a halo; sums, counts and fills over all rows so far take what the blocks
before give them, one row per block; exponential weights pass their states along the same way, a Hilbert transform is a convolution in chunks, and a
parabolic stop starts each block from a guessed state until all guesses are right. So no task holds more than a block. A null key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fourier, scans
from ..sources.scratch import join_same, scratch
from .graph import Node, order_levels, window_sql, with_expressions
from .wide import is_wide, with_wide

PLACE, BLOCK, HALO = "__rn", "__block", "__halo"


def placed(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """``df`` with each row's number in its key and the number of its block, as a written table.

    Rows are sorted by range over all keys, so a hot key has many ranges; a row's number is its place in its range behind the rows of its key in
    the ranges before.
    """
    spark = df.sparkSession
    path = scratch(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = df.repartitionByRange(n, *keys, order).withColumn("__range", F.spark_partition_id())
    made.write.parquet(path)
    ranged = spark.read.schema(made.schema).parquet(path)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*keys, "__range").count().select(*keys, "__range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order))
    counted = join_same(ranged.withColumn("__own", own), before, [*keys, "__range"])
    return counted.withColumn(PLACE, F.col("__before") + F.col("__own")).withColumn(BLOCK, F.floor((F.col(PLACE) - 1) / block)).drop("__range", "__before", "__own")


def reach(node: Node) -> int | None:
    """Rows before its own that a window node reads; None for all of them."""
    if node.what == "lag":
        return node.params[0]
    n = node.params[0] if node.params else None
    return None if n is None else n - 1


def with_bounded(df: DataFrame, nodes: list[Node], keys: list[str], block: int) -> DataFrame:
    """Adds windows of a bounded length, computed over each block and a halo of the rows before it."""
    halo = max(map(reach, nodes))
    if halo > block:
        raise ValueError(f"a window reads {halo} rows back: blocks of {block} rows are too short")
    lent = df.where(F.col(PLACE) > (F.col(BLOCK) + 1) * block - halo).withColumn(BLOCK, F.col(BLOCK) + 1).withColumn(HALO, F.lit(True))
    both = df.withColumn(HALO, F.lit(False)).unionByName(lent)
    made = both.select("*", *[F.expr(window_sql(n, [*keys, BLOCK], PLACE)).alias(n.name) for n in nodes if not is_wide(n)])
    if wide := [n for n in nodes if is_wide(n)]:
        made = with_wide(made, wide, [*keys, BLOCK], PLACE)
    return made.where(~F.col(HALO)).drop(HALO)


def with_running(df: DataFrame, nodes: list[Node], keys: list[str]) -> DataFrame:
    """Adds sums, counts, extremes and fills over all rows so far: over those of the block, and what the blocks before it give."""
    own = Window.partitionBy(*keys, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = lambda n: F.col(n.deps[0].name)
    at = lambda n: F.when(x(n).isNotNull(), F.col(PLACE))
    plain = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}

    def total(n: Node) -> Column:
        return plain[n.what](x(n)) if n.what in plain else F.max_by(x(n), at(n)) if n.what == "ffill" else F.min_by(x(n), at(n))

    def passed_on(n: Node) -> Column:
        c = F.col(f"__t_{n.name}")
        if n.what == "first_valid":
            return F.first(c, True).over(whole)
        return F.last(c, True).over(earlier) if n.what == "ffill" else (F.sum(c) if n.what == "count" else plain[n.what](c)).over(earlier)

    def merged(n: Node) -> Column:
        before = F.col(f"__b_{n.name}")
        if n.what == "first_valid":
            return before
        if n.what == "ffill":
            return F.coalesce(F.last(x(n), True).over(own), before)
        mine = plain[n.what](x(n)).over(own)
        both = {"sum": mine + before, "count": mine + before, "max": F.greatest(mine, before), "min": F.least(mine, before)}[n.what]
        return F.coalesce(both, mine, before)

    totals = df.groupBy(*keys, BLOCK).agg(*[total(n).alias(f"__t_{n.name}") for n in nodes])
    carried = totals.select(*keys, BLOCK, *[passed_on(n).alias(f"__b_{n.name}") for n in nodes])
    return join_same(df, carried, [*keys, BLOCK]).select(*df.columns, *[merged(n).alias(n.name) for n in nodes])


def with_scans(df: DataFrame, nodes: list[Node], keys: list[str], order: str) -> DataFrame:
    """Adds scans: exponential weights of one depth together, the others one by one."""
    waiting = list(nodes)
    while waiting:
        names = {n.name for n in waiting}
        ready = [n for n in waiting if not any(d.name in names for d in n.deps)]
        weights = [(n.name, n.deps[0].name, dict(n.params)["alpha"]) for n in ready if n.what == "ewm"]
        if weights:
            df = scans.ewm_blocks(df, weights, keys, PLACE, BLOCK)
        for n in ready:
            if n.what == "sar":
                df = scans.stop_blocks(df, n.name, [d.name for d in n.deps], dict(n.params), keys, PLACE, BLOCK)
            elif n.what == "quadrature":
                df = fourier.quadrature_blocks(df, n.name, n.deps[0].name, keys, PLACE)
        waiting = [n for n in waiting if n not in ready]
    return df


def compute(df: DataFrame, outputs: dict[str, Node], keys: list[str], order: str = "ts", *, block: int) -> DataFrame:
    """``df`` with a column for each output, equal to ``graph.compute``, in blocks of ``block`` rows.

    After each level the table is written, as its blocks are read several times by the next.
    """
    if block < 2:
        raise ValueError(f"blocks of {block} rows are too short")
    own, spark = df.columns, df.sparkSession
    nodes, level = order_levels(list(outputs.values()))
    wanted = {n.name for n in outputs.values()}
    df = placed(df, keys, order, block)
    for depth in range(max(level.values(), default=0) + 1):
        here = [n for n in nodes if level[n] == depth]
        later = {d.name for n in nodes if level[n] >= depth for d in n.deps} | wanted
        df = df.select(*[c for c in df.columns if c in own or c in later or c in (PLACE, BLOCK)])
        path = scratch(spark)
        df.write.parquet(path)
        df = with_scans(spark.read.schema(df.schema).parquet(path), [n for n in here if n.kind == "scan"], keys, order)
        windows = [n for n in here if n.kind == "win" and n.what != "row_number"]
        running = [n for n in windows if n.what in ("ffill", "first_valid") or reach(n) is None]
        for n in here:
            if n.what == "row_number":
                df = df.withColumn(n.name, F.col(PLACE))
        if running:
            df = with_running(df, running, keys)
        if bounded := [n for n in windows if n not in running]:
            df = with_bounded(df, bounded, keys, block)
        df = with_expressions(df, [n for n in here if n.kind == "expr"])
    return df.select(*[F.col(f"`{c}`") for c in own if c.lower() not in {o.lower() for o in outputs}], *[F.col(f"`{n.name}`").alias(name) for name, n in outputs.items()])
