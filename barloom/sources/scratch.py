"""Folders for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` or the context's checkpoint folder, which driver and executors share.

    Where neither is set, a session in one process gets a temporary one; on a cluster that is an error, as executors would not find it.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: give a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new scratch folder: what is read several times is computed once, and a lost executor costs a read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_same(df: DataFrame, other: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` where ``names`` are equal, null being equal to null; an equi-join, with the columns of ``names`` once."""
    renamed = other.withColumnsRenamed({n: f"__same_{n}" for n in names})
    equal = reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.col(f"`__same_{n}`")) for n in names])
    joined = df.join(renamed, equal, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__same_{n}" for n in names])
