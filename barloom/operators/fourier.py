"""The Hilbert quadrature of very long series, as a distributed convolution.

Turning each frequency of n values by a quarter is a circular convolution with a kernel of n known numbers, so any length will do: values and kernel are
transformed with zeros to a power of two, M = rows x columns, multiplied, and transformed back. A transform of M is one along the columns, a
turn of each cell, and one along the rows; the product needs whole rows only, and the way back starts with rows. So there are three passes over chunks of
columns, of rows, and of columns, and no task holds more than a chunk, about the square root of M times a few.

All of it is in extended precision and rounded to doubles at the end, as a sum of products would be that loses no digits: where two bars have nearly the same angle,
a period is the reciprocal of what little differs, and shows the last bits of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..sources.scratch import written

CELLS = 1 << 17
"""Cells of a chunk."""

LONG, LONG_COMPLEX = np.longdouble, np.clongdouble
TURN = 8 * np.arctan(LONG(1))


def kernel(j: np.ndarray, n: int, size: int) -> np.ndarray:
    """What values of a series of ``n`` are convolved with, at the places ``j`` of ``size`` (2 n - 1 or more), behind which negative places stand."""
    at = np.where(j < n, j, j - size + n)
    used = ((j < n) | (j > size - n)) & (at % n != 0)
    angle = (np.pi * np.where(used, at, 1) / n).astype(LONG)  # the angles are doubles in SQL, too
    odd = np.where(at % 2 == 0, 1.0, -1.0)
    # the sum of sines of all frequencies below the half
    value = (np.cos(angle) - odd) / np.sin(angle) if n % 2 else (1 - odd) / np.tan(angle)
    return np.where(used, value / n, 0.0)


def turns(r: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """The root of unity of each cell."""
    return np.exp(1j * (TURN * (r[:, None] * c) / size))


def shape_of(n: int, cells: int) -> tuple[int, int, int, int]:
    """(rows, columns, columns of a chunk, rows of a chunk) for a series of ``n``."""
    bits = (2 * int(n) - 2).bit_length() or 1
    rows, columns = 1 << bits // 2, 1 << bits - bits // 2
    return rows, columns, min(columns, max(1, cells // rows)), min(rows, max(1, cells // columns))


def quadrature_blocks(df: DataFrame, out: str, source: str, keys: list[str], place: str, cells: int = CELLS) -> DataFrame:
    """``df`` with the quadrature of ``source`` over each whole key as ``out``: equal to ``scans.quadrature``, null where the key has a null.

    ``place`` numbers the rows of a key from 1 on, without gaps.
    """
    own = written(df)
    name = [f"__k{i}" for i in range(len(keys))]
    key_fields = [df.schema[k] for k in keys]
    base = StructType([type(f)(n, f.dataType) for n, f in zip(name, key_fields, strict=True)]).add("n", "long")
    blocks_schema = StructType(list(base.fields)).add("r", "long").add("c", "long").add("x", BinaryType()).add("h", BinaryType())
    turned_schema = StructType(list(base.fields)).add("r", "long").add("c", "long").add("x", BinaryType())
    value_schema = StructType(list(base.fields)).add("at", "long").add("value", "double")

    sizes = own.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, name, strict=True)]).agg(F.count("*").alias("n"), (F.count(F.when(~F.isnan(F.col(source).cast("double")), 1)) < F.count("*")).alias("bad"))
    same = [own[k].eqNullSafe(sizes[n]) for k, n in zip(keys, name, strict=True)]
    valid = own.join(sizes.where(~F.col("bad")), same).select(*name, "n", (F.col(place) - 1).alias("at"), F.col(source).cast("double").alias("value"))
    bits = F.length(F.bin(2 * F.col("n") - 2))
    low = F.floor(bits / 2)
    rows, columns = F.pow(F.lit(2), low).cast("long"), F.pow(F.lit(2), bits - low).cast("long")
    chunk = F.greatest(F.lit(1), F.least(columns, F.floor(F.lit(cells) / rows)))
    chunked = valid.withColumn("c", F.floor((F.col("at") % columns) / chunk).cast("long"))

    def along_columns(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *names, n, c = key
        rows, columns, wide, high = shape_of(n, cells)
        x = np.zeros((rows, wide), LONG)
        x[part["at"] // columns, part["at"] % columns - c * wide] = part["value"]
        column = np.arange(c * wide, (c + 1) * wide)
        h = kernel(np.arange(rows)[:, None] * columns + column, n, rows * columns)
        turn = turns(np.arange(rows), column, rows * columns).conj()
        x, h = np.fft.fft(x, axis=0) * turn, np.fft.fft(h, axis=0) * turn
        return pd.DataFrame([(*names, n, r, c, x[r * high : (r + 1) * high].tobytes(), h[r * high : (r + 1) * high].tobytes()) for r in range(rows // high)], columns=blocks_schema.names)

    def along_rows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *names, n, r = key
        rows, columns, wide, high = shape_of(n, cells)
        part = part.sort_values("c")
        x, h = (np.concatenate([np.frombuffer(b, LONG_COMPLEX).reshape(high, wide) for b in part[name]], axis=1) for name in ("x", "h"))
        back = np.fft.ifft(np.fft.fft(x, axis=1) * np.fft.fft(h, axis=1), axis=1)
        back *= turns(np.arange(r * high, (r + 1) * high), np.arange(columns), rows * columns)
        return pd.DataFrame([(*names, n, r, c, back[:, c * wide : (c + 1) * wide].tobytes()) for c in range(columns // wide)], columns=turned_schema.names)

    def back_along_columns(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *names, n, c = key
        rows, columns, wide, high = shape_of(n, cells)
        part = part.sort_values("r")
        x = np.concatenate([np.frombuffer(b, LONG_COMPLEX).reshape(high, wide) for b in part["x"]])
        value = np.fft.ifft(x, axis=0).real.astype(float)
        at = np.arange(rows)[:, None] * columns + np.arange(c * wide, (c + 1) * wide)
        kept = at < n
        made = pd.DataFrame({"at": at[kept], "value": value[kept]})
        return made.assign(**dict(zip(name, names, strict=True)), n=n)[value_schema.names]

    first = chunked.groupBy(*name, "n", "c").applyInPandas(along_columns, blocks_schema)
    second = first.groupBy(*name, "n", "r").applyInPandas(along_rows, turned_schema)
    third = second.groupBy(*name, "n", "c").applyInPandas(back_along_columns, value_schema).drop("n")
    met = [own[k].eqNullSafe(third[n]) for k, n in zip(keys, name, strict=True)] + [own[place] == third["at"] + 1]
    return own.join(third, met, "left").select(own["*"], third["value"].alias(out))
