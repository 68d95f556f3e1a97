"""Null-safe arithmetic and coercion on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def fdiv(a: Column, b: Column) -> Column:
    """a / b; where b is 0, infinity with the sign of a, or null for 0 / 0."""
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, infinite).otherwise(a / F.nullif(b, F.lit(0.0)))


def number(text: Column) -> Column:
    """A double from text; blank, malformed and NaN give null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def utc_from_local(text: Column, zone: str, pattern: str | None = None) -> Column:
    """A UTC timestamp from local date and time text; malformed text gives null."""
    parsed = F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(text, F.lit(pattern))
    return F.to_utc_timestamp(parsed, zone)


def epoch_of_local_minute(text: Column, zone: str = "US/Eastern") -> Column:
    """UTC epoch seconds of a local ``yyyy-MM-dd HH:mm[...]`` text, floored to the minute."""
    return F.unix_timestamp(utc_from_local(F.substring(F.trim(text), 1, 16), zone, "yyyy-MM-dd HH:mm"))


def clean_zero(x: Column, digits: int) -> Column:
    """Rounded, NaN as null, without a negative zero."""
    return F.when(~F.isnan(x), F.round(x, digits) + F.lit(0.0))


def clean_double(x: Column, digits: int) -> Column:
    """As ``clean_zero``, with a double scaled, rounded half away from zero and scaled back, as other engines do.

    Spark's own rounding goes by the shortest decimal of ``x``, which may lie on a half where ``x`` lies below or above it.
    """
    scale = F.lit(10.0**digits)
    return F.when(~F.isnan(x), F.round(x * scale, 0) / scale + F.lit(0.0))


def without_nan(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` with null in place of NaN in those of ``columns`` that are floating-point columns of it: a value that is no number is a missing one."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)}
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in columns if c in floats})
