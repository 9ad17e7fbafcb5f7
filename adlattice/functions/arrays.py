"""Array helpers for token lists and bags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(values: Column, max_len: int | None) -> Column:
    return values if max_len is None else F.slice(values, 1, max_len)


def pad_right(values: Column, width: Column, fill: Column) -> Column:
    """``values`` filled up to ``width`` elements."""
    return F.concat(values, F.array_repeat(fill, F.greatest(width - F.size(values), F.lit(0)).cast("int")))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def as_text(values: Column) -> Column:
    """Comma-separated text of an integer array."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def scaled_text(values: Column, scale: int = 1_000_000) -> Column:
    """Comma-separated text of a real array, each value rounded to 1/scale."""
    return as_text(F.transform(values, lambda v: F.floor(v.cast("double") * F.lit(float(scale)) + F.lit(0.5))))
