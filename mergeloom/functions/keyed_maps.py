"""Arithmetic of MAP columns; zero values are no members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove_zeros(a: Column) -> Column:
    return F.map_filter(a, lambda _, v: v.isNotNull() & (v != 0))


def plus(a: Column, b: Column) -> Column:
    return remove_zeros(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x + y, x, y)))


def negate(a: Column) -> Column:
    return F.transform_values(a, lambda _, v: -v)


def times(a: Column, b: Column) -> Column:
    return remove_zeros(F.map_zip_with(a, b, lambda _, x, y: x * y))


def scale(a: Column, by: float) -> Column:
    return remove_zeros(F.transform_values(a, lambda _, v: v * by))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_values(times(a, b)), F.lit(0.0), lambda s, v: s + v)
