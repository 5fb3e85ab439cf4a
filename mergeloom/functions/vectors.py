"""Vectors and matrices: dense as ARRAY columns, sparse as rows or maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.algebra import elementwise

DENSE_SHARE = 0.25
plus = elementwise


def negate(a: Column) -> Column:
    return F.transform(a, lambda v: -v)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda v: v * by)


def updated(a: Column, index: Column | int, value: Column | float) -> Column:
    at = F.lit(index) if isinstance(index, int) else index
    return F.transform(a, lambda v, i: F.when(i == at, F.lit(value) if not isinstance(value, Column) else value).otherwise(v))


def extended(a: Column, size: int, fill: float = 0.0) -> Column:
    """At least ``size`` long."""
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def to_map(a: Column) -> Column:
    """Index to value, without zeros."""
    entries = F.filter(F.transform(a, lambda v, i: F.struct(i.alias("key"), v.alias("value"))), lambda e: e["value"] != 0)
    return F.map_from_entries(entries)


def from_map(m: Column, size: int, fill: float = 0.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(fill)))


def is_dense(a: Column, share: float = DENSE_SHARE) -> Column:
    """Would the vector be stored dense, by its share of entries?"""
    return F.size(F.filter(a, lambda v: v != 0)) >= share * F.size(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, v: s + v)


def minkowski(a: Column, b: Column, p: float) -> Column:
    """The p-distance of two arrays; the shorter one is padded with zeros."""
    terms = F.zip_with(a, b, lambda x, y: F.pow(F.abs(F.coalesce(x, F.lit(0.0)).cast("double") - F.coalesce(y, F.lit(0.0)).cast("double")), F.lit(float(p))))
    return F.pow(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), F.lit(1.0 / p))


def l1(a: Column, b: Column) -> Column:
    return minkowski(a, b, 1)


def l2(a: Column, b: Column) -> Column:
    return minkowski(a, b, 2)


def norm(a: Column, p: float = 2) -> Column:
    return minkowski(a, F.array().cast("array<double>"), p)


def minkowski_map(a: Column, b: Column, p: float) -> Column:
    """The p-distance of two maps over the union of their keys. Equal terms of
    different keys all count."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.pow(F.abs(F.coalesce(x, F.lit(0)).cast("double") - F.coalesce(y, F.lit(0)).cast("double")), F.lit(float(p))))
    return F.pow(F.aggregate(F.map_values(both), F.lit(0.0), lambda s, v: s + v), F.lit(1.0 / p))


def scalar_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


# Sparse rows -----------------------------------------------------------


def sparse_sum(rows: DataFrame, index: Sequence[str], value: str, by: Sequence[str] = (), keep_zeros: bool = False) -> DataFrame:
    """Vectors or matrices as rows (by, index..., value), added up."""
    out = rows.groupBy(*by, *index).agg(F.sum(value).alias(value))
    return out if keep_zeros else out.where(F.col(value) != 0)


def matrix_fill(spark, n_rows: int, n_cols: int, value: float) -> DataFrame:
    """(row, col, v) of a constant matrix."""
    return spark.range(n_rows * n_cols).select(F.expr(f"cast(id div {n_cols} as int)").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"), F.lit(value).alias("v"))


def matrix_updated(matrix: DataFrame, changes: DataFrame) -> DataFrame:
    """The matrix with the changed cells' values in place of its own."""
    return matrix.join(changes.select("row", "col"), ["row", "col"], "left_anti").unionByName(changes)
