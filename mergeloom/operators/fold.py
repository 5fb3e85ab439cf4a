"""Folds: sequential aggregations, as native as they can be.

Every fold is an ``Agg`` and so joins with others in one pass. Those with an
associative step are native aggregates; a general step runs over the group's
rows in order inside one expression. Groups too large for that take
``ordered.fold_groups``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.operators import aggregators as A
from mergeloom.plans.spec import Agg, array_of, struct_of

fold_left = A.fold_left
first, last = A.head, A.last
maximum, minimum = A.max_of, A.min_of
sum_of, sum_option, product = A.sum_of, A.sum_option, A.product_of
size, count, exists, forall = A.size, A.count, A.exists, A.forall
container = A.to_list
const = A.const


def contramap(agg: Agg, f: Callable[[Column], Column]) -> Agg:
    return agg.compose_prepare(f)


def map_result(agg: Agg, f: Callable[[Column], Column]) -> Agg:
    return agg.and_then_present(f)


def join_with(left: Agg, right: Agg, f: Callable[[Column, Column], Column]) -> Agg:
    """Two folds in one pass, their results combined by ``f``."""
    return struct_of({"l": left, "r": right}).and_then_present(lambda s: f(s["l"], s["r"]))


def sequence(folds: Sequence[Agg]) -> Agg:
    """Several folds of one result type as an array, in one pass."""
    return array_of(folds)


def over_empty(df: DataFrame, agg: Agg) -> DataFrame:
    """The fold of no rows."""
    return df.limit(0).agg(agg.column().alias("value"))


def over(df: DataFrame, agg: Agg) -> DataFrame:
    return df.agg(agg.column().alias("value"))


def foreach(df: DataFrame, f: Callable) -> None:
    """Run ``f`` on every row, on the executors, for its effect."""
    df.foreach(f)


def affine(slope: Column | str, offset: Column | str, order: Sequence[str]) -> Agg:
    """The composition of y = slope x + offset along the order, first applied
    first, as a struct of both."""
    both = F.struct((F.col(slope) if isinstance(slope, str) else slope).cast("double").alias("slope"), (F.col(offset) if isinstance(offset, str) else offset).cast("double").alias("offset"))
    start = F.struct(F.lit(1.0).alias("slope"), F.lit(0.0).alias("offset"))
    step = lambda f, g: F.struct((g["slope"] * f["slope"]).alias("slope"), (g["slope"] * f["offset"] + g["offset"]).alias("offset"))
    return A.fold_left(both, start, step, order=order)
