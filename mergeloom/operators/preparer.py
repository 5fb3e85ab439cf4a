"""A fluent way to prepare rows before they are aggregated.

``prepare(df).map(...).filter(...).aggregate(...)``: each step is a projection,
selection or explosion that Catalyst merges and pushes down.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.operators import aggregators as A
from mergeloom.plans import spec
from mergeloom.plans.spec import Agg

Function = Callable[[Column], Column]


class Preparer:
    """Rows with one column of interest, ``x``; the others come along."""

    def __init__(self, df: DataFrame, x: Column | str | None = None, by: Sequence[str] = ()) -> None:
        self.df = df if x is None else df.withColumn("x", F.col(x) if isinstance(x, str) else x)
        self.by = tuple(by)

    @property
    def x(self) -> Column:
        return F.col("x")

    def _with(self, df: DataFrame) -> Preparer:
        return Preparer(df, None, self.by)

    def map(self, f: Function) -> Preparer:
        return self._with(self.df.withColumn("x", f(self.x)))

    def flat_map(self, f: Function) -> Preparer:
        """``f`` gives an array; each element becomes a row."""
        return self._with(self.df.withColumn("x", F.explode(f(self.x))))

    def flatten(self) -> Preparer:
        return self.flat_map(lambda x: x)

    def filter(self, predicate: Function) -> Preparer:
        return self._with(self.df.where(predicate(self.x)))

    def collect(self, defined: Function, f: Function) -> Preparer:
        return self.filter(defined).map(f)

    def group_by(self, *keys: str) -> Preparer:
        return Preparer(self.df, None, keys)

    def aggregate(self, **aggs: Agg) -> DataFrame:
        return spec.aggregate(self.df, aggs, self.by)

    def split(self, f: Callable[[Column], dict[str, Agg]]) -> DataFrame:
        """Several aggregations of the same prepared rows, in one pass."""
        return self.aggregate(**f(self.x))

    def lift(self, **aggs: Agg) -> DataFrame:
        return self.aggregate(**{n: a.lift() for n, a in aggs.items()})

    def count(self, predicate: Function) -> DataFrame:
        return self.aggregate(count=A.count(predicate(self.x)))

    def exists(self, predicate: Function) -> DataFrame:
        return self.aggregate(exists=A.exists(predicate(self.x)))

    def forall(self, predicate: Function) -> DataFrame:
        return self.aggregate(forall=A.forall(predicate(self.x)))

    def size(self) -> DataFrame:
        return self.aggregate(size=A.size())

    def sorted_take(self, k: int) -> DataFrame:
        return A.sorted_take(self.df, k, "x", self.by)

    def sorted_reverse_take(self, k: int) -> DataFrame:
        return A.sorted_reverse_take(self.df, k, "x", self.by)

    def to_list(self, *order: str) -> DataFrame:
        return self.aggregate(values=A.to_list(self.x, order))

    def to_set(self) -> DataFrame:
        return self.aggregate(values=A.to_set(self.x))

    def unique_count(self) -> DataFrame:
        return self.aggregate(unique_count=A.unique_count_exact(self.x))

    def head_option(self, *order: str) -> DataFrame:
        return self.aggregate(head=A.head(self.x, order))

    def last_option(self, *order: str) -> DataFrame:
        return self.aggregate(last=A.last(self.x, order))

    def max_option(self) -> DataFrame:
        return self.aggregate(max=A.max_of(self.x))

    def min_option(self) -> DataFrame:
        return self.aggregate(min=A.min_of(self.x))

    def max_option_by(self, f: Function, *order: str) -> DataFrame:
        return self.aggregate(max=A.max_by(self.x, f(self.x), order))

    def min_option_by(self, f: Function, *order: str) -> DataFrame:
        return self.aggregate(min=A.min_by(self.x, f(self.x), order))

    def sum(self) -> DataFrame:
        return self.aggregate(sum=A.sum_of(self.x))

    def sum_option(self) -> DataFrame:
        return self.aggregate(sum=A.sum_option(self.x))

    def reduce_option(self, f: Callable[[Column, Column], Column], *order: str) -> DataFrame:
        return self.aggregate(value=A.from_reduce(self.x, f, order))

    def _or_raise(self, **aggs: Agg) -> DataFrame:
        return spec.aggregate_or_raise(self.df, aggs)

    def head(self, *order: str) -> DataFrame:
        """As ``head_option``, but empty input raises (as for the next ones)."""
        return self._or_raise(head=A.head(self.x, order))

    def last(self, *order: str) -> DataFrame:
        return self._or_raise(last=A.last(self.x, order))

    def max(self) -> DataFrame:
        return self._or_raise(max=A.max_of(self.x))

    def min(self) -> DataFrame:
        return self._or_raise(min=A.min_of(self.x))

    def max_by(self, f: Function, *order: str) -> DataFrame:
        return self._or_raise(max=A.max_by(self.x, f(self.x), order))

    def min_by(self, f: Function, *order: str) -> DataFrame:
        return self._or_raise(min=A.min_by(self.x, f(self.x), order))

    def reduce(self, f: Callable[[Column, Column], Column], *order: str) -> DataFrame:
        return self._or_raise(value=A.from_reduce(self.x, f, order))


def prepare(df: DataFrame, x: Column | str, by: Sequence[str] = ()) -> Preparer:
    return Preparer(df, x, by)
