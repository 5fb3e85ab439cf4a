"""Intervals as predicates that Catalyst can push to the scan.

An interval is a lower and an upper bound, each closed, open or absent.
``contains`` gives a Column of plain comparisons.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """lower and upper may be None (unbounded); an empty interval is ``EMPTY``."""

    lower: Any = None
    upper: Any = None
    lower_closed: bool = True
    upper_closed: bool = False
    empty: bool = False

    def contains(self, x: Column) -> Column:
        if self.empty:
            return F.lit(False)
        parts = []
        if self.lower is not None:
            parts.append(x >= self.lower if self.lower_closed else x > self.lower)
        if self.upper is not None:
            parts.append(x <= self.upper if self.upper_closed else x < self.upper)
        return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else F.lit(True)

    def holds(self, x: Any) -> bool:
        """The same for a Python value."""
        if self.empty:
            return False
        above = self.lower is None or (x >= self.lower if self.lower_closed else x > self.lower)
        return above and (self.upper is None or (x <= self.upper if self.upper_closed else x < self.upper))

    def intersect(self, other: Interval) -> Interval:
        if self.empty or other.empty:
            return EMPTY
        lower, lower_closed = max(((i.lower, i.lower_closed) for i in (self, other) if i.lower is not None), key=lambda b: (b[0], not b[1]), default=(None, True))
        upper, upper_closed = min(((i.upper, i.upper_closed) for i in (self, other) if i.upper is not None), key=lambda b: (b[0], b[1]), default=(None, False))
        return _made(lower, upper, lower_closed, upper_closed)

    def map_non_decreasing(self, f: Callable[[Any], Any]) -> Interval:
        """The interval of images under a non-decreasing function."""
        if self.empty:
            return EMPTY
        bound = lambda b: None if b is None else f(b)
        return _made(bound(self.lower), bound(self.upper), self.lower_closed, self.upper_closed)

    # Whole numbers -----------------------------------------------------

    def least(self) -> int | None:
        """The smallest whole number inside, if the interval has one."""
        if self.empty or self.lower is None:
            return None
        x = self.lower if self.lower_closed else self.lower + 1
        return x if self.holds(x) else None

    def greatest(self) -> int | None:
        if self.empty or self.upper is None:
            return None
        x = self.upper if self.upper_closed else self.upper - 1
        return x if self.holds(x) else None

    def is_empty_of_integers(self) -> bool:
        return self.empty or (self.lower is not None and self.upper is not None and self.least() is None)

    def left_closed_right_open(self) -> Interval:
        """The same whole numbers as [a, b)."""
        if self.empty or self.lower is None or self.upper is None:
            return self
        a, b = self.least(), self.greatest()
        return EMPTY if a is None or b is None else Interval(a, b + 1)

    def strict_lower_bound(self) -> int | None:
        """The largest whole number below all of the interval."""
        return None if self.empty or self.lower is None else self.lower - 1 if self.lower_closed else self.lower

    def strict_upper_bound(self) -> int | None:
        return None if self.empty or self.upper is None else self.upper + 1 if self.upper_closed else self.upper

    def least_to_greatest(self) -> Column:
        """The whole numbers inside as an array column; both ends must be."""
        a, b = self.least(), self.greatest()
        return F.array().cast("array<long>") if a is None or b is None else F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))

    def greatest_to_least(self) -> Column:
        return F.reverse(self.least_to_greatest())


EMPTY = Interval(empty=True)
UNIVERSE = Interval()


def _made(lower: Any, upper: Any, lower_closed: bool, upper_closed: bool) -> Interval:
    if lower is not None and upper is not None and (lower > upper or (lower == upper and not (lower_closed and upper_closed))):
        return EMPTY
    return Interval(lower, upper, lower_closed, upper_closed)


def closed(a: Any, b: Any) -> Interval:
    return _made(a, b, True, True)


def open_(a: Any, b: Any) -> Interval:
    return _made(a, b, False, False)


def left_closed_right_open(a: Any, b: Any) -> Interval:
    return _made(a, b, True, False)


def left_open_right_closed(a: Any, b: Any) -> Interval:
    return _made(a, b, False, True)


def at_least(a: Any) -> Interval:
    return Interval(lower=a)


def above(a: Any) -> Interval:
    return Interval(lower=a, lower_closed=False)


def at_most(b: Any) -> Interval:
    return Interval(upper=b, upper_closed=True)


def below(b: Any) -> Interval:
    return Interval(upper=b)


def intersect_all(df: DataFrame, lower: str, upper: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, lower, upper, empty): the intersection of [lower, upper) intervals
    of each group; NULL bounds are unbounded."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(F.max(lower).alias(lower), F.min(upper).alias(upper))
    return out.withColumn("empty", F.coalesce(F.col(lower) >= F.col(upper), F.lit(False)))


def whole_numbers(lower: Column | str, upper: Column | str, lower_closed: bool = True, upper_closed: bool = False) -> Column:
    """The whole numbers between two columns as an array, ascending; none where
    the interval is empty, NULL where a bound is."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (lower, upper))
    first = F.ceil(a) if lower_closed else F.floor(a) + 1
    last = F.floor(b) if upper_closed else F.ceil(b) - 1
    return F.when(a.isNotNull() & b.isNotNull(), F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>")))


def successor(x: Column, most: int = 2**63 - 1) -> Column:
    """x + 1, NULL at the type's limit."""
    return F.when(x < most, x + 1)


def predecessor(x: Column, least: int = -(2**63)) -> Column:
    return F.when(x > least, x - 1)
