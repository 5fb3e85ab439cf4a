"""Exponential histograms: how much came within the last window of time.

``exact`` and ``running`` are native and exact. ``ExpHist`` is the bounded
state for streams (Datar, Gionis, Indyk, Motwani): buckets of sizes 1, 2, 4,
... with the time of their newest item. Whenever a size has more than l + 1
buckets its two oldest become one of the next size. Only the oldest bucket of
all may reach out of the window, which bounds the error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(df: DataFrame, value: str, time: str, now: Column | float, window: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, total): the sum of values later than now - window."""
    at = now if isinstance(now, Column) else F.lit(now)
    rows = df.where((F.col(time) > at - window) & (F.col(time) <= at))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def running(value: str, time: str, window: int, by: Sequence[str]) -> Column:
    """For each row the sum over (time - window, time]; whole-number times."""
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-(window - 1), 0)
    return F.sum(value).over(w)


def least_buckets(epsilon: float) -> int:
    """l: as many buckets as a size must have for that relative error."""
    return math.ceil(1 / (2 * epsilon))


#: Buckets of one size, newest first, as runs (time, how many of that time).
Runs = tuple[tuple[int, int], ...]


def _merged(runs: list[tuple[int, int]], most: int) -> tuple[Runs, list[tuple[int, int]]]:
    """What stays of one size, ``most`` buckets or one less, and the runs that
    the oldest ones make in the next size when they are joined in pairs."""
    pairs = max(0, -(-(sum(n for _, n in runs) - most) // 2))
    kept, up = list(runs), []
    while pairs:
        time, n = kept.pop()
        whole = min(n // 2, pairs)
        if whole:
            up.append((time, whole))
            pairs, n = pairs - whole, n - 2 * whole
        elif kept:  # a single one joins the next newer bucket, whose time counts
            newer, more = kept.pop()
            up.append((newer, 1))
            pairs, time, n = pairs - 1, newer, more - 1
        if n:
            kept.append((time, n))
    return tuple(kept), up[::-1]


@dataclass(frozen=True)
class ExpHist:
    """``sizes[i]`` holds the buckets of size 2^i; none is newer than a smaller one."""

    epsilon: float
    window: int
    sizes: tuple[Runs, ...] = ()
    time: int = 0

    @property
    def buckets(self) -> list[tuple[int, int]]:
        """(size, time) of all buckets, newest first."""
        return [(1 << i, t) for i, runs in enumerate(self.sizes) for t, n in runs for _ in range(n)]

    @property
    def total(self) -> int:
        return sum(n << i for i, runs in enumerate(self.sizes) for _, n in runs)

    def step(self, time: int) -> ExpHist:
        """Move on to ``time`` and drop what is too old; never back in time."""
        now = max(self.time, time)
        kept = [tuple(r for r in runs if r[0] > now - self.window) for runs in self.sizes]
        while kept and not kept[-1]:
            kept.pop()
        return ExpHist(self.epsilon, self.window, tuple(kept), now)

    def add(self, n: int, time: int) -> ExpHist:
        """n more at ``time``: buckets of size 1, then merges size by size."""
        moved = self.step(time)
        if n <= 0:
            return moved
        most, out, coming = least_buckets(self.epsilon) + 1, [], [(moved.time, n)]
        for runs in moved.sizes:
            kept, coming = _merged([*coming, *runs], most)
            out.append(kept)
        while coming:
            kept, coming = _merged(coming, most)
            out.append(kept)
        return ExpHist(self.epsilon, self.window, tuple(out), moved.time)

    def inc(self, time: int) -> ExpHist:
        return self.add(1, time)

    def add_all(self, items: Sequence[tuple[int, int]]) -> ExpHist:
        """(n, time) pairs in the order of time."""
        out = self
        for n, time in items:
            out = out.add(n, time)
        return out

    def bounds(self) -> tuple[int, int]:
        """The true number lies from low to high."""
        oldest = 1 << len(self.sizes) >> 1
        return (self.total - oldest + 1, self.total) if oldest else (0, 0)

    def guess(self) -> float:
        """The middle of the bounds: half of the oldest bucket counts."""
        return sum(self.bounds()) / 2

    def relative_error(self) -> float:
        """A bound on the guess's relative error."""
        low, high = self.bounds()
        return (high - low) / 2 / max(low, 1)

    def state(self) -> tuple[list[int], list[int], list[int], int]:
        """Size numbers, times and numbers of all runs, and the time."""
        flat = [(i, *r) for i, runs in enumerate(self.sizes) for r in runs]
        return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat], self.time

    @classmethod
    def of_state(cls, epsilon: float, window: int, number: Sequence[int], times: Sequence[int], counts: Sequence[int], now: int) -> ExpHist:
        sizes: list[list[tuple[int, int]]] = [[] for _ in range(max(number, default=-1) + 1)]
        for i, t, n in zip(number, times, counts, strict=True):
            sizes[i].append((t, n))
        return cls(epsilon, window, tuple(map(tuple, sizes)), now)


def fold(df: DataFrame, by: Sequence[str], time: str, n: str, epsilon: float, window: int, key_schema: str = "") -> DataFrame:
    """(by, time, guess, low, high): each group's rows added in order of time;
    the state of a group is its buckets."""
    from mergeloom.operators.ordered import fold_groups

    def end(h: ExpHist) -> tuple:
        return (h.time, h.guess(), *h.bounds())

    schema = ", ".join(x for x in (key_schema, "time long, guess double, low long, high long") if x)
    return fold_groups(df, by, [time], [time, n], schema, lambda: ExpHist(epsilon, window), lambda h, row: h.add(int(row[1]), int(row[0])), end)
