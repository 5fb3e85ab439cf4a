"""Quantile trees as a relation of leaves (group, leaf, n, s): merge is a sum.

A leaf is a dyadic bin of width 2^level. Coarser nodes are sums of leaves, so
``compress`` may move rare leaves up to a wider bin: then rows carry a level.
``bounded`` builds such a tree with that bound in every task already.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.operators import monoid
from mergeloom.plans.spec import null_safe
from mergeloom.sources import tables

LEVEL = -16


def _checked(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("quantile trees take no negative values"))).otherwise(x)


def leaves(df: DataFrame, x: str, by: Sequence[str] = (), level: int = LEVEL) -> DataFrame:
    """(by, leaf, n, s): counts and sums by bin. Negative values raise."""
    value = F.col(x).cast("double")
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(value)).select(*by, F.floor(_checked(value) / (2.0**level)).alias("leaf"), value.alias("_v"))
    return rows.groupBy(*by, "leaf").agg(F.count("*").alias("n"), F.sum("_v").alias("s"))


def merge(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tree.groupBy(*by, "leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def coarsened(tree: DataFrame, levels: int, by: Sequence[str] = ()) -> DataFrame:
    """All bins 2^levels as wide."""
    return merge(tree.withColumn("leaf", F.shiftright("leaf", levels)), by)


#: Leaves (as a power of two) that one window orders for a quantile.
BLOCK_BITS = 16


def quantile_bounds(tree: DataFrame, p: float, by: Sequence[str] = (), level: int = LEVEL) -> DataFrame:
    """(by, lower, upper): the bin of rank min(floor(n p), n - 1), from 0.

    Blocks of 2^``BLOCK_BITS`` neighbouring leaves are ranked first, then the
    leaves of the block that holds the rank: no window orders all leaves of a
    group, only as many blocks as its range has and the leaves of one."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = tree.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.shiftright("leaf", BLOCK_BITS).alias("_block"), "leaf", "n")
    order, whole = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(*keys, "_block", "n", F.sum("n").over(order).alias("_to"), F.sum("n").over(whole).alias("_whole"))
    rank = F.least(F.floor(F.col("_whole") * p), F.col("_whole") - 1)
    hit = blocks.where((F.col("_to") > rank) & (F.col("_to") - F.col("n") <= rank))
    hit = hit.select(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("_block").alias("_hit"), (rank - F.col("_to") + F.col("n")).alias("_rank"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys], F.col("_block") == F.col("_hit"))
    own = rows.join(hit, same).withColumn("_to", F.sum("n").over(Window.partitionBy(*keys).orderBy("leaf")))
    found = own.where((F.col("_to") > F.col("_rank")) & (F.col("_to") - F.col("n") <= F.col("_rank")))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], (F.col("leaf") * 2.0**level).alias("lower"), ((F.col("leaf") + 1) * 2.0**level).alias("upper"))


# Trees of bounded size -------------------------------------------------------


def most_nodes(k: int) -> int:
    """The nodes of a bounded tree at most."""
    return 2 ** (k + 2)


class Nodes:
    """A tree of at most ``most_nodes`` nodes: (level, place) with counts and
    sums, and values that are still to be binned."""

    WAITING = 8192

    def __init__(self, level: int, k: int) -> None:
        self.level, self.k, self.values, self.waiting = level, k, [], 0
        self.at, self.n, self.s = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, values: np.ndarray) -> Nodes:
        values = values[~np.isnan(values)]
        if (values < 0).any():
            raise ValueError("quantile trees take no negative values")
        self.values.append(values)
        self.waiting += len(values)
        if self.waiting >= self.WAITING:
            self._settle()
        return self

    def _settle(self) -> None:
        """Bins what waits, and compresses a tree that has become too large."""
        if self.values:
            v = np.concatenate(self.values)
            place = np.floor(v / 2.0**self.level).astype(np.int64)
            self._add(np.stack([np.full(len(v), self.level), place], 1), np.ones(len(v), np.int64), v)
            self.values, self.waiting = [], 0
        if len(self.n) > most_nodes(self.k):
            self._compress()

    def _add(self, at: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
        both = np.concatenate([self.at, at])
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.append(True, (np.diff(both[order], axis=0) != 0).any(1)) if len(order) else np.zeros(0, bool)
        own = np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        nodes = both[order][new]
        counts = np.zeros(len(nodes), np.int64)
        np.add.at(counts, own, np.concatenate([self.n, n]))
        self.at, self.n, self.s = nodes, counts, np.bincount(own, np.concatenate([self.s, s]), len(nodes))

    def _compress(self) -> None:
        """Nodes of fewer than a 2^k-th of all values go to their parents, from
        the lowest level up, as far as one node is above all others."""
        least, level = int(self.n.sum()) >> self.k, int(self.at[:, 0].min())
        while True:
            top = self.at[:, 1] >> np.maximum(0, level - self.at[:, 0])
            if len(np.unique(np.where(self.at[:, 0] <= level, top, -1 - self.at[:, 1]))) <= 1:
                return
            small = (self.at[:, 0] == level) & (self.n < least)
            if small.any():
                at, n, s = self.at[small], self.n[small], self.s[small]
                self.at, self.n, self.s = self.at[~small], self.n[~small], self.s[~small]
                self._add(np.stack([at[:, 0] + 1, at[:, 1] >> 1], 1), n, s)
            level += 1
            if level > 63:
                return

    def __add__(self, other: Nodes) -> Nodes:
        self._settle()
        other._settle()
        self._add(other.at, other.n, other.s)
        self._settle()
        return self

    def rows(self) -> list[tuple]:
        self._settle()
        return [(int(a), int(b), int(n), float(s)) for (a, b), n, s in zip(self.at, self.n, self.s, strict=True)]


def bounded(df: DataFrame, x: str, k: int = 9, by: Sequence[str] = (), level: int = LEVEL) -> DataFrame:
    """(by, level, leaf, n, s): a tree of at most ``most_nodes(k)`` nodes a group.
    Tasks keep trees of that size and merge them, so neither rows nor leaves
    shuffle. While a group has no more leaves than that its tree is exact."""
    one = lambda v: np.array([np.nan if v is None else v])
    many = lambda t, columns: (t or Nodes(level, k)).take(columns[0].to_numpy(zero_copy_only=False))
    tree = monoid.Monoid(lambda v: Nodes(level, k).take(one(v)), lambda a, b: a + b, lambda t: (t.rows(),), append=lambda t, v: t.take(one(v)), bulk=many)
    value = F.col(x).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("_x"))
    # A state is some hundred kilobytes at most.
    out = monoid.aggregate(rows, tree, ["_x"], "nodes array<struct<level:int,leaf:long,n:long,s:double>>", by, held=200)
    return out.select(*by, F.inline("nodes"))


def node_bounds(nodes: DataFrame, p: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, lower, upper): bounds of the value of rank min(floor(n p), n - 1),
    from 0, in a tree of nodes of any levels. Were every value at its node's
    lower end, the value of that rank would be lower, and higher at the upper
    ends. Windows over the nodes of a group, which are few."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    width = F.pow(F.lit(2.0), F.col("level"))
    ends = nodes.select(*by, "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("leaf") * width).alias("at")), F.struct(F.lit(1).alias("side"), ((F.col("leaf") + 1) * width).alias("at")))).alias("e"))
    side = Window.partitionBy(*by, "e.side")
    ranked = ends.withColumns({"_to": F.sum("n").over(side.orderBy("e.at")), "_all": F.sum("n").over(side)})
    rank = F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    least = lambda which: F.min(F.when((F.col("e.side") == which) & (F.col("_to") > rank), F.col("e.at")))
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    return grouped.agg(least(0).alias("lower"), least(1).alias("upper"))


def approximate_percentile(df: DataFrame, x: str, p: float, by: Sequence[str] = (), level: int = LEVEL, k: int = 9) -> DataFrame:
    """(by, percentile): the lower bound of the quantile, by a bounded tree."""
    return node_bounds(bounded(df, x, k, by, level), p, by).select(*by, F.col("lower").alias("percentile"))


# Sums over trees ---------------------------------------------------------------


def range_bounds(tree: DataFrame, start: Column | float, end: Column | float, by: Sequence[str] = (), level: int = LEVEL) -> DataFrame:
    """(by, count_low, count_high, sum_low, sum_high) of values in the range:
    bins that lie inside count for both, bins that overlap for the upper."""
    lo, hi = F.col("leaf") * 2.0**level, (F.col("leaf") + 1) * 2.0**level
    a, b = (F.lit(c) if not isinstance(c, Column) else c for c in (start, end))
    inside, meets = (a <= lo) & (b >= hi), (a < hi) & (b >= lo)
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    grouped = tree.groupBy(*by) if by else tree.groupBy()
    return grouped.agg(pick(inside, "n").alias("count_low"), pick(meets, "n").alias("count_high"), pick(inside, "s").cast("double").alias("sum_low"), pick(meets, "s").cast("double").alias("sum_high"))


def total(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    grouped = tree.groupBy(*by) if by else tree.groupBy()
    return grouped.agg(F.sum("n").alias("count"), F.sum("s").alias("sum"))


def inter_quartile_mean(tree: DataFrame, by: Sequence[str] = (), level: int = LEVEL) -> DataFrame:
    """(by, lower, upper): bounds of the mean between the quartiles.

    Either quartile lies somewhere in its bin. With both at their bins' lower
    ends, bins that lie wholly between them have the least sum and bins that touch
    the stretch the most values: their ratio is the lower bound. With both at the
    upper ends, the sum of those that touch over the count of those wholly between
    is the upper one. One pass over the leaves, with the quartiles beside them."""
    width = 2.0**level
    keys = [f"_q{i}" for i in range(len(by))]
    quartiles = None
    for name, p in (("first", 0.25), ("third", 0.75)):
        found = quantile_bounds(tree, p, by, level).select(*[F.col(c).alias(f"{k}{name}") for c, k in zip(by, keys, strict=True)], F.struct("lower", "upper").alias(name))
        if quartiles is None:
            quartiles = found
        else:
            quartiles = quartiles.join(found, null_safe([f"{k}first" for k in keys], [f"{k}third" for k in keys]) if by else F.lit(True))
    beside = tree.join(quartiles, null_safe(by, [f"{k}first" for k in keys])) if by else tree.join(F.broadcast(quartiles))
    left, right = F.col("leaf") * width, (F.col("leaf") + 1) * width
    sums = {}
    for end in ("lower", "upper"):
        start, stop = F.col(f"first.{end}"), F.col(f"third.{end}")
        between, touching = (left >= start) & (right <= stop), (left <= stop) & (right > start)
        sums[end] = [F.sum(F.when(between if (c == "s") == (end == "lower") else touching, F.col(c))) for c in ("s", "n")]
    grouped = beside.groupBy(*by) if by else beside.groupBy()
    return grouped.agg(*[F.try_divide(F.coalesce(total, F.lit(0)), F.coalesce(count, F.lit(0))).alias(end) for end, (total, count) in sums.items()])


def compress(tree: DataFrame, k: int, by: Sequence[str] = (), level: int = LEVEL, cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """(by, level, leaf, n, s): nodes with fewer than total / 2^k values merge
    into their parents until none is left or the root is reached, which is 63
    levels up at most. At most 2^(k+2) rows a group. A loop over levels, each a
    grouped sum of what is still open, written away by ``cut`` so that no level
    is computed twice."""
    keys = list(by) or ["_all"]
    rows = tree if by else tree.withColumn("_all", F.lit(1))
    least = rows.groupBy(*keys).agg(F.shiftright(F.sum("n"), k).alias("_least"), F.max("leaf").alias("_top"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    limits = least.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_least", "_top")
    sized = rows.withColumn("level", F.lit(level)).join(limits, reduce(lambda a, b: a & b, same)).drop(*[f"_k{i}" for i in range(len(keys))])
    now, done = cut(sized), None
    while True:
        small = (F.col("n") < F.col("_least")) & F.expr(f"shiftright(_top, level - ({level})) > 0")
        closed = now.where(~small).select(*keys, "level", "leaf", "n", "s")
        done = closed if done is None else done.unionByName(closed)
        up = now.where(small).withColumns({"leaf": F.shiftright("leaf", 1), "level": F.col("level") + 1})
        now = cut(up.groupBy(*keys, "level", "leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("_least").alias("_least"), F.max("_top").alias("_top")))
        if now.isEmpty():
            return done if by else done.drop("_all")
