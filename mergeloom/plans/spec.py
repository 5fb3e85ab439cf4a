"""``Agg``: one definition of a statistic, several plans.

An aggregation is *prepare* (input columns), *combine* (parts, each a native
aggregate with the aggregate that merges stored values of it) and *present* (an
expression over the parts). From the one definition come

* ``aggregate``: one ``groupBy().agg()`` for any number of aggregations, so one
  HashAggregate with map-side partials and one exchange;
* ``over``: the same parts as window functions, running or sliding;
* ``buffers``, ``merge`` and ``present_buffers``: parts stored as a table, merged
  later with others, presented last.

Central statistics (moments, correlations) merge about the merged mean, which no
sum of parts gives in one pass. They name their ``centers``, sums over the parts
that give it; ``merge`` adds those up by group first and joins them back.

A part has a ``zero`` if it comes from a monoid: empty input then presents the
zero. Without one the result of empty input is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

Inputs = tuple[Column, ...]


@dataclass(frozen=True)
class Part:
    """A column of the buffer."""

    name: str
    update: Callable[[Inputs], Column]
    merge: Callable[[Column], Column]
    zero: object = None
    #: The same over a window, for updates that combine several aggregates.
    windowed: Callable[[Inputs, WindowSpec], Column] | None = None

    def over(self, inputs: Inputs, window: WindowSpec) -> Column:
        return self.windowed(inputs, window) if self.windowed else self.update(inputs).over(window)

    def value(self, column: Column) -> Column:
        return column if self.zero is None else F.coalesce(column, self.zero if isinstance(self.zero, Column) else F.lit(self.zero))


@dataclass(frozen=True)
class Agg:
    """An aggregation over ``inputs``; see the module's text."""

    inputs: Inputs
    parts: tuple[Part, ...]
    present: Callable[[Sequence[Column]], Column]
    #: Over the parts: is the buffer the monoid's zero? None without a zero.
    is_zero: Callable[[Sequence[Column]], Column] | None = None
    #: Aggregates over the parts whose values ``merge_about`` needs by group.
    centers: Callable[[Sequence[Column]], Sequence[Column]] | None = None
    #: (parts, centers): the merged parts, in place of the parts' own merges.
    merge_about: Callable[[Sequence[Column], Sequence[Column]], Sequence[Column]] | None = None

    def updates(self) -> list[Column]:
        return [p.value(p.update(self.inputs)) for p in self.parts]

    def column(self) -> Column:
        """The whole aggregation as one column for ``agg()``."""
        return self.present(self.updates())

    def over(self, window: WindowSpec) -> Column:
        return self.present([p.value(p.over(self.inputs, window)) for p in self.parts])

    # Combinators -------------------------------------------------------

    def compose_prepare(self, f: Callable[[Column], Column]) -> Agg:
        """Apply ``f`` to every input before aggregating."""
        return replace(self, inputs=tuple(f(x) for x in self.inputs))

    def and_then_present(self, f: Callable[[Column], Column]) -> Agg:
        present = self.present
        return replace(self, present=lambda parts: f(present(parts)))

    def filter_before(self, predicate: Column) -> Agg:
        """Only rows that satisfy the predicate count."""
        return replace(self, inputs=tuple(F.when(predicate, x) for x in self.inputs))

    def collect_before(self, defined: Column, f: Callable[[Column], Column]) -> Agg:
        """A partial function: where it is defined, ``f`` of the input counts."""
        return self.compose_prepare(lambda x: F.when(defined, f(x)))

    def lift(self) -> Agg:
        """NULL instead of the zero on empty input."""
        return replace(self, parts=tuple(replace(p, zero=None) for p in self.parts), is_zero=None)

    def join(self, *others: Agg, names: Sequence[str] | None = None) -> Agg:
        """Several aggregations in one pass; presents a struct ``_1``, ``_2`` ..."""
        return struct_of(dict(zip(names or [f"_{i + 1}" for i in range(len(others) + 1)], (self, *others), strict=True)))

    #: Aggregations of different inputs pair up the same way.
    zip = join

    def either(self, other: Agg, is_left: Column) -> Agg:
        """Rows of the left side to this one, the others to ``other``."""
        return struct_of({"left": self.filter_before(is_left), "right": other.filter_before(~is_left)})


def struct_of(aggs: Mapping[str, Agg]) -> Agg:
    """Named aggregations as one that presents a struct of theirs."""
    inputs: list[Column] = []
    parts: list[Part] = []
    spans: list[tuple[str, Agg, int, int]] = []
    for name, agg in aggs.items():
        at, first = len(inputs), len(parts)
        inputs += agg.inputs
        for p in agg.parts:
            update = lambda xs, p=p, at=at, n=len(agg.inputs): p.update(xs[at : at + n])
            windowed = p.windowed and (lambda xs, w, p=p, at=at, n=len(agg.inputs): p.windowed(xs[at : at + n], w))
            parts.append(Part(f"{name}_{p.name}", update, p.merge, p.zero, windowed))
        spans.append((name, agg, first, len(parts)))
    present = lambda cols: F.struct(*[a.present(cols[i:j]).alias(n) for n, a, i, j in spans])
    zeros = all(a.is_zero for a in aggs.values())
    is_zero = (lambda cols: _all([a.is_zero(cols[i:j]) for _, a, i, j in spans])) if zeros else None
    central = [(a, i, j) for _, a, i, j in spans if a.centers]
    if not central:
        return Agg(tuple(inputs), tuple(parts), present, is_zero)

    def centers(cols: Sequence[Column]) -> list[Column]:
        return [c for a, i, j in central for c in a.centers(cols[i:j])]

    def merge_about(cols: Sequence[Column], about: Sequence[Column]) -> list[Column]:
        out, at = [], 0
        for _, a, i, j in spans:
            if a.centers:
                n = len(a.centers(cols[i:j]))
                out += a.merge_about(cols[i:j], about[at : at + n])
                at += n
            else:
                out += [p.merge(c) for p, c in zip(a.parts, cols[i:j], strict=True)]
        return out

    return Agg(tuple(inputs), tuple(parts), present, is_zero, centers, merge_about)


def map_of(aggs: Mapping[str, Agg]) -> Agg:
    """Named aggregations of one result type, presented as a map."""
    inner = struct_of(aggs)
    as_map = lambda s: F.create_map(*[x for n in aggs for x in (F.lit(n), s[n])])
    return inner.and_then_present(as_map)


def array_of(aggs: Sequence[Agg]) -> Agg:
    """A sequence of aggregations, presented as an array."""
    inner = struct_of({f"_{i + 1}": a for i, a in enumerate(aggs)})
    return inner.and_then_present(lambda s: F.array(*[s[f"_{i + 1}"] for i in range(len(aggs))]))


def _all(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


# Plans -----------------------------------------------------------------


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of keys by which nulls are equal, as they are in a grouping."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def aggregate(df: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str | Column] = ()) -> DataFrame:
    """All aggregations in one pass, grouped by ``by`` or over everything."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*[a.column().alias(n) for n, a in aggs.items()])


def aggregate_or_raise(df: DataFrame, aggs: Mapping[str, Agg]) -> DataFrame:
    """Over everything; on input without rows an aggregation without zero raises."""
    out = df.agg(F.count(F.lit(1)).alias("_rows"), *[a.column().alias(n) for n, a in aggs.items()])
    raising = lambda n: F.when(F.col("_rows") == 0, F.raise_error(F.lit(f"{n}: empty input"))).otherwise(F.col(n)).alias(n)
    return out.select(*[raising(n) if all(p.zero is None for p in a.parts) else F.col(n) for n, a in aggs.items()])


def buffers(df: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str]) -> DataFrame:
    """The parts themselves, a column each, to be stored and merged later."""
    return df.groupBy(*by).agg(*[p.update(a.inputs).alias(f"{n}__{p.name}") for n, a in aggs.items() for p in a.parts])


def _columns(name: str, agg: Agg) -> list[Column]:
    return [F.col(f"{name}__{p.name}") for p in agg.parts]


def merge(stored: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str] = ()) -> DataFrame:
    """Buffers merged by coarser keys; still buffers. With central statistics
    there is one more aggregation, of the centers, and a join by key of as many
    rows as there are groups; adaptive execution can split a hot group there."""
    centers = [c.alias(f"_{n}_{i}") for n, a in aggs.items() if a.centers for i, c in enumerate(a.centers(_columns(n, a)))]
    rows = stored
    if centers and by:
        about = stored.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(*centers)
        rows = stored.join(about, null_safe(by, [f"_k{i}" for i in range(len(by))]))
    elif centers:
        rows = stored.crossJoin(F.broadcast(stored.agg(*centers)))  # one row
    out = []
    for n, a in aggs.items():
        own = _columns(n, a)
        about = [F.col(f"_{n}_{i}") for i in range(len(a.centers(own)))] if a.centers else []
        merged = a.merge_about(own, about) if a.centers else [p.merge(c) for p, c in zip(a.parts, own, strict=True)]
        out += [m.alias(f"{n}__{p.name}") for m, p in zip(merged, a.parts, strict=True)]
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*out)


def append(stored: DataFrame, df: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str]) -> DataFrame:
    """New rows folded into stored buffers; still buffers."""
    return merge(stored.unionByName(buffers(df, aggs, by)), aggs, by)


def present_buffers(stored: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str] = ()) -> DataFrame:
    """The results of merged buffers."""
    return stored.select(*by, *[a.present([p.value(c) for p, c in zip(a.parts, _columns(n, a), strict=True)]).alias(n) for n, a in aggs.items()])
