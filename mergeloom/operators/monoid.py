"""Monoids of any Python value, with partial results in every task.

``Agg`` covers what native aggregates can say. A ``Monoid`` is for the rest: its
states are Python values, and three functions say what to do with them. Rows
become states where they lie: a task keeps a state a group, at most ``held`` of
them, and lets states go as binary values, so what shuffles are states and not
rows. They merge by key in a stream of sorted rows, one state at a time. States
are a table like any other partial result: stored, merged later, presented last.

Where the order matters, rows are ranged by (group, order) over the cluster:
each task folds the stretch of a group that it has, and the stretches' states
merge in order. A group may be far larger than a task's memory; only a state may
not. The same stretches give running results: each starts from the merged states
of all before it.

Null keys are one group, and so are NaN keys. Groups are as fine as their key's
values; without a key everything is one group, and empty input gives ``zero`` if
the monoid has one.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from mergeloom.operators.ordered import _group
from mergeloom.session import ship
from mergeloom.sources import tables

#: States that a task keeps, states that merge at once.
HELD, AT_ONCE = 10_000, 64


@dataclass(frozen=True)
class Monoid:
    """``prepare`` makes a state of a row's values, ``plus`` one of two,
    ``present`` a tuple of results. ``append`` takes a row into a state at less
    cost than preparing it, ``total`` merges several states at once, and ``bulk``
    takes the Arrow columns of many rows into a state (or None) at once. ``plus``
    must be associative; it need not commute where an order is given. States
    that are appended to may change in place."""

    prepare: Callable[..., Any]
    plus: Callable[[Any, Any], Any]
    present: Callable[[Any], tuple] = lambda state: (state,)
    zero: Callable[[], Any] | None = None
    append: Callable[..., Any] | None = None
    total: Callable[[list], Any] | None = None
    bulk: Callable[[Any, list[pa.Array]], Any] | None = None
    dumps: Callable[[Any], bytes] = pickle.dumps
    loads: Callable[[bytes], Any] = pickle.loads

    def taken(self, state: Any, row: tuple) -> Any:
        return self.append(state, *row) if self.append else self.plus(state, self.prepare(*row))

    def sum(self, states: list) -> Any:
        if self.total:
            return self.total(states)
        out = states[0]
        for s in states[1:]:
            out = self.plus(out, s)
        return out


def _stored(df: DataFrame, by: Sequence[str], *more: StructField) -> StructType:
    return StructType([*(df.schema[c] for c in by), *more, StructField("_state", BinaryType())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, tuple]]:
    """(key, other values) of each row."""
    for b in batches:
        values = [c.to_pylist() for c in b.columns]
        own = zip(*values[:keys], strict=True) if keys else repeat(())
        yield from zip(own, zip(*values[keys:], strict=True), strict=False)


def _given(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _groups(b: pa.RecordBatch, k: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """(key, other columns) of each group of a batch."""
    if not k:
        yield (), b.columns
        return
    ids = np.zeros(b.num_rows, np.int64)
    for c in b.columns[:k]:
        coded = c.dictionary_encode(null_encoding="encode")
        ids = np.unique(ids * (len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    ends = np.append(np.nonzero(np.diff(ids[order]))[0] + 1, len(order))
    sorted_rows, start = b.take(pa.array(order)), 0
    for end in ends.tolist():
        yield tuple(c[start].as_py() for c in sorted_rows.columns[:k]), [c.slice(start, end - start) for c in sorted_rows.columns[k:]]
        start = end


def partials(df: DataFrame, monoid: Monoid, columns: Sequence[str], by: Sequence[str] = (), held: int = HELD) -> DataFrame:
    """(by, _state): states of the groups in each task, to be merged."""
    ship(df.sparkSession)
    out, k = _stored(df, by), len(by)
    arrow = to_arrow_schema(out)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        if not monoid.bulk:
            yield from _rows(batches, k)
            return
        for b in batches:
            if b.num_rows:
                yield from _groups(b, k)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own: dict[tuple, list] = {}
        for key, row in items(batches):
            group = _group(key)
            if group in own:
                own[group][1] = monoid.bulk(own[group][1], row) if monoid.bulk else monoid.taken(own[group][1], row)
                continue
            if len(own) >= held:
                yield from ((*key, monoid.dumps(s)) for key, s in own.values())
                own = {}
            own[group] = [key, monoid.bulk(None, row) if monoid.bulk else monoid.prepare(*row)]
        yield from ((*key, monoid.dumps(s)) for key, s in own.values())

    return df.select(*by, *columns).mapInArrow(lambda batches: _given(states(batches), arrow), out)


def merge(stored: DataFrame, monoid: Monoid, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """(by, _state): stored states merged by ``by``, in ``order`` if it matters."""
    out, k = _stored(stored, by), len(by)
    arrow = to_arrow_schema(out)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, key, held = None, (), []
        for own, (state,) in _rows(batches, k):
            if held and (_group(own) != last or len(held) == AT_ONCE):
                merged = monoid.sum(held)
                if _group(own) == last:
                    held = [merged]
                else:
                    yield (*key, monoid.dumps(merged))
                    held = []
            key, last = own, _group(own)
            held.append(monoid.loads(state))
        if held:
            yield (*key, monoid.dumps(monoid.sum(held)))
        elif not k and monoid.zero:
            yield (monoid.dumps(monoid.zero()),)

    rows = stored.select(*by, "_state", *order)
    rows = rows.repartition(*by) if by else rows.coalesce(1)  # a state a task and flush, and no key to part them by
    if by or order:
        rows = rows.sortWithinPartitions(*by, *order)
    return rows.select(*by, "_state").mapInArrow(lambda batches: _given(states(batches), arrow), out)


def append(stored: DataFrame, df: DataFrame, monoid: Monoid, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """New rows taken into stored states; still states."""
    return merge(stored.unionByName(partials(df, monoid, columns, by)), monoid, by)


def present(stored: DataFrame, monoid: Monoid, schema: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, results) of merged states; ``schema`` names the results."""
    out, k = StructType([*(stored.schema[c] for c in by), *StructType.fromDDL(schema)]), len(by)
    arrow = to_arrow_schema(out)
    run = lambda batches: _given(((*key, *monoid.present(monoid.loads(s))) for key, (s,) in _rows(batches, k)), arrow)
    return stored.select(*by, "_state").mapInArrow(run, out)


def aggregate(df: DataFrame, monoid: Monoid, columns: Sequence[str], schema: str, by: Sequence[str] = (), held: int = HELD) -> DataFrame:
    """(by, results): any monoid's sum of the rows, whatever their order."""
    return present(merge(partials(df, monoid, columns, by, held), monoid, by), monoid, schema, by)


# In order ----------------------------------------------------------------


def ordered_partials(df: DataFrame, monoid: Monoid, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, _part, _state): the states of stretches; those of a group follow one
    another by ``_part``."""
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return _stretches(rows.select(*by, F.spark_partition_id().cast("long").alias("_part"), *columns), monoid, by)


def _stretches(rows: DataFrame, monoid: Monoid, by: Sequence[str]) -> DataFrame:
    """Of rows (by, _part, columns) that come in order."""
    ship(rows.sparkSession)
    out, k = _stored(rows, by, StructField("_part", LongType())), len(by) + 1
    arrow = to_arrow_schema(out)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, key, state = None, None, None
        for own, row in _rows(batches, k):
            if key is not None and _group(own) == last:
                state = monoid.taken(state, row)
                continue
            if key is not None:
                yield (*key, monoid.dumps(state))
            key, last, state = own, _group(own), monoid.prepare(*row)
        if key is not None:
            yield (*key, monoid.dumps(state))

    return rows.mapInArrow(lambda batches: _given(states(batches), arrow), out)


def reduce_ordered(df: DataFrame, monoid: Monoid, columns: Sequence[str], order: Sequence[str], schema: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, results): the rows of each group combined in order, in as many
    tasks as there are ranges."""
    return present(merge(ordered_partials(df, monoid, columns, order, by), monoid, by, ["_part"]), monoid, schema, by)


def scan_ordered(df: DataFrame, monoid: Monoid, columns: Sequence[str], order: Sequence[str], schema: str, by: Sequence[str] = (), cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """(by, order, columns, results): beside each row the result of its group's
    rows up to it. Rows are ranged and written once (``cut``), with their places."""
    names = list(dict.fromkeys([*by, *order, *columns]))
    rows = df.select(*names).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    by_part = rows.repartition("_part").sortWithinPartitions("_part", "_at")
    ends = cut(_stretches(by_part.select(*by, "_part", *columns), monoid, by))
    begins = _begins(ends, monoid, by)
    both = rows.withColumn("_state", F.lit(None).cast("binary")).unionByName(begins.withColumn("_at", F.lit(-1).cast("long")), allowMissingColumns=True)
    # A range's rows are in the order of their groups, so a group's start belongs before them all.
    both = both.repartition("_part").sortWithinPartitions("_part", *by, "_at")
    own, k = StructType([*(df.schema[c] for c in names), *StructType.fromDDL(schema)]), len(by)
    arrow, width = to_arrow_schema(own), len(names)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, state, started = None, None, False
        for key, row in _rows(batches, k + 1):
            begin, shown, values = row[0], row[1 : 1 + width], row[1 + width :]
            if _group(key) != last:
                last, started = _group(key), False
            if begin is not None:
                state, started = monoid.loads(begin), True
                continue
            state = monoid.taken(state, values) if started else monoid.prepare(*values)
            started = True
            # What is presented must not change with later rows: results are plain values.
            yield (*shown, *monoid.present(state))

    return both.select("_part", *by, "_state", *names, *columns).toDF(*[f"_{i}" for i in range(2 + k + width + len(columns))]).mapInArrow(lambda batches: _given(results(batches), arrow), own)


def _begins(ends: DataFrame, monoid: Monoid, by: Sequence[str]) -> DataFrame:
    """(by, _part, _state): the merged states before each stretch but a group's
    first one."""
    out, k = _stored(ends, by, StructField("_part", LongType())), len(by)
    arrow = to_arrow_schema(out)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, sofar = None, None
        for key, (part, state) in _rows(batches, k):
            if sofar is not None and _group(key) == last:
                yield (*key, part, sofar)
                sofar = monoid.dumps(monoid.plus(monoid.loads(sofar), monoid.loads(state)))
            else:
                last, sofar = _group(key), state

    rows = ends.select(*by, "_part", "_state")
    rows = rows.repartition(*by) if by else rows.coalesce(1)  # a row a range
    return rows.sortWithinPartitions(*by, "_part").mapInArrow(lambda batches: _given(states(batches), arrow), out)


# Some monoids --------------------------------------------------------------


def of_reduce(combine: Callable[[Any, Any], Any]) -> Monoid:
    """Any associative function of two values as a semigroup; nulls are left out."""
    plus = lambda a, b: b if a is None else a if b is None else combine(a, b)
    return Monoid(lambda x: x, plus)


def appended(first: Callable[..., Any], append: Callable[..., Any], plus: Callable[[Any, Any], Any], present: Callable[[Any], tuple] = lambda s: (s,), zero: Callable[[], Any] | None = None) -> Monoid:
    """A state made of the first row, to which others are appended."""
    return Monoid(first, plus, present, zero, append)


#: y = slope * x + offset, the first row's function applied first: (slope, offset).
affine = Monoid(lambda slope, offset: (slope, offset), lambda f, g: (g[0] * f[0], g[0] * f[1] + g[1]), lambda s: s, lambda: (1.0, 0.0))

#: The product of whole numbers of any size, as decimal digits.
big_product = Monoid(lambda x: 1 if x is None else x, lambda a, b: a * b, lambda p: (_digits(p),), lambda: 1)

#: The values of a group in order, nulls left out. The list is the group's result.
listed = Monoid(lambda x: [] if x is None else [x], lambda a, b: a + b, zero=list, append=lambda s, x: s if x is None else s.append(x) or s)


def _digits(n: int) -> str:
    if hasattr(sys, "set_int_max_str_digits"):
        sys.set_int_max_str_digits(0)
    return str(n)
