"""Order-sensitive operators that no native window expresses.

Rows are hashed by group, sorted in their partitions and streamed as Arrow
batches through a Python generator with one group's state at a time: a group
may be larger than memory, only its state may not. Values come as Python's own:
nulls are None, 64-bit integers exact. Null keys are one group, and so are NaN
keys. Without a group all rows form one sequence, which is one task's; a scan
that any ``Agg`` expresses should use ``scan.global_scan`` instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from mergeloom.plans.spec import null_safe
from mergeloom.session import ship
from mergeloom.sources import tables

Row = tuple
#: Rows of a group whose gradient steps are composed by themselves.
STRETCH = 50_000


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _group(key: Row) -> Row:
    """The key, equal to itself: NaN is equal to NaN as in a grouping."""
    return tuple("NaN" if x != x else x for x in key) if any(x != x for x in key) else key


def _streamed(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], schema: str, run: Callable[[Iterator[tuple[Row, Row]]], Iterator[tuple]], reverse: bool = False, rows_a_batch: int = 10_000) -> DataFrame:
    """``run`` gets (key, values) in order, group after group."""
    ship(df.sparkSession)
    places = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate([*by, *columns])], *[F.col(o).alias(p) for o, p in zip(order, places, strict=True)])
    k, width, own = len(by), len(by) + len(columns), _arrow(schema)
    keys = [f"_v{i}" for i in range(k)]
    rows = rows.repartition(*keys) if by else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*keys, *[F.col(p).desc() if reverse else F.col(p) for p in places])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Row, Row]]:
        for b in batches:
            for t in zip(*[b.column(i).to_pylist() for i in range(width)], strict=True):
                yield t[:k], t[k:]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), own, strict=True)], schema=own)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for out in run(items(batches)):
            held.append(out)
            if len(held) == rows_a_batch:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return rows.drop(*places).mapInArrow(apply, schema)


def scan_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], schema: str, initial: Any, step: Callable[[Any, Row], tuple[Any, tuple]]) -> DataFrame:
    """A general scan: ``step(state, row)`` gives the next state and the output
    tuple; a row out for each row in, key columns first in ``schema``."""

    def run(items: Iterator[tuple[Row, Row]]) -> Iterator[tuple]:
        state, last = None, object()
        for key, row in items:
            if (group := _group(key)) != last:
                state, last = initial() if callable(initial) else initial, group
            state, out = step(state, row)
            yield (*key, *out)

    return _streamed(df, by, order, columns, schema, run)


def fold_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], schema: str, initial: Any, step: Callable[[Any, Row], Any], end: Callable[[Any], tuple | None], reverse: bool = False) -> DataFrame:
    """A general fold: a row out for each group, or none if ``end`` gives None.
    ``reverse`` begins with the last row."""

    def run(items: Iterator[tuple[Row, Row]]) -> Iterator[tuple]:
        state, last, key, started = None, None, (), False
        for new, row in items:
            if not started or (group := _group(new)) != last:
                if started and (out := end(state)) is not None:
                    yield (*key, *out)
                state, last, key, started = initial() if callable(initial) else initial, _group(new), new, True
            state = step(state, row)
        if started and (out := end(state)) is not None:
            yield (*key, *out)

    return _streamed(df, by, order, columns, schema, run, reverse)


def right_folded(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str, value: str, schema: str, fold: Callable[[Any, Any], Any]) -> DataFrame:
    """Each row is an item to fold or a value to start from (``value`` not
    null). The group's first value counts; the items before it are folded into
    it from the right, nearest first. Groups without a value give no row.

    Rows come last first, so the state is one value: each value starts anew,
    and every item that follows it in this order is folded in at once."""

    def step(state: tuple | None, row: Row) -> tuple | None:
        if row[1] is not None:
            return (row[1],)
        return state and (fold(row[0], state[0]),)

    return fold_groups(df, by, order, [item, value], schema, lambda: None, step, lambda s: s, reverse=True)


def right_folded_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], item: str, value: str, schema: str, fold: Callable[[Any, Any], Any], measure: Callable[[Any], float] = lambda x: x) -> DataFrame:
    """As ``right_folded``, with the sum of a measure of every value, each with
    the items right before it folded in: (by, value, total)."""

    def step(state: tuple, row: Row) -> tuple:
        current, total = state
        if row[1] is not None:
            return (row[1],), total + (measure(current[0]) if current else 0.0)
        return current and (fold(row[0], current[0]),), total

    return fold_groups(df, by, order, [item, value], schema, lambda: (None, 0.0), step, lambda s: (s[0][0], s[1] + measure(s[0][0])) if s[0] else None, reverse=True)


# Gradient descent ----------------------------------------------------------


def linear_gradient(weights: list[float], x: list[float], y: float) -> list[float]:
    """The gradient of the squared error of a linear model, its intercept last."""
    point = [*x, 1.0]
    error = sum(w * v for w, v in zip(weights, point, strict=True)) - y
    return [error * v for v in point]


def constant_step(size: float) -> Callable[[int, list[float]], float]:
    return lambda count, gradient: size


def count_adaptive_step(size: float, decay: float) -> Callable[[int, list[float]], float]:
    """Steps that shrink as a power of the count of steps."""
    return lambda count, gradient: size * float(count + 1) ** -decay


def sgd(df: DataFrame, by: Sequence[str], order: Sequence[str], features: Sequence[str], target: str, initial: Sequence[float], step_size: Callable[[int, list[float]], float], gradient: Callable = linear_gradient, key_schema: str = "") -> DataFrame:
    """(by, count, weights): one pass of gradient steps over each group's rows
    in order, from the initial weights (the intercept last)."""

    def step(state: tuple, row: Row) -> tuple:
        count, weights = state
        g = gradient(weights, list(row[:-1]), row[-1])
        size = step_size(count, g)
        return count + 1, [w - size * d for w, d in zip(weights, g, strict=True)]

    schema = ", ".join(x for x in (key_schema, "count long, weights array<double>") if x)
    return fold_groups(df, by, order, [*features, target], schema, lambda: (0, [float(w) for w in initial]), step, lambda s: (s[0], s[1]))


def linear_sgd(df: DataFrame, by: Sequence[str], order: Sequence[str], features: Sequence[str], target: str, initial: Sequence[float], step_size: Callable[[int, list[float]], float], key_schema: str = "", cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """(by, count, weights): ``sgd`` with ``linear_gradient`` and steps whose size
    depends on their count alone, in as many tasks as there are stretches.

    Such a step is an affine function of the weights, so stretches of a group's
    rows are composed by themselves, up to rounding, and only one matrix of each
    goes on to the group's fold. Rows are ranged and written once (``cut``) for
    their places in the group."""
    ship(df.sparkSession)
    keys, k, xs, d = [f"_k{i}" for i in range(len(by))], len(by), [f"_x{i}" for i in range(len(features))], len(features) + 1
    places = [f"_o{i}" for i in range(len(order))]
    named = [F.col(c).alias(n) for c, n in zip([*by, *order, *features, target], [*keys, *places, *xs, "_y"], strict=True)]
    rows = df.select(*named).repartitionByRange(*keys, *places).sortWithinPartitions(*keys, *places)
    rows = cut(rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in (*xs, "_y")], F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)))
    own = [f"_g{i}" for i in range(k)]
    runs = rows.groupBy(*[F.col(c).alias(g) for c, g in zip(keys, own, strict=True)], F.col("_part").alias("_in")).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*own).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = rows.join(runs, null_safe([*keys, "_part"], [*own, "_in"])).select(*keys, (F.col("_before") + F.col("_at") - F.col("_from")).alias("_n"), *xs, "_y")
    rows = rows.withColumn("_stretch", F.floor(F.col("_n") / STRETCH)).select(*keys, "_stretch", "_n", *xs, "_y")
    rows = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_n")
    out = StructType([*(rows.schema[c] for c in (*keys, "_stretch")), StructField("_rows", LongType()), StructField("_m", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(out)

    def matrix(n: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The steps as one matrix, which acts on the weights and a 1."""
        size = np.array([step_size(c, []) for c in n])[:, None]
        point = np.hstack([x, np.ones((len(x), 1))])
        steps = np.zeros((len(x), d + 1, d + 1))
        steps[:, :d, :d] = np.eye(d) - (size * point)[:, :, None] * point[:, None, :]
        steps[:, :d, d], steps[:, d, d] = size * point * y[:, None], 1.0
        while len(steps) > 1:
            both = np.matmul(steps[1::2], steps[: len(steps) // 2 * 2 : 2])
            steps = np.concatenate([both, steps[-1:]]) if len(steps) % 2 else both
        return steps[0]

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, key, count, whole = None, (), 0, None
        for b in batches:
            if any(b.column(i).null_count for i in range(k + 2, b.num_columns)):
                raise ValueError("a feature or a target is null")
            x, y, n = np.stack([b.column(i).to_numpy() for i in range(k + 2, k + 2 + d - 1)], 1) if d > 1 else np.zeros((b.num_rows, 0)), b.column(k + 1 + d).to_numpy(), b.column(k + 1).to_pylist()
            start = 0
            for new, run in groupby(zip(*[b.column(i).to_pylist() for i in range(k + 1)], strict=True), _group):
                first = next(run)
                end = start + 1 + sum(1 for _ in run)
                part = matrix(n[start:end], x[start:end], y[start:end])
                if whole is not None and new == last:
                    count, whole = count + end - start, part @ whole
                else:
                    if whole is not None:
                        yield (*key, count, whole.ravel().tolist())
                    last, key, count, whole = new, first, end - start, part
                start = end
        if whole is not None:
            yield (*key, count, whole.ravel().tolist())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in composed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    def step(state: tuple, row: Row) -> tuple:
        count, weights = state
        return count + row[0], (np.array(row[1]).reshape(d + 1, d + 1) @ [*weights, 1.0])[:d].tolist()

    schema = ", ".join(x for x in (key_schema, "count long, weights array<double>") if x)
    return fold_groups(rows.mapInArrow(written, out), keys, ["_stretch"], ["_rows", "_m"], schema, lambda: (0, [float(w) for w in initial]), step, lambda s: (s[0], s[1]))


def sgd_in_parts(df: DataFrame, by: Sequence[str], features: Sequence[str], target: str, initial: Sequence[float], step_size: Callable[[int, list[float]], float], gradient: Callable = linear_gradient) -> DataFrame:
    """(by, count, weights): each task makes its own pass from the initial
    weights over the rows that it has, and the models are averaged by their counts
    of steps. No rows shuffle; the result depends on how they are dealt."""
    from mergeloom.operators import monoid

    def step(state: tuple, *row: Any) -> tuple:
        count, weights = state
        g = gradient(weights, list(row[:-1]), row[-1])
        size = step_size(count, g)
        return count + 1, [w - size * d for w, d in zip(weights, g, strict=True)]

    def average(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        return n, [(a[0] * x + b[0] * y) / n for x, y in zip(a[1], b[1], strict=True)]

    models = monoid.Monoid(lambda *row: step((0, [float(w) for w in initial]), *row), average, lambda s: s, append=step)
    return monoid.aggregate(df, models, [*features, target], "count long, weights array<double>", by)


def averaged_weights(models: DataFrame) -> DataFrame:
    """(count, weights): models averaged by their counts of steps."""
    rows = models.select("count", F.posexplode("weights").alias("i", "w")).groupBy("i")
    means = rows.agg((F.sum(F.col("w") * F.col("count")) / F.sum("count")).alias("w"), F.sum("count").alias("count"))
    return means.agg(F.max("count").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("weights"))


# Heavy hitters with bounded counters ---------------------------------------


def space_saver_partials(df: DataFrame, x: str, capacity: int, item_type: str = "string") -> DataFrame:
    """(part, item, n, err, least): each partition's counters, ``capacity`` at
    most. A new item takes the place of the least one and inherits its count
    as its possible error; ``least`` is that bound for items not listed."""
    if capacity < 2:
        raise ValueError("the capacity must be above 1")
    ship(df.sparkSession)

    schema = f"part int, item {item_type}, n long, err long, least long"
    own = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        counters: dict[Any, list[int]] = {}
        heap: list[tuple[int, int, Any]] = []
        part, serial = 0, 0
        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            for item, n in Counter(b.column(1).to_pylist()).items():
                if item in counters:
                    counters[item][0] += n
                    continue
                err = 0
                if len(counters) >= capacity:
                    while True:
                        count, _, old = heapq.heappop(heap)
                        if old not in counters:
                            continue
                        if counters[old][0] == count:
                            break
                        serial += 1
                        heapq.heappush(heap, (counters[old][0], serial, old))
                    err = count
                    del counters[old]
                counters[item] = [err + n, err]
                serial += 1
                heapq.heappush(heap, (err + n, serial, item))
        if counters:
            least = min(c for c, _ in counters.values()) if len(counters) >= capacity else 0
            held = [(part, k, c, e, least) for k, (c, e) in counters.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), own, strict=True)], schema=own)

    rows = df.where(F.col(x).isNotNull()).select(F.spark_partition_id().alias("part"), F.col(x).cast(item_type).alias("item"))
    return rows.mapInArrow(run, schema)


def space_saver_merge(partials: DataFrame, capacity: int) -> DataFrame:
    """(item, low, n, high, guaranteed): partial counters added up. Where a
    part does not list an item, its bound counts as count and error. ``n`` and
    ``high`` are the upper bound, ``low`` what is certain."""
    bound = partials.groupBy("part").agg(F.max("least").alias("least")).agg(F.coalesce(F.sum("least"), F.lit(0)).alias("_all"))
    own = partials.groupBy("item").agg(F.sum(F.col("n") - F.col("least")).alias("n"), F.sum(F.col("err") - F.col("least")).alias("err"))
    added = own.join(F.broadcast(bound)).select("item", (F.col("n") + F.col("_all")).alias("n"), (F.col("err") + F.col("_all")).alias("err"))
    top = added.orderBy(F.col("n").desc(), "err", "item").limit(capacity)
    return top.select("item", (F.col("n") - F.col("err")).alias("low"), "n", F.col("n").alias("high"), (F.col("err") == 0).alias("guaranteed"))


def space_saver(df: DataFrame, x: str, capacity: int, item_type: str = "string") -> DataFrame:
    return space_saver_merge(space_saver_partials(df, x, capacity, item_type), capacity)


def most_frequent(saver: DataFrame, threshold: int) -> DataFrame:
    """Items that may occur ``threshold`` times or more, and whether they must."""
    return saver.where(F.col("n") >= threshold).withColumn("guaranteed", F.col("low") >= threshold)


def saver_top_k(saver: DataFrame, k: int) -> DataFrame:
    """The k most frequent; guaranteed if no other can be among them."""
    rows = saver.orderBy(F.col("n").desc(), "item").limit(k + 1)
    ranked = rows.withColumn("_k", F.row_number().over(Window.orderBy(F.col("n").desc(), "item")))
    following = ranked.agg(F.coalesce(F.max(F.when(F.col("_k") == k + 1, F.col("n"))), F.lit(0)).alias("_next"))
    return ranked.where(F.col("_k") <= k).join(F.broadcast(following)).withColumn("guaranteed", F.col("low") >= F.col("_next")).drop("_k", "_next")


def consistent_with(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do the bounds of all items in both summaries meet?"""
    both = a.select("item", F.col("low").alias("_l"), F.col("high").alias("_h")).join(b, "item")
    return both.agg(F.coalesce(F.bool_and((F.col("_l") <= F.col("high")) & (F.col("low") <= F.col("_h"))), F.lit(True)).alias("consistent"))
