"""Scans and sliding windows: aggregations along an order.

A scan gives an output for each row. All scans of one order share a window
specification, so Spark sorts once. Any ``Agg`` can run as a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from mergeloom.plans.spec import Agg
from mergeloom.sources import tables


def ordered(order: Sequence[str | Column], by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def index(w: WindowSpec) -> Column:
    """0 for the first row."""
    return F.row_number().over(w) - 1


def cumulative(agg: Agg, w: WindowSpec) -> Column:
    """The aggregation of all rows up to this one."""
    return agg.over(_running(w))


def from_aggregator(agg: Agg, w: WindowSpec, initial: Column | None = None) -> Column:
    """A running sum-like aggregation that starts from ``initial``."""
    running = agg.over(_running(w))
    return running if initial is None else initial + running


def prior_state(agg: Agg, w: WindowSpec, initial: object = None) -> Column:
    """The state before this row: the aggregation of all earlier rows."""
    before = agg.over(_before(w))
    return before if initial is None else F.coalesce(before, F.lit(initial))


def posterior_state(agg: Agg, w: WindowSpec) -> Column:
    return cumulative(agg, w)


def exclusive_sum(x: str, w: WindowSpec, zero: object = 0) -> Column:
    """What the sum was before this row came."""
    return F.coalesce(F.sum(x).over(_before(w)), F.lit(zero))


def trailing(agg: Agg, n: int, w: WindowSpec) -> Column:
    """The aggregation of the last n rows, this one included."""
    return agg.over(w.rowsBetween(-(n - 1), 0))


def trailing_items(x: str, n: int, w: WindowSpec) -> Column:
    return F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))


def trailing_sum_by_difference(x: str, n: int, w: WindowSpec) -> Column:
    """The sum of the last n rows as the difference of two running sums, for
    frames so wide that adding up each anew costs more. Exact for integers."""
    running = F.sum(x).over(_running(w))
    return running - F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -n)), F.lit(0))


def last_n(df: DataFrame, aggs: Mapping[str, Agg], n: int, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, aggs): aggregations of each group's last n rows."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    top = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
    return top.groupBy(*by).agg(*[a.column().alias(k) for k, a in aggs.items()])


def scan(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """The rows with scans beside them, all in one pass over one order."""
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def zip_scans(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Two inputs side by side: the k-th row of each with the k-th of the other.
    Other columns must bear different names."""
    a = left.withColumn("_k", F.row_number().over(ordered(order_left, by)))
    b = right.withColumn("_k", F.row_number().over(ordered(order_right, by)))
    return a.join(b, [*by, "_k"]).withColumn("index", F.col("_k") - 1).drop("_k")


def iterate_arithmetic(start: float, step: float, w: WindowSpec) -> Column:
    """The sequence start, start + step, ... along the order."""
    return F.lit(start) + index(w) * F.lit(step)


def iterate_geometric(start: float, ratio: float, w: WindowSpec) -> Column:
    return F.lit(start) * F.pow(F.lit(float(ratio)), index(w).cast("double"))


def global_scan(df: DataFrame, aggs: Mapping[str, Agg], order: Sequence[str], rank: Column, chunks: int | None = None) -> DataFrame:
    """Running aggregations of the whole table in order, in many tasks.

    ``rank`` is a number that never falls along the order. The table is cut
    into ``chunks`` ranges of equal size by approximate quantiles of it (default:
    one for each million rows, two for each core at least); each range's
    buffers are merged, each range begins with the buffers of all before it,
    and a window runs within each range. Two shuffles of the rows' range, none
    of them to a single task but for a row a range. Results stand beside the
    rows under the aggregations' names; their parts must merge from rows."""
    if alone := [n for n, a in aggs.items() if a.centers]:
        raise ValueError(f"{alone}: central statistics merge by spec.merge only")
    if chunks is None:
        chunks = min(10_000, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // 1_000_000)))
    probabilities = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(rank, probabilities, 10_000).alias("b")).first().b or []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<double>"), lambda b: b <= rank.cast("double"))) if bounds else F.lit(0)
    names = df.columns
    flat = df.withColumn("_chunk", at)
    single = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(0, 0)
    parts = {f"_{n}__{p.name}": (a, p) for n, a in aggs.items() for p in a.parts}
    rows = flat.select("*", F.lit(1).alias("_real"), *[p.update(a.inputs).over(single).alias(c) for c, (a, p) in parts.items()])
    totals = flat.groupBy("_chunk").agg(*[p.update(a.inputs).alias(c) for c, (a, p) in parts.items()])
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("_chunk", F.lit(0).alias("_real"), *[p.merge(F.col(c)).over(before).alias(c) for c, (_, p) in parts.items()])
    both = rows.unionByName(heads, allowMissingColumns=True)
    running = Window.partitionBy("_chunk").orderBy("_real", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.select(*names, "_real", *[p.value(p.merge(F.col(c)).over(running)).alias(c) for c, (_, p) in parts.items()]).where("_real = 1")
    return merged.select(*names, *[a.present([F.col(f"_{n}__{p.name}") for p in a.parts]).alias(n) for n, a in aggs.items()])


# Windows of the whole table, in many tasks ----------------------------------


def global_index(df: DataFrame, order: Sequence[str], name: str = "index", cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """The rows with their number from 0 in a total order of the whole table.

    Rows are ranged by the order and written once (``cut``) with their places in
    the range; what lies before a range is a sum of counts, of which the driver
    holds one a range."""
    at, ranges = F.col("_at"), F.shiftright("_at", 33)  # how Spark numbers rows: task, then row
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    before, rows = 0, []
    for r, n in sorted(map(tuple, placed.groupBy(ranges.alias("_range")).agg(F.count("*").alias("_n")).collect())):
        rows.append((r, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_range long, _before long")
    return placed.join(F.broadcast(starts), ranges == F.col("_range")).withColumn(name, at.bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_at", "_range", "_before")


def global_zip(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str], cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """Two whole tables side by side, by their rows' numbers; columns must bear
    different names. The longer one's rest is left out."""
    return global_index(left, order_left, cut=cut).join(global_index(right, order_right, cut=cut), "index")


def global_trailing(df: DataFrame, aggs: Mapping[str, Agg], n: int, order: Sequence[str], block: int = 1_000_000, cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """The rows with aggregations of the last n rows of the whole table, each
    row's own included.

    Numbered rows are cut into blocks of ``block`` rows (n at least); a block's
    last n - 1 rows also go to the next one, where they are counted but give no
    result. A window runs within each block."""
    if n < 1:
        raise ValueError("a window holds one row at least")
    size = max(n, block)
    rows = global_index(df, order, "_index", cut)
    own, place = F.floor(F.col("_index") / size), F.col("_index") % size
    dealt = rows.withColumn("_own", own).withColumn("_block", F.explode(F.when(place > size - n, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_block").orderBy("_index").rowsBetween(-(n - 1), 0)
    out = dealt.select(*df.columns, "_own", "_block", *[a.over(w).alias(k) for k, a in aggs.items()])
    return out.where("_own = _block").drop("_own", "_block")
