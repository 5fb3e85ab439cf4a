"""Count-min sketches as a relation (group, row, col, n): merge is a sum.

Rows go to their cells at once and add up there before they shuffle, so what
crosses the network is at most ``depth`` times ``width`` cells a task and group,
however many different items there are. Estimates for all rows, as heavy hitters
need them, read the cells from one broadcast array of ``depth`` times ``width``
numbers where that is at most ``MOST_CELLS``, so no item shuffles that is not a
hitter; larger sketches join their cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.functions import hashing
from mergeloom.operators.aggregators import LN2
from mergeloom.plans.spec import Agg, buffers, null_safe, present_buffers
from mergeloom.plans.spec import merge as merge_buffers
from mergeloom.sources import tables

SEED = 1
#: Cells, 8 bytes each, of a sketch that is broadcast.
MOST_CELLS = 4_000_000


def depth_for(delta: float) -> int:
    return math.ceil(math.log(1.0 / delta))


def width_for(eps: float) -> int:
    return math.ceil(math.e / eps)


def eps_of(width: int) -> float:
    return math.e / width


def delta_of(depth: int) -> float:
    return math.exp(-depth)


def columns_of(df: DataFrame, x: str, depth: int, width: int, seed: int, family: str = "md5") -> list[Column]:
    """An item's columns, one a row of the sketch: the item is hashed once."""
    return hashing.linear_rows(hashing.fingerprint(x, df.schema[x].dataType, family), depth, width, seed)


def _cells(items: DataFrame, x: str, depth: int, width: int, seed: int, family: str) -> DataFrame:
    """Each item with its column in each row: columns row, col."""
    return items.select("*", F.posexplode(F.array(*columns_of(items, x, depth, width, seed, family))).alias("row", "col"))


def counts(df: DataFrame, x: str, by: Sequence[str] = (), n: Column | None = None) -> DataFrame:
    """(by, x, n): the exact table of counts (or sums of ``n``)."""
    return df.where(F.col(x).isNotNull()).groupBy(*by, x).agg((F.count("*") if n is None else F.sum(n)).alias("n"))


def sketch(df: DataFrame, x: str, depth: int, width: int, by: Sequence[str] = (), n: Column | None = None, seed: int = SEED, family: str = "md5") -> DataFrame:
    """(by, row, col, n): the cells that are not empty."""
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"), *([] if n is None else [n.alias("_n")]))
    # One number a cell is less to group by.
    places = F.array(*[F.lit(r * width) + c for r, c in enumerate(columns_of(rows, "_x", depth, width, seed, family))])
    cells = rows.select(*by, F.explode(places).alias("_at"), *([] if n is None else ["_n"]))
    cells = cells.groupBy(*by, "_at").agg((F.count("*") if n is None else F.sum("_n")).alias("n"))
    return cells.select(*by, F.floor(F.col("_at") / width).cast("int").alias("row"), (F.col("_at") % width).alias("col"), "n")


def dense(cells: DataFrame, depth: int, width: int, by: Sequence[str] = (), of: str = "n", empty: object = 0) -> DataFrame:
    """(by, _cells, total): all cells of a group as one array, row after row, and
    the sum of the first row. Each place's ``empty`` comes before its value, if it
    has one; the last of a place is its cell."""
    kind = cells.schema[of].dataType
    zero = F.lit(empty).cast(kind)
    if by:
        places = cells.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth * width - 1).cast("long"))).alias("k"))
    else:
        places = cells.sparkSession.range(0, depth * width, 1, 1).select(F.col("id").alias("k"))
    counted = cells.select(*by, (F.col("row") * width + F.col("col")).cast("long").alias("k"), F.lit(1).alias("own"), F.col(of).alias("n"))
    both = counted.unionByName(places.select(*by, "k", F.lit(0).alias("own"), zero.alias("n")))
    first = F.sum(F.when(F.col("k") < width, F.col("n"))) if of == "n" else F.lit(None)
    both = (both.groupBy(*by) if by else both.groupBy()).agg(F.array_sort(F.collect_list(F.struct("k", "own", "n"))).alias("c"), F.coalesce(first, zero).alias("total"))
    following = F.concat(F.slice("c", 2, depth * width * 2), F.array(F.lit(None).cast(both.schema["c"].dataType.elementType)))
    last = F.filter(F.arrays_zip(F.col("c").alias("c"), following.alias("next")), lambda z: z["next"].isNull() | (z["next"]["k"] != z["c"]["k"]))
    return both.select(*by, F.transform(last, lambda z: z["c"]["n"]).alias("_cells"), "total")


def _least(cells: Column, columns: list[Column], width: int) -> Column:
    each = [F.get(cells, r * width + c) for r, c in enumerate(columns)]
    return F.least(*each) if len(each) > 1 else each[0]


def estimated(df: DataFrame, cells: DataFrame, x: str, depth: int, width: int, seed: int = SEED, family: str = "md5", by: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with a non-null item, its ``estimate`` and the
    sketch's ``total`` beside it, from one broadcast row a group. The caller has
    counted the groups: their cells together are at most ``MOST_CELLS``."""
    if depth * width > MOST_CELLS:
        raise ValueError(f"a sketch of {depth * width} cells is not broadcast")
    keys = [f"_g{i}" for i in range(len(by))]
    whole = F.broadcast(dense(cells, depth, width, by).withColumnsRenamed(dict(zip(by, keys, strict=True))))
    rows = df.where(F.col(x).isNotNull())
    rows = rows.join(whole, null_safe(by, keys)) if by else rows.crossJoin(whole)  # one row
    return rows.withColumn("estimate", _least(F.col("_cells"), columns_of(df, x, depth, width, seed, family), width)).drop("_cells", *keys)


def merge(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, "row", "col").agg(F.sum("n").alias("n"))


def total(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, total): the number of items, the sum of any row."""
    rows = cells.where("row = 0")
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def frequency(cells: DataFrame, items: DataFrame, x: str, depth: int, width: int, by: Sequence[str] = (), seed: int = SEED, family: str = "md5") -> DataFrame:
    """(by, x, estimate) for each row of ``items`` (by, x), distinct: the least
    cell; an empty cell makes it 0. Without groups small sketches are broadcast;
    others meet their cells, null keys being a group."""
    items = items.select(*by, x).distinct()
    if not by and depth * width <= MOST_CELLS:
        return estimated(items, cells, x, depth, width, seed, family).select(x, "estimate")
    keys = [f"_k{i}" for i in range(len(by))]
    own = cells.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("row").alias("_row"), F.col("col").alias("_col"), "n")
    found = _cells(items, x, depth, width, seed, family).join(own, null_safe([*by, "row", "col"], [*keys, "_row", "_col"]), "left")
    return found.groupBy(*by, x).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def with_bounds(estimates: DataFrame, totals: DataFrame, width: int, depth: int, by: Sequence[str] = ()) -> DataFrame:
    """Estimates with low = max(0, estimate - eps total) and probability."""
    both = estimates.join(totals, list(by)) if by else estimates.join(F.broadcast(totals))
    low = F.greatest(F.lit(0), (F.col("estimate") - eps_of(width) * F.col("total")).cast("long"))
    return both.withColumns({"low": low, "high": F.col("estimate"), "prob": F.lit(1 - delta_of(depth))}).drop("total")


def inner_product(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """(estimate): the least row of summed products."""
    both = a.select("row", "col", F.col("n").alias("_a")).join(b.select("row", "col", F.col("n").alias("_b")), ["row", "col"])
    rows = both.groupBy("row").agg(F.sum(F.col("_a") * F.col("_b")).alias("_p"))
    return rows.agg(F.when(F.count("*") == depth, F.min("_p")).otherwise(0).alias("estimate"))


def second_moment(a: DataFrame, depth: int) -> DataFrame:
    return inner_product(a, a, depth)


def top_pct(df: DataFrame, x: str, depth: int, width: int, pct: float, seed: int = SEED, family: str = "md5") -> DataFrame:
    """(x, estimate): items whose estimate is at least ``pct`` of the total."""
    cells = sketch(df, x, depth, width, seed=seed, family=family)
    if depth * width <= MOST_CELLS:
        rows = estimated(df.select(x), cells, x, depth, width, seed, family)
        return rows.where(F.col("estimate") >= pct * F.col("total")).select(x, "estimate").distinct()
    estimates = frequency(cells, df.where(F.col(x).isNotNull()), x, depth, width, seed=seed, family=family)
    return estimates.join(F.broadcast(total(cells))).where(F.col("estimate") >= pct * F.col("total")).drop("total")


def top_n(df: DataFrame, x: str, depth: int, width: int, n: int, by: Sequence[str] = (), seed: int = SEED, family: str = "md5", cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """(by, x, estimate): the n largest estimates, of each scope if ``by`` is
    given; ties by item. The same whatever the order of merging.

    Any n items of a scope bound the least estimate that can be among them. The
    native sketch of frequent items, a bounded number of candidates a scope in
    each task, names good ones; then every row is estimated where it lies, and only
    items from the bound on shuffle (all distinct ones of a scope without a bound). The cells of all scopes are broadcast for
    that while they are at most ``MOST_CELLS``; with more scopes than that each
    scope's distinct items are estimated."""
    cells = sketch(df, x, depth, width, by, seed=seed, family=family)
    keys, order = [f"_s{i}" for i in range(len(by))], [F.col("estimate").desc(), F.col(x)]
    if by:
        cells = cut(cells)  # its scopes are counted before its cells are read
    scopes = cells.select(*by).distinct().count() if by else 1
    if scopes * depth * width > MOST_CELLS:
        estimates = frequency(cells, df.where(F.col(x).isNotNull()), x, depth, width, by, seed, family)
    else:
        tracked = max(1000, 4 * n)
        known = df.where(F.col(x).isNotNull()).select(*by, x)
        some = (known.groupBy(*by) if by else known.groupBy()).agg(F.call_function("approx_top_k", F.col(x), F.lit(n), F.lit(tracked)).alias("t"))
        some = estimated(some.select(*by, F.explode("t.item").alias(x)), cells, x, depth, width, seed, family, by)
        kth = (some.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]) if by else some.groupBy()).agg(F.when(F.count("*") >= n, F.min("estimate")).otherwise(F.lit(None)).alias("_bound"))
        rows = estimated(known, cells, x, depth, width, seed, family, by)
        # A row a scope; none where no item stands out and the native sketch names none.
        rows = rows.join(F.broadcast(kth), null_safe(by, keys), "left") if by else rows.crossJoin(F.broadcast(kth))
        estimates = rows.where(F.col("_bound").isNull() | (F.col("estimate") >= F.col("_bound"))).select(*by, x, "estimate").distinct()
    if not by:
        return estimates.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return estimates.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


# Sketch map: cells of any mergeable value --------------------------------


def sketch_map(df: DataFrame, x: str, value: Column, depth: int, width: int, by: Sequence[str] = (), seed: int = SEED, family: str = "md5") -> DataFrame:
    """(by, row, col, n): cells sum a value by key; keys merge in them."""
    return sketch(df, x, depth, width, by, value, seed, family)


def heavy_hitters(df: DataFrame, x: str, value: Column, depth: int, width: int, k: int, seed: int = SEED, family: str = "md5") -> DataFrame:
    """(x, estimate): the k keys with the largest estimated sums."""
    cells = sketch(df, x, depth, width, (), value, seed, family)
    return frequency(cells, df.where(F.col(x).isNotNull()), x, depth, width, seed=seed, family=family).orderBy(F.col("estimate").desc(), F.col(x)).limit(k)


def sketch_map_of(df: DataFrame, x: str, agg: Agg, depth: int, width: int, seed: int = SEED, family: str = "md5") -> DataFrame:
    """(row, col, value__...): cells that hold any aggregation's buffer of the
    keys that meet in them. Stored ones merge by ``spec.merge``."""
    rows = df.where(F.col(x).isNotNull())
    return buffers(_cells(rows, x, depth, width, seed, family), {"value": agg}, ["row", "col"])


def merge_map(stored: DataFrame, agg: Agg) -> DataFrame:
    return merge_buffers(stored, {"value": agg}, ["row", "col"])


def map_values(stored: DataFrame, agg: Agg) -> DataFrame:
    """(row, col, n): what the cells' buffers present, in an order that grows."""
    return present_buffers(stored, {"value": agg}, ["row", "col"]).withColumnRenamed("value", "n")


def map_estimates(df: DataFrame, stored: DataFrame, x: str, agg: Agg, depth: int, width: int, seed: int = SEED, family: str = "md5") -> DataFrame:
    """The rows of ``df`` with the ``estimate`` of their key: the least of its
    cells' values. For aggregations whose result never falls when rows are
    added (sums of what is not negative, maxima, counts of distinct values) it
    is the key's own value at least."""
    if depth * width > MOST_CELLS:
        raise ValueError(f"a sketch of {depth * width} cells is not broadcast")
    whole = dense(map_values(stored, agg).withColumnRenamed("n", "v"), depth, width, (), "v", None)
    rows = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(whole.drop("total")))  # one row
    return rows.withColumn("estimate", _least(F.col("_cells"), columns_of(df, x, depth, width, seed, family), width)).drop("_cells")


def map_hitters(df: DataFrame, x: str, agg: Agg, likely: Column, depth: int, width: int, k: int, seed: int = SEED, family: str = "md5") -> DataFrame:
    """(x, estimate): the k keys of the largest estimates. The keys of the rows
    with the largest ``likely`` bound what can be among them; only keys from
    that bound on shuffle."""
    stored = sketch_map_of(df, x, agg, depth, width, seed, family)
    top = df.where(F.col(x).isNotNull()).orderBy(likely.desc()).limit(4 * k).select(x).distinct()
    bound = map_estimates(top, stored, x, agg, depth, width, seed, family).orderBy(F.col("estimate").desc()).limit(k)
    bound = bound.agg(F.when(F.count("*") >= k, F.min("estimate")).alias("_bound"))
    rows = map_estimates(df.select(x), stored, x, agg, depth, width, seed, family).crossJoin(F.broadcast(bound))  # one row
    found = rows.where(F.col("_bound").isNull() | (F.col("estimate") >= F.col("_bound"))).select(x, "estimate").distinct()
    return found.orderBy(F.col("estimate").desc(), F.col(x)).limit(k)


# Decaying counts ---------------------------------------------------------


def decaying(df: DataFrame, x: str, time: str, half_life: float, depth: int, width: int, n: Column | None = None, seed: int = SEED, family: str = "md5") -> tuple[DataFrame, DataFrame]:
    """(cells, latest): cells whose counts halve once a half-life, all as of
    the latest time, a table of one row (ts)."""
    latest = df.agg(F.max(time).alias("ts"))
    rows = df.where(F.col(x).isNotNull()).join(F.broadcast(latest))
    amount = (F.lit(1.0) if n is None else n) * F.exp(-(F.col("ts") - F.col(time)) * (LN2 / half_life))
    return sketch(rows, x, depth, width, (), amount, seed, family), latest


def rescaled(cells: DataFrame, latest: DataFrame, half_life: float, at: float) -> DataFrame:
    """The cells as of another time."""
    factor = F.exp((F.col("ts") - F.lit(float(at))) * (LN2 / half_life))
    return cells.join(F.broadcast(latest)).withColumn("n", F.col("n") * factor).drop("ts")


def merge_decaying(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], half_life: float) -> tuple[DataFrame, DataFrame]:
    """Two decaying sketches as of the later of their times."""
    latest = a[1].union(b[1]).agg(F.max("ts").alias("_now"))
    moved = None
    for cells, own in (a, b):
        rows = cells.join(F.broadcast(own)).join(F.broadcast(latest)).select("row", "col", (F.col("n") * F.exp(-(F.col("_now") - F.col("ts")) * (LN2 / half_life))).alias("n"))
        moved = rows if moved is None else moved.unionByName(rows)
    return merge(moved), latest.withColumnRenamed("_now", "ts")


def scaled(cells: DataFrame, by: float) -> DataFrame:
    return cells.withColumn("n", F.col("n") * by)


def norm(cells: DataFrame, depth: int) -> DataFrame:
    """(norm): the square root of the least row of summed squares."""
    return second_moment(cells, depth).select(F.sqrt("estimate").alias("norm"))


def total_range(cells: DataFrame) -> DataFrame:
    """(low, high): the least and largest row sum, equal but for rounding."""
    rows = cells.groupBy("row").agg(F.sum("n").alias("n"))
    return rows.agg(F.min("n").alias("low"), F.max("n").alias("high"))
