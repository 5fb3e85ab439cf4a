"""Aggregation constructors: counts, extrema, collections, top-k, statistics.

Order-sensitive ones take the columns that define the order, as the order of
rows in a DataFrame is no property of it. Ties keep the earliest row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.plans.spec import Agg, Inputs, Part, buffers, merge, null_safe

ColumnLike = str | Column


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _key(order: Sequence[ColumnLike]) -> Column:
    return F.struct(*[_c(o) for o in order])


def _one(parts: Sequence[Column]) -> Column:
    return parts[0]


def simple(x: ColumnLike, update: Callable[[Column], Column], merge: Callable[[Column], Column], zero: object = None, is_zero: Callable[[Column], Column] | None = None) -> Agg:
    """One input, one part, presented as it is."""
    return Agg((_c(x),), (Part("value", lambda xs: update(xs[0]), merge, zero),), _one, (lambda p: is_zero(p[0])) if is_zero else None)


# Constants, folds, sums ------------------------------------------------


def const(value: object) -> Agg:
    """The value, whatever the input."""
    return Agg((F.lit(1),), (Part("n", lambda xs: F.count(xs[0]), F.sum, 0),), lambda p: F.lit(value), lambda p: F.lit(False))


def from_reduce(x: ColumnLike, combine: Callable[[Column, Column], Column], order: Sequence[ColumnLike] | None = None) -> Agg:
    """Any associative function of two columns, in ``order`` if it matters.
    For functions that no native aggregate has, within one expression; collects
    the group. ``monoid.of_reduce`` combines in every task instead, and
    ``monoid.reduce_ordered`` does so in order."""
    x = _c(x)
    item = F.struct(*([_key(order).alias("o")] if order else []), x.alias("x"))
    fold = lambda rows: F.reduce(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.element_at(rows, 1)["x"], lambda a, b: combine(a, b["x"]))
    update = lambda xs: F.array_sort(F.collect_list(F.when(xs[0].isNotNull(), item)))
    return Agg((x,), (Part("rows", update, lambda c: F.array_sort(F.flatten(F.collect_list(c)))),), lambda p: F.when(F.size(p[0]) > 0, fold(p[0])))


def fold_left(x: ColumnLike, start: Column, step: Callable[[Column, Column], Column], end: Callable[[Column], Column] | None = None, order: Sequence[ColumnLike] = ()) -> Agg:
    """A sequential fold in ``order`` over the collected group. Steps that are an
    associative function's take ``monoid.reduce_ordered``, which collects none."""
    item = F.struct(_key(order).alias("o"), _c(x).alias("x"))
    run = lambda rows: F.reduce(rows, start, lambda a, r: step(a, r["x"]), end) if end else F.reduce(rows, start, lambda a, r: step(a, r["x"]))
    return Agg((_c(x),), (Part("rows", lambda xs: F.array_sort(F.collect_list(item)), lambda c: F.array_sort(F.flatten(F.collect_list(c)))),), lambda p: run(p[0]))


def append_monoid(x: ColumnLike, update: Callable[[Column], Column], merge: Callable[[Column], Column], zero: object = None, present: Callable[[Column], Column] | None = None) -> Agg:
    """An aggregation from a native one that takes rows in (``update``) and one
    that joins its results (``merge``); without ``zero`` a semigroup's."""
    agg = simple(x, update, merge, zero)
    return agg.and_then_present(present) if present else agg


append_semigroup = append_monoid


def prepared(x: ColumnLike, prepare: Callable[[Column], Column], agg: Callable[[Column], Agg]) -> Agg:
    """Map, then aggregate."""
    return agg(prepare(_c(x)))


def sum_of(x: ColumnLike) -> Agg:
    """The monoid sum: 0 on empty input."""
    return simple(x, F.sum, F.sum, 0, lambda p: p == 0)


def sum_option(x: ColumnLike) -> Agg:
    return simple(x, F.sum, F.sum)


def numeric_sum(x: ColumnLike) -> Agg:
    return simple(_c(x).cast("double"), F.sum, F.sum, 0.0, lambda p: p == 0)


def wrapping_sum(x: ColumnLike) -> Agg:
    """A 64-bit sum that wraps around instead of overflowing."""
    two64, two63 = F.lit("18446744073709551616").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")
    wrap = lambda p: (F.pmod(p[0] + two63, two64) - two63).cast("long")
    return Agg((_c(x),), (Part("wide", lambda xs: F.sum(xs[0].cast("decimal(38,0)")), F.sum, F.lit(0).cast("decimal(38,0)")),), wrap, lambda p: p[0] == 0)


def product_of(x: ColumnLike) -> Agg:
    """The ring product in doubles: 1 on empty input."""
    return simple(x, F.product, F.product, 1.0)


def exact_product(x: ColumnLike) -> Agg:
    """A product of whole numbers without rounding, as far as 64 bits reach; beyond
    them it raises. Collects the group: ``monoid.big_product`` neither collects
    nor ends anywhere."""
    run = lambda rows: F.reduce(rows, F.lit(1).cast("long"), lambda a, b: a * b)
    return Agg((_c(x).cast("long"),), (Part("rows", lambda xs: F.collect_list(xs[0]), lambda c: F.flatten(F.collect_list(c))),), lambda p: run(p[0]))


# Counts and predicates -------------------------------------------------


def size() -> Agg:
    return simple(F.lit(1), F.count, F.sum, 0, lambda p: p == 0)


def count(predicate: Column) -> Agg:
    return simple(predicate, F.count_if, F.sum, 0, lambda p: p == 0)


def exists(predicate: Column) -> Agg:
    return simple(predicate, F.bool_or, F.bool_or, False, lambda p: ~p)


def forall(predicate: Column) -> Agg:
    return simple(predicate, F.bool_and, F.bool_and, True, lambda p: p)


def bool_xor(x: ColumnLike) -> Agg:
    """The sum of the Boolean ring."""
    return Agg((_c(x),), (Part("bit", lambda xs: F.bit_xor(xs[0].cast("int")), F.bit_xor, 0),), lambda p: p[0] == 1, lambda p: p[0] == 0)


def unique_count(x: ColumnLike) -> Agg:
    update = lambda xs: F.collect_set(xs[0])
    return Agg((_c(x),), (Part("set", update, lambda c: F.array_distinct(F.flatten(F.collect_list(c)))),), lambda p: F.size(p[0]).cast("long"))


def unique_count_exact(x: ColumnLike) -> Agg:
    """The same number without a stored set: for ``aggregate`` and ``over``."""

    def refuse(_: Column) -> Column:
        raise ValueError("numbers of distinct values do not merge: use unique_count, or keyed.group and count")

    return simple(x, F.count_distinct, refuse, 0)


# First, last, extrema --------------------------------------------------


def head(x: ColumnLike, order: Sequence[ColumnLike]) -> Agg:
    """The first value in order. The buffer keeps its place in the order."""
    row = lambda xs: F.when(xs[1].isNotNull(), F.struct(xs[1].alias("o"), xs[0].alias("x")))
    return Agg((_c(x), _key(order)), (Part("row", lambda xs: F.min_by(row(xs), xs[1]), lambda c: F.min_by(c, c["o"])),), lambda p: p[0]["x"])


def last(x: ColumnLike, order: Sequence[ColumnLike]) -> Agg:
    row = lambda xs: F.when(xs[1].isNotNull(), F.struct(xs[1].alias("o"), xs[0].alias("x")))
    return Agg((_c(x), _key(order)), (Part("row", lambda xs: F.max_by(row(xs), xs[1]), lambda c: F.max_by(c, c["o"])),), lambda p: p[0]["x"])


def max_of(x: ColumnLike, zero: object = None) -> Agg:
    """The largest value; ``zero`` makes it a monoid (its least value)."""
    return simple(x, F.max, F.max, zero)


def min_of(x: ColumnLike, zero: object = None) -> Agg:
    return simple(x, F.min, F.min, zero)


def _first_by(x: ColumnLike, by: ColumnLike, key: Column) -> Agg:
    """The value with the smallest key; rows without ``by`` do not count."""
    key = F.when(_c(by).isNotNull(), key)
    row = lambda xs: F.when(xs[1].isNotNull(), F.struct(xs[1].alias("o"), xs[0].alias("x")))
    return Agg((_c(x), key), (Part("row", lambda xs: F.min_by(row(xs), xs[1]), lambda c: F.min_by(c, c["o"])),), lambda p: p[0]["x"])


def min_by(x: ColumnLike, by: ColumnLike, order: Sequence[ColumnLike] = ()) -> Agg:
    """The value with the smallest ``by``; ties keep the earliest in order."""
    return _first_by(x, by, _key([by, *order]))


def max_by(x: ColumnLike, by: ColumnLike, order: Sequence[ColumnLike] = ()) -> Agg:
    """The value with the largest ``by``, a number, time, string or binary value;
    ties keep the earliest in order."""
    return _first_by(x, by, _key([_turned(_c(by)), *order]))


def _turned(x: Column) -> Column:
    """A value whose order is the reverse, whatever the type: its negative, or
    its bytes' complements with an end that is above them all. Only the branch of
    the column's own type is left once Spark has resolved it. NaN is the largest."""
    kind, text = F.typeof(x), x.cast("string")
    real, whole, time = kind.isin("float", "double"), kind.isin("tinyint", "smallint", "int", "bigint") | kind.startswith("decimal"), kind.isin("date", "timestamp", "timestamp_ntz")
    value = text.try_cast("double")
    digits = "0123456789ABCDEF"
    return F.struct(
        F.when(real, F.when(F.isnan(value), 0).otherwise(1)).alias("nan"), F.when(real, -value).alias("real"), F.when(whole, -text.try_cast("decimal(38,10)")).alias("whole"),
        F.when(time, -F.unix_micros(text.try_cast("timestamp"))).alias("time"), F.when(~(real | whole | time), F.concat(F.translate(F.hex(text), digits, digits[::-1]), F.lit("g"))).alias("text"),
    )


# Collections -----------------------------------------------------------


def to_list(x: ColumnLike, order: Sequence[ColumnLike]) -> Agg:
    item = F.struct(_key(order).alias("o"), _c(x).alias("x"))
    return Agg((_c(x),), (Part("rows", lambda xs: F.array_sort(F.collect_list(item)), lambda c: F.array_sort(F.flatten(F.collect_list(c)))),), lambda p: p[0]["x"])


def to_set(x: ColumnLike) -> Agg:
    return Agg((_c(x),), (Part("set", lambda xs: F.collect_set(xs[0]), lambda c: F.array_distinct(F.flatten(F.collect_list(c)))),), lambda p: F.array_sort(p[0]))


def concat_strings(x: ColumnLike, order: Sequence[ColumnLike], separator: str = "") -> Agg:
    """The string monoid: concatenation in order, "" on empty input."""
    return to_list(x, order).and_then_present(lambda a: F.array_join(a, separator))


def concat_lists(x: ColumnLike, order: Sequence[ColumnLike]) -> Agg:
    return to_list(x, order).and_then_present(F.flatten)


def union_sets(x: ColumnLike) -> Agg:
    """The union of arrays as sets, sorted."""
    return Agg((_c(x),), (Part("set", lambda xs: F.array_distinct(F.flatten(F.collect_set(xs[0]))), lambda c: F.array_distinct(F.flatten(F.collect_list(c)))),), lambda p: F.array_sort(p[0]))


# Top k -----------------------------------------------------------------


def sort_by_take(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The k first rows in order, of each group or of all, with ``rank`` from 1.
    Grouped it is a row number with a limit pushed below the shuffle, global a
    TakeOrderedAndProject: no group is collected."""
    if not by:
        top = df.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sorted_take(df: DataFrame, k: int, x: str, by: Sequence[str] = ()) -> DataFrame:
    """The k smallest values, ascending, as an array a group."""
    return _values(sort_by_take(df, k, [F.col(x)], by), x, by)


def sorted_reverse_take(df: DataFrame, k: int, x: str, by: Sequence[str] = ()) -> DataFrame:
    """The k largest values, descending, as an array a group."""
    return _values(sort_by_take(df, k, [F.col(x).desc()], by), x, by)


def _values(top: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(x).alias("v"))))
    grouped = top.groupBy(*by) if by else top.groupBy()
    return grouped.agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def top_k(df: DataFrame, k: int, x: str, by: Sequence[str]) -> DataFrame:
    """(by, top): the k smallest values, ascending, as a buffer of at most k.
    The limit by group runs before the shuffle and after it, so no task ever
    holds more than k values of a group."""
    return _values(sort_by_take(df.where(F.col(x).isNotNull()), k, [F.col(x)], by), x, by).withColumnRenamed("values", "top")


def merge_top_k(stored: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Such buffers merged by coarser keys, the same way."""
    return top_k(stored.select(*by, F.explode("top").alias("_x")), k, "_x", by)


# Samples ---------------------------------------------------------------

SEED = 471312384


def hash_unit(seed: int, *columns: ColumnLike) -> Column:
    """A number in [0, 1) from the md5 of the columns' text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def random_sample(df: DataFrame, probability: float, key: Sequence[ColumnLike], seed: int = SEED) -> DataFrame:
    """Each row with the given probability, decided by its key's hash: the
    same rows whatever the partitions."""
    return df.where(hash_unit(seed, *key) < probability)


def reservoir_sample(df: DataFrame, k: int, key: Sequence[ColumnLike], seed: int = SEED) -> DataFrame:
    """k rows, each set of k equally likely, decided by the keys' hashes."""
    return df.orderBy(hash_unit(seed, *key), *[_c(c) for c in key]).limit(k)


# Statistics ------------------------------------------------------------


def averaged(x: ColumnLike, weight: ColumnLike | None = None) -> Agg:
    """(count, mean) as a struct; a row may count ``weight`` times, also a
    negative number of times, which takes earlier rows out again."""
    w = F.lit(1) if weight is None else _c(weight)
    x = _c(x).cast("double")
    parts = (Part("count", lambda xs: F.sum(F.when(xs[0].isNotNull(), xs[1])), F.sum, 0), Part("sum", lambda xs: F.sum(xs[0] * xs[1]), F.sum, 0.0))
    present = lambda p: F.struct(p[0].alias("count"), F.when(p[0] != 0, p[1] / p[0]).otherwise(0.0).alias("mean"))
    return Agg((x, w), parts, present, lambda p: p[0] == 0)


def average(x: ColumnLike) -> Agg:
    return averaged(x).and_then_present(lambda s: s["mean"])


#: Puts an aggregate in its place: as it is in a group, or over a window.
On = Callable[[Column], Column]


def _part(name: str, update: Callable[[Inputs, On], Column], of: str, zero: object = None) -> Part:
    """A part of a central statistic, which is not merged on its own."""

    def refuse(_: Column) -> Column:
        raise ValueError(f"{of} merge by spec.merge only: it needs the merged mean first")

    return Part(name, lambda xs: update(xs, lambda c: c), refuse, zero, lambda xs, w: update(xs, lambda c: c.over(w)))


def _weighted_mean(n: Column, mean: Column) -> Column:
    return F.try_divide(F.sum(n * mean), F.sum(n))


MOMENTS = ("m0", "m1", "m2", "m3", "m4")


def moments(x: ColumnLike) -> Agg:
    """count, mean, variance, stddev (population), skewness and excess kurtosis.
    The buffer is the count, the mean and the central sums of powers 2 to 4,
    which the native one-pass aggregates give and ``spec.merge`` moves to the
    merged mean. A column without values has count 0 and nulls."""

    def central(c: Column, k: int, on: On) -> Column:
        n, var = on(F.count(c)), on(F.var_pop(c))
        if k < 3:
            return (n.cast("double"), on(F.avg(c)), var * n)[k]
        power = on(F.skewness(c)) * n * F.pow(var, F.lit(1.5)) if k == 3 else (on(F.kurtosis(c)) + 3) * n * var * var
        return F.coalesce(power, F.when(n > 0, F.lit(0.0)))

    def merge_about(p: Sequence[Column], about: Sequence[Column]) -> list[Column]:
        n, mean, m2, m3, m4 = p
        d = mean - about[0]
        return [
            F.sum(n), F.max(about[0]), F.sum(m2 + n * d * d), F.sum(m3 + 3 * d * m2 + n * d * d * d),
            F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d),
        ]

    parts = tuple(_part(m, lambda xs, on, k=k: central(xs[0], k, on), "moments", 0.0 if m == "m0" else None) for k, m in enumerate(MOMENTS))
    return Agg((_c(x).cast("double"),), parts, lambda p: F.struct(*[c.alias(n) for n, c in present_moments(p).items()]), None, lambda p: [_weighted_mean(p[0], p[1])], merge_about)


def present_moments(parts: Sequence[Column]) -> dict[str, Column]:
    """The statistics of the columns m0..m4."""
    m0, m1, m2, m3, m4 = parts
    variance = F.try_divide(m2, m0)
    return {
        "count": m0.cast("long"), "mean": m1, "variance": variance, "stddev": F.sqrt(variance),
        "skewness": F.try_divide(m3, m2 * F.sqrt(variance)), "kurtosis": F.try_divide(m0 * m4, m2 * m2) - 3,
    }


def moment_buffers(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """(by, m0..m4): count, mean and central sums of powers, as a table whose
    columns may be scaled or negated."""
    stored = buffers(df, {"m": moments(x)}, by)
    return stored.withColumnsRenamed({f"m__{m}": m for m in MOMENTS})


def merge_moments(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Such tables merged by coarser keys."""
    merged = merge(stored.withColumnsRenamed({m: f"m__{m}" for m in MOMENTS}), {"m": moments("_")}, by)
    return merged.withColumnsRenamed({f"m__{m}": m for m in MOMENTS})


def scale_moments(stored: DataFrame, z: float) -> DataFrame:
    """Moments weighted by z >= 0: the mean stays, all else scales."""
    if z < 0:
        raise ValueError("moments cannot be scaled by a negative number")
    return stored.withColumns({m: F.col(m) * z for m in MOMENTS if m != "m1"})


def negate_moments(stored: DataFrame) -> DataFrame:
    """Negated count and sums; no lawful group element."""
    return stored.withColumns({m: -F.col(m) for m in MOMENTS if m != "m1"})


def combined_mean(n: Column, a: Column, k: Column, b: Column) -> Column:
    """The mean of two groups: the larger group's mean, moved by the other's
    share of the distance, so that a small group costs no precision."""
    share = F.coalesce(F.try_divide(F.least(n, k).cast("double"), (n + k).cast("double")), F.lit(0.0))
    start, other = F.when(n < k, b).otherwise(a), F.when(n < k, a).otherwise(b)
    return F.when(n + k == 0, 0.0).otherwise(start + share * (other - start))


def _pairs(inputs: Inputs, updates: dict[str, Callable[[Inputs, On], Column]], present: Callable[[dict[str, Column]], Column]) -> Agg:
    """Pairs by weight, means and central sums: ``w, mx, my, xx, yy, xy``."""

    def merge_about(p: Sequence[Column], about: Sequence[Column]) -> list[Column]:
        w, mx, my, xx, yy, xy = p
        dx, dy = mx - about[0], my - about[1]
        return [F.sum(w), F.max(about[0]), F.max(about[1]), F.sum(xx + w * dx * dx), F.sum(yy + w * dy * dy), F.sum(xy + w * dx * dy)]

    parts = tuple(_part(n, f, "correlations", 0.0 if n == "w" else None) for n, f in updates.items())
    centers = lambda p: [_weighted_mean(p[0], p[1]), _weighted_mean(p[0], p[2])]
    return Agg(inputs, parts, lambda p: present(dict(zip(updates, p, strict=True))), None, centers, merge_about)


def _correlated(p: dict[str, Column]) -> Column:
    """The correlation of central sums, within -1 and 1 whatever the rounding;
    null if either side does not vary."""
    root = lambda c: F.sqrt(F.greatest(F.lit(0.0), c))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(p["xy"], root(p["xx"]) * root(p["yy"]))))


def correlation(x: ColumnLike, y: ColumnLike) -> Agg:
    """Population co-moments of pairs without a null: count, correlation,
    covariance, least squares (y on x), means, variances and distance = sqrt(1 -
    correlation). Stored buffers merge."""
    both = lambda xs: F.when(xs[1].isNotNull(), xs[0])
    other = lambda xs: F.when(xs[0].isNotNull(), xs[1])
    updates = {
        "w": lambda xs, on: on(F.count(both(xs))).cast("double"), "mx": lambda xs, on: on(F.avg(both(xs))), "my": lambda xs, on: on(F.avg(other(xs))),
        "xx": lambda xs, on: on(F.var_pop(both(xs))) * on(F.count(both(xs))), "yy": lambda xs, on: on(F.var_pop(other(xs))) * on(F.count(both(xs))),
        "xy": lambda xs, on: on(F.covar_pop(xs[0], xs[1])) * on(F.count(both(xs))),
    }

    def present(p: dict[str, Column]) -> Column:
        slope, c, mean = F.try_divide(p["xy"], p["xx"]), _correlated(p), lambda s: F.try_divide(s, p["w"])
        return F.struct(
            p["w"].cast("long").alias("count"), c.alias("correlation"), mean(p["xy"]).alias("covariance"), slope.alias("slope"), (p["my"] - slope * p["mx"]).alias("intercept"),
            p["mx"].alias("mean_x"), p["my"].alias("mean_y"), mean(p["xx"]).alias("variance_x"), mean(p["yy"]).alias("variance_y"), F.sqrt(1 - c).alias("distance"),
        )

    return _pairs((_c(x).cast("double"), _c(y).cast("double")), updates, present)


def weighted_correlation(x: ColumnLike, y: ColumnLike, weight: ColumnLike, about: tuple[float, float] = (0.0, 0.0)) -> Agg:
    """The same for weighted pairs: weight, means, covariance, variances,
    correlation. Rows with a null in any of the three do not count. Within a
    buffer the sums are about the point ``about``; one near the data keeps
    digits when values are large beside their spread
    (``weighted_correlation_of`` finds it). Stored buffers merge."""

    def moment(i: int, j: int) -> Callable[[Inputs, On], Column]:
        """The sum of w a^i b^j about the point."""

        def run(xs: Inputs, on: On) -> Column:
            a, b, out = xs[0] - float(about[0]), xs[1] - float(about[1]), F.when(xs[0].isNotNull() & xs[1].isNotNull(), xs[2])
            for factor in (*[a] * i, *[b] * j):
                out = out * factor
            return on(F.sum(out))

        return run

    def central(i: int, j: int) -> Callable[[Inputs, On], Column]:
        first, second = (moment(1, 0) if i else moment(0, 1)), (moment(0, 1) if j else moment(1, 0))
        return lambda xs, on: moment(i, j)(xs, on) - F.try_divide(first(xs, on) * second(xs, on), moment(0, 0)(xs, on))

    mean = lambda i, j, c: lambda xs, on: F.lit(float(c)) + F.try_divide(moment(i, j)(xs, on), moment(0, 0)(xs, on))
    updates = {"w": moment(0, 0), "mx": mean(1, 0, about[0]), "my": mean(0, 1, about[1]), "xx": central(2, 0), "yy": central(0, 2), "xy": central(1, 1)}

    def present(p: dict[str, Column]) -> Column:
        of = lambda s: F.try_divide(s, p["w"])
        return F.struct(
            p["w"].alias("weight"), p["mx"].alias("mean_x"), p["my"].alias("mean_y"), of(p["xy"]).alias("covariance"),
            of(p["xx"]).alias("variance_x"), of(p["yy"]).alias("variance_y"), _correlated(p).alias("correlation"),
        )

    return _pairs(tuple(_c(c).cast("double") for c in (x, y, weight)), updates, present)


def weighted_correlation_of(df: DataFrame, x: str, y: str, weight: str) -> Agg:
    """``weighted_correlation`` about the means of ``df``, one pass more."""
    means = df.agg(F.avg(x), F.avg(y)).first()
    return weighted_correlation(x, y, weight, tuple(float(m) if m is not None and math.isfinite(m) else 0.0 for m in means))


def gaussian_sum(mean: ColumnLike, variance: ColumnLike) -> Agg:
    """The sum of independent normal variables: means and variances add."""
    parts = (Part("mean", lambda xs: F.sum(xs[0]), F.sum, 0.0), Part("variance", lambda xs: F.sum(xs[1]), F.sum, 0.0))
    return Agg((_c(mean).cast("double"), _c(variance).cast("double")), parts, lambda p: F.struct(p[0].alias("mean"), p[1].alias("variance")))


def gaussian_sample(mean: Column, variance: Column, seed: int) -> Column:
    return mean + F.sqrt(variance) * F.randn(seed)


# Decay -----------------------------------------------------------------

LN2 = math.log(2.0)


def decayed_value(df: DataFrame, x: str, time: str, half_life: float, by: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    """(by, value, time): the sum of the values, each halved once a half-life
    up to the group's latest time. ``time`` is in the half-life's unit. Values
    of at most ``eps`` collapse to 0. The latest time is a window-free first
    aggregate; values are relative to it, so no exponent is large."""
    rows = _with_latest(df, time, by)
    decayed = F.col(x) * F.exp(-(F.col("_latest") - F.col(time)) * (LN2 / half_life))
    out = rows.groupBy(*by) if by else rows.groupBy(F.lit(1).alias("_all"))  # no rows: no value
    out = out.agg(F.sum(decayed).alias("value"), F.max("_latest").alias("time"))
    return out.select(*by, F.when(F.abs("value") > eps, F.col("value")).otherwise(0.0).alias("value"), "time")


def _with_latest(df: DataFrame, time: str, by: Sequence[str]) -> DataFrame:
    """The rows with their group's latest time, null keys being a group. One
    row a group meets the rows, so that adaptive execution can split a hot one."""
    keys = [f"_k{i}" for i in range(len(by))]
    if not keys:
        return df.join(F.broadcast(df.agg(F.max(time).alias("_latest"))))  # one row
    latest = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.max(time).alias("_latest"))
    return df.join(latest, null_safe(by, keys)).drop(*keys)


def value_as_of(value: Column, time: Column, half_life: float, at: Column | float) -> Column:
    return value * F.exp(-((F.lit(at) if not isinstance(at, Column) else at) - time) * (LN2 / half_life))


def decayed_average(value: Column, half_life: float) -> Column:
    """The average that a constant stream of this level would give."""
    return value / (half_life / LN2)


def decayed_average_from(value: Column, half_life: float, start: Column, end: Column) -> Column:
    whole = half_life * (1 - F.pow(F.lit(2.0), (start - end) / half_life)) / LN2
    return F.when(end > start, value / whole).otherwise(0.0)


def discrete_average(value: Column, half_life: float) -> Column:
    return value * (1 - 2 ** (-1 / half_life))


def decayed_vector(df: DataFrame, key: str, x: str, time: str, half_life: float, by: Sequence[str] = (), eps: float = -1.0) -> DataFrame:
    """(by, key, value, time): a decayed value for each key of the vector, all
    as of the group's latest time. A vector whose norm is at most ``eps``
    collapses to no rows."""
    decayed = F.col(x) * F.exp(-(F.col("_latest") - F.col(time)) * (LN2 / half_life))
    out = _with_latest(df, time, by).groupBy(*by, key).agg(F.sum(decayed).alias("value"), F.max("_latest").alias("time"))
    if eps < 0:
        return out
    keys = [f"_k{i}" for i in range(len(by))] or ["_k"]
    norms = out.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] if by else [F.lit(1).alias("_k")])
    large = norms.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm")).where(F.col("_norm") > eps)
    return out.join(large, null_safe(by, keys) if by else F.lit(True), "left_semi")


# Either, map-like, conditional -----------------------------------------


def either_sum(left: ColumnLike, right: ColumnLike) -> Agg:
    """Any left value absorbs all right ones: (left, right), one of them NULL."""
    parts = (Part("left", lambda xs: F.sum(xs[0]), F.sum), Part("right", lambda xs: F.sum(xs[1]), F.sum))
    return Agg((_c(left), _c(right)), parts, lambda p: F.struct(p[0].alias("left"), F.when(p[0].isNull(), p[1]).alias("right")))


def sum_before(x: ColumnLike) -> Agg:
    """The sum of all elements of array values, added up by row first."""
    inner = F.aggregate(_c(x), F.lit(0.0), lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0)))
    return simple(inner, F.sum, F.sum, 0.0, lambda p: p == 0)


def eventually(exact: Agg, eventual: Agg, must_convert: Callable[[Column], Column]) -> Agg:
    """The exact result until ``must_convert`` of it says otherwise."""
    from mergeloom.plans.spec import struct_of

    return struct_of({"exact": exact, "eventual": eventual}).and_then_present(lambda s: F.when(must_convert(s["exact"]), s["eventual"]).otherwise(s["exact"]))
