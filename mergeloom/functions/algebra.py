"""Instances: how two values of a type combine.

``semigroup``, ``zero``, ``negate`` and ``times`` are chosen by data type, also
for structs, component by component. ``plus_agg`` is the matching aggregation.
Booleans form the ring of XOR and AND, strings and lists concatenate, arrays of
numbers add element by element (the longer one's tail stays), maps add by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.functions import keyed_maps
from mergeloom.operators import aggregators as A
from mergeloom.plans.spec import Agg, struct_of

_custom: dict[str, tuple[Callable[[Column, Column], Column], object]] = {}


def register(name: str, plus: Callable[[Column, Column], Column], zero: object = None) -> None:
    """A named instance of one's own, for ``plus(..., instance=name)``."""
    _custom[name] = (plus, zero)


def plus(a: Column, b: Column, kind: T.DataType | None = None, instance: str | None = None) -> Column:
    """The sum of two values."""
    if instance:
        return _custom[instance][0](a, b)
    match kind:
        case T.BooleanType():
            return a != b
        case T.StringType():
            return F.concat(a, b)
        case T.ArrayType(elementType=T.NumericType()):
            return elementwise(a, b)
        case T.ArrayType():
            return F.concat(a, b)
        case T.MapType():
            return keyed_maps.plus(a, b)
        case T.StructType():
            return F.struct(*[plus(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind])
    return a + b


def times(a: Column, b: Column, kind: T.DataType | None = None) -> Column:
    match kind:
        case T.BooleanType():
            return a & b
        case T.ArrayType():
            return elementwise_times(a, b)
        case T.MapType():
            return keyed_maps.times(a, b)
        case T.StructType():
            return F.struct(*[times(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind])
    return a * b


def zero(kind: T.DataType, instance: str | None = None) -> Column:
    if instance:
        return F.lit(_custom[instance][1])
    match kind:
        case T.BooleanType():
            return F.lit(False)
        case T.StringType():
            return F.lit("")
        case T.ArrayType() | T.MapType():
            return F.from_json(F.lit("[]" if isinstance(kind, T.ArrayType) else "{}"), kind)
        case T.StructType():
            return F.struct(*[zero(f.dataType).alias(f.name) for f in kind])
    return F.lit(0).cast(kind)


def negate(a: Column, kind: T.DataType | None = None) -> Column:
    match kind:
        case T.BooleanType():
            return a
        case T.ArrayType():
            return F.transform(a, lambda v: -v)
        case T.MapType():
            return keyed_maps.negate(a)
        case T.StructType():
            return F.struct(*[negate(a[f.name], f.dataType).alias(f.name) for f in kind])
    return -a


def minus(a: Column, b: Column, kind: T.DataType | None = None) -> Column:
    return plus(a, negate(b, kind), kind)


def is_nonzero(a: Column, kind: T.DataType) -> Column:
    match kind:
        case T.ArrayType():
            return F.exists(a, lambda v: v != 0) if isinstance(kind.elementType, T.NumericType) else F.size(a) > 0
        case T.MapType():
            return F.size(keyed_maps.remove_zeros(a)) > 0
        case T.BooleanType():
            return a
    return a != zero(kind)


def nonzero_option(a: Column) -> Column:
    return F.nullif(a, F.lit(0))


def maybe_plus(a: Column, b: Column) -> Column:
    """The sum where both are there, else the one that is."""
    return F.coalesce(a + b, a, b)


def int_times(n: Column, a: Column, kind: T.DataType | None = None) -> Column:
    """a added n times; strings repeat."""
    return F.repeat(a, n) if isinstance(kind, T.StringType) else n * a


def divide(a: Column, b: Column) -> Column:
    """The field's division; NULL by zero."""
    return F.try_divide(a, b)


def inverse(a: Column) -> Column:
    return F.try_divide(F.lit(1.0), a)


def elementwise(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x + y, x, y))


def elementwise_times(a: Column, b: Column) -> Column:
    """Element by element, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y)


def elementwise_sum(df: DataFrame, array: str, by: Sequence[str]) -> DataFrame:
    """(by, array): the arrays of each group added element by element, through
    rows of (position, value), so no group's arrays are collected."""
    rows = df.select(*by, F.posexplode(array).alias("_i", "_v"))
    sums = rows.groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_v")))
    return sums.groupBy(*by).agg(F.transform(ordered, lambda s: s["_v"]).alias(array))


def plus_agg(x: str, kind: T.DataType, order: Sequence[str] = ()) -> Agg:
    """The aggregation that adds up all values of a column; structs are added
    component by component, in one pass."""
    match kind:
        case T.BooleanType():
            return A.bool_xor(x)
        case T.StringType():
            return A.concat_strings(x, order)
        case T.StructType():
            return struct_of({f.name: _field(x, f, order) for f in kind})
        case T.ArrayType(elementType=T.NumericType()) | T.MapType():
            return A.from_reduce(x, lambda a, b: plus(a, b, kind), list(order) or None)
        case T.ArrayType():
            return A.concat_lists(x, order)
    return A.sum_of(x)


def _field(x: str, f: T.StructField, order: Sequence[str]) -> Agg:
    return plus_agg(f"{x}.{f.name}", f.dataType, order)


# Values with an added unit: n * 1 + v -----------------------------------


def adjoined(ones: Column, value: Column) -> Column:
    return F.struct(ones.alias("ones"), value.alias("value"))


def adjoined_plus(a: Column, b: Column) -> Column:
    return adjoined(a["ones"] + b["ones"], a["value"] + b["value"])


def adjoined_times(a: Column, b: Column) -> Column:
    """(n + v)(m + w) = nm + (nw + mv + vw)."""
    return adjoined(a["ones"] * b["ones"], a["ones"] * b["value"] + b["ones"] * a["value"] + a["value"] * b["value"])


def bijected(plus: Callable[[Column, Column], Column], to: Callable[[Column], Column], back: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """An instance carried along an isomorphism."""
    return lambda a, b: back(plus(to(a), to(b)))


def combined_with(df: DataFrame, aggs: dict[str, Agg], f: Callable[..., Column], out: str) -> DataFrame:
    """Every row with a value made from it and from aggregates of all rows: the
    aggregates are one row, so their side of the join is."""
    total = df.agg(*[a.column().alias(f"_{n}") for n, a in aggs.items()])
    return df.join(F.broadcast(total)).withColumn(out, f(*[F.col(f"_{n}") for n in aggs])).drop(*[f"_{n}" for n in aggs])
