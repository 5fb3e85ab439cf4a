"""HyperLogLog as a relation (group, j, rho): merge is the maximum by register."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions import hashing
from mergeloom.functions.approximate import approximate
from mergeloom.plans.spec import null_safe

SEED = 12345678


def error(bits: int) -> float:
    return 1.04 / math.sqrt(2**bits)


def bits_for_error(err: float) -> int:
    if not 0.00003 < err < 1.0:
        raise ValueError("the error must lie between 0.00003 and 1")
    return max(4, math.ceil(2 * math.log2(1.04 / err)))


def alpha(bits: int) -> float:
    return {4: 0.673, 5: 0.697, 6: 0.709}.get(bits, 0.7213 / (1 + 1.079 / 2**bits))


def registers(df: DataFrame, x: str | Sequence[str], bits: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, j, rho): a row for each register that is set. NULLs do not count."""
    keys = [x] if isinstance(x, str) else list(x)
    rows = df.where(hashing.known(*keys)).withColumn("_d", hashing.digest(SEED, *keys))
    rows = rows.select(*by, (hashing.hex32(F.col("_d"), 0) % 2**bits).cast("int").alias("j"), hashing.rho32(hashing.hex32(F.col("_d"), 1)).cast("int").alias("rho"))
    return rows.groupBy(*by, "j").agg(F.max("rho").alias("rho"))


def merge(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Registers merged by coarser keys (or a union of sketches merged)."""
    return sketch.groupBy(*by, "j").agg(F.max("rho").alias("rho"))


def union(*sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = sketches[0].select(*by, "j", "rho")
    for s in sketches[1:]:
        rows = rows.unionByName(s.select(*by, "j", "rho"))
    return merge(rows, by)


def _estimate(bits: int, z: Column, filled: Column) -> Column:
    m = float(2**bits)
    empty = m - filled
    raw = alpha(bits) * m * m / (z + empty)
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw)


def estimate(sketch: DataFrame, bits: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, estimate): linear counting while there are empty registers and few
    elements, the harmonic mean beyond. No rows: an estimate of 0."""
    grouped = sketch.groupBy(*by) if by else sketch.groupBy()
    sums = grouped.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho").cast("double"))), F.lit(0.0)).alias("_z"), F.count("*").cast("double").alias("_n"))
    return sums.select(*by, _estimate(bits, F.col("_z"), F.col("_n")).alias("estimate"))


def approximate_size(sketch: DataFrame, bits: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, size): the estimate with bounds of three standard errors."""
    e, d = F.col("estimate"), 3 * error(bits)
    size = approximate(F.floor(F.greatest(F.lit(0.0), e * (1 - d))), F.floor(e), F.ceil(e * (1 + d)), F.lit(0.9972))
    return estimate(sketch, bits, by).select(*by, size.alias("size"))


def downsize(sketch: DataFrame, bits: int, reduced: int, by: Sequence[str] = ()) -> DataFrame:
    """The sketch with fewer bits: the same as one made with them, as j is the
    hash's remainder and rho comes from other bits."""
    if reduced > bits:
        raise ValueError("a sketch can only lose bits")
    return merge(sketch.withColumn("j", F.col("j") % 2**reduced), by)


def intersection(sketches: Sequence[DataFrame], bits: int) -> DataFrame:
    """(estimate): the size of the sets' intersection by inclusion and
    exclusion over the unions of all subsets, 0 at least. One pass over the
    registers tagged by sketch; 2^n - 1 unions for n sketches."""
    n = len(sketches)
    tagged = None
    for i, s in enumerate(sketches):
        rows = s.select(F.lit(i).alias("i"), "j", "rho")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    subsets = [(mask, [i for i in range(n) if mask >> i & 1]) for mask in range(1, 2**n)]
    members = F.map_from_arrays(F.array(*[F.lit(i) for i in range(n)]), F.array(*[F.array(*[F.lit(m) for m, own in subsets if i in own]) for i in range(n)]))
    each = tagged.withColumn("mask", F.explode(members[F.col("i")]))
    sizes = estimate(merge(each, ["mask"]), bits, ["mask"])
    sign = F.when(F.bit_count("mask") % 2 == 1, 1.0).otherwise(-1.0)
    return sizes.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(sign * F.col("estimate")), F.lit(0.0))).alias("estimate"))


def set_size(df: DataFrame, x: str, bits: int, most: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, size): exact up to ``most`` distinct values, then the estimate cut
    to a whole number. Exact sets are not kept: distinct values are counted in
    a first, pre-aggregated step that both branches share."""
    values = df.where(F.col(x).isNotNull()).select(*by, x).distinct()
    exact = (values.groupBy(*by) if by else values.groupBy()).agg(F.count("*").alias("_exact"))
    est = estimate(registers(values, x, bits, by), bits, by)
    if by:  # null keys are a group
        keys = [f"_k{i}" for i in range(len(by))]
        both = exact.join(est.withColumnsRenamed(dict(zip(by, keys, strict=True))), null_safe(by, keys)).drop(*keys)
    else:
        both = exact.join(F.broadcast(est))
    return both.select(*by, F.when(F.col("_exact") <= most, F.col("_exact")).otherwise(F.floor("estimate")).cast("long").alias("size"))


def approximate_unique_count(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact up to 100 distinct values, then 13 bits (about 1.2 percent)."""
    return set_size(df, x, 13, 100, by)


# Series: distinct counts since any time ---------------------------------


def series(df: DataFrame, x: str, time: str, bits: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, j, rho, ts): for each register and level the latest time."""
    rows = df.where(F.col(x).isNotNull()).withColumn("_d", hashing.digest(SEED, x))
    rows = rows.select(*by, (hashing.hex32(F.col("_d"), 0) % 2**bits).cast("int").alias("j"), hashing.rho32(hashing.hex32(F.col("_d"), 1)).cast("int").alias("rho"), F.col(time).alias("ts"))
    return rows.groupBy(*by, "j", "rho").agg(F.max("ts").alias("ts"))


def merge_series(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sketch.groupBy(*by, "j", "rho").agg(F.max("ts").alias("ts"))


def since(sketch: DataFrame, start: Column, by: Sequence[str] = ()) -> DataFrame:
    """The plain sketch of what came at ``start`` or later."""
    return merge(sketch.where(F.col("ts") >= start), by)
