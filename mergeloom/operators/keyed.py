"""Keyed algebra: maps as tables of (key, value).

A map's sum is a union with addition, its product an inner join, and keys whose
value is zero are no members: ``sum_by_key`` and all that build on it drop
them, once, at the end. ``keep_zeros`` gives the plain grouped sum instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.plans.spec import Agg, null_safe
from mergeloom.sources import tables


def sum_by_key(df: DataFrame, key: Sequence[str], value: str, keep_zeros: bool = False) -> DataFrame:
    """(key, value): the sums; zero sums go unless kept."""
    out = df.groupBy(*key).agg(F.sum(value).alias(value))
    return out if keep_zeros else out.where(F.col(value) != 0)


def group(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(key, values): all values of a key in order, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*key).agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def to_graph(df: DataFrame, source: str, target: str) -> DataFrame:
    """(source, targets): each node's set of neighbours, sorted."""
    return df.groupBy(source).agg(F.array_sort(F.collect_set(target)).alias("targets"))


def outer_join(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every key of either map with its value there, or NULL."""
    return left.join(right, list(key), "full_outer")


def times(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The maps' product: keys of both, values multiplied, zeros dropped."""
    both = left.select(*key, F.col(value).alias("_l")).join(right.select(*key, F.col(value).alias("_r")), list(key))
    return both.select(*key, (F.col("_l") * F.col("_r")).alias(value)).where(F.col(value) != 0)


def dot(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The sum of the product's values, 0 if there is none."""
    return times(left, right, key, value).agg(F.coalesce(F.sum(value), F.lit(0)).alias("dot"))


def plus(*maps: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The maps' sum: union with addition, zeros dropped."""
    rows = maps[0].select(*key, value)
    for m in maps[1:]:
        rows = rows.unionByName(m.select(*key, value))
    return sum_by_key(rows, key, value)


def negate(m: DataFrame, value: str) -> DataFrame:
    return m.withColumn(value, -F.col(value))


def minus(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return plus(left, negate(right, value), key=key, value=value)


def merge_lookup(keys: DataFrame, table: DataFrame, key: str, value: str, present: Mapping[str, Column], zero: object = 0) -> DataFrame:
    """For each key its value in ``table`` (else the zero), keyed anew by
    ``present`` and added up, zeros dropped."""
    found = keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(zero)))
    return sum_by_key(found.select(*[c.alias(n) for n, c in present.items()], value), list(present), value)


def remove_zeros(m: DataFrame, value: str) -> DataFrame:
    return m.where(F.col(value) != 0)


def right_contains_left(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row: does ``right`` hold every (key, value) of ``left``?"""
    missing = left.join(right.select(*key, value), [left[c].eqNullSafe(right[c]) for c in [*key, value]], "left_anti")
    return missing.limit(1).agg((F.count("*") == 0).alias("contained"))


def sparse_equiv(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row: are the maps equal but for zeros?"""
    return minus(left, right, key, value).limit(1).agg((F.count("*") == 0).alias("equal"))


#: Parts of maps that are compared, at least: a task's memory is that of one.
PARTS = 96


def parts(spark: SparkSession) -> int:
    """As many as shuffles have, or ``PARTS``; a number that is given is not
    coalesced into fewer parts that grow with the input."""
    return max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def compared_maps(left: DataFrame, right: DataFrame, by: Sequence[str], key: Sequence[str], value: str) -> DataFrame:
    """(by, contained, equal): the same two questions for a map of each group.
    A group on one side only meets an empty map. Both sides are put side by side
    by group and key in one shuffle, so groups of any size have partial answers;
    keys are unique in their map, null groups and keys are like others. For
    ``equal`` a null value is 0."""
    sides = [m.select(*by, *key, F.lit(n).alias("_side"), F.col(value).alias("_v")) for n, m in enumerate((left, right))]
    entry = lambda n, c: F.first(F.when(F.col("_side") == n, c), ignorenulls=True)
    both = sides[0].unionByName(sides[1])
    both = both.repartition(parts(both.sparkSession), *by, *key).groupBy(*by, *key)
    # Apart, so that they are held in a hash table and not sorted.
    both = both.agg(*[entry(n, c).alias(f"{a}{n}") for n in (0, 1) for a, c in (("_in", F.lit(True)), ("_v", F.col("_v")))])
    contained = F.col("_in0").isNull() | (F.col("_in1").isNotNull() & F.col("_v0").eqNullSafe(F.col("_v1")))
    equal = F.coalesce("_v0", F.lit(0)) == F.coalesce("_v1", F.lit(0))
    return both.groupBy(*by).agg(F.bool_and(contained).alias("contained"), F.bool_and(equal).alias("equal"))


def invert(m: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): for each value the set of keys that have it."""
    return m.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def invert_exact(m: DataFrame, key: str, values: str) -> DataFrame:
    """The same for arrays of values; keys of empty arrays stand under NULL."""
    return m.select(key, F.explode_outer(values).alias("value")).groupBy("value").agg(F.array_sort(F.collect_set(key)).alias("keys"))


# Cube and rollup -------------------------------------------------------


def _grouped(df: DataFrame, keys: Sequence[str], how: str):
    return df.cube(*keys) if how == "cube" else df.rollup(*keys)


def cube_or_rollup_sum(df: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    """(keys, level, value): sums over all subsets (cube) or prefixes (rollup)
    of the keys; ``level`` is Spark's grouping id, which tells a key that is
    summed over from a NULL. Zero sums are dropped."""
    return _grouped(df, keys, how).agg(F.grouping_id().alias("level"), F.sum(value).alias(value)).where(F.col(value) != 0)


def cube_or_rollup_aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg], how: str) -> DataFrame:
    """The same with any aggregations. Groups in which all buffers are their
    monoid's zero are dropped."""
    parts = {f"{n}__{p.name}": p.value(p.update(a.inputs)) for n, a in aggs.items() for p in a.parts}
    out = _grouped(df, keys, how).agg(F.grouping_id().alias("level"), *[c.alias(n) for n, c in parts.items()])
    own = {n: [F.col(f"{n}__{p.name}") for p in a.parts] for n, a in aggs.items()}
    zero = None
    if all(a.is_zero for a in aggs.values()):
        for n, a in aggs.items():
            zero = a.is_zero(own[n]) if zero is None else zero & a.is_zero(own[n])
    out = out if zero is None else out.where(~zero)
    return out.select(*keys, "level", *[a.present(own[n]).alias(n) for n, a in aggs.items()])


def cube_or_rollup_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], how: str) -> DataFrame:
    """The same with the list of values in order. Lists grow with the group:
    sum or aggregate instead where that will do."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(value).alias("v"))))
    return _grouped(df, keys, how).agg(F.grouping_id().alias("level"), F.transform(rows, lambda r: r["v"]).alias("values"))


# Set difference and reset ----------------------------------------------


def set_diff_of(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, op): what to add to and remove from ``old`` to get ``new``."""
    o, n = old.select(*key).distinct(), new.select(*key).distinct()
    added = n.join(o, list(key), "left_anti").withColumn("op", F.lit("add"))
    return added.unionByName(o.join(n, list(key), "left_anti").withColumn("op", F.lit("remove")))


def set_diff_merge(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(key, op) of several diffs one after another: the last one counts."""
    return changes.groupBy(*key).agg(F.max_by("op", F.struct(*order)).alias("op"))


def set_diff_apply(old: DataFrame, diff: DataFrame, key: Sequence[str]) -> DataFrame:
    kept = old.select(*key).distinct().join(diff.where("op = 'remove'"), list(key), "left_anti")
    return kept.select(*key).union(diff.where("op = 'add'").select(*key)).distinct()


def set_diff_strict(old: DataFrame, diff: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``set_diff_apply``, but raises if an added key is there already or a
    removed one is not."""
    here = old.select(*key).distinct().withColumn("_in", F.lit(True))
    marked = diff.join(here, list(key), "left").select(*key, "op", F.coalesce("_in", F.lit(False)).alias("_in"))
    bad = (F.col("op") == "add") == F.col("_in")
    checked = marked.select(*key, F.when(bad, F.raise_error(F.lit("the difference does not fit the set"))).otherwise(F.col("op")).alias("op"))
    return set_diff_apply(old, checked, key)


def set_diff_invert(diff: DataFrame) -> DataFrame:
    return diff.withColumn("op", F.when(F.col("op") == "add", "remove").otherwise("add"))


def reset_sum(df: DataFrame, value: str, is_reset: Column, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, value): the sum of the values from the last reset on."""
    keys = [f"_k{i}" for i in range(len(by))]
    groups = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]) if by else df.groupBy()
    last = groups.agg(F.max(F.when(is_reset, F.struct(*order))).alias("_reset"))
    both = df.join(last, null_safe(by, keys)) if by else df.join(F.broadcast(last))  # null keys are a group
    rows = both.where(F.col("_reset").isNull() | (F.struct(*order) >= F.col("_reset")))
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(F.sum(value).alias(value))


def min_plus_step(distances: DataFrame, edges: DataFrame, node: str = "node", cost: str = "cost") -> DataFrame:
    """One relaxation of shortest paths: (node, cost) joined with edges
    (source, target, weight); the smaller of old and new cost stays."""
    through = distances.join(edges, F.col(node) == F.col("source")).select(F.col("target").alias(node), (F.col(cost) + F.col("weight")).alias(cost))
    return distances.select(node, cost).union(through).groupBy(node).agg(F.min(cost).alias(cost))


def min_plus_closure(start: DataFrame, edges: DataFrame, most_rounds: int, cut: Callable[[DataFrame], DataFrame] = tables.cut) -> DataFrame:
    """(node, cost): the least cost of each node that paths from ``start`` reach.

    A round goes on from the nodes whose cost the one before has lowered, and no
    others. What it lowers is written by itself (``cut``); of what was written
    before it reads the nodes that it meets. Raises if ``most_rounds`` are not
    enough: shortest paths of so many edges, or a cycle of negative weight."""
    least = lambda rows: rows.groupBy("node").agg(F.min("cost").alias("cost"))
    lowered = cut(least(start.where("node is not null").select("node", "cost")))
    written = lowered
    for _ in range(most_rounds):
        met = lowered.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"))
        met = least(met.where("node is not null"))
        known = least(written.join(met.select("node"), "node", "left_semi")).withColumnRenamed("cost", "_known")
        lowered = cut(met.join(known, "node", "left").where("_known is null or cost < _known").select("node", "cost"))
        if lowered.isEmpty():
            return least(written)
        written = written.unionByName(lowered)
    raise RuntimeError(f"distances still change after {most_rounds} rounds")
