"""User-defined monoids: the same however rows are dealt, in order where it
matters, and running results of whole tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mergeloom.operators import aggregators as A
from mergeloom.operators import monoid, scan
from mergeloom.operators.monoid import Monoid

ROWS = [(i, [None, "a", "b", "c"][i % 4], float("nan") if i % 10 == 0 else float(i % 3), i * 7 % 31 - 10) for i in range(500)]
SCHEMA = "i long, g string, d double, x long"

WORDS = Monoid(lambda x: str(x), lambda a, b: f"{a},{b}", lambda s: (s,), lambda: "")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(7).cache()


def by_group(f, key=lambda r: r[1]):
    groups = defaultdict(list)
    for r in ROWS:
        groups[key(r)].append(r)
    return {k: f(v) for k, v in groups.items()}


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_any_partitioning_gives_the_same(rows, held):
    gcd = monoid.of_reduce(math.gcd)
    want = by_group(lambda v: math.gcd(*[r[3] for r in v]))
    for parts in (1, 4, 13):
        got = monoid.aggregate(rows.repartition(parts), gcd, ["x"], "v long", ["g"], held)
        assert {r.g: r.v for r in got.collect()} == want


def test_states_shuffle_and_not_rows(spark, rows):
    many = spark.range(0, 20_000, 1, 4).withColumn("g", F.col("id") % 3)
    count = Monoid(lambda _: 1, lambda a, b: a + b)
    assert monoid.partials(many, count, ["id"], ["g"]).count() == 12
    assert {r.g: r.n for r in monoid.aggregate(many, count, ["id"], "n long", ["g"]).collect()} == {0: 6667, 1: 6667, 2: 6666}


def test_nan_and_null_keys_are_groups(rows):
    got = monoid.aggregate(rows, Monoid(lambda x: x, lambda a, b: a + b), ["x"], "v long", ["d"]).collect()
    want = by_group(lambda v: sum(r[3] for r in v), lambda r: "nan" if r[2] != r[2] else r[2])
    assert {"nan" if r.d != r.d else r.d: r.v for r in got} == want and len(got) == len(want)


def test_empty_input(spark, rows):
    none = rows.where("false")
    assert monoid.aggregate(none, WORDS, ["x"], "v string").collect()[0].v == ""
    assert monoid.aggregate(none, monoid.of_reduce(max), ["x"], "v long").collect() == []
    assert monoid.aggregate(none, WORDS, ["x"], "v string", ["g"]).collect() == []
    assert monoid.reduce_ordered(none, monoid.affine, ["d", "d"], ["i"], "slope double, offset double").collect()[0].slope == 1.0
    assert monoid.scan_ordered(none, WORDS, ["x"], ["i"], "v string").collect() == []


def test_append_and_total(rows):
    """A state that appends in place and merges many at once."""

    def total(states):
        out = set()
        for s in states:
            out |= s
        return out

    distinct = Monoid(lambda x: {x}, lambda a, b: a | b, lambda s: (len(s),), append=lambda s, x: s.add(x) or s, total=total)
    got = monoid.aggregate(rows, distinct, ["x"], "n long", ["g"]).collect()
    assert {r.g: r.n for r in got} == by_group(lambda v: len({r[3] for r in v}))
    half = monoid.merge(monoid.partials(rows.where("i < 250"), distinct, ["x"], ["g"]), distinct, ["g"])
    both = monoid.append(half, rows.where("i >= 250"), distinct, ["x"], ["g"])
    assert {r.g: r.n for r in monoid.present(both, distinct, "n long", ["g"]).collect()} == by_group(lambda v: len({r[3] for r in v}))


def test_non_commutative_in_order(rows):
    for parts in (1, 9):
        got = monoid.reduce_ordered(rows.repartition(parts), WORDS, ["x"], ["i"], "v string", ["g"])
        assert {r.g: r.v for r in got.collect()} == by_group(lambda v: ",".join(str(r[3]) for r in v))
    assert monoid.reduce_ordered(rows, WORDS, ["x"], ["i"], "v string").first().v == ",".join(str(r[3]) for r in ROWS)
    assert monoid.reduce_ordered(rows, monoid.listed, ["x"], ["g", "i"], "v array<long>").first().v == [r[3] for r in sorted(ROWS, key=lambda r: (r[1] or "", r[0]))]


def test_one_group_lies_in_many_ranges(spark):
    one = spark.range(0, 50_000, 1, 8).withColumn("g", F.lit("only"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = monoid.ordered_partials(one, Monoid(lambda _: 1, lambda a, b: a + b), ["id"], ["id"], ["g"])
        assert parts.count() == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_affine_functions_with_real_slopes(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, rng.uniform(0.5, 1.4), rng.uniform(-3, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, g long, s double, b double").repartition(6)
    got = {r.g: (r.slope, r.offset) for r in monoid.reduce_ordered(df, monoid.affine, ["s", "b"], ["i"], "slope double, offset double", ["g"]).collect()}
    for g in (0, 1):
        at0, at1 = 0.0, 1.0
        for _, own, s, b in rows:
            if own == g:
                at0, at1 = s * at0 + b, s * at1 + b
        assert got[g][1] == pytest.approx(at0, rel=1e-9) and got[g][0] + got[g][1] == pytest.approx(at1, rel=1e-9)


def test_running_results(rows):
    for by in ([], ["g"]):
        got = monoid.scan_ordered(rows, WORDS, ["x"], ["i"], "v string", by).collect()
        sofar, want = defaultdict(list), {}
        for i, g, _, x in ROWS:
            key = g if by else 0
            sofar[key].append(str(x))
            want[i] = ",".join(sofar[key])
        assert {r.i: r.v for r in got} == want and set(got[0].asDict()) == {*by, "i", "x", "v"}


def test_big_product(spark):
    df = spark.createDataFrame([(1, n) for n in range(1, 41)] + [(2, None), (2, -7)], "g int, n long").repartition(3)
    got = {r.g: r.p for r in monoid.aggregate(df, monoid.big_product, ["n"], "p string", ["g"]).collect()}
    assert got == {1: str(math.factorial(40)), 2: "-7"}


# Windows of whole tables ------------------------------------------------------


def test_global_windows(spark, rows):
    w = Window.orderBy("x", "i")
    want = {r.i: r.k for r in rows.select("i", (F.row_number().over(w) - 1).alias("k")).collect()}
    got = scan.global_index(rows, ["x", "i"])
    assert {r.i: r["index"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    for n in (1, 3, 120, 900):
        last = w.rowsBetween(-(n - 1), 0)
        want = {r.i: (r.s, r.c, r.m) for r in rows.select("i", F.sum("x").over(last).alias("s"), F.count("*").over(last).alias("c"), F.max("d").over(last).alias("m")).collect()}
        out = scan.global_trailing(rows, {"s": A.sum_of("x"), "c": A.size(), "m": A.max_of("d")}, n, ["x", "i"], block=100)
        assert {r.i: repr((r.s, r.c, r.m)) for r in out.collect()} == {k: repr(v) for k, v in want.items()}
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_global_zip_and_empty(rows):
    left, right = rows.select("i"), rows.where("i < 20").select((-F.col("i")).alias("j"))
    got = scan.global_zip(left, right, ["i"], ["j"]).collect()
    assert sorted((r["index"], r.i, r.j) for r in got) == [(k, k, k - 19) for k in range(20)]
    assert scan.global_index(rows.where("false"), ["i"]).collect() == []
    assert scan.global_trailing(rows.where("false"), {"n": A.size()}, 3, ["i"]).collect() == []


# Null groups and extrema of any type --------------------------------------------


def test_null_groups_stay(spark):
    from mergeloom.operators import keyed
    from mergeloom.operators.sketches import hll, qtree

    df = spark.createDataFrame([(None, None, 1.0, 1.0), (None, None, 3.0, 2.0), ("a", 1, 5.0, 2.0), ("a", None, 7.0, 4.0)], "g string, h int, v double, t double")
    by = ["g", "h"]
    keys = {(None, None), ("a", 1), ("a", None)}
    for out in (
        A.decayed_value(df, "v", "t", 1.0, by), A.decayed_vector(df, "v", "v", "t", 1.0, by, 0.0), hll.set_size(df, "v", 8, 10, by),
        qtree.inter_quartile_mean(qtree.leaves(df, "v", by), by), keyed.reset_sum(df, "v", F.col("t") > 100, ["t"], by), qtree.node_bounds(qtree.bounded(df, "v", 3, by), 0.5, by),
    ):
        assert {(r.g, r.h) for r in out.collect()} == keys
    assert {(r.g, r.h): r.v for r in keyed.reset_sum(df, "v", F.col("t") > 100, ["t"], by).collect()}[None, None] == 4.0
    assert A.decayed_value(df.where("g = 'a'"), "v", "t", 2.0).first().value == pytest.approx(7 + 2.5)
    assert A.decayed_value(df.where("false"), "v", "t", 2.0).collect() == []


def test_max_by_of_any_type(spark):
    values = {"string": ["", "a", "ab", "b", "é", None], "bigint": [-(2**63), 2**63 - 1, 0, None], "double": [1.5, float("nan"), float("-inf"), None], "date": ["2024-01-01", "1969-12-31", None], "timestamp_ntz": ["2024-01-01 00:00:00.000001", "2024-01-01 00:00:00", None], "decimal(20,4)": ["-1.5", "3.25", None], "binary": ["a", "ab", None]}
    for kind, xs in values.items():
        rows = [(i, str(x) if x is not None else None) for i, x in enumerate(xs)]
        df = spark.createDataFrame([*rows, *[(i + 50, x) for i, x in rows]], "i long, x string").select("i", F.col("x").cast(kind).alias("x"))
        best = df.where(F.col("x") == df.agg(F.max("x")).first()[0]) if kind != "double" else df.where(F.isnan("x"))
        want = best.agg(F.min("i")).first()[0]
        assert df.agg(A.max_by("i", "x", ["i"]).column()).first()[0] == want
        assert df.where("x is null").agg(A.max_by("i", "x", ["i"]).column()).first()[0] is None
        least = df.where(F.col("x") == df.agg(F.min("x")).first()[0]).agg(F.min("i")).first()[0]
        assert df.agg(A.min_by("i", "x", ["i"]).column()).first()[0] == least
    df = spark.createDataFrame([(1, "b", 5), (2, "a", 5), (3, "a", 4)], "i long, o string, x int")
    assert df.agg(A.max_by("i", "x", ["o"]).column()).first()[0] == 2


def test_bulk_takes_whole_batches(spark, rows):
    """The same sums by Arrow columns, with null and NaN keys."""
    import numpy as np

    bulk = Monoid(lambda x: x, lambda a, b: a + b, bulk=lambda s, c: (s or 0) + int(np.asarray(c[0]).sum()))
    for by in (["g"], ["d"], ["g", "d"], []):
        plain = monoid.aggregate(rows, Monoid(lambda x: x, lambda a, b: a + b), ["x"], "v long", by)
        got = monoid.aggregate(rows, bulk, ["x"], "v long", by, held=2)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))


def test_models_in_parts(spark):
    from mergeloom.operators import ordered

    rng = random.Random(4)
    data = [(i % 2, x, 3.0 * x + 1.0 - 4.0 * (i % 2)) for i in range(4000) for x in [rng.uniform(-1, 1)]]
    df = spark.createDataFrame(data, "g long, x double, y double").repartition(6)
    got = {r.g: r for r in ordered.sgd_in_parts(df, ["g"], ["x"], "y", [0.0, 0.0], ordered.constant_step(0.1)).collect()}
    for g in (0, 1):
        assert got[g]["count"] == 2000 and got[g].weights == pytest.approx([3.0, 1.0 - 4.0 * g], abs=0.05)
    one = df.where("g = 0").coalesce(1).sortWithinPartitions("x")
    alone = ordered.sgd_in_parts(one, [], ["x"], "y", [0.0, 0.0], ordered.constant_step(0.1)).first()
    whole = ordered.sgd(one, [], ["x"], ["x"], "y", [0.0, 0.0], ordered.constant_step(0.1)).first()
    assert alone.weights == pytest.approx(whole.weights) and alone["count"] == whole["count"]
