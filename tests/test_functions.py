"""Scalar instances, intervals, vectors, approximate values, folds, histograms."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.functions import algebra, approximate, intervals, keyed_maps, vectors
from mergeloom.operators import fold, ordered
from mergeloom.operators.sketches.exphist import ExpHist, least_buckets
from mergeloom.plans import spec


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


bounds = st.integers(-20, 20)
made = st.one_of(
    st.builds(intervals.closed, bounds, bounds), st.builds(intervals.open_, bounds, bounds), st.builds(intervals.left_closed_right_open, bounds, bounds),
    st.builds(intervals.left_open_right_closed, bounds, bounds), st.builds(intervals.at_least, bounds), st.builds(intervals.above, bounds),
    st.builds(intervals.at_most, bounds), st.builds(intervals.below, bounds), st.just(intervals.UNIVERSE), st.just(intervals.EMPTY),
)


@given(made, made, bounds)
def test_intersection_holds_what_both_hold(a, b, x):
    assert a.intersect(b).holds(x) == (a.holds(x) and b.holds(x))


@given(made, bounds)
def test_whole_number_ends(a, x):
    inside = [v for v in range(-60, 61) if a.holds(v)]
    if a.lower is not None and a.upper is not None:
        assert (a.least(), a.greatest()) == ((inside[0], inside[-1]) if inside else (None, None))
        assert a.is_empty_of_integers() == (not inside)
        assert a.left_closed_right_open().holds(x) == a.holds(x)


def test_interval_example_and_columns(spark):
    i = intervals.left_closed_right_open(1, 5).intersect(intervals.left_open_right_closed(2, 9))
    assert i == intervals.open_(2, 5)
    assert [r.id for r in spark.range(10).where(i.contains(F.col("id"))).collect()] == [3, 4]
    assert one(spark, x=i.least_to_greatest(), y=i.greatest_to_least()) == ([3, 4], [4, 3])
    assert i.map_non_decreasing(lambda v: v * 2) == intervals.open_(4, 10)


def test_instances(spark):
    a = F.lit
    ints, texts = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    got = one(
        spark, xor=algebra.plus(a(True), a(True), T.BooleanType()), text=algebra.plus(a("ab"), a("c"), T.StringType()),
        arrays=algebra.plus(F.array(a(1), a(2), a(3)), F.array(a(10), a(20)), ints), lists=algebra.plus(F.array(a("x")), F.array(a("y")), texts),
        zero=algebra.zero(T.StringType()), maybe=algebra.maybe_plus(a(None).cast("int"), a(4)), inverse=algebra.inverse(a(4.0)),
        none=algebra.divide(a(1.0), a(0.0)),
    )
    assert tuple(got) == (False, "abc", [11, 22, 3], ["x", "y"], "", 4, 0.25, None)


def test_struct_and_map_instances(spark):
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("b", T.BooleanType())])
    s = F.struct(F.lit(2).cast("long").alias("n"), F.lit(True).alias("b"))
    got = one(spark, s=algebra.plus(s, s, kind), z=algebra.zero(kind), m=keyed_maps.plus(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(-1), F.lit("b"), F.lit(2))))
    assert got.s.asDict() == {"n": 4, "b": False} and got.z.asDict() == {"n": 0, "b": False} and got.m == {"b": 2}


def test_registered_instance(spark):
    algebra.register("longer", lambda a, b: F.when(F.length(a) >= F.length(b), a).otherwise(b), "")
    assert one(spark, x=algebra.plus(F.lit("ab"), F.lit("xyz"), instance="longer"), z=algebra.zero(T.StringType(), "longer")) == ("xyz", "")


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0), F.lit(12.0))
    got = one(spark, l1=vectors.l1(a, b), l2=vectors.l2(a, b), back=vectors.from_map(vectors.to_map(b), 3), set=vectors.updated(a, 1, 7.0), long=vectors.extended(a, 4), dense=vectors.is_dense(b))
    assert (got.l1, got.l2, got.back, got.set, got.long, got.dense) == (19.0, 13.0, [0.0, 4.0, 12.0], [3.0, 7.0], [3.0, 0.0, 0.0, 0.0], True)


def test_approximate_values(spark):
    x, y = (approximate.approximate(F.lit(lo), F.lit(mid), F.lit(hi), F.lit(0.9)) for lo, mid, hi in ((1.0, 2.0, 3.0), (-2.0, 0.0, 1.0)))
    t, f = approximate.truth(F.lit(True), F.lit(0.9)), approximate.truth(F.lit(False), F.lit(0.8))
    got = one(spark, s=approximate.plus(x, y), d=approximate.minus(x, y), p=approximate.times(x, y), a=approximate.and_(t, f), o=approximate.or_(t, f), n=approximate.not_(t), e=approximate.xor(t, f))
    assert (got.s["min"], got.s["max"], got.d["min"], got.d["max"], got.p["min"], got.p["max"]) == (-1.0, 4.0, 0.0, 5.0, -6.0, 3.0)
    assert (got.a.is_true, got.o.is_true, got.n.is_true, got.e.is_true) == (False, True, False, True)
    assert got.a.prob == 0.8 and got.o.prob == 0.9


def test_affine_functions_compose_in_order(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, 4.0)], "i int, s double, b double")
    f = df.agg(fold.affine("s", "b", ["i"]).column().alias("f")).first().f
    assert (f.slope, f.offset) == (6.0, 7.0)


def test_fold_in_order(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "i int, c string").repartition(3)
    agg = fold.fold_left("c", F.lit(""), lambda acc, c: F.concat(acc, c), order=["i"])
    assert spec.aggregate(df, {"x": agg}).first().x == "abc"
    assert fold.over_empty(df, agg).first().value == ""


def test_exponential_histogram_sizes_and_bounds():
    rng = random.Random(1)
    for epsilon in (0.5, 0.1, 0.03):
        for window in (5, 50, 500):
            h, items, now, most = ExpHist(epsilon, window), [], 0, least_buckets(epsilon) + 1
            for _ in range(150):
                now += rng.choice([0, 0, 1, 3, window // 4])
                n = rng.choice([0, 1, 1, 2, 7, 100, 12345])
                h = h.add(n, now)
                items.append((n, now))
                true = sum(n for n, t in items if t > now - window)
                low, high = h.bounds()
                assert low <= true <= high and abs(h.guess() - true) <= epsilon * true + 1e-9 and h.relative_error() <= epsilon + 0.5 / max(low, 1)
                assert all(most - 1 <= sum(n for _, n in runs) <= most for runs in h.sizes[:-1])
                times = [t for _, t in h.buckets]
                assert times == sorted(times, reverse=True) and ExpHist.of_state(epsilon, window, *h.state()) == h
            assert ExpHist(epsilon, window).add_all(items) == h
    one = ExpHist(0.1, 9)
    for _ in range(57):
        one = one.inc(3)
    assert one.buckets == ExpHist(0.1, 9).add(57, 3).buckets


def test_exponential_histogram_example():
    h = ExpHist(0.5, 100).add(76, 1)
    sizes = lambda h: [n for n, _ in reversed(h.buckets)]
    assert sizes(h) == [32, 16, 8, 8, 4, 4, 2, 1, 1]
    assert sizes(h.inc(1)) == [32, 16, 8, 8, 4, 4, 2, 2, 1]
    assert sizes(h.inc(1).add(2, 1)) == [32, 16, 16, 8, 4, 2, 1]


def test_exponential_histogram_error():
    rng, h, seen, now = random.Random(3), ExpHist(0.1, 50), [], 0
    for _ in range(400):
        now += rng.randrange(3)
        n = rng.randrange(4)
        h = h.add(n, now)
        seen.append((now, n))
        true = sum(n for t, n in seen if t > now - 50)
        low, high = h.bounds()
        assert low <= true <= high or true == 0
        assert not true or abs(h.guess() - true) <= 0.1 * true + 0.5
    assert h.step(now - 30) == h


def test_general_scan_and_folds(spark):
    rows = [(k, i, v) for k in "ab" for i, v in enumerate([3, 1, 2])]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(4)
    out = ordered.scan_groups(df, ["k"], ["i"], ["v"], "k string, total long", 0, lambda s, r: (s + r[0], (s + r[0],)))
    assert sorted(map(tuple, out.collect())) == [(k, t) for k in "ab" for t in (3, 4, 6)]
    sums = ordered.fold_groups(df, ["k"], ["i"], ["v"], "k string, text string", "", lambda s, r: s + str(int(r[0])), lambda s: (s,))
    assert sorted(map(tuple, sums.collect())) == [("a", "312"), ("b", "312")]


def test_ordered_operators_keep_nulls_and_long_integers(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(None, i, v) for i, v in enumerate([big, None, big])] + [(1, 0, big)], "k long, i int, v long").repartition(3)
    out = ordered.scan_groups(df, ["k"], ["i"], ["v"], "k long, n long, v long", 0, lambda s, r: (s + 1, (s + 1, r[0]))).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(None, 1, big), (None, 2, None), (None, 3, big), (1, 1, big)]))
    folded = ordered.fold_groups(df, ["k"], ["i"], ["v"], "k long, n long", 0, lambda s, r: s + 1, lambda s: (s,)).collect()
    assert {r.k: r.n for r in folded} == {None: 3, 1: 1}
    nan = spark.createDataFrame([(float("nan"), i) for i in range(4)], "k double, i int")
    assert ordered.fold_groups(nan, ["k"], ["i"], ["i"], "k double, n long", 0, lambda s, r: s + 1, lambda s: (s,)).first().n == 4
    none = ordered.fold_groups(df.limit(0), ["k"], ["i"], ["v"], "k long, n long", 0, lambda s, r: s + 1, lambda s: (s,))
    assert none.count() == 0


def test_right_folded(spark):
    rows = [(1, 1, None, 1.0), (2, 2, None, 2.0), (3, None, 10.0, None), (4, 7, None, None), (5, None, 100.0, None)]
    df = spark.createDataFrame([(i, float(x) if x else None, v) for i, x, v, _ in rows], "i int, x double, v double").withColumn("k", F.lit("g"))
    out = ordered.right_folded(df, ["k"], ["i"], "x", "v", "k string, v double", lambda x, acc: 2 * acc + x).first()
    assert out.v == 2 * (2 * 10 + 2) + 1
    sums = ordered.right_folded_sums(df, ["k"], ["i"], "x", "v", "k string, v double, total double", lambda x, acc: acc + x).first()
    assert (sums.v, sums.total) == (13.0, 120.0)


def test_gradient_descent_finds_a_line(spark):
    df = spark.createDataFrame([(i, (i % 10) / 10.0, 3 * (i % 10) / 10.0 + 1) for i in range(2000)], "i int, x double, y double")
    m = ordered.sgd(df, [], ["i"], ["x"], "y", [0.0, 0.0], ordered.constant_step(0.2)).first()
    assert m["count"] == 2000 and m["weights"] == pytest.approx([3.0, 1.0], abs=0.01)
    two = spark.createDataFrame([(1, [1.0, 0.0]), (3, [5.0, 4.0])], "count long, weights array<double>")
    assert ordered.averaged_weights(two).first().weights == [4.0, 3.0]


def test_whole_numbers_of_rows(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.5, 1.9), (-2.0, -2.0), (3.0, 1.0), (None, 2.0)], "a double, b double")
    both = lambda lo, hi: [r[0] for r in df.select(intervals.whole_numbers("a", "b", lo, hi)).collect()]
    assert both(True, True) == [[1, 2, 3, 4], [], [-2], [], None]
    assert both(True, False) == [[1, 2, 3], [], [], [], None]
    assert both(False, False) == [[2, 3], [], [], [], None]
    assert both(False, True) == [[2, 3, 4], [], [], [], None]
