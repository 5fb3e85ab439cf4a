"""Laws: any partitioning gives the same, merged buffers give the whole, empty
input gives the zero or nothing."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergeloom.operators import aggregators as A
from mergeloom.operators import keyed as K
from mergeloom.operators import scan
from mergeloom.operators.preparer import prepare
from mergeloom.plans import spec

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
lists = st.lists(st.integers(-1000, 1000), max_size=30)


def frame(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x int")


def aggs():
    return {
        "size": A.size(),
        "sum": A.sum_of("x"),
        "max": A.max_of("x"),
        "min": A.min_of("x"),
        "all": A.forall(F.col("x") > -2000),
        "any": A.exists(F.col("x") > 990),
        "head": A.head("x", ["i"]),
        "last": A.last("x", ["i"]),
        "list": A.to_list("x", ["i"]),
        "set": A.to_set("x"),
        "mean": A.averaged("x").and_then_present(lambda s: F.round(s["mean"], 9)),
        "odd": A.bool_xor(F.col("x") % 2 != 0),
    }


def expected(xs):
    return {
        "size": len(xs), "sum": sum(xs), "max": max(xs, default=None), "min": min(xs, default=None), "all": True, "any": any(x > 990 for x in xs),
        "head": xs[0] if xs else None, "last": xs[-1] if xs else None, "list": xs, "set": sorted(set(xs)), 
        "mean": round(sum(xs) / len(xs), 9) if xs else 0.0, "odd": sum(x % 2 for x in xs) % 2 == 1,
    }


@few
@given(lists)
def test_aggregations_equal_lists_in_any_partitioning(spark, xs):
    want = expected(xs)
    for n in (1, 7):
        row = spec.aggregate(frame(spark, xs).repartition(n), aggs()).first().asDict()
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in row.items()} == want


@few
@given(lists)
def test_merged_buffers_equal_the_whole(spark, xs):
    df = frame(spark, xs).withColumn("part", F.col("i") % 3)
    stored = spec.buffers(df, aggs(), ["part"])
    row = spec.present_buffers(spec.merge(stored, aggs()), aggs()).first().asDict()
    assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in row.items()} == expected(xs)


def test_empty_input(spark):
    none = frame(spark, [])
    row = spec.aggregate(none, aggs()).first()
    assert (row["size"], row["sum"], row["max"], row["all"], row["any"], row["list"]) == (0, 0, None, True, False, [])
    with pytest.raises(Exception, match="empty input"):
        prepare(none, "x").max().collect()
    assert prepare(spark.createDataFrame([(None,)], "x int"), "x").max().first()[0] is None
    assert prepare(none, "x").max_option().first()[0] is None


def test_moments_of_known_values(spark):
    for xs, want in (([1, 2, 3, 4, 5], (5, 3.0, 2.0, 0.0, -1.3)), ([1, 1, 1, 2, 3], (5, 1.6, 0.64, 0.84375, -0.921875))):
        df = frame(spark, xs)
        m = spec.aggregate(df, {"m": A.moments("x")}).first().m
        assert (m["count"], *[pytest.approx(v) for v in (m["mean"], m["variance"], m["skewness"], m["kurtosis"])]) == want
        stored = A.merge_moments(A.moment_buffers(df, "x", ["i"]))
        merged = stored.select(*[c.alias(n) for n, c in A.present_moments([F.col(m) for m in A.MOMENTS]).items()]).first()
        assert [merged[n] for n in ("count", "mean", "variance", "skewness", "kurtosis")] == pytest.approx(list(want))
        negated = A.negate_moments(stored).first()
        assert (negated.m0, negated.m1) == (-want[0], pytest.approx(want[1]))


def central():
    x, y = F.col("x").cast("double"), (F.col("x") * F.col("i")).cast("double")
    return {"m": A.moments(x), "c": A.correlation(x, y), "w": A.weighted_correlation(x, y, F.col("i") % 3 + 1), "n": A.size()}


def flat(row):
    """All numbers of a row, nested ones too; null for what does not vary."""
    out = []
    for v in row:
        out += flat(v) if isinstance(v, tuple) else [v]
    return out


@few
@given(st.lists(st.integers(-50, 50), max_size=25))
def test_central_statistics_merge_in_any_order(spark, xs):
    df = frame(spark, xs).withColumn("part", F.when(F.col("i") % 4 > 0, F.col("i") % 4)).withColumn("whole", F.lit("w"))
    want = flat(spec.aggregate(df, central()).first())
    numbers = lambda row: [pytest.approx(v, rel=1e-6, abs=1e-6) if isinstance(v, float) else v for v in row]
    joined = {"s": spec.struct_of(central())}
    by_part = spec.buffers(df, joined, ["whole", "part", "i"])
    steps = spec.merge(spec.merge(by_part, joined, ["whole", "part"]), joined)
    assert flat(spec.present_buffers(steps, joined).first()) == numbers(want)
    stored = spec.append(spec.buffers(df.where("i < 9"), central(), ["whole"]), df.where("i >= 9"), central(), ["whole"])
    assert not xs or flat(spec.present_buffers(stored, central()).first()) == numbers(want)
    window = scan.ordered(["i"]).rowsBetween(scan.Window.unboundedPreceding, scan.Window.unboundedFollowing)
    over = df.select(*[a.over(window).alias(n) for n, a in central().items()]).first()
    assert not xs or flat(over) == numbers(want)


def test_parts_of_central_statistics_refuse_to_merge_alone(spark):
    df = frame(spark, [1, 2, 3])
    for agg in (A.moments("x"), A.correlation("x", "i")):
        with pytest.raises(ValueError, match="merge"):
            scan.global_scan(df, {"a": agg}, ["i"], F.col("i"), 2)
    distinct = {"a": A.unique_count_exact("x")}
    with pytest.raises(ValueError, match="merge"):
        spec.merge(spec.buffers(df, distinct, ["i"]), distinct)


def test_correlation_of_large_values(spark):
    rows = spark.range(200).select((F.col("id") + 1e9).alias("x"), (2 * F.col("id") - 3e8).alias("y"), F.lit(2).alias("w"))
    c = spec.aggregate(rows, {"c": A.correlation("x", "y")}).first().c
    assert c.correlation == pytest.approx(1.0) and c.correlation <= 1 and c.distance == pytest.approx(0, abs=1e-6)
    w = spec.aggregate(rows, {"c": A.weighted_correlation_of(rows, "x", "y", "w")}).first().c
    assert (w.weight, w.variance_x, w.correlation) == (400.0, pytest.approx((200**2 - 1) / 12), pytest.approx(1.0))
    same = rows.withColumn("x", F.lit(1e9))
    flat_x = spec.aggregate(same, {"c": A.weighted_correlation("x", "y", "w")}).first().c
    assert flat_x.weight == 400.0  # whatever is left of the variance, nothing is divided by zero


def test_top_k_buffers(spark):
    rng = random.Random(3)
    rows = [(g, p, rng.randrange(50)) for g in "ab" for p in range(4) for _ in range(9)]
    df = spark.createDataFrame([*rows, ("a", 0, None)], "g string, p int, x int").repartition(5)
    got = A.merge_top_k(A.top_k(df, 3, "x", ["g", "p"]), 3, ["g"]).collect()
    assert {r.g: r.top for r in got} == {g: sorted(x for h, _, x in rows if h == g)[:3] for g in "ab"}
    everything = A.merge_top_k(A.top_k(df, 3, "x", ["g"]), 3).first()
    assert everything.top == sorted(x for *_, x in rows)[:3]


def test_sum_by_key_drops_zeros_only_if_asked(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in K.sum_by_key(df, ["k"], "v").collect()] == [("b", 2)]
    assert sorted(map(tuple, K.sum_by_key(df, ["k"], "v", keep_zeros=True).collect())) == [("a", 0), ("b", 2)]


def test_reset_state(spark):
    df = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 5, True), (4, 3, False)], "i int, v int, r boolean").withColumn("k", F.lit(1))
    assert K.reset_sum(df, "v", F.col("r"), ["i"], ["k"]).first().v == 8


def test_set_differences(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "k int")
    rng = random.Random(1)
    for _ in range(3):
        a, b = ({rng.randrange(20) for _ in range(8)} for _ in range(2))
        diff = K.set_diff_of(one(a), one(b), ["k"])
        assert {r.k for r in K.set_diff_apply(one(a), diff, ["k"]).collect()} == b
        assert {r.k for r in K.set_diff_strict(one(b), K.set_diff_invert(diff), ["k"]).collect()} == a
    wrong = spark.createDataFrame([(1, "add")], "k int, op string")
    with pytest.raises(Exception, match="does not fit"):
        K.set_diff_strict(one([1]), wrong, ["k"]).collect()
    changes = spark.createDataFrame([(7, "add", 1), (7, "remove", 2)], "k int, op string, at int")
    assert K.set_diff_merge(changes, ["k"], ["at"]).first().op == "remove"


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0), (3, 4, 1.0)], "source long, target long, weight double")
    start = spark.createDataFrame([(1, 0.0)], "node long, cost double")
    assert dict(map(tuple, K.min_plus_closure(start, edges, 10).collect())) == {1: 0.0, 2: 5.0, 3: 6.0, 4: 7.0}
    with pytest.raises(RuntimeError, match="still change"):
        K.min_plus_closure(start, edges, 2)


@few
@given(lists, st.integers(2, 9))
def test_global_scan_in_any_ranges(spark, xs, chunks):
    own = {k: aggs()[k] for k in ("size", "sum", "max", "head", "last", "mean", "any")}
    got = scan.global_scan(frame(spark, xs), own, ["i"], F.col("i"), chunks).orderBy("i").collect()
    for k, row in enumerate(got):
        want = expected(xs[: k + 1])
        assert {n: row[n] for n in own} == {n: pytest.approx(want[n]) if n == "mean" else want[n] for n in own}


def test_scans_by_group(spark):
    df = frame(spark, [5, 1, 4, 2]).withColumn("g", F.col("i") % 2)
    w = scan.ordered(["i"], ["g"])
    rows = scan.scan(df, {"s": scan.cumulative(A.sum_of("x"), w), "b": scan.prior_state(A.sum_of("x"), w, 0), "k": scan.index(w), "d": scan.trailing_sum_by_difference("x", 2, w)}).orderBy("i").collect()
    assert [(r.s, r.b, r.k, r.d) for r in rows] == [(5, 0, 0, 5), (1, 0, 0, 1), (9, 5, 1, 9), (3, 1, 1, 3)]


def test_combined_mean(spark):
    for n, a, k, b in ((1, 2.0, 1000, 3.0), (5, 1.0, 5, 2.0), (0, 0.0, 4, 7.0), (900, 1.0, 2, 5.0)):
        got = spark.range(1).select(A.combined_mean(F.lit(n), F.lit(a), F.lit(k), F.lit(b)).alias("m")).first().m
        assert got == pytest.approx((n * a + k * b) / (n + k))
