"""Functions that no query needs: each against its definition."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mergeloom.functions import algebra, approximate, hashing, intervals, vectors
from mergeloom.operators import aggregators as A
from mergeloom.operators import fold, ordered, scan
from mergeloom.operators import keyed as K
from mergeloom.operators.preparer import prepare
from mergeloom.operators.sketches import bloom, cms, hll, minhash, qtree
from mergeloom.plans import spec
from mergeloom.streaming import summers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def numbers(spark, xs, kind="int"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")


def test_carried_and_adjoined_instances(spark):
    product = algebra.bijected(lambda a, b: a + b, F.log, F.exp)  # sums of logarithms
    added = algebra.adjoined_plus(algebra.adjoined(F.lit(1), F.lit(5)), algebra.adjoined(F.lit(2), F.lit(-3)))
    row = one(spark, product=product(F.lit(6.0), F.lit(7.0)), added=added)
    assert row.product == pytest.approx(42.0) and tuple(row.added) == (3, 2)


def test_approximate_bounds(spark):
    a = approximate.approximate(F.lit(2.0), F.lit(5.0), F.lit(9.0), F.lit(0.9))
    row = one(spark, low=approximate.with_min(a, F.lit(6.0)), high=approximate.with_max(a, F.lit(4.0)), at=approximate.bounds_contain(a, F.lit(9.0)), out=approximate.bounds_contain(a, F.lit(9.5)))
    assert tuple(row.low) == (6.0, 6.0, 9.0, 0.9) and tuple(row.high) == (2.0, 4.0, 4.0, 0.9) and (row.at, row.out) == (True, False)


def test_hashes(spark):
    rows = spark.range(1000).select(hashing.fast64(1, "id").alias("a"), hashing.fast64(2, "id").alias("b"))
    assert rows.select("a").distinct().count() == 1000 and rows.where("a = b").count() == 0


def test_strict_bounds_and_neighbours(spark):
    assert intervals.closed(3, 7).strict_lower_bound() == 2 and intervals.closed(3, 7).strict_upper_bound() == 8
    assert intervals.open_(3, 7).strict_lower_bound() == 3 and intervals.open_(3, 7).strict_upper_bound() == 7
    assert intervals.EMPTY.strict_lower_bound() is None and intervals.UNIVERSE.strict_upper_bound() is None
    most = F.lit(2**63 - 1)
    row = one(spark, up=intervals.successor(F.lit(4).cast("long")), top=intervals.successor(most), down=intervals.predecessor(F.lit(4).cast("long")), bottom=intervals.predecessor(F.lit(-(2**63)).cast("long")))
    assert tuple(row) == (5, None, 3, None)


def test_matrices_and_distances(spark):
    ones = vectors.matrix_fill(spark, 2, 3, 1.0)
    assert sorted(map(tuple, ones.collect())) == [(i, j, 1.0) for i in range(2) for j in range(3)]
    changes = spark.createDataFrame([(1, 2, 9.0)], "row int, col int, v double")
    assert {(r.row, r.col): r.v for r in vectors.matrix_updated(ones, changes).collect()}[1, 2] == 9.0
    assert vectors.matrix_updated(ones, changes).count() == 6
    assert one(spark, d=vectors.scalar_distance(F.lit(3.0), F.lit(-4.0))).d == 7.0


def test_unions_of_sets(spark):
    df = spark.createDataFrame([(1, [3, 1]), (2, [1, 2]), (3, None)], "i int, x array<int>")
    agg = {"s": A.union_sets("x")}
    assert spec.aggregate(df, agg).first().s == [1, 2, 3]
    assert spec.present_buffers(spec.merge(spec.buffers(df, agg, ["i"]), agg), agg).first().s == [1, 2, 3]


def test_samples_of_a_normal_variable(spark):
    row = spark.range(20_000).select(A.gaussian_sample(F.lit(3.0), F.lit(4.0), 7).alias("x")).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    assert row.m == pytest.approx(3.0, abs=0.1) and row.v == pytest.approx(4.0, abs=0.3)


def test_mapped_folds(spark):
    df = numbers(spark, [1, 2, 3])
    agg = fold.map_result(fold.contramap(A.sum_of("x"), lambda x: x * 10), lambda s: s + 1)
    assert spec.aggregate(df, {"s": agg}).first().s == 61


def test_optional_results(spark):
    some, none = prepare(numbers(spark, [5, -7, 2]), "x"), prepare(numbers(spark, []), "x")
    results = {
        "last_option": (lambda p: p.last_option("i"), 2), "min_option": (lambda p: p.min_option(), -7),
        "max_option_by": (lambda p: p.max_option_by(lambda x: x * x, "i"), -7), "min_option_by": (lambda p: p.min_option_by(lambda x: x * x, "i"), 2),
        "reduce_option": (lambda p: p.reduce_option(lambda a, b: a - b, "i"), 10),
    }
    for name, (f, want) in results.items():
        assert f(some).first()[0] == want and f(none).first()[0] is None, name


def test_geometric_sequence(spark):
    w = Window.orderBy("i")
    assert [r.g for r in numbers(spark, [0] * 5).select("i", scan.iterate_geometric(3.0, 2.0, w).alias("g")).orderBy("i").collect()] == [3.0, 6.0, 12.0, 24.0, 48.0]


def test_filters_that_answer_and_grow(spark):
    empty, first, second = (bloom.create(spark.range(a, b).withColumnRenamed("id", "x"), "x", 4, 2000) for a, b in ((0, 0), (0, 50), (40, 90)))
    grown, said = bloom.check_and_add(first, spark.range(40, 90).withColumnRenamed("id", "x"), "x", 4, 2000)
    assert {r.bit for r in grown.collect()} == {r.bit for r in bloom.union(first, second).collect()}
    assert all(r.maybe for r in said.collect() if r.x < 50) and sum(r.maybe for r in said.collect()) < 20
    a, b = ({r.bit for r in f.collect()} for f in (first, second))
    assert {r.bit for r in bloom.bits_xor(first, second).collect()} == a ^ b and bloom.bits_xor(empty, first).count() == len(a)
    both = bloom.merge_packed(bloom.packed(first).union(bloom.packed(second)))
    assert both.select(F.bitmap_count("bitmap").alias("n")).agg(F.sum("n")).first()[0] == len(a | b)


def test_merged_series(spark):
    rows = spark.range(3000).select((F.col("id") % 700).alias("x"), F.col("id").alias("t"), (F.col("id") % 3).alias("g"))
    whole, parts = hll.series(rows, "x", "t", 8), hll.series(rows, "x", "t", 8, ["g"])
    order = lambda df: sorted(map(tuple, df.select("j", "rho", "ts").collect()))
    assert order(hll.merge_series(parts)) == order(whole)


def test_parameters_of_bands():
    assert minhash.hashes_for(1024) == 256 and minhash.hashes_for(1024, 2) == 512
    assert minhash.probability_of_inclusion(0.5, 1, 1) == 0.5 and minhash.probability_of_inclusion(0.9, 20, 5) > 0.99
    assert minhash.probability_of_inclusion(minhash.estimated_threshold(16, 4), 16, 4) == pytest.approx(0.64, abs=0.05)


def test_coarser_bins(spark):
    tree = qtree.leaves(numbers(spark, [0.1, 0.6, 1.2, 7.9], "double"), "x", level=-1)
    assert sorted(map(tuple, qtree.coarsened(tree, 2).select("leaf", "n").collect())) == [(0, 3), (3, 1)]


def test_frequent_items_and_rows_as_they_are(spark):
    df = spark.createDataFrame([(x,) for x in "aaaaabbbc"], "x string")
    rows = ordered.most_frequent(ordered.space_saver(df, "x", 5), 3).collect()
    assert {(r.item, r.n, r.guaranteed) for r in rows} == {("a", 5, True), ("b", 3, True)}
    keyed = df.withColumn("v", F.lit(1))
    assert summers.null_summer(keyed, ["x"], "v").count() == 9
    seen, observation = summers.counted_calls(keyed, "calls", F.sum("v").alias("total"))
    seen.write.format("noop").mode("overwrite").save()
    assert observation.get == {"calls": 9, "total": 9}


def test_hot_key_of_one_value_is_dealt_out(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 9000, 1).otherwise(F.col("id") % 7).alias("k"), F.lit(1).alias("v"))
    want = {r.k: r.v for r in df.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    assert {r.k: r.v for r in summers.salted_sum_by_key(df, ["k"], "v", 8).collect()} == want


def test_estimates_by_broadcast_and_by_join_agree(spark, monkeypatch):
    df = spark.createDataFrame([(str(i * i % 97),) for i in range(3000)] + [(None,)], "x string")
    cells = cms.sketch(df, "x", 3, 40)
    want = {r.x: r.estimate for r in cms.frequency(cells, df.where("x is not null"), "x", 3, 40).collect()}
    got = cms.estimated(df, cells, "x", 3, 40).collect()
    assert len(got) == 3000 and all(r.estimate == want[r.x] and r.total == 3000 for r in got)
    results = lambda: (sorted(map(tuple, cms.top_pct(df, "x", 3, 40, 0.03).collect())), list(map(tuple, cms.top_n(df, "x", 3, 40, 7).collect())))
    small = results()
    assert small[1] == sorted(want.items(), key=lambda p: (-p[1], p[0]))[:7] and small[0] == sorted((x, n) for x, n in want.items() if n >= 90)
    assert cms.top_n(df, "x", 3, 40, 500).count() == len(want)
    monkeypatch.setattr(cms, "MOST_CELLS", 10)
    assert results() == small
    assert cms.top_n(df.limit(0), "x", 3, 40, 7).count() == 0 and cms.top_pct(df.limit(0), "x", 3, 40, 0.1).count() == 0


def test_maps_compared_by_group(spark):
    """Against plain dictionaries: null groups, keys and values, zeros, a side
    without the group, no rows at all."""
    schema = "g string, k string, v long"
    left = [("a", "x", 1), ("a", None, 2), ("b", "x", 1), ("b", "y", 0), (None, "x", 5), ("c", "x", None), ("e", "x", 0), ("f", "x", 1)]
    right = [("a", "x", 1), ("a", None, 2), ("a", "z", 3), ("b", "x", 1), (None, "x", 5), ("c", "x", None), ("d", "x", 4), ("f", "x", 2)]
    groups = lambda rows: {g: {k: v for h, k, v in rows if h == g} for g, _, _ in rows}
    a, b = groups(left), groups(right)
    want = {}
    for g in {*a, *b}:
        x, y = a.get(g, {}), b.get(g, {})
        want[g] = (all(k in y and y[k] == v for k, v in x.items()), all((x.get(k) or 0) == (y.get(k) or 0) for k in {*x, *y}))
    table = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    got = K.compared_maps(table(left), table(right), ["g"], ["k"], "v")
    assert {r.g: (r.contained, r.equal) for r in got.collect()} == want
    assert set(want.values()) == {(True, True), (True, False), (False, True), (False, False)}
    assert K.compared_maps(table([]), table([]), ["g"], ["k"], "v").collect() == []
