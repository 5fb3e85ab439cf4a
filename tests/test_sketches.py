"""Sketches against exact answers, within their stated bounds."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mergeloom.operators import aggregators as A
from mergeloom.operators import ordered
from mergeloom.operators.sketches import bloom, cms, hll, minhash, qtree
from mergeloom.sources import tables
from mergeloom.streaming import summers


def items(spark, xs, kind="int"):
    return spark.createDataFrame([(x,) for x in xs], f"x {kind}")


def test_hll_error_and_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("x"), (F.col("id") % 4).alias("g"))
    whole = hll.registers(df, "x", 12)
    est = hll.estimate(whole, 12).first().estimate
    assert abs(est - 5000) <= 3 * hll.error(12) * 5000
    merged = hll.merge(hll.registers(df, "x", 12, ["g"]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, hll.downsize(whole, 12, 8).collect())) == sorted(map(tuple, hll.registers(df, "x", 8).collect()))
    assert hll.estimate(whole.limit(0), 12).first().estimate == 0
    assert hll.bits_for_error(0.0163) == 12


def test_hll_intersection(spark):
    a, b = (hll.registers(spark.range(s, s + 4000).withColumnRenamed("id", "x"), "x", 13) for s in (0, 2000))
    assert abs(hll.intersection([a, b], 13).first().estimate - 2000) < 300


def test_set_size_is_exact_while_small(spark):
    df = items(spark, [1, 2, 2, 3])
    assert hll.set_size(df, "x", 10).first()["size"] == 3
    assert hll.set_size(df.limit(0), "x", 10).first()["size"] == 0


def test_cms_bounds(spark):
    rng = random.Random(1)
    xs = [int(rng.paretovariate(1)) for _ in range(3000)]
    true, df = Counter(xs), items(spark, xs)
    depth, width = cms.depth_for(1e-4), cms.width_for(0.01)
    est = {r.x: r.estimate for r in cms.frequency(cms.sketch(df, "x", depth, width), df, "x", depth, width).collect()}
    assert all(true[x] <= est[x] <= true[x] + 0.01 * len(xs) for x in true)
    top = cms.top_n(df, "x", depth, width, 3).collect()
    assert [r.x for r in top] == [x for x, _ in sorted(true.items(), key=lambda p: (-p[1], p[0]))[:3]]
    assert cms.frequency(cms.sketch(df, "x", depth, width), items(spark, [10**8]), "x", depth, width).first().estimate <= 30


def test_top_n_of_scopes_where_no_item_stands_out(spark):
    """More items than the native sketch tracks, all about as often: it names none."""
    df = spark.range(24_000).select(F.when(F.col("id") % 2 == 1, F.lit("odd")).otherwise(F.lit("even")).alias("g"), (F.col("id") % 6000).alias("x"))
    cells = cms.sketch(df, "x", 3, 500, ["g"])
    true = {(r.g, r.x): r.estimate for r in cms.frequency(cells, df, "x", 3, 500, ["g"]).collect()}
    want = {(g, x) for s in ("odd", "even") for (g, x), n in sorted((p for p in true.items() if p[0][0] == s), key=lambda p: (-p[1], p[0][1]))[:3]}
    got = cms.top_n(df, "x", 3, 500, 3, ["g"]).collect()
    assert len(got) == 6 and {(r.g, r.x) for r in got} == want and all(r.estimate == true[r.g, r.x] for r in got)


def test_decaying_cms_merge(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0)], "x string, t double")
    whole, at = cms.decaying(rows, "x", "t", 10.0, 4, 50)
    parts = [cms.decaying(rows.where(f"t {op} 6"), "x", "t", 10.0, 4, 50) for op in ("<", ">=")]
    merged, _ = cms.merge_decaying(*parts, 10.0)
    get = lambda cells: {r.x: r.estimate for r in cms.frequency(cells, rows, "x", 4, 50).collect()}
    assert get(merged) == pytest.approx(get(whole)) and get(whole)["a"] == pytest.approx(1.5)
    assert get(cms.rescaled(whole, at, 10.0, 20.0))["a"] == pytest.approx(0.75)
    assert cms.total_range(whole).first() == pytest.approx((1.5 + 0.5**0.5,) * 2)


def test_bloom(spark):
    width = bloom.optimal_width(500, 0.01)
    hashes = bloom.optimal_hashes(500, width)
    bits = bloom.create(items(spark, range(500)), "x", hashes, width)
    asked = bloom.maybe_contains(items(spark, range(2500)), "x", bits, hashes, width).collect()
    assert all(r.maybe for r in asked if r.x < 500)
    assert sum(r.maybe for r in asked if r.x >= 500) <= 60
    size = bloom.size(bits, hashes, width).first()["size"]
    assert size["min"] <= 500 <= size["max"]
    half = bloom.create(items(spark, range(250)), "x", hashes, width)
    other = bloom.create(items(spark, range(250, 500)), "x", hashes, width)
    assert bloom.hamming(bloom.union(half, other), bits).first().distance == 0
    assert bloom.intersects(half, bits).first()[0] and bloom.bits_minus(half, bits).count() == 0
    n = bloom.packed(bits).select(F.bitmap_count("bitmap").alias("n")).agg(F.sum("n")).first()[0]
    assert n == bits.count()


def test_qtree_bounds_hold(spark):
    rng = random.Random(2)
    xs = sorted(rng.random() * 100 for _ in range(2000))
    tree = qtree.leaves(items(spark, xs, "double"), "x", level=-2)
    for p in (0, 0.05, 0.5, 0.777777777, 0.95, 1):
        b = qtree.quantile_bounds(tree, p, level=-2).first()
        assert b.lower <= xs[min(int(len(xs) * p), len(xs) - 1)] < b.upper
    fine = qtree.leaves(items(spark, xs, "double"), "x", level=-20).withColumn("g", F.lit(None).cast("string"))
    for p in (0, 0.31, 0.5, 1):  # many blocks of leaves, and a null group
        b = qtree.quantile_bounds(fine, p, ["g"], level=-20).first()
        assert b.g is None and b.lower <= xs[min(int(len(xs) * p), len(xs) - 1)] < b.upper
    small = qtree.compress(tree, 4, level=-2)
    assert small.agg(F.sum("n")).first()[0] == 2000 and small.count() <= 2**6
    mean = qtree.inter_quartile_mean(tree, level=-2).first()
    true = sum(x for x in xs if xs[500] <= x < xs[1500]) / 1000
    assert mean.lower <= true <= mean.upper
    with pytest.raises(Exception, match="negative"):
        qtree.leaves(items(spark, [-1.0], "double"), "x").collect()


def test_minhash(spark):
    a, b = set(range(1000)), set(range(333, 1333))
    sig = lambda s: minhash.signatures(items(spark, s).withColumn("k", F.lit(1)), "x", 256, ["k"])
    est = minhash.similarity(sig(a), sig(b), 256).first().similarity
    assert abs(est - len(a & b) / len(a | b)) < 0.1
    assert abs(minhash.approximate_count(sig(a), 256, ["k"]).first()["count"] - 1000) < 250
    hashes, bands = minhash.pick_hashes_and_bands(0.5, 64)
    assert hashes % bands == 0 and abs(minhash.estimated_threshold(bands, hashes // bands) - 0.5) < 0.2


def test_similar_pairs_and_copies(spark):
    rng = random.Random(7)
    sets = {i: set(rng.sample(range(400), 60)) for i in range(6)}
    sets |= {10 + i: sets[i % 3] for i in range(7)} | {30: sets[1] | {500}}
    df = spark.createDataFrame([(k, x) for k, xs in sets.items() for x in xs], "k int, x int")
    got = {(r.a, r.b): r.similarity for r in minhash.similar_pairs(minhash.signatures(df, "x", 64, ["k"]), 64, 16, "k", 0.8).collect()}
    true = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert set(got) == {p for p, s in true.items() if s > 0.8} and all(abs(got[p] - true[p]) < 0.15 for p in got)


@pytest.mark.parametrize("least, bands", [(0.8, 16), (0.6, 8), (1.0, 16)])
def test_links_of_classes_compared_in_parts(spark, monkeypatch, least, bands):
    """Buckets of more sets than are compared at once: the links are those of all
    pairs, each once, and their numbers are added up without them."""
    monkeypatch.setattr(minhash, "CHUNK", 20)
    rng = random.Random(3)
    sets = {f"k{i}": frozenset(rng.sample(range(30), rng.choice([25, 26, 27]))) for i in range(120)} | {"z1": frozenset(range(100, 110)), "z2": frozenset(range(100, 110))}
    df = spark.createDataFrame([(k, x) for k, xs in sets.items() for x in xs], "k string, x int")
    sketch = minhash.signatures(df, "x", 64, ["k"]).cache()
    own = {}
    for r in sketch.collect():
        own.setdefault(r.k, [0] * 64)[r.i] = r.h
    first = {}
    for k in sorted(own):
        first.setdefault(tuple(own[k]), k)
    rows = 64 // bands
    shares = lambda a, b: any(own[a][i : i + rows] == own[b][i : i + rows] for i in range(0, rows * bands, rows))
    equal = lambda a, b: sum(x == y for x, y in zip(own[a], own[b], strict=True)) / 64
    names = sorted(first.values())
    want = {(a, b): equal(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if equal(a, b) >= least and shares(a, b)}
    members, links = minhash.similar_classes(sketch, 64, bands, "k", least)
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    assert {r.k: r["class"] for r in members.collect()} == {k: first[tuple(v)] for k, v in own.items()}
    numbers = minhash.linked_classes(sketch, 64, bands, "k", least)[1]
    assert {r["class"]: r.links for r in numbers.collect()} == Counter(k for p in want for k in p)
    assert least == 1 or len(want) > 100
    sketch.unpersist()


def test_space_saver_bounds(spark):
    rows = [(str(i),) for i in range(1, 101) for _ in range(i * i // 10)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "x string").repartition(10)
    true = Counter(x for (x,) in rows)
    out = ordered.space_saver(df, "x", 60).collect()
    assert len(out) == 60 and all(r.low <= true[r.item] <= r.high for r in out)
    top = ordered.saver_top_k(ordered.space_saver(df, "x", 60), 5).collect()
    assert {r.item for r in top} <= {str(i) for i in range(85, 101)}
    exact = ordered.space_saver(df, "x", 1000)
    assert {r.item: r.n for r in exact.collect()} == dict(true)
    assert ordered.consistent_with(ordered.space_saver(df, "x", 60), exact).first()[0]


def test_streamed_histogram_counts_the_window(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", 10 * i + j, 1) for j in range(5)], "k string, t long, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t long, n long").parquet(f"{tmp_path}/in")
    out = summers.exp_hist_stream(stream, "k", "t", "n", 0.1, 100)
    q = out.writeStream.format("memory").queryName("hist").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("hist").orderBy(F.col("high").desc()).first()
    assert last.low <= 15 <= last.high


def test_buffered_stream_equals_batch(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    df.repartition(4).write.parquet(f"{tmp_path}/in/t.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/t.parquet")
    aggs = {"n": A.size(), "v": A.sum_of("v")}
    summers.buffered(stream, aggs, ["k"], f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = sorted(map(tuple, summers.totals(spark, aggs, ["k"], f"{tmp_path}/out").collect()))
    assert got == [(k, len(range(k, 100, 3)), sum(range(k, 100, 3))) for k in range(3)]


def test_windowed_and_sessions(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", 1), ("2024-01-01 00:00:30", 2), ("2024-01-01 00:02:00", 4)], "t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    rows = rows.withColumn("k", F.lit("a"))
    assert sorted(r.v for r in summers.windowed(rows, "t", "1 minute", "1 minute", {"v": A.sum_of("v")}).collect()) == [3, 4]
    assert sorted(r.v for r in summers.sessions(rows, "t", "1 minute", "1 minute", {"v": A.sum_of("v")}, ["k"]).collect()) == [3, 4]


def test_stored_buffers(spark, tmp_path):
    aggs = {"n": A.size(), "top": A.max_of("x")}
    for xs in ([1, 5], [3]):
        tables.store(items(spark, xs).withColumn("k", F.lit("a")), aggs, ["k"], f"{tmp_path}/b")
    assert [tuple(r) for r in tables.load(spark, aggs, ["k"], f"{tmp_path}/b").collect()] == [("a", 3, 5)]


# Hashing once, bounded trees ------------------------------------------------------


def test_xxhash_is_the_published_one(spark):
    import xxhash

    from mergeloom.functions import hashing

    texts = ["", "a", "abc", "as the test text of a hash", "é漢" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.hash128("t").alias("h")).collect()
    for r in got:
        assert r.h.high & (2**64 - 1) == xxhash.xxh64_intdigest(r.t.encode(), 42)
    # The published vector of XXH64 of no input, seed 0, by the same library.
    assert xxhash.xxh64_intdigest(b"", 0) == 0xEF46DB3751D8E999
    assert len({(r.h.high, r.h.low) for r in got}) == len(texts) and all(r.h.high != r.h.low for r in got)


def test_linear_family(spark):
    from mergeloom.functions import hashing

    xs = [0, 1, -1, 2**63 - 1, -(2**63), 2**31 - 1, 2**40 + 5, 123456789]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = {r.x: r.c for r in df.select("x", hashing.linear(F.col("x"), 4, 1000, 7).alias("c")).collect()}
    for x in xs:
        u, out = x & (2**64 - 1), []
        for row in range(4):
            a, b, c, d = hashing.coefficients(7, row)
            out.append(((u & (2**30 - 1)) * a + (u >> 30 & (2**30 - 1)) * b + (u >> 60) * c + d) % (2**31 - 1) % 1000)
        assert got[x] == out
    # Two items meet in a row about as often as chance says.
    cols = spark.range(2000).select(hashing.linear(F.col("id"), 3, 64, 1).alias("c"))
    for r in range(3):
        loads = [x.n for x in cols.groupBy(F.get("c", F.lit(r)).alias("k")).agg(F.count("*").alias("n")).collect()]
        assert len(loads) == 64 and sum(n * n for n in loads) < 1.3 * 2000 * 2000 / 64


def test_items_of_one_value_meet_whatever_their_width(spark):
    """Short, int and long columns are one family; text has its own two."""
    for kind in ("smallint", "int", "long"):
        df = spark.createDataFrame([(i % 50,) for i in range(3000)], "x int").select(F.col("x").cast(kind).alias("x"))
        cells = cms.sketch(df, "x", 4, 200)
        got = {(r.row, r.col): r.n for r in cells.collect()}
        first = got if kind == "smallint" else first  # noqa: F821
        assert got == first
    text = spark.createDataFrame([(f"k{i % 40}",) for i in range(2000)], "x string")
    for family in ("md5", "xxhash64"):
        cells = cms.sketch(text, "x", 5, 400, family=family)
        assert all(r.estimate >= 50 for r in cms.frequency(cells, text, "x", 5, 400, family=family).collect())
        grouped = cms.sketch(text.withColumn("g", F.lit(None).cast("int")), "x", 5, 400, ["g"], family=family)
        asked = text.withColumn("g", F.lit(None).cast("int"))
        assert all(r.estimate >= 50 for r in cms.frequency(grouped, asked, "x", 5, 400, ["g"], family=family).collect())


def test_bounded_tree(spark):
    rng = random.Random(5)
    values = [rng.expovariate(0.001) for _ in range(30_000)] + [0.0] * 500 + [1e6]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(1, None), (0, float("nan"))], "g int, v double").repartition(6)
    for k in (3, 6):
        nodes = qtree.bounded(df, "v", k, ["g"]).cache()
        partial_nodes = {r.g: r.n for r in nodes.groupBy("g").agg(F.count("*").alias("n")).collect()}
        assert all(n <= qtree.most_nodes(k) for n in partial_nodes.values())
        sums = {r.g: (r.n, r.s) for r in nodes.groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
        for g in (0, 1):
            own = sorted(v for i, v in enumerate(values) if i % 2 == g)
            assert sums[g][0] == len(own) and sums[g][1] == pytest.approx(sum(own))
        for p in (0.0, 0.01, 0.5, 0.9, 0.999, 1.0):
            for r in qtree.node_bounds(nodes, p, ["g"]).collect():
                own = sorted(v for i, v in enumerate(values) if i % 2 == r.g)
                value = own[min(int(len(own) * p), len(own) - 1)]
                assert r.lower <= value < r.upper
                if k == 6 and 0.01 < p < 0.99:  # ranks off by a few 2^-k of all at most
                    off = 6 * len(own) / 2**k
                    assert sum(v < r.lower for v in own) >= len(own) * p - off and sum(v < r.upper for v in own) <= len(own) * p + off
        nodes.unpersist()


def test_small_trees_are_exact(spark):
    df = spark.createDataFrame([(float(i % 40),) for i in range(1000)], "v double").repartition(3)
    assert qtree.approximate_percentile(df, "v", 0.25).first().percentile == 10.0
    assert {(r.leaf, r.n) for r in qtree.bounded(df, "v", 9, level=0).collect()} == {(i, 25) for i in range(40)}
    with pytest.raises(Exception, match="negative"):
        qtree.bounded(spark.createDataFrame([(-1.0,)], "v double"), "v").collect()


def test_bands_by_their_threshold():
    assert minhash.pick_bands(0.5, 100) == 23 and minhash.pick_bands(0.3, 256) == 73


def test_bloom_size_bounds(spark):
    for n in (1, 50, 900):
        df = spark.range(n).withColumnRenamed("id", "x")
        size = bloom.size(bloom.create(df, "x", 5, 9000), 5, 9000).first()["size"]
        assert size.min <= n <= size.max and size.min <= size.estimate <= size.max and 0 <= size.prob <= 1
