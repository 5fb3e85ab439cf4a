"""Binary states: exact while small, the relations' own registers and cells
beyond, merged in any mix; scoped hitters, sketch maps and closures."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mergeloom.operators import aggregators as A
from mergeloom.operators import keyed as K
from mergeloom.operators import ordered
from mergeloom.operators.sketches import bloom, cms, hll, states


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(g, rng.randrange(n), h) for g, n in ((None, 5), ("a", 2000), ("b", 60)) for h in range(2) for _ in range(1500)]
    return spark.createDataFrame([*data, ("b", None, 0)], "g string, x long, h int").repartition(6).cache()


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_registers_are_the_relations_own(rows):
    want = pairs(hll.registers(rows, "x", 8, ["g"]))
    for most in (0, 10, 100, 10_000):
        fine = states.sets(rows, "x", 8, most, ["g", "h"])
        stored = states.merge_sets(fine, ["g"])
        assert pairs(states.registers(stored, ["g"])) == want
        got = {r.g: (r.size, r.exact) for r in states.set_sizes(stored, ["g"]).collect()}
        true = {r.g: r.n for r in rows.groupBy("g").agg(F.countDistinct("x").alias("n")).collect()}
        estimates = {r.g: r.estimate for r in hll.estimate(hll.registers(rows, "x", 8, ["g"]), 8, ["g"]).collect()}
        for g, n in true.items():
            assert got[g][1] == (n <= most)
            assert got[g][0] == pytest.approx(n if n <= most else estimates[g], rel=1e-12)


def test_states_and_relations_become_each_other(rows):
    relation = hll.registers(rows, "x", 8, ["g"])
    stored = states.of_registers(relation, 8, ["g"])
    assert pairs(states.registers(stored, ["g"])) == pairs(relation)
    exact = states.sets(rows, "x", 8, 10_000, ["g"])
    both = states.merge_sets(stored.unionByName(exact), ["g"])
    assert pairs(states.registers(both, ["g"])) == pairs(relation)


def test_cells_are_the_relations_own(rows):
    want = pairs(cms.sketch(rows, "x", 4, 50, ["g"]).select("g", "row", "col", "n"))
    full = states.merge_counts(states.counts(rows, "x", 4, 50, 0, ["g", "h"]), ["g"])
    assert pairs(states.count_rows(full, ["g"]).where("row is not null").select("g", "row", "col", "n")) == want
    mixed = states.merge_counts(states.counts(rows, "x", 4, 50, 70, ["g", "h"]), ["g"])
    got = {r.g: (r.total, r.exact) for r in states.totals(mixed, ["g"]).collect()}
    assert got == {None: (3000, True), "a": (3000, False), "b": (3000, True)}
    found = states.frequency(mixed, rows, "x", 4, 50, ["g"]).collect()
    true, cells = Counter(), {(r.g, r.x): r.estimate for r in cms.frequency(cms.sketch(rows, "x", 4, 50, ["g"]), rows.where("x is not null"), "x", 4, 50, ["g"]).collect()}
    for r in rows.collect():
        true[r.g, r.x] += 1
    assert len(found) == len({k for k in true if k[1] is not None})
    for r in found:
        assert r.estimate == (cells[r.g, r.x] if r.g == "a" else true[r.g, r.x]) and r.exact == (r.g != "a")
    one = states.counts(rows, "x", 4, 50, 5000)
    assert all(r.exact for r in states.frequency(one, rows, "x", 4, 50).collect())


def test_round_trips_and_wrong_bytes(spark, rows):
    s = states.SetState(6, 3).add(5).add(-7)
    assert states.SetState.loads(s.dumps()).hashes == {5, -7}
    full = states.SetState(6, 1).add(5).add(-7).add(2**40)
    assert (states.SetState.loads(full.dumps()).registers == full.registers).all() and full.hashes is None
    c = states.CountState(3, 7, 1, 2).add(4, 2).add(-9)
    assert states.CountState.loads(c.dumps()).counts == {4: 2, -9: 1} and c.add(8).counts is None
    assert (states.CountState.loads(c.dumps()).cells == c.cells).all() and c.total() == 4
    with pytest.raises(ValueError, match="no MSET"):
        states.SetState.loads(c.dumps())
    with pytest.raises(ValueError, match="different widths"):
        states.BitState(8) + states.BitState(16)
    empty = states.set_sizes(states.sets(rows.where("false"), "x", 8)).collect()
    assert [tuple(r) for r in empty] == [(0.0, True)]


def test_filters(rows):
    fine = states.filters(rows, "x", 4, 5000, ["g", "h"])
    merged = states.merge_filters(fine, ["g"])
    for g in (None, "a", "b"):
        own = rows.where(F.col("g").eqNullSafe(F.lit(g)))
        got = states.bits(merged, ["g"]).where(F.col("g").eqNullSafe(F.lit(g))).select("bit")
        assert pairs(got) == pairs(bloom.create(own, "x", 4, 5000))


def test_space_saver_bytes(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("it\"em é,%d" % min(rng.randrange(40), rng.randrange(40)),) for _ in range(2000)], "x string").repartition(3)
    saver = ordered.space_saver(df, "x", 12).cache()
    stored = states.pack_saver(saver)
    back = states.unpack_saver(stored)
    assert pairs(back) == pairs(saver.select("item", "low", "n", "high", "guaranteed"))
    assert stored.schema["_state"].dataType.simpleString() == "binary"
    with pytest.raises(Exception, match="no MSAV"):
        states.unpack_saver(stored.select(F.lit(b"XXXX[]").alias("_state"))).collect()


# Scoped hitters ------------------------------------------------------------------


def test_scoped_hitters_with_bounds(spark, rows, monkeypatch):
    plain = {}
    monkeypatch.setattr(cms, "MOST_CELLS", 500)  # every distinct item is estimated
    for n in (1, 3, 100):
        plain[n] = pairs(cms.top_n(rows, "x", 4, 60, n, ["g"]))
    monkeypatch.undo()
    for n in (1, 3, 100):
        assert pairs(cms.top_n(rows, "x", 4, 60, n, ["g"])) == plain[n]
    assert {r[0] for r in plain[1]} == {None, "a", "b"} and all(r[2] > 0 for r in plain[1])
    many = spark.range(0, 40_000, 1, 4).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id") % 60).otherwise(F.col("id")).alias("x"))
    got = cms.top_n(many, "x", 4, 20_000, 5, ["g"])
    assert {(r.g, r.x) for r in got.collect()} == {(g, x) for g in range(3) for x in sorted(x for x in range(0, 60, 2) if x % 3 == g)[:5]}


def test_sketch_maps_of_any_aggregate(spark):
    rng = random.Random(9)
    data = [(rng.randrange(300), rng.randrange(1000)) for _ in range(6000)] + [(None, 5000), (7, 4000), (11, 3000)]
    df = spark.createDataFrame(data, "k long, v long").repartition(5)
    for agg, of in ((A.max_of("v"), max), (A.sum_of("v"), sum)):
        true = {k: of(v for q, v in data if q == k) for k in range(300)}
        stored = cms.sketch_map_of(df, "k", agg, 5, 900)
        halves = cms.sketch_map_of(df.where("v < 500"), "k", agg, 5, 900).unionByName(cms.sketch_map_of(df.where("v >= 500"), "k", agg, 5, 900))
        assert pairs(cms.map_values(stored, agg)) == pairs(cms.map_values(cms.merge_map(halves, agg), agg))
        got = {r.k: r.estimate for r in cms.map_estimates(df, stored, "k", agg, 5, 900).collect()}
        assert set(got) == set(true) and all(got[k] >= true[k] for k in true)
        assert sum(got[k] == true[k] for k in true) > 290
        hitters = [(r.k, r.estimate) for r in cms.map_hitters(df, "k", agg, F.col("v"), 5, 900, 4).collect()]
        assert hitters == sorted(got.items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    assert cms.map_hitters(df.where("false"), "k", A.max_of("v"), F.col("v"), 5, 90, 4).collect() == []


# Closures ----------------------------------------------------------------------------


def test_closure_goes_on_from_what_changed(spark):
    from mergeloom.sources import tables

    edges = [(i, i + 1, 1.0) for i in range(30)] + [(0, 25, 26.5), (0, 20, 5.0), (3, 3, 0.0), (None, 4, 1.0), (4, None, 1.0), (90, 91, 1.0)]
    e = spark.createDataFrame(edges, "source long, target long, weight double").cache()
    start = spark.createDataFrame([(0, 0.0), (0, 2.0), (None, 1.0)], "node long, cost double")
    sizes = []

    def cut(df):
        out = tables.cut(df)
        sizes.append(out.count())
        return out

    got = dict(map(tuple, K.min_plus_closure(start, e, 40, cut).collect()))
    want = {i: float(i) for i in range(31)} | {20 + i: 5.0 + i for i in range(11)}
    assert got == want
    assert sum(sizes) < 3 * len(want) and max(sizes) <= 3  # never the whole table
    with pytest.raises(RuntimeError):
        K.min_plus_closure(start, spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "source long, target long, weight double"), 5)
