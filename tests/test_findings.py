"""Single queries against their SQL, on tables made for what they got wrong."""

from __future__ import annotations

import duckdb
import pytest
from test_queries import ORACLE, QUERIES, rows


@pytest.fixture
def agree(spark, tmp_path):
    """``agree(query, table, rows as SQL)``: DuckDB writes the table; both read it."""

    def check(name: str, table: str, sql: str) -> int:
        c = duckdb.connect()
        c.execute("set timezone = 'UTC'")
        c.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet'")
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        df, cursor = QUERIES[name](spark, str(tmp_path)), c.execute(ORACLE[name])
        columns = [d[0] for d in cursor.description]
        want = rows(columns, cursor.fetchall())
        assert rows(df.columns, df.collect()) == want
        return len(want)

    return check


def test_top_n_of_a_null_scope_where_no_user_stands_out(agree):
    """``error`` is made the null scope; each type has more users than the native sketch tracks."""
    events = "select i::bigint as event_id, timestamp '2024-01-01' as ts, (i % 5000)::bigint as user_id, ['error', 'view'][i % 2 + 1] as event_type, 1.0::double as value from range(20000) t(i)"
    assert agree("null_group_top_n_cms", "events", events) == 6


def test_wrapping_sum_of_products_beyond_64_bits(agree):
    keys = "(i * 1000003 % 9000000 + case when i % 7 = 0 then -12000000 else 0 end)::bigint"
    assert agree("wrapping_sum", "lineitem", f"select {keys} as l_orderkey, ['A', 'N', null][i % 3 + 1] as l_returnflag from range(3000) t(i)") == 3


def test_best_stretch_takes_ties_at_once(agree):
    # In the order of reading each pair of tied rows has a better stretch than it has as one.
    tied = "select ['A', 'R'][i % 2 + 1] as l_returnflag, (i // 4)::bigint as l_orderkey, 1 as l_linenumber, (case when i // 2 % 2 = 0 then 1 else 50 end)::double as l_quantity from range(400) t(i)"
    assert agree("ordered_best_stretch", "lineitem", tied) == 2


@pytest.mark.parametrize("low, n", [(1, 1), (1, 2), (1, 0)])
def test_best_stretch_of_losses(agree, low, n):
    """Where all sums are negative the best one is, but for ties of several rows."""
    ties = f"select 'A' as l_returnflag, i::bigint as l_orderkey, 1 as l_linenumber, {low}::double as l_quantity from range(5) t(i), range(case when i = 3 then {n} else 1 end)"
    assert agree("ordered_best_stretch", "lineitem", ties) == 1


def test_linear_sgd_in_stretches_equals_row_by_row(spark, monkeypatch):
    """Stretches of a few rows, in ranges over several tasks, a null group among them."""
    from pyspark.sql import functions as F

    from mergeloom.operators import ordered

    monkeypatch.setattr(ordered, "STRETCH", 37)
    g = F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), (F.col("id") % 3).cast("string")))
    df = spark.range(2000).select(g.alias("g"), (F.col("id") * 7919 % 2003).alias("o"), (F.col("id") % 11 / 11).alias("x"), (F.col("id") % 7 / 7).alias("y")).repartition(5)
    args = (df, ["g"], ["o"], ["x"], "y", [0.5, 0.0], ordered.count_adaptive_step(0.1, 0.5))
    want = {r.g: r for r in ordered.sgd(*args, key_schema="g string").collect()}
    got = {r.g: r for r in ordered.linear_sgd(*args, key_schema="g string").collect()}
    assert set(got) == set(want) == {None, "g1", "g2"}
    assert all(got[k].asDict()["count"] == want[k].asDict()["count"] and got[k].weights == pytest.approx(want[k].weights, abs=1e-12) for k in want)


def test_compared_maps_are_hashed_in_parts_that_do_not_grow(spark):
    """A null value is an entry, other than none; no rows are sorted to be grouped."""
    from mergeloom.operators import keyed

    left = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, 0), (4, "a", 5), (None, "a", 1)], "g int, k string, v long")
    right = spark.createDataFrame([(1, "a", None), (2, "b", 0), (3, None, 0), (4, "a", 6), (5, "a", 1), (None, "a", 1)], "g int, k string, v long")
    out = keyed.compared_maps(left, right, ["g"], ["k"], "v")
    assert {r.g: (r.contained, r.equal) for r in out.collect()} == {1: (True, True), 2: (False, True), 3: (True, True), 4: (False, False), 5: (True, False), None: (True, True)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_pairs_of_copies_are_written_by_many_tasks(spark, monkeypatch):
    """Few links between classes of many copies; classes larger than a part, too."""
    from pyspark.sql import functions as F

    from mergeloom.operators.sketches import minhash

    monkeypatch.setattr(minhash, "PART", 7, raising=False)
    # Class c lacks one of 200 elements; class 11 is of one set, classes 10 and 11 link with none.
    rows = [(f"{c:02}-{i:02}", x) for c in range(12) for i in range(1 if c == 11 else 30) for x in (range(1000 * c, 1000 * c + 5) if c > 9 else set(range(200)) - {c})]
    sketch = minhash.signatures(spark.createDataFrame(rows, "k string, x int"), "x", 64, ["k"]).cache()
    own = {}
    for s in sketch.collect():
        own.setdefault(s.k, [0] * 64)[s.i] = s.h
    equal = lambda a, b: sum(x == y for x, y in zip(own[a], own[b], strict=True)) / 64
    want = {(a, b): s for a in own for b in own if a < b and (s := equal(a, b)) >= 0.9}
    out = minhash.similar_pairs(sketch, 64, 16, "k", 0.9).select("a", "b", "similarity", F.spark_partition_id().alias("task")).collect()
    assert len(out) == len(want) > 30_000 and {(r.a, r.b): r.similarity for r in out} == want
    tasks = [r.task for r in out]
    assert max(tasks.count(t) for t in set(tasks)) < len(out) / 4
    sketch.unpersist()
