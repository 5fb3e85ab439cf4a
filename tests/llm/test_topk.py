from __future__ import annotations

import math

import numpy as np
import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from mergeloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def numbers_of(x):
    if x is None or any(v is None or not math.isfinite(v) or not math.isfinite(v * 256) for v in x):
        return None
    return [math.floor(v * 256) for v in x]


def brute(rows, k=5):
    own = [(i, r[0], numbers_of(r[1])) for i, r in enumerate(rows)]
    own = [r for r in own if r[2] is not None]
    out = []
    for i, vec, q in own:
        if vec is None or vec % 50:
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), v is None, v or 0, j) for j, v, x in own if j != i and len(x) == len(q)]
        out += [(vec, n + 1, None if none else v, -s) for n, (s, none, v, _) in enumerate(sorted(scores)[:k])]
    return sorted(map(repr, out))


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):  # clusters far apart
        middle = rng.normal(size=16) * 20
        rows += [(100 * c + i, (middle + rng.normal(size=16)).tolist(), 1) for i in range(60)]
    rows += [(5000 + i, rng.normal(size=16).tolist(), 1) for i in range(200)]
    same = rng.normal(size=16).tolist()
    rows += [(6000 + i, same, 1) for i in range(150)] + [(6000, same, 2), (6050, same, None), (None, same, 1), (None, same, 1)]
    rows += [(7000, None, 1), (7050, [], 1), (7051, [], 1), (7100, [float("nan")] * 16, 1), (7150, [None] + [1.0] * 15, 1), (7200, [float("inf")] * 16, 1), (7250, [1e307] + [0.0] * 15, 1), (7300, [0.0] * 16, 1), (7301, [-0.0] * 16, 1)]
    rows += [(8000, [1e9, -3.0], 1), (8050, [1e9, 2.0], 1), (8051, [0.004, -0.004], 1), (8052, [1e300, 1.0], 1), (8100, [-1e300, 1.0], 1), (8101, [123456789.123, 7.0], 1)]
    rows += [(8150, [3e5] * 16, 1), (8151, [1e16] * 16, 1), (-50, [2.0, 5.0, 1.0], 1)]
    return rows


@pytest.mark.parametrize("shard", [64, 512])
def test_same_as_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_VALUES", shard)
    if shard == 64:  # four vectors a shard, several blocks of balls, several tasks a shard
        monkeypatch.setattr(topk, "BALLS_A_BLOCK", 30)
        monkeypatch.setattr(topk, "QUERIES_A_TASK", 7)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if shard == 512:
        df = df.select("*", *[F.lit(1).alias(c) for c in ("row", "VEC_ID", "d", "shard", "q", "asks", "leaf")])
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_floats_and_other_k(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA.replace("double", "float"))
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0, 11)) == brute(rows, 11)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0)) == []
    assert rows_of(topk.top_k(spark.createDataFrame([(50, None, 1), (100, [1.0], 1)], SCHEMA), F.col("vec_id") % 50 == 0)) == []


def tree_of(x, rows):
    order, middles, radii = topk.grown(x)
    n = len(x)
    parts = [rows[order], rows[order], np.zeros(n, bool), np.zeros(n, bool), x[order].astype(np.int32), middles, radii]
    return topk.Tree("s", x.shape[1], False, n, *[np.ascontiguousarray(p).tobytes() for p in parts])


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.floor(np.repeat(rng.normal(size=(40, 24)) * 2000, 100, axis=0) + rng.normal(size=(4000, 24)) * 50)
    tree = tree_of(x, np.arange(4000))
    for (lo, hi), c, r in zip(tree.spans, tree.middles, tree.radii, strict=True):
        assert (np.linalg.norm(tree.x[lo:hi] - c, axis=1) <= r + 1e-6).all()
    looked = []
    plain = topk.products
    monkeypatch.setattr(topk, "products", lambda q, v, wild: looked.append(len(q) * len(v)) or plain(q, v, wild))
    q = x[::40]
    found = tree.search(q, np.arange(0, 4000, 40), False, np.full(100, -np.inf), 5)
    for i, best in enumerate(found):
        s = x @ q[i]
        s[40 * i] = -np.inf
        assert [-b[0] for b in best] == sorted(s.tolist())[:-6:-1]
    first = sum(looked)
    assert first < 0.35 * len(q) * len(x)
    # With the scores shared from elsewhere hardly anything is left to look at.
    looked.clear()
    least = np.array([-b[-1][0] for b in found], float) + 1e7
    assert not any(len(b) == 5 for b in tree.search(q, np.arange(0, 4000, 40), False, least, 5))
    assert sum(looked) < 0.5 * first
