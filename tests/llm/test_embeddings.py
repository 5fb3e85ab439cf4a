from __future__ import annotations

import numpy as np
import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F
from test_simhash import grouped

from mergeloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        rows.append((i, rng.normal(size=32).tolist(), int(i % 3)))
    for i in range(60):
        base = np.array(rows[i % 20][1])
        rows.append((1000 + i, (base + rng.normal(scale=0.12 * (i % 4) / 3, size=32)).tolist(), rows[i % 20][2] if i % 7 else 2))
    big = rng.normal(size=32)
    rows += [(2000 + i, (big + rng.normal(scale=0.1, size=32)).tolist(), 1) for i in range(80)]
    rows += [(3000 + i, big.tolist(), 1) for i in range(40)] + [(3100, (2 * big).tolist(), 1), (3101, big.tolist(), None)]
    rows += [(4000, None, 1), (4001, [0.0] * 32, 1), (4002, [], 1), (4003, [float("nan")] * 32, 1), (4004, [float("inf")] * 32, 1), (4005, [None, 1.0], 1), (4006, [1.0, 2.0], 1), (4007, [1.0, 2.0], 1), (4008, [2.0, 4.01, 0.0], 1), (4009, [1e38] * 32, 1), (4010, [1e-38] * 32, 1)]
    rows += [(None, rows[0][1], 0), (7, rows[8][1], rows[8][2])]
    return rows


def brute(rows):
    def usable(r):
        return r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    x = [np.array(r[1], np.float32).astype(float) if usable(r) else None for r in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links.append((i, j))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    groups = grouped(len(rows), links)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return [(r[0], int(k), least.get(g), r[0] is not None and r[0] == least.get(g)) for r, k, g in zip(rows, n, groups, strict=True)]


def test_same_as_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = embeddings.near_duplicates(df)
    assert rows_of(got) == sorted(map(repr, brute(rows)))
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("gid", "n", "code", "LABEL", "x", "key")])
    assert rows_of(embeddings.near_duplicates(odd)) == sorted(map(repr, brute(rows)))


def table(kind, n, d, rng):
    """Unit vectors of a kind and partners of theirs at cosines from 0.98 on."""
    if kind == "shifted":
        x = rng.normal(size=(n, d)) / np.sqrt(d) + 1.5 * np.ones(d) / np.sqrt(d)
    elif kind == "close to a mean":
        x = 0.35 * rng.normal(size=(n, d)) / np.sqrt(d) + np.ones(d) / np.sqrt(d)
    elif kind == "low rank":
        x = rng.normal(size=(n, 12)) @ rng.normal(size=(12, d)) + 0.01 * rng.normal(size=(n, d))
    elif kind == "clustered":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, d))
    else:
        x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "low rank":
        step = rng.normal(size=(n, 12)) @ np.linalg.svd(x, full_matrices=False)[2][:12]
    else:
        step = rng.normal(size=(n, d))
    step -= (step * x).sum(1)[:, None] * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.985, n)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * step


KINDS = ["isotropic", "shifted", "close to a mean", "low rank", "clustered"]


@pytest.mark.parametrize("kind", KINDS)
def test_recall_of_the_tables(kind):
    """Pairs that are barely similar enough meet, whatever the data look like."""
    x, y = table(kind, 4000, 48, np.random.default_rng(5))
    model = embeddings.modelled(x[:3000], 4000)
    met = (model.keys(x) == model.keys(y)).any(1)
    assert met.mean() >= 0.99


def test_recall_of_lengths_without_a_model():
    for kind in KINDS:
        x, y = table(kind, 3000, 24, np.random.default_rng(6))
        model = embeddings.about_origin(24, 3000)
        assert (model.keys(x) == model.keys(y)).any(1).mean() >= 0.99


@pytest.mark.parametrize("kind", ["shifted", "close to a mean", "low rank"])
def test_links_of_whole_tables(spark, kind):
    """The operator against brute force: at least 99 of 100 links, none false."""
    x, y = table(kind, 700, 32, np.random.default_rng(7))
    both = np.vstack([x, y]).astype(np.float32)
    own = both.astype(float)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    want = (own @ own.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], SCHEMA).repartition(4)
    got = np.array([r.n_links for r in sorted(embeddings.near_duplicates(df).collect())])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() >= 1300


def test_codes_are_balanced():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64)) * np.linspace(0.2, 2, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, turned = embeddings.itq(x)
    assert np.abs(((x - mean) @ turned >= 0).mean(0) - 0.5).max() < 0.1


def test_keys_spell_signs():
    signs = np.array([[1, 0, 1, 1, 0, 0, 1], [0, 1, 1, 0, 1, 1, 0]], bool)
    assert embeddings.sliced(signs, 3).tolist() == [[5, 1], [6, 6]]


def test_empty_table(spark):
    assert rows_of(embeddings.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    only = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA)
    assert rows_of(embeddings.near_duplicates(only)) == ["(1, 0, 1, True)", "(2, 0, 2, True)"]


def test_units():
    import pyarrow as pa

    rows = [[3.0, 4.0], None, [], [1e308, 0.0], [None, 1.0], [float("inf"), 1.0], [0.0, -0.0], [5e-324], [1.0, 2.0, 2.0]]
    found = {int(i): x for at, _, xs in embeddings.units(pa.array(rows, pa.list_(pa.float64())).slice(0)) for i, x in zip(at, xs, strict=True)}
    assert sorted(found) == [0, 3, 7, 8] and np.allclose(found[0], [0.6, 0.8]) and np.allclose(found[8], [1 / 3, 2 / 3, 2 / 3])
    later = {int(i) for at, _, _ in embeddings.units(pa.array(rows, pa.list_(pa.float64())).slice(3)) for i in at}
    assert later == {0, 4, 5}


def test_groups_of_near_copies(spark):
    """A large group of near copies, one of copies, and loose vectors."""
    rng = np.random.default_rng(12)
    middle = rng.normal(size=48)
    rows = [(i, (middle + 0.08 * rng.normal(size=48)).tolist(), i % 2) for i in range(700)]
    rows += [(1000 + i, (-middle).tolist(), 1) for i in range(600)] + [(2000 + i, rng.normal(size=48).tolist(), i % 2) for i in range(900)]
    want = {}
    for label in (0, 1):
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= {r[0]: int(n) - 1 for r, n in zip(own, (x @ x.T >= 0.98).sum(1), strict=True)}
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert set(got) == set(want) and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 400_000


def test_one_very_long_vector_does_not_spoil_the_sample(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=8).tolist(),) for _ in range(400)] + [(rng.normal(size=5000).tolist(),)]
    models = embeddings.fit(spark.createDataFrame(rows, "embedding array<double>"), 400, 300)
    assert 8 in models and models[8].projections[0].shape == (8, 64)
