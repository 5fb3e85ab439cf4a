from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from conftest_llm import rows_of
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from mergeloom.llm import golay, simhash
from mergeloom.llm.components import components


def plain_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def grouped(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    prints = [plain_print(r[1]) for r in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 4]
    groups = grouped(len(rows), close)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return sorted(repr((r[0], p, least.get(g))) for r, p, g in zip(rows, prints, groups, strict=True))


def test_golay_code_is_perfect():
    table = golay.errors()
    assert sorted(set((table >= 0).sum(1).tolist())) == [1, 6]
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 300)
    for w, near in zip(words.tolist(), golay.near(words).tolist(), strict=True):
        for b1 in range(-1, 23, 3):
            for b2 in range(b1 + 1, 23, 5):
                other = w ^ (1 << b1 if b1 >= 0 else 0) ^ (1 << b2)
                assert {x for x in near if x >= 0} & {x for x in golay.near(np.array([other]))[0].tolist() if x >= 0}


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_prints_within_four_bits_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    rows, keys = simhash.keys(np.array([x, y], np.uint64).view(np.int64))
    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
    assert np.bincount(rows).max() <= 108


def test_same_as_brute_force(docs, odd):
    want = brute([tuple(r) for r in docs.collect()])
    assert rows_of(simhash.near_duplicates(docs)) == want
    assert rows_of(simhash.near_duplicates(odd)) == want


def test_chains_and_dense_groups(spark):
    rng = random.Random(2)
    prints, x = {0, -1}, rng.getrandbits(63)
    for _ in range(150):  # a long chain: each link 4 bits
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        prints.add(x if x < 2**63 else x - 2**64)
    centre = rng.getrandbits(62)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    prints |= {rng.getrandbits(63) for _ in range(300)}
    prints = sorted(prints)
    u = np.array(prints, np.int64).view(np.uint64)
    links = [(i, j) for i in range(len(u)) for j in np.nonzero(np.bitwise_count(u[:i] ^ u[i]) <= 4)[0].tolist()]
    want = {prints[i]: prints[g] for i, g in enumerate(grouped(len(prints), links))}
    got = simhash.link(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert {r.fp: r.component for r in got.collect()} == want


def test_large_buckets_in_blocks(spark, monkeypatch):
    """The same components however few members a block may hold."""
    rng = random.Random(12)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(63)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(63), rng.choice([3, 4, 5, 6]))) for _ in range(90)}
    prints = sorted(prints)
    u = np.array(prints, np.int64).view(np.uint64)
    links = [(i, j) for i in range(len(u)) for j in np.nonzero(np.bitwise_count(u[:i] ^ u[i]) <= 4)[0].tolist()]
    want = {prints[i]: prints[g] for i, g in enumerate(grouped(len(prints), links))}
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for most in (1, 5, 512):
        monkeypatch.setattr(simhash, "BLOCK_MEMBERS", most)
        assert {r.fp: r.component for r in simhash.link(table).collect()} == want
    found = simhash._close_in_blocks(spark.createDataFrame([(1, p, p, len(prints)) for p in prints], "key long, fp long, c long, n long"), 4)
    assert {tuple(sorted(r)) for r in found.collect()} == {tuple(sorted((prints[i], prints[j]))) for i, j in links}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((40, 30), (300, 280), (50, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2)]
        want = {i: g for i, g in enumerate(grouped(n, links)) if i != g}
        got = components(spark.createDataFrame(links, "a long, b long"), "a", "b")
        assert {r.id: r.component for r in got.collect()} == want


def test_empty_table(none):
    assert rows_of(simhash.near_duplicates(none)) == []
    assert rows_of(simhash.deduplicated(none)) == []


def test_one_document_of_each_group_stays(docs, odd):
    rows = [tuple(r) for r in docs.collect()]
    prints = [plain_print(r[1]) for r in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 4]
    groups = grouped(len(rows), close)
    best = {}
    for g, r in zip(groups, rows, strict=True):
        key = (r[0] is None, r[0] or 0)
        best[g] = min(key, best.get(g, key))
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(best.values())
    assert simhash.deduplicated(odd).columns == odd.columns


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_keeps_one_of_edited_copies(spark, docs, odd):
    """Copies with three of 127 words changed: far beyond four bits."""
    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(127)] for _ in range(40)]
    edited = [list(t) for t in texts for _ in range(2)]
    for t in edited:
        for i in rng.sample(range(127), rng.choice([1, 3, 9])):
            t[i] = "changed"
    rows = [tuple(r) for r in docs.collect()] + [(1000 + i, " ".join(t), "a", "s", 0) for i, t in enumerate(texts + edited)]
    rng.shuffle(rows)
    sets = [plain_set(r[1]) for r in rows]
    close = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    best = {}
    for g, r in zip(grouped(len(rows), close), rows, strict=True):
        key = (r[0] is None, r[0] or 0)
        best[g] = min(key, best.get(g, key))
    table = spark.createDataFrame(rows, docs.schema).repartition(4)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stage(spark, table, "").collect()) == sorted(best.values())
    assert stage(spark, odd, "").columns == odd.columns


def test_sets_compared_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 300)
    sets = [set(rng.choice(base, rng.integers(200, 300), replace=False).tolist()) for _ in range(40)] + [set(), {5}, {5}, {5, 6}]
    found = simhash.close_sets(pa.array([sorted(x) for x in sets], pa.list_(pa.int64())), 0.8, 64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert found[i, j] == (len(a & b) / max(len(a | b), 1) >= 0.8), (i, j)
    assert 40 < found[:40, :40].sum() < 1600


def test_a_bucket_of_many_slices(spark, monkeypatch):
    """Members of one bucket that only some pairs link, over many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 3)
    sets = {i: list(range(20 * i, 20 * i + 20)) for i in range(17)} | {100 + i: [*range(20 * i, 20 * i + 18), 9000, 9001] for i in range(5)}
    named = spark.createDataFrame([(7, v, v) for v in sets] + [(8, 1, 1), (8, 3, 3)], "key long, v long, c long")
    table = spark.createDataFrame(list(sets.items()), "v long, s array<long>")
    assert sorted(map(tuple, simhash._linked_in_blocks(named, table, 0.8).distinct().collect())) == [(i, 100 + i) for i in range(5)]


def test_a_component_of_many_buckets_is_compared_once(spark, monkeypatch):
    """A group that stands in very many buckets, with others that some of its
    members link, buckets of others alone, and a pair that shares one bucket."""
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 4)
    rng = random.Random(4)
    base = list(range(1000, 1020))
    sets = {v: base[:18] + [v] for v in range(30)}  # one component, 0, of near copies
    sets |= {100 + i: base[:18] + [5000 + i] for i in range(6)} | {200 + i: list(range(50 * i, 50 * i + 20)) for i in range(60)}
    sets |= {300 + i: [*sets[200 + i][:18], 9000 + i] for i in range(20)}
    named = [(k, v, 0) for k in range(50) for v in range(30) if rng.random() < 0.8]
    named += [(k, v, v) for k in range(50) for v in rng.sample([v for v in sets if v >= 100], 5)]
    named += [(60 + i, v, v) for i in range(20) for v in (200 + i, 300 + i)] + [(90, 0, 0), (90, 100, 100)]
    rows = spark.createDataFrame(named, "key long, v long, c long")
    table = spark.createDataFrame(list(sets.items()), "v long, s array<long>")
    members, rest = simhash._by_hub(rows)
    got = {tuple(r) for f in (simhash._linked_to_hubs(members, table, 0.8), simhash._linked_in_blocks(rest, table, 0.8)) for r in f.collect()}
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = {(min(c, d), max(c, d)) for k, v, c in named for j, w, d in named if k == j and c != d and alike(sets[v], sets[w])}
    assert want and want <= got
    own = {c: [sets[v] for _, v, o in named if o == c] for _, _, c in named}
    assert all(any(alike(x, y) for x in own[a] for y in own[b]) for a, b in got)
    assert members.where("c = 0").count() == 30 and rest.where("c = 0").count() == 0
    assert rows.where("c = 0").count() > 1000


def test_blocks_are_not_collected_in_the_heap(spark):
    """A block's sets come to Python as sorted rows, whole and in any batches."""
    sets = {i: list(range(20 * i, 20 * i + 20)) for i in range(17)} | {100 + i: [*range(20 * i, 20 * i + 18), 9000, 9001] for i in range(5)}
    named = spark.createDataFrame([(k, v, v) for k in range(30) for v in sets], "key long, v long, c long")
    found = simhash._linked_in_blocks(named, spark.createDataFrame(list(sets.items()), "v long, s array<long>"), 0.8)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert sorted(map(tuple, found.collect())) == sorted([(i, 100 + i) for i in range(5)] * 30)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_documents_without_copies(none):
    assert rows_of(simhash.without_copies(none)) == []
