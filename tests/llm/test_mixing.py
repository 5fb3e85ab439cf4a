from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import rows_of
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergeloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    out = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert sum(out) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for s, t in zip(sizes, out, strict=True))
    free = [t / mixing.WEIGHTS[i % 3] for i, (s, t) in enumerate(zip(sizes, out, strict=True)) if t < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


@given(st.lists(st.integers(0, 500), min_size=1, max_size=9), st.integers(1, 40))
def test_draws_sum_to_what_is_wanted(wanted, shards):
    out = mixing.draws(np.array(wanted), shards, 1)
    assert out.sum(0).tolist() == wanted
    assert out.sum(1).max() - out.sum(1).min() <= 1


@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutations(n, key):
    out = mixing.permuted(np.arange(n), n, np.full(n, key, np.uint64))
    assert sorted(out.tolist()) == list(range(n))


def test_mixture(docs, odd, spark):
    plan = mixing.Mix(docs, block=16, shards=8)
    taken = plan.taken().select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(repr((r.doc_id, r["size"])) for r in taken) == sorted(repr((r.doc_id, len(WORD.findall(r.text or "")))) for r in docs.collect())
    assert all(r.taken <= 3 * r["size"] for r in taken)
    by = {}
    for r in taken:
        by.setdefault((r.source, r.source_size, r.target), [0, 0])
        by[r.source, r.source_size, r.target][0] += r["size"]
        by[r.source, r.source_size, r.target][1] += r.taken
    assert all(size == own for (_, size, _), (own, _) in by.items())
    assert all(abs(got - target) <= 64 for (_, _, target), (_, got) in by.items())
    mixture = plan.mixture()
    assert mixture.agg(F.sum("words")).first()[0] == sum(r.taken for r in taken)
    slots = plan.slots()
    assert slots.select("shard", "slot").distinct().count() == slots.count() == int(plan.drawn.sum())
    again = mixing.Mix(odd.repartition(3), block=16, shards=8).taken().select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, taken))


def test_mixed_documents_hold_the_words_taken(docs, odd):
    rows = mixing.mix_documents(docs, block=16, shards=8)
    assert rows.columns == docs.columns
    plan = mixing.Mix(docs, block=16, shards=8)
    total = plan.taken().agg(F.sum("taken")).first()[0]
    own = {r.text for r in docs.collect() if r.text}
    got = rows.collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == total
    assert all(r.n_chars == len(r.text) for r in got) and all(any(r.text in t for t in own) for r in got)
    assert mixing.mix_documents(odd, block=16, shards=8).columns == odd.columns


def test_edge_tables(spark, none):
    assert rows_of(mixing.Mix(none).taken()) == [] and rows_of(mixing.mix_documents(none)) == []
    blank = spark.createDataFrame([(1, None, "a", None, 0), (2, " ", "a", "x", 0)], none.schema)
    assert [r.taken for r in mixing.Mix(blank).taken().collect()] == [0, 0] and rows_of(mixing.mix_documents(blank)) == []


def test_more_sources_than_draws_take_fewer_shards(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DRAWS", 8)
    monkeypatch.setattr(mixing, "ROWS_A_CHUNK", 3)
    plan = mixing.Mix(docs, block=16, shards=64)
    assert plan.shards == 2 and plan.taken().count() == docs.count()


def test_taken_words_anew(docs):
    """Streams, blocks, permutations and slots followed document by document."""
    plan = mixing.Mix(docs, block=16, shards=8)
    placed = plan.placed.collect()
    sources = {r.sid: r for r in plan.sources.collect()}
    reads = Counter()
    for sid, own in enumerate(plan.drawn.sum(0).tolist()):
        n = sources[sid].n_blocks
        for d in range(own):
            key = mixing._mixed(np.array([d // n], np.uint64) + np.uint64(sid << 32) + np.uint64(plan.seed))
            reads[sid, int(mixing.permuted(np.array([d % n]), n, key)[0])] += 1
    assert max(reads.values()) <= 3
    for sid, source in sources.items():
        stream = sorted((r.start, r["size"]) for r in placed if r.sid == sid and r["size"])
        assert [x for x, _ in stream] == np.cumsum([0, *(n for _, n in stream[:-1])]).tolist() and sum(n for _, n in stream) == source.source_size
    want = sorted(repr((r.doc_id, r["size"], sum(reads[r.sid, w // 16] for w in range(r.start, r.start + r["size"])))) for r in placed)
    assert rows_of(plan.taken().select("doc_id", "size", "taken")) == want


def test_mixed_documents_come_in_slot_order(docs):
    plan = mixing.Mix(docs.coalesce(1), block=16, shards=4)
    first = {}
    for r in plan.mixture().collect():
        first[r.doc_id] = min((r.shard, r.slot), first.get(r.doc_id, (99, 0)))
    parts = mixing.mix_documents(docs.coalesce(1), block=16, shards=4).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    for p in {r.p for r in parts}:
        own = list(dict.fromkeys(r.doc_id for r in parts if r.p == p and r.doc_id not in (None, 5, rows_twice(docs))))
        assert [first[d] for d in own] == sorted(first[d] for d in own)


def rows_twice(docs):
    """A doc_id that comes several times."""
    return docs.groupBy("doc_id").count().where("count > 1 and doc_id != 5").first().doc_id


def test_plans_start_no_other_python_workers(spark, docs, monkeypatch):
    """Small tables of the driver's come as Arrow, not as rows of Python objects."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows of Python objects"))
    assert mixing.mix_documents(docs).count() > 0
