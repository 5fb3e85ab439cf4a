"""Buffers of a stream that flush by size and time, over several micro-batches
and a restart."""

from __future__ import annotations

import random
from collections import Counter

from mergeloom.streaming import timed


def batch(rng, n):
    """Half of the rows are of two keys."""
    return [(rng.choice([7, None]) if rng.random() < 0.5 else rng.randrange(100, 400), rng.choice([None, 1, 2**40])) for _ in range(n)]


def total(rows):
    out = Counter()
    for k, v in rows:
        out[k] += v or 0
    return dict(out)


def test_buffer_by_itself():
    rng, b, out, fed = random.Random(1), timed.Buffer(500, 50, 0.1, 800), [], []
    for _ in range(10):
        rows = [(str(k), hash((k, 1)), v or 0) for k, v in batch(rng, 100)]
        fed += [(k, v) for k, _, v in rows]
        out += b.take(rows)
        b = timed.Buffer(500, 50, 0.1, 800).restore(*b.state())
    assert {w for _, _, w in out} == {"cold", "size"}
    assert all(k in ("7", "None") for k, _, w in out if w == "size") and b.seen < 1000
    out += b.drained("time")
    assert total([(k, v) for k, v, _ in out]) == total(fed) and not b.sums
    small = timed.Buffer(10**6, 3, 0.0, 10**6)
    assert {w for _, _, w in small.take([(str(i), i, 1) for i in range(5)])} == {"size"}
    assert list(small.take([])) == []


def test_micro_batches_and_a_restart(spark, tmp_path):
    rng, fed, top = random.Random(2), [], f"file://{tmp_path}"
    schema = "k long, v long"

    def put(n):
        rows = batch(rng, n)
        fed.extend(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")

    def begun(after):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        return timed.start(timed.timed_sums(stream, "k", "v", 60, after, parts=3, share=0.1), f"{top}/out", f"{top}/progress", {"processingTime": "100 milliseconds"})

    for _ in range(3):
        put(120)
    q = begun(3_600_000)
    timed.read_all(q, 100)
    q.stop()  # sums still wait in the state
    done = [(r.k, r.v) for r in spark.read.parquet(f"{top}/out").collect()]
    assert sum(v for _, v in done) < sum(v or 0 for _, v in fed)
    put(120)
    put(90)
    q = begun(1500)  # goes on from the checkpoint
    timed.drain(q, 100)
    got = spark.read.parquet(f"{top}/out").collect()
    assert total([(r.k, r.v) for r in got]) == total(fed)
    assert {r.flushed for r in got} == {"cold", "size", "time"}
    assert {r.k for r in got if r.flushed != "cold"} <= {7, None}
