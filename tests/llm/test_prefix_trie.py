from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from conftest_llm import rows_of
from pyspark.sql import functions as F

from mergeloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}


def families(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    if not convs:
        return []
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(-12, 90), 500, 503, 504, 1001]:  # bases of 501 and of 1001 are missing
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(3)} é"))
    rows += [(96, t, "user", "same") for t in range(70)] + [(97, t, "user", "same") for t in range(75)] + [(95, 5, "user", "only")]
    rows += [(200, None, None, None), (200, None, "user", ""), (200, 1, "", None), (200, 1, "", "é"), (200, 1, "us", "er"), (200, 1, "user", ""), (None, 1, "user", "lost"), (201, None, None, None)]
    rows += [(200, 2, "user", "twice")] * 3 + [(202, 2**62, "user", "x" * 100_000)] + [(-(2**62), 0, "user", "far")]
    rng.shuffle(rows)
    return rows


def test_same_as_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns = prefix_trie.ordered_turns(df, 50)
    want = brute(families(turns_of(rows)))
    assert rows_of(prefix_trie.trie(*prefix_trie.rebuilt(turns)).select(*OUT)) == want
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("TURN", "pos", "part", "node", "k", "digest", "block", "last")])
    assert rows_of(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(odd)), block=4).select(*OUT)) == want
    assert rows_of(prefix_trie.conversation_trie(df).select(*OUT)) == brute(turns_of(rows))


def test_one_deep_conversation_in_many_ranges(spark):
    """Six hundred turns, nearly half of the rows, with blocks of four: four
    levels of block digests and ten rounds."""
    rows = [(7, t, "user", f"step {t % 9}") for t in range(600)] + [(8, t, "user", f"step {t % 9}") for t in range(300)]
    rows += [(9, t, "user", f"step {t % 9}" if t != 200 else "else") for t in range(250)] + [(100 + i, 0, "user", "step 0") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(prefix_trie.conversation_trie(df, block=4).select(*OUT)) == brute(turns_of(rows))


def test_repeated_rows_lie_in_many_ranges(spark):
    df = spark.createDataFrame([(1, 1, "user", "again")] * 900 + [(2, 1, "user", "again")] * 5, SCHEMA).repartition(6)
    turns = prefix_trie.ordered_turns(df, 40).cache()
    assert sorted(r.pos for r in turns.where("conv_id = 1").collect()) == list(range(1, 901))
    assert sorted(r.pos for r in turns.where("conv_id = 2").collect()) == list(range(1, 6))
    turns.unpersist()


def test_empty_tables(spark):
    for rows in ([], [(None, 1, "user", "text")]):
        turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
        assert rows_of(prefix_trie.trie(*prefix_trie.rebuilt(turns))) == []


def test_ends_in_runs(spark):
    rows = [(bytes([i % 3]), i * 7) for i in range(1000)]
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.ends_of(spark.createDataFrame(rows, "node binary, conv_id long").repartition(5), 10).collect()}
    assert got == {bytes([k]): hashlib.sha256(",".join(str(i * 7) for i in range(1000) if i % 3 == k).encode()).hexdigest() for k in range(3)}
