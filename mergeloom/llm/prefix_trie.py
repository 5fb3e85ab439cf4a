"""Conversation prefix trie: what shared beginnings of conversations save.

A node is a distinct sequence of first turns (role and text), the root the empty
one; conversations that begin with it are its members. A node's saving is its
members but one times the bytes of its last text: what a cache of prefixes need
not process again.

**Places.** Turns are ordered over the whole table by ranges, so that one
conversation may hold a third of all rows: a task numbers the turns of its range,
and what lies before, at most one conversation's head a range, is added from
counts. From there on a turn is a digest and a number of bytes.

**Nodes.** A node's key is a digest of its turns: the digest of its parent's key
and its last turn, along a conversation. Conversations are cut into blocks of
``BLOCK`` turns: each block's digest comes first, the prefixes of these digests are
nodes of the same kind (so a level up, and again, until blocks are few), and at a
block's end the key is that prefix. Keys depend on the turns alone, and no task
follows more than a block.

**Rollup** by pointer jumping. Every node knows its parent by key. In round k a
node adds what it has, which covers its descendants less than 2^k below it, to its
ancestor 2^k above, and takes that one's ancestor for the next round: leaves and
savings reach all ancestors after logarithmically many rounds in the depth. Sums
are grouped before they meet; a pointer to the root needs no join, as depths say
who has one; each round is written, so a lost executor costs the round at hand.

**Ends** are sorted by ranges of (node, conv_id), written as runs of ``RUN_IDS``
ids, and hashed run by run, so a node where all conversations end streams through
its task.

Rows of a null conv_id belong to no conversation. Turns come by number, null
first, ties by role and text in UTF-8 order; null role or text is ''. Repeated
rows are turns of their own. Turns without text and very long ones are turns like
any other; only digests are kept. Other columns, whatever their names, are not
read. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, keyed_stream, materialize, pick

#: Turns that one task follows at a stretch.
BLOCK = 256
#: Rows of a range when turns are ordered, ids of a run when ends are hashed.
RANGE_ROWS, RUN_IDS = 200_000, 4096
ROOT = b""
KEY_BYTES = 16


def _key(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=KEY_BYTES).digest()


def ordered_turns(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv_id, pos, digest, bytes): each turn's place from 1, a digest of role
    and text, and the bytes of its text."""
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows may lie in two ranges
    order = ["conv_id", "turn", "role", "text", "_row"]
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // range_rows))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for b in batches(found):
            ids, places = b.column(1).to_pylist(), []
            for i in ids:
                k, last = (k + 1 if i == last else 1), i
                places.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.int64()), b.column(2), b.column(3)], ["part", "conv_id", "k", "digest", "bytes"])

    size = F.octet_length("text").cast("long")
    # The role's length first, so that no other pair of strings reads the same.
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 2 * KEY_BYTES))
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "conv_id", digest.alias("digest"), size.alias("bytes"))
    turns = materialize(rows.mapInArrow(run, "part int, conv_id long, k long, digest binary, bytes long"), "turns")
    # Only a range's first conversation can have begun before it: two rows a range at most.
    counts = turns.groupBy("part", "conv_id").agg(F.max("k").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("conv_id", "n")).alias("lo"), F.max(F.struct("conv_id", "n")).alias("hi"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("part", "e.conv_id", "e.n")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.withColumn("before", F.sum("n").over(before)).where("before is not null").select("part", "conv_id", "before")
    return turns.join(F.broadcast(heads), ["part", "conv_id"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with ``last``, conversations): each conversation as it is."""
    convs = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("length")), "convs")
    return materialize(turns.join(convs, "conv_id").select("conv_id", "pos", "digest", "bytes", (F.col("pos") == F.col("length")).alias("last")), "whole"), convs


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The same after each conversation's first turns have given way to those of
    the first of its family: conversations c - c % ``family`` share beginnings of
    crc32(c) % ``most`` turns. At most 2 * ``family`` conversations read one
    beginning, of less than ``most`` turns."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = materialize(convs, "families")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    taken = F.least("h", F.coalesce("_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    convs = materialize(convs, "convs")
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "taken", "length"), "base").where("pos <= taken").select("conv_id", "pos", "digest", "bytes", "length")
    own = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes", "length")
    rows = heads.unionByName(own).select("conv_id", "pos", "digest", "bytes", (F.col("pos") == F.col("length")).alias("last"))
    return materialize(rows, "rebuilt"), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, node, parent, bytes, last) of (conv_id, pos, digest, bytes,
    last): each turn with the key of the sequence that it ends."""
    at = F.floor((F.col("pos") - 1) / block).alias("block")
    rows = turns.select("conv_id", at, "pos", "digest", "bytes", "last")
    if longest >= block:  # blocks that are full have a digest each, whose prefixes come first
        long = turns.groupBy("conv_id").agg(F.max("pos").alias("_n")).where(F.col("_n") >= block).select("conv_id")
        ends = _block_digests(rows.join(long, "conv_id", "left_semi"), block)
        ends = ends.select("conv_id", (F.col("block") + 1).alias("pos"), "digest", F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("last"))
        seeds = materialize(prefixes(materialize(ends, "blocks"), longest // block, block).select("conv_id", "pos", "node"), "seeds")
        seed = lambda shift, pos: seeds.select("conv_id", (F.col("pos") - shift).alias("block"), pos, F.col("node").alias("digest"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("boolean").alias("last"))
        # A block's own first: the key to start from, and the key at its end.
        rows = rows.unionByName(seed(0, F.lit(-1).cast("long").alias("pos"))).unionByName(seed(1, F.lit(0).cast("long").alias("pos")))
    return _chained(rows, block)


def _block_digests(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, digest) of each full block."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, ROOT
        for b in batches(found):
            out = []
            for conv, at, pos, digest in zip(*[c.to_pylist() for c in b.columns[:4]], strict=True):
                if (conv, at) != now:
                    now, key = (conv, at), ROOT
                key = _key(key, digest)
                if pos % block == 0:
                    out.append((conv, at, key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["conv_id", "block", "digest"])

    return keyed_stream(rows, ["conv_id", "block"], ["pos"], run, "conv_id long, block long, digest binary")


def _chained(rows: DataFrame, block: int) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, end = None, ROOT, None
        for b in batches(found):
            kept, nodes, parents = [], [], []
            for r, (conv, at, pos, digest) in enumerate(zip(*[c.to_pylist() for c in b.columns[:4]], strict=True)):
                if (conv, at) != now:
                    now, key, end = (conv, at), ROOT, None
                if pos == -1:
                    key = digest
                elif pos == 0:
                    end = digest
                else:
                    parents.append(key)
                    key = end if pos % block == 0 else _key(key, digest)
                    kept.append(r)
                    nodes.append(key)
            if kept:
                own = pa.array(kept)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column(4).take(own), b.column(5).take(own)], ["conv_id", "pos", "node", "parent", "bytes", "last"])

    return keyed_stream(rows, ["conv_id", "block"], ["pos"], run, "conv_id long, pos long, node binary, parent binary, bytes long, last boolean")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over the subtree of each of (node,
    parent, depth, leaf, saved). A round goes through the nodes that have an
    ancestor that far above, as none of the others adds to one any more."""
    sums = ("n_leaves", "saved_tokens")
    own = nodes.select("node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    state = nodes.select("node", "depth", F.col("parent").alias("above"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")).where("depth >= 1")
    jump = 1
    while jump <= deepest:
        adds = materialize(state.groupBy(F.col("above").alias("node")).agg(*[F.sum(c).alias(c) for c in sums]), "adds")
        own = own.unionByName(adds)
        if 2 * jump <= deepest:
            further = state.select(F.col("node").alias("above"), F.col("above").alias("_next"))
            more = adds.select("node", *[F.col(c).alias(f"_{c}") for c in sums])
            moved = state.where(F.col("depth") >= 2 * jump).join(more, "node", "left")
            # The root needs no join: those twice as deep as the jump point to it.
            far, near = moved.where(F.col("depth") > 2 * jump).join(further, "above"), moved.where(F.col("depth") == 2 * jump).withColumn("_next", F.lit(ROOT))
            both = far.select("node", "depth", "_next", *sums, *[f"_{c}" for c in sums]).unionByName(near.drop("above"))
            state = materialize(both.select("node", "depth", F.col("_next").alias("above"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]), "rollup")
        jump *= 2
    return own.groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])


def ends_of(members: DataFrame, run_ids: int = RUN_IDS) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id), the conversations that end there:
    the SHA-256 of their ids in order, comma-joined."""

    def joined(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "ids"])

        for b in batches(found):
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (key != node or len(ids) == run_ids):
                    yield piece()
                    ids = []
                node = key
                ids.append(conv)
        if ids:
            yield piece()

    def hashed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches(found):
            for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != node or state is None:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 1000:
                yield _two(out)
                out = []
        if state is not None:
            yield _two([*out, (node, state.hexdigest())])

    runs = members.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first long, ids string")
    return keyed_stream(runs, ["node"], ["first"], hashed, "node binary, ends_sha256 string")


def _two(rows: list[tuple]) -> pa.RecordBatch:
    keys, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], ["node", "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) of written turns (conv_id, pos, digest, bytes,
    last) and written conversations (conv_id, length), turnless ones included."""
    every = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")).first()
    steps = materialize(prefixes(turns, every.longest, block), "prefixes")
    # The parent and the depth follow from the key: grouping by them keeps the sums in plain hash tables.
    nodes = steps.groupBy("node", "parent", F.col("pos").alias("depth")).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"))
    top = convs.agg(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("bytes"))
    nodes = materialize(nodes.unionByName(top.where("n_convs > 0")), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    mothers = nodes.where("depth > 1").select("node", "parent").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("_mother")), "parent").select("node", "_mother")
    parent = F.when(F.col("depth") == 1, F.lit(every.least)).otherwise(F.col("_mother")).cast("long")
    full = nodes.join(children, "node", "left").join(mothers, "node", "left")
    full = materialize(full.select("node", "parent", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes"), "nodes")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    sums = rolled_up(full.select("node", "parent", "depth", leaf.alias("leaf"), saved.alias("saved")), every.longest)
    ends = steps.where("last").select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    nobody = F.lit(hashlib.sha256().hexdigest())
    out = full.join(sums, "node").join(ends_of(ends), "node", "left")
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    return trie(*whole(ordered_turns(conversations)), block)


def oracle_sql() -> str:
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))"
    return f"""
        with turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k,
                coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
            convs as (select c, max(k) as n, any_value(xor({crc}, 4294967295)) % 9 as h from turns group by c),
            heads as (select a.c, least(a.h, coalesce(b.n, 0)) as taken, a.h from convs a left join convs b on b.c = a.c - a.c % 5),
            rebuilt as (select h.c, t.k as pos, role, text from heads h join turns t on t.c = h.c - h.c % 5 and t.k <= h.taken
                union all select h.c, t.k - h.h + h.taken, role, text from heads h join turns t on t.c = h.c and t.k > h.h),
            steps as (select c, pos as d, octet_length(encode(text)) as bytes, string_agg(sha256(length(role) || ':' || role || text), ' ') over (partition by c order by pos) as key from rebuilt
                union all select c, 0, 0, '' from convs),
            lengths as (select c, max(d) as n from steps group by c),
            nodes as (select key, d, min(c) as rep, count(*) as n, any_value(bytes) as bytes from steps group by key, d),
            above as (select n.key, s.key as up, n.d - s.d as far from nodes n join steps s on s.c = n.rep and s.d <= n.d),
            kids as (select up as key, count(*) as n_children from above where far = 1 group by up),
            sums as (select up as key, sum((coalesce(n_children, 0) = 0)::int)::bigint as n_leaves, sum((n - 1) * bytes)::bigint as saved_tokens
                from above join nodes using (key) left join kids using (key) group by up),
            ends as (select key, string_agg(s.c::varchar, ',' order by s.c) as ids from steps s join lengths l on l.c = s.c and l.n = s.d group by key)
        select nodes.rep as conv_id, nodes.d::bigint as depth, p.rep as parent_conv_id, nodes.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
        from nodes join sums using (key) left join kids using (key) left join ends using (key)
            left join above on above.key = nodes.key and above.far = 1 left join nodes p on p.key = above.up
    """
