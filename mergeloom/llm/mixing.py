"""Mixing sources to target weights.

The words of a source's documents, one after another, form the source's
stream, cut into blocks of ``BLOCK`` words (the last one may be shorter). The
output is a row of shards with equally many slots, a block a slot. For each
shard a multinomial draw over what the sources still have to give says how
many slots each source fills; a draw beyond a source's rest is drawn again
among the others, so the totals come out as apportioned and no block is taken
more often than ``MOST_TIMES``. A source's slots are numbered through all
shards. Number d reads block p(d mod n) of the n blocks, p being a
pseudorandom permutation of the source's indices, another one each round
through the source. Slots and blocks are then joined by block index.

Stream positions come from a two-level prefix sum: documents are hashed into
chunks of about ``ROWS_A_CHUNK`` documents by id, size and text, chunk totals
are summed up, and a window runs within each chunk only. No task sees a whole
source, nor one id's rows if their texts differ. Slots are made by as many
tasks as ``SLOTS_A_TASK`` asks for. The driver holds a row a source and the
draws, sources times shards; with more than ``MOST_DRAWS`` of them there are
fewer shards, one at least. Text never shuffles for the counts.

As documents (``mix_documents``) the output keeps its order: each run of words
bears the shard and slot where its source's turn first comes to it, and every
output partition, a random part of all rows, is sorted by them, so sources
alternate in each file as the shards say.

Null texts count as empty. Null is a source of its own, last in order. Empty
documents get no words. Very long texts are counted whole and span blocks.
Repeated rows are documents of their own; rows equal in id, size and text tie,
and which of them comes first changes nothing in the result. Null doc_ids are
carried. Other columns, whatever their names, are not read, and stay where rows
are kept. An empty table gives no rows. Seeds fix all draws: reruns agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, byte_texts, flattened, materialize, numbered, pick, sized_join, table_of

BLOCK = 128
SHARDS = 256
ROWS_A_CHUNK = 2_000
MOST_TIMES = 3
MOST_DRAWS = 4_000_000
SLOTS_A_ROW, SLOTS_A_TASK = 1 << 14, 1 << 18
WEIGHTS = (1, 2, 3)
GOLDEN = 0x9E3779B97F4A7C15  # 2^64 over the golden ratio, odd


def targets(sizes: list[int], weights: list[int], most_times: int = MOST_TIMES) -> list[float]:
    """Each source's share of all words by weight; what exceeds ``most_times``
    a source's size goes to the others by weight, until none is above."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    while True:
        rest = total - sum(most_times * s for s, c in zip(sizes, capped, strict=True) if c)
        by = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [float(most_times * s) if c else rest * w / by for s, w, c in zip(sizes, weights, capped, strict=True)]
        above = [not c and t > most_times * s for s, t, c in zip(sizes, out, capped, strict=True)]
        if not any(above):
            return out
        capped = [c or a for c, a in zip(capped, above, strict=True)]


def apportion(shares: list[float]) -> np.ndarray:
    """Whole numbers near the shares, with their rounded sum: by largest rest."""
    shares = np.array(shares, float).reshape(-1)
    out = np.floor(shares + 1e-9).astype(np.int64)
    more = int(round(shares.sum())) - int(out.sum())
    for i in np.argsort(-(shares - out), kind="stable")[: max(0, more)]:
        out[i] += shares[i] > out[i]
    return out


def draws(wanted: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial slot counts that sum to ``wanted``."""
    rng, left = np.random.default_rng(seed), wanted.astype(np.int64).copy()
    n = int(left.sum())
    out = np.zeros((shards, len(left)), np.int64)
    for k in range(shards):
        need = n // shards + (k < n % shards)
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each index's key, by a Feistel network
    over the next even power of two, walked until it is back in range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, keys = index.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        key = keys[todo]
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right + key + np.uint64((r + 1) * GOLDEN % 2**64)) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def measured(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, mark); one Arrow pass. ``row`` names a column
    of longs that tells rows apart, else null; ``mark`` is a hash of the text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            found = byte_texts(b.column(3))
            sizes = pa.array([len(t.split()) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sizes, pa.array([zlib.crc32(t) for t in found], pa.int64())], ["row", "doc_id", "source", "size", "mark"])

    ready = pick(docs, **({row: "long"} if row else {}), doc_id="long", source="string", text="string")
    ready = ready.withColumnRenamed(row, "row") if row else ready.withColumn("row", F.lit(None).cast("long"))
    return ready.select("row", "doc_id", "source", "text").mapInArrow(run, "row long, doc_id long, source string, size long, mark long")


class Mix:
    """A plan over documents: ``sources``, ``placed``, ``slots``, ``blocks``."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 20240607, row: str | None = None) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.block, self.seed = block, seed
        sized = materialize(measured(docs, row), "sized")
        rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
        self.shards = max(1, min(shards, MOST_DRAWS // max(1, len(rows))))
        rows.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.size for r in rows]
        goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]) if rows else []
        counts = [-(-s // block) for s in sizes]
        wanted = apportion([t * n / s if s else 0.0 for t, n, s in zip(goals, counts, sizes, strict=True)])
        self.drawn = draws(wanted, self.shards, seed)
        table = [(r.source, i, s, t, n, -(-r.docs // ROWS_A_CHUNK)) for i, (r, s, t, n) in enumerate(zip(rows, sizes, goals, counts, strict=True))]
        self.sources = materialize(table_of(self.spark, table, "source string, sid int, source_size long, target double, n_blocks long, n_chunks long").coalesce(1), "sources")
        self.placed = self._placed(sized)

    def _placed(self, sized: DataFrame) -> DataFrame:
        """(row, doc_id, source, size, sid, source_size, target, start)."""
        named = sized_join(sized, self.sources, ["source"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "mark"), F.col("n_chunks")))
        own = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "mark", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inner = named.withColumn("_to", F.sum("size").over(own))
        totals = named.groupBy("sid", "chunk").agg(F.sum("size").alias("_all"))
        before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("sid", "chunk", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_from"))
        return materialize(inner.join(offsets, ["sid", "chunk"]).withColumn("start", F.expr("_from + _to - size")).drop("_from", "_to", "chunk", "n_chunks", "mark"), "placed")

    def slots(self) -> DataFrame:
        """(shard, slot, sid, block): which block each slot reads."""
        first = np.cumsum(self.drawn, axis=0) - self.drawn
        at = np.cumsum(self.drawn, axis=1) - self.drawn
        k, s = np.nonzero(self.drawn)
        table = list(zip(k.tolist(), s.tolist(), self.drawn[k, s].tolist(), first[k, s].tolist(), at[k, s].tolist(), strict=True))
        plan = table_of(self.spark, table, "shard int, sid int, n long, first long, at long")
        plan = plan.join(self.sources.select("sid", "n_blocks"), "sid")
        pieces = plan.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS_A_ROW).cast("long"))))
        pieces = pieces.repartition(-(-int(self.drawn.sum()) // SLOTS_A_TASK) or 1, "shard", "sid", "skip")
        seed = self.seed

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for shard, sid, n, first, at, n_blocks, skip in zip(*(b.column(c).to_pylist() for c in ("shard", "sid", "n", "first", "at", "n_blocks", "skip")), strict=True):
                    i = np.arange(skip, min(n, skip + SLOTS_A_ROW))
                    d = first + i
                    key = _mixed((d // n_blocks).astype(np.uint64) + np.uint64(sid << 32) + np.uint64(seed))
                    block = permuted(d % n_blocks, n_blocks, key)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shard, np.int32)), pa.array(at + i), pa.array(np.full(len(i), sid, np.int32)), pa.array(block)], ["shard", "slot", "sid", "block"])

        return pieces.mapInArrow(run, "shard int, slot long, sid int, block long")

    def blocks(self) -> DataFrame:
        """(sid, block, doc_id, row, start, from_word, words): each block's
        documents, with the words of the document that lie in the block."""
        b = self.block
        spread = self.placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        low, high = f"greatest(start, block * {b})", f"least(start + size, (block + 1) * {b})"
        return spread.select("sid", "block", "doc_id", "row", "start", F.expr(f"{low} - start").alias("from_word"), F.expr(f"{high} - {low}").alias("words"))

    def mixture(self) -> DataFrame:
        """(shard, slot, sid, block, doc_id, row, start, from_word, words): the
        output, slot by slot. ``start`` and ``sid`` name the document."""
        return self.slots().join(self.blocks(), ["sid", "block"])

    def block_times(self) -> DataFrame:
        """``blocks`` with ``times``, how many slots read the block, and the
        ``first`` of them by shard and slot."""
        order = F.struct("shard", "slot")
        return self.blocks().join(self.slots().groupBy("sid", "block").agg(F.count("*").alias("times"), F.min(order).alias("first")), ["sid", "block"])

    def taken(self) -> DataFrame:
        """``placed`` with ``taken``: a document's words in the output, repeats
        counted."""
        sums = self.block_times().groupBy("sid", "start").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
        full = self.placed.where("size > 0").join(sums, ["sid", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        return full.unionByName(self.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: for each time round, a row for each run of
    neighbouring words that a document gives; whole documents come whole. Rows
    of a partition come in the order of shards and slots. Returns the columns of
    ``docs``; ``n_chars``, if there, is counted anew."""
    flat, names, at = flattened(docs)
    rows = numbered(flat, "rows")
    plan = Mix(rows.select("_row", *[F.col(at[n]).alias(n) for n in ("doc_id", "text", "source")]), row="_row", **options)
    given = plan.block_times().select(F.col("row").alias("_row"), F.struct("from_word", "words", "times", "first.shard", "first.slot").alias("g"))
    given = given.groupBy("_row").agg(F.sort_array(F.collect_list("g")).alias("_given"))
    sizes = plan.placed.select(F.col("row").alias("_row"), F.col("size").alias("_size"))
    joined = rows.join(given.join(sizes, "_row"), "_row").drop("_row")
    text, count = at["text"], at.get("n_chars")

    def run(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(batch):
            held = [c for c in b.schema.names if c not in ("_given", "_size")]
            index, pieces, places = [], [], []
            for i, (t, blocks, n) in enumerate(zip(b.column(text).to_pylist(), b.column("_given").to_pylist(), b.column("_size").to_pylist(), strict=True)):
                for piece, place in given_texts(t, [tuple(x.values()) for x in blocks], n):
                    index.append(i)
                    pieces.append(piece)
                    places.append(place)
            out = b.select(held).take(pa.array(index, pa.int64()))
            for name, values in ((text, pa.array(pieces, pa.string())), (count, pa.array([len(x) for x in pieces], pa.int64()))):
                if name:
                    k = held.index(name)
                    out = out.set_column(k, out.schema.field(name), values.cast(out.schema.field(name).type))
            shards, slots = zip(*places, strict=True) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shards, pa.int32()), pa.array(slots, pa.int64())], [*held, "_shard", "_slot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("_given", "_size"))
    out = joined.mapInArrow(run, f"{schema}, _shard int, _slot long").sortWithinPartitions("_shard", "_slot")
    return out.drop("_shard", "_slot").toDF(*names)


def given_texts(text: str, blocks: list[tuple[int, int, int, int, int]], size: int) -> Iterator[tuple[str, tuple[int, int]]]:
    """For each time round, the runs of words in blocks (from_word, words,
    times, shard, slot) that are given at least so often, each with the first
    (shard, slot) that reads one of its blocks."""
    ends: list[tuple[int, int]] | None = None
    for k in range(1, max(b[2] for b in blocks) + 1):
        runs: list[list] = []
        for start, words, times, *place in blocks:
            if times >= k:
                if runs and runs[-1][1] == start:
                    runs[-1][1] = start + words
                    runs[-1][2] = min(runs[-1][2], tuple(place))
                else:
                    runs.append([start, start + words, tuple(place)])
        for i, j, place in runs:
            if (i, j) == (0, size):
                yield text, place
                continue
            if ends is None:
                ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            yield text[ends[i][0] : ends[j - 1][1]], place
