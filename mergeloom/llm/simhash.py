"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a
word of the (23, 12) Golay code with leading zeros. Two fingerprints with at
most 4 differing bits (a, b, c by segment) fall into one of two cases:

* some segment is equal. The other two hold at most 4 errors, so one of them
  at most 2: key = that equal segment and a codeword near the other one;
* none is equal. Then the errors are 1, 1, 1 or 1, 1, 2: two segments have one
  error each, so an equal half each: key = both halves and a codeword near the
  third segment.

That makes 18 to 108 keys of 35 to 40 bits a fingerprint. The codewords near a
word are 1 or 6 (see ``golay``), and words within 2 bits share one.

Only distinct fingerprints get keys. Components then form in two passes.
First every bucket links its members to its first, last and preceding member
(rows in proportion to the bucket), each link verified. After that only
buckets which still hold several components are joined, and only between
members of different components, again verified; large ones in blocks. So no link that joins two
components is lost, and groups of near copies are not expanded into pairs.

Null text counts as empty; a text without words has fingerprint zero and
links like any other. A null doc_id gets a fingerprint and a component, but is
never a component's id unless no other is there. Repeated rows come out as
often as they came in. Very long texts are hashed whole, in runs of ``chunk``
shingles. Other columns, whatever their names, are not read; where whole rows
are kept they stay as they are. An empty table gives no rows.

Ties: a bit that just half of the hashes set is 0, fingerprints at just four
differing bits link, and so do sets of shingles at just the least similarity. Of a
component the row of the smallest doc_id stays, null last, of equal ones that with
the smallest row number.

Four bits reach only part of the texts that share most of their words. The
pipeline drops near copies by the texts themselves (``similar``): a Jaccard
similarity of 0.8 or more of their sets of five-word shingles. Golay keys and
bands of min-hashes only propose pairs; sets decide. Of pairs at 0.8 exactly,
``BANDS`` bands of ``BAND_ROWS`` min-hashes miss (1 - 0.8**6)**40 = 5 in a
million, of closer ones fewer. Texts do not shuffle for that: rows are written
once with a number, and whatever is asked of some of them, the sets of those
that share a key and the rows that stay, filters that table where it lies
(``common.by_number``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm import golay
from mergeloom.llm.common import batches, by_number, byte_texts, flattened, give_back, materialize, numbered, pick
from mergeloom.llm.components import components

SEED = 42
MOST_BITS = 4
BANDS, BAND_ROWS = 40, 6
#: Members of a bucket in a slice, and shingles in all of them, about; a block
#: holds two slices' sets.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 18
#: Fingerprints whose keys, up to 150 each, one task makes.
KEYED_A_TASK = 10_000
#: (shift, bits) of the segments and of each segment's two halves.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
HALVES = (((11, 11), (0, 11)), ((11, 10), (0, 11)), ((11, 10), (0, 11)))


def fingerprint(text: bytes, width: int = 4, seed: int = SEED, chunk: int = 1 << 16) -> int:
    """Signed 64-bit SimHash of the shingles of ``width`` words."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, chunk):
        h = np.array([hash_of(b" ".join(words[k : k + width]), seed) for k in range(i, min(n, i + chunk))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of all fingerprints, in no special order."""
    p = prints.view(np.uint64)
    cut = lambda shift, bits, x: (x >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
    segments = [cut(s, b, p) for s, b in SEGMENTS]
    nears = [golay.near(s) for s in segments]
    halves = [[x >> s & ((1 << b) - 1) for s, b in HALVES[i]] for i, x in enumerate(segments)]
    rows, out, tag = [], [], 0

    def add(whole: np.ndarray, near: np.ndarray) -> None:
        nonlocal tag
        r, k = np.nonzero(near >= 0)
        rows.append(r)
        out.append((np.int64(tag) << 36) | (whole[r] << 12) | near[r, k])
        tag += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                add(segments[i], nears[j])
    for third in range(3):
        i, j = (x for x in range(3) if x != third)
        for x in halves[i]:
            for y in halves[j]:
                add(x << 11 | y, nears[third])
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): whole texts, one Arrow pass, no shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            fp = pa.array([fingerprint(t, width) for t in byte_texts(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def _keyed(prints: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(i, 4096).to_numpy()
                r, k = keys(fp)
                for j in range(0, len(r), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(k[j : j + (1 << 16)]), pa.array(fp[r[j : j + (1 << 16)]])], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def _close(a: str, b: str, most: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def link(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(fp, component) for distinct fingerprints ``prints`` (fp): component is
    the smallest fingerprint reachable by links of at most ``most`` bits."""
    if most > MOST_BITS:
        raise ValueError(f"the keys find at most {MOST_BITS} differing bits")
    tasks = -(-prints.count() // KEYED_A_TASK) or 1
    bucket = Window.partitionBy("key").orderBy("fp")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = _keyed(prints.select("fp").repartition(tasks, "fp")).select(
        "key", "fp", F.lag("fp").over(bucket).alias("before"), F.first("fp").over(whole).alias("low"), F.last("fp").over(whole).alias("high")
    ).where("low != high")
    shared = materialize(shared, "shared")
    stars = shared.select("fp", F.explode(F.array("before", "low", "high")).alias("to")).where("to != fp").where(_close("fp", "to", most))
    first = components(stars, "fp", "to")
    named = shared.select("key", "fp").join(first, F.col("fp") == F.col("id"), "left").select("key", "fp", F.coalesce("component", "fp").alias("c"))
    by_key = Window.partitionBy("key")
    mixed = named.select("*", F.min("c").over(by_key).alias("c0"), F.max("c").over(by_key).alias("c1"), F.count("*").over(by_key).alias("n"))
    mixed = mixed.where("c0 != c1").select("key", "fp", "c", "n")
    small = mixed.where(F.col("n") <= BLOCK_MEMBERS)
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")))
    pairs = pairs.where(_close("x.fp", "y.fp", most)).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    pairs = pairs.union(_close_in_blocks(mixed.where(F.col("n") > BLOCK_MEMBERS), most))
    second = components(pairs, "a", "b").withColumnsRenamed({"id": "c", "component": "root"})
    out = prints.select("fp").join(first, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("component", "fp").alias("c"))
    return out.join(second, "c", "left").select("fp", F.coalesce("root", "c").alias("component"))


def _close_in_blocks(buckets: DataFrame, most: int) -> DataFrame:
    """(a, b): components of a bucket (key, fp, c, its number n of rows) that some
    pair of members links. Pairs of slices of ``BLOCK_MEMBERS`` or so are blocks,
    so that a bucket of any size is the work of many tasks and no task's memory."""
    k = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    dealt = buckets.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "c")

    def linked(block: pa.Table) -> pa.Table:
        own, fp, c = (block[x].to_numpy() for x in ("own", "fp", "c"))
        near = np.not_equal.outer(c, c) & (np.bitwise_count(np.bitwise_xor.outer(fp.view(np.uint64), fp.view(np.uint64))) <= most)
        if block["i"][0] != block["j"][0]:
            near &= np.not_equal.outer(own, own)
        x, y = np.nonzero(np.triu(near))
        found = np.unique(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], 1), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return dealt.groupBy("key", "i", "j").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id
    reachable by links of at most ``most`` differing bits."""
    all_prints = materialize(fingerprints(docs, width), "prints")
    distinct = all_prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialize(link(distinct, most), "named")
    ids = named.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialize(ids, "ids")  # so that a join on a component that many share can be split
    by_print = named.join(ids, "component").select("fp", "component_id")
    return all_prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes."""
    words = text.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def marks(hashes: np.ndarray, chunk: int = 1 << 12) -> tuple[bytes, int, list[int]]:
    """A digest, the SimHash and the keys by bands of a set of shingles."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    if not len(hashes):
        return digest, 0, []
    times, plus = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    ones, least = np.zeros(64, np.int64), np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), chunk):
        h = hashes[i : i + chunk]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        least = np.minimum(least, (times * h + plus).min(1))
    fp = int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])
    bands = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return digest, fp, np.array(bands, np.uint64).view(np.int64).tolist()


def _marked(rows: DataFrame, width: int) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found):
            digest, fp, bands, n = zip(*((*marks(h), len(h)) for h in (shingles(t, width) for t in byte_texts(b.column(1)))), strict=True)
            columns = [pa.array(digest, pa.binary()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["_row", "digest", "fp", "bands", "n"])

    return rows.select("_row", F.col("text").cast("string")).mapInArrow(run, "_row long, digest binary, fp long, bands array<long>, n long")


def _set_keys(sets: DataFrame) -> DataFrame:
    """(key, v) from (v, fp, bands): Golay keys of the SimHash, and bands."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 1024):
                v, fp, bands = (b.column(k).slice(i, 1024) for k in range(3))
                v, (r, k) = v.to_numpy(), keys(fp.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v[r])], ["key", "v"])
                at = np.repeat(np.arange(len(v)), bands.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([bands.flatten(), pa.array(v[at])], ["key", "v"])

    return sets.select("v", "fp", "bands").mapInArrow(run, "key long, v long")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found, 1 << 20):
            sets = [shingles(t, width).view(np.int64) for t in byte_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["v", "s"])

    return rows.select(F.col("_row").alias("v"), F.col("text").cast("string")).mapInArrow(run, "v long, s array<long>")


def similar(rows: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(_row, component) for a ``numbered`` table with ``text``: component is the
    smallest number reachable by links of texts whose sets of shingles have a
    Jaccard similarity of ``least`` (0.8 or more: bands are made for that)."""
    if least < 0.8:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    marked = materialize(_marked(rows, width), "marks")
    same = materialize(marked.groupBy("digest").agg(F.min("_row").alias("v")), "same")
    tasks = -(-same.count() // KEYED_A_TASK) or 1
    by_key = Window.partitionBy("key")
    keyed = _set_keys(marked.repartition(tasks, "_row").join(same.select("v").repartition(tasks, "v"), F.col("_row") == F.col("v")))
    shared = keyed.select("key", "v", F.min("v").over(by_key).alias("low"), F.max("v").over(by_key).alias("high")).where("low != high").drop("high")
    shared = materialize(shared, "shared")
    wanted = shared.select(F.col("v").alias("_row")).distinct()
    sets = materialize(_sets(by_number(rows, wanted), width), "sets")

    def roots(pairs: DataFrame) -> DataFrame:
        """(c, root): components ``ca`` and ``cb`` joined by those of the pairs a, b
        that are similar. Sizes go first: sets whose sizes differ by more than a
        similarity of ``least`` allows stay away."""
        for k in "ab":
            pairs = pairs.join(marked.select(F.col("_row").alias(k), F.col("n").alias(f"n{k}")), k)
        pairs = pairs.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
        x, y = (sets.select(F.col("v").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        links = pairs.join(x, "a").join(y, "b").where(both / (F.col("na") + F.col("nb") - both) >= least)
        return components(links.select("ca", "cb"), "ca", "cb").withColumnsRenamed({"id": "c", "component": "root"})

    def moved(named: DataFrame, to: DataFrame) -> DataFrame:
        """``named`` with the components ``c`` that ``to`` joins."""
        return named.join(to, "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")

    # Each member with its bucket's first one; then, in buckets of several components, one member of each component with
    # those of the first and the one before; then all members of buckets that still have several, in blocks: those of a bucket's
    # largest component with the others of all its buckets at once, the others among themselves.
    stars = shared.select(F.col("v").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
    first = roots(stars.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")))
    named = materialize(_mixed(moved(shared.select("key", "v", F.col("v").alias("c")), first)), "mixed")
    order, head = by_key.orderBy("c"), F.struct("v", "c")
    heads = named.groupBy("key", "c").agg(F.min("v").alias("v"))
    heads = heads.select(head.alias("x"), F.first(head).over(order).alias("low"), F.lag(head).over(order).alias("before"))
    heads = heads.select("x", F.explode(F.array("low", "before")).alias("y")).where("y.c != x.c")
    second = roots(heads.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct())
    members, rest = _by_hub(materialize(_mixed(moved(named, second)), "mixed"))
    links = _linked_to_hubs(members, sets, least).union(_linked_in_blocks(rest, sets, least))
    third = components(links, "ca", "cb").withColumnsRenamed({"id": "c", "component": "root"})
    out = moved(moved(moved(same.select("digest", F.col("v").alias("c")), first), second), third)
    out = materialize(out.select("digest", F.col("c").alias("component")), "roots")
    return marked.select("_row", "digest").join(out, "digest").select("_row", "component")


def _mixed(named: DataFrame) -> DataFrame:
    """The rows (key, v, c) of keys with several components."""
    by_key = Window.partitionBy("key")
    out = named.select("key", "v", "c", F.min("c").over(by_key).alias("c0"), F.max("c").over(by_key).alias("c1"))
    return out.where("c0 != c1").select("key", "v", "c")


def _slices(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK_MEMBERS, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _by_hub(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hub, v, c) and (key, v, c) from rows (key, v, c) of keys with several
    components. A key's hub is that one of its components which has the most
    members. A large group of near copies is the hub of very many keys, all of
    them with much the same members: it is to be compared once with the others
    that any of them holds, and what remains of its keys, without it, by key.
    Hubs for which that makes more pairs than going by key stay with their keys."""
    sizes = named.select("c", "v").distinct().groupBy("c").agg(F.count("*").alias("size"))
    parts = named.groupBy("key", "c").agg(F.count("*").alias("m")).join(sizes, "c")
    hubs = parts.groupBy("key").agg(F.max(F.struct("size", "c", "m")).alias("h"), F.sum("m").alias("m"))
    hubs = hubs.select("key", F.col("h.c").alias("hub"), (F.col("h.m") * (F.col("m") - F.col("h.m")).cast("double")).alias("pairs"))
    whole = materialize(named.join(hubs, "key"), "hubs")
    members, inside = whole.select("hub", "v", "c").distinct(), F.col("c") == F.col("hub")
    by_key = whole.select("key", "hub", "pairs").distinct().groupBy("hub").agg(F.sum("pairs").alias("pairs"))
    at_once = members.groupBy("hub").agg((F.count_if(inside) * F.count_if(~inside).cast("double")).alias("at_once"))
    worth = materialize(at_once.join(by_key, "hub").where("at_once <= pairs").select("hub", F.lit(True).alias("worth")), "worth")
    rest = whole.join(worth, "hub", "left").where(F.col("worth").isNull() | ~inside)
    return members.join(worth, "hub").select("hub", "v", "c"), _mixed(rest)


def _linked_to_hubs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(ca, cb): the hubs and those of their others' components that some pair of
    members links, from (hub, v, c). A hub's own members and the others are dealt
    into slices of their own; a block is a slice of either side."""
    inside = F.col("c") == F.col("hub")
    sized = members.join(sets.select("v", F.size("s").alias("n")), "v")
    k = [_slices(F.count_if(side), F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0))).alias(name) for side, name in ((inside, "k0"), (~inside, "k1"))]
    own = F.when(inside, F.pmod(F.xxhash64("v"), F.col("k0"))).otherwise(F.col("k0") + F.pmod(F.xxhash64("v"), F.col("k1"))).cast("int")
    others = F.when(inside, F.sequence("k0", F.col("k0") + F.col("k1") - 1)).otherwise(F.sequence(F.lit(0), F.col("k0") - 1))
    dealt = sized.join(sized.groupBy("hub").agg(*k), "hub").select(F.col("hub").alias("key"), own.alias("own"), F.explode(others).alias("other"), "v", "c")
    return _compared(dealt, sets, least)


def _linked_in_blocks(named: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(ca, cb): the components of a bucket (key, v, c) that some pair of members
    links. A bucket's members are dealt into slices of about ``BLOCK_MEMBERS`` and
    ``BLOCK_SHINGLES``; each pair of slices is a block. No pair is a row, and a
    bucket of any size is as many blocks as it needs."""
    sized = named.join(sets.select("v", F.size("s").alias("n")), "v")
    dealt = sized.join(sized.groupBy("key").agg(_slices(F.count("*"), F.sum("n")).alias("k")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("v"), F.col("k")).cast("int"))
    return _compared(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))), sets, least)


def _compared(dealt: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(ca, cb) from (key, own, other, v, c): members ``v`` of the slices ``own`` of
    a key, once for each slice ``other`` that they meet. A task compares the sets
    of a block, a pair of slices, all at once."""
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "c").join(sets, "v")
    # Blocks come as sorted rows, one after another: collected lists of sets would fill the JVM's heap.
    blocks = dealt.select("key", "i", "j", "own", "c", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def linked(block: pa.Table) -> pa.RecordBatch:
        own, c = block["own"].to_numpy(), block["c"].to_numpy()
        near = close_sets(block["s"].combine_chunks(), least)
        if block["i"][0] != block["j"][0]:
            near &= np.not_equal.outer(own, own)
        x, y = np.nonzero(np.triu(near & np.not_equal.outer(c, c)))
        found = np.unique(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["ca", "cb"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in rows:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(ids[low]) != last:
                    yield linked(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(low, high - low))
                last = tuple(ids[low])
        if held:
            yield linked(pa.Table.from_batches(held))
        held = []
        give_back()

    return blocks.mapInArrow(run, "ca long, cb long")


def close_sets(sets: pa.ListArray, least: float, chunk: int = 1 << 12) -> np.ndarray:
    """A matrix: which of the sets of longs are similar? Only what stands in two
    sets or more is counted, in blocks of columns."""
    sizes = np.asarray(sets.value_lengths())
    n, at = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    _, token, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    kept = times[token] > 1
    at, token = at[kept], number[token[kept]]
    order = np.argsort(token, kind="stable")
    at, token, both = at[order], token[order], np.zeros((n, n))
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, chunk):
        i, j = np.searchsorted(token, [low, low + chunk])
        there = np.zeros((n, min(chunk, int(token[-1]) + 1 - low)), np.float32)
        there[at[i:j], token[i:j] - low] = 1
        both += there @ there.T
    np.fill_diagonal(both, sizes)
    return both / np.maximum(np.add.outer(sizes, sizes) - both, 1) >= least


def deduplicated(docs: DataFrame, width: int = 4, most: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id
    (null last)."""

    def find(rows: DataFrame) -> DataFrame:
        found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width, most)
        return found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component"))

    return _one_of_each(docs, find)


def without_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of ``similar``, chosen alike."""
    return _one_of_each(docs, lambda rows: similar(rows, width, least))


def _one_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows get a number on being written once, so rows of equal or null
    doc_ids stay apart; ``find`` gives (_row, component)."""
    flat, names, at = flattened(docs)
    rows = numbered(flat, "rows")
    found = materialize(find(rows.select("_row", F.col(at["text"]).alias("text"))), "found")
    ids = found.join(rows.select("_row", F.col(at["doc_id"]).alias("doc_id")), "_row")
    chosen = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).getField("_row").alias("_row"))
    return by_number(rows, chosen).select(*flat.columns).toDF(*names)
