"""MinHash signatures as a relation (set, i, h): merge is the minimum."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from mergeloom.functions import hashing
from mergeloom.operators.keyed import parts
from mergeloom.session import ship
from mergeloom.sources import tables

#: Sets that are compared with each other at once; a larger bucket is dealt out.
CHUNK = 2000
#: Members of a class that are a row, and so pairs' square root, when pairs are written out.
PART = 1000


def hashes_for(bytes_: int, hash_bytes: int = 4) -> int:
    return bytes_ // hash_bytes


def pick_bands(threshold: float, hashes: int) -> int:
    """The fewest bands whose threshold is at most ``threshold``, rows a band
    being hashes / bands without rounding."""
    return next(b for b in itertools.count(1) if estimated_threshold(b, hashes / b) <= threshold)


def pick_hashes_and_bands(threshold: float, most_hashes: int) -> tuple[int, int]:
    bands = pick_bands(threshold, most_hashes)
    return most_hashes // bands * bands, bands


def estimated_threshold(bands: int, rows: float) -> float:
    """The similarity at which a pair becomes a candidate about every other time."""
    return (1.0 / bands) ** (1.0 / rows)


def probability_of_inclusion(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands


def signatures(df: DataFrame, x: str, hashes: int, by: Sequence[str]) -> DataFrame:
    """(by, i, h): the least of each of ``hashes`` hash functions over a set's
    distinct elements. Four functions come from one digest."""
    items = df.where(F.col(x).isNotNull()).select(*by, x).distinct()
    quads = items.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((hashes - 1) // 4)))).withColumn("_d", hashing.digest(F.col("_q"), x))
    least = quads.groupBy(*by, "_q").agg(*[F.min(hashing.hex32(F.col("_d"), k)).alias(f"_h{k}") for k in range(4)])
    each = least.select(*by, "_q", F.posexplode(F.array(*[F.col(f"_h{k}") for k in range(4)])).alias("_k", "h"))
    return each.select(*by, (F.col("_q") * 4 + F.col("_k")).alias("i"), "h").where(F.col("i") < hashes)


def merge(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    return sketch.groupBy(*by, "i").agg(F.min("h").alias("h"))


def similarity(a: DataFrame, b: DataFrame, hashes: int) -> DataFrame:
    """(similarity): the share of equal registers of two single sketches."""
    both = a.select("i", F.col("h").alias("_a")).join(b.select("i", F.col("h").alias("_b")), "i")
    return both.agg((F.count_if(F.col("_a") == F.col("_b")) / F.lit(float(hashes))).alias("similarity"))


def approximate_count(sketch: DataFrame, hashes: int, by: Sequence[str]) -> DataFrame:
    """(by, count): how many distinct elements a set has, by the mean of its
    scaled minima."""
    mean = F.sum(F.col("h") / F.lit(2.0**32))
    return sketch.groupBy(*by).agg(F.round(hashes / mean - 1).cast("long").alias("count"))


def bands(sketch: DataFrame, hashes: int, n_bands: int, by: Sequence[str]) -> DataFrame:
    """(by, band, bucket): sets that agree in all rows of a band share it."""
    rows = hashes // n_bands
    keyed = sketch.withColumn("band", F.floor(F.col("i") / rows).cast("int")).where(F.col("band") < n_bands)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda s: s["h"].cast("string")), ",")
    return keyed.groupBy(*by, "band").agg(F.md5(text).alias("bucket"))


def candidates(sketch: DataFrame, hashes: int, n_bands: int, key: str) -> DataFrame:
    """(a, b), a < b: pairs of sets that share a bucket, each once. Buckets of
    one set are dropped before the join."""
    keyed = bands(sketch, hashes, n_bands, [key])
    shared = keyed.groupBy("band", "bucket").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = keyed.join(shared, ["band", "bucket"])
    pairs = rows.select("band", "bucket", F.col(key).alias("a")).join(rows.select("band", "bucket", F.col(key).alias("b")), ["band", "bucket"]).where("a < b")
    return pairs.select("a", "b").distinct()


def _blocks(hashes: int, n_bands: int, least: float) -> tuple[int, list[int]]:
    """How many equal registers a link has at least, and where the blocks of
    registers begin, with the end, of which it shares one whole.

    With fewer unequal registers than bands a link shares a band whatever they
    are, and so one of any blocks that are one more than its unequal registers:
    fewer and longer ones than the bands, with the same links."""
    enough = next((k for k in range(hashes + 1) if k / float(hashes) >= least), hashes + 1)
    n = max(1, hashes - enough + 1)
    if n <= n_bands:
        return enough, [-(-k * hashes // n) for k in range(n + 1)]
    return enough, [k * (hashes // n_bands) for k in range(n_bands + 1)]


def _together(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[tuple]:
    """(block, keys, registers, left, right) of each group of rows that follow one
    another: the sets to compare, and which of them stand on which side."""

    def whole(parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts).combine_chunks()
        block, low, high, own = (t.column(c).to_numpy() for c in ("_block", "_low", "_high", "_own"))
        h = t.column("_h").combine_chunks().flatten().to_numpy().reshape(-1, hashes)
        return int(block[0]), t.column("_key").combine_chunks(), h, np.nonzero(own == low)[0], np.nonzero(own == high)[0], low[0] == high[0]

    last, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("_block", "_bucket", "_low", "_high")], 1)
        starts = np.append(0, np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            own = tuple(ids[start].tolist())
            if held and own != last:
                if sum(x.num_rows for x in held) > 1:
                    yield whole(held)
                held = []
            last = own
            held.append(b.slice(start, end - start))
    if held and sum(x.num_rows for x in held) > 1:
        yield whole(held)


def _linked(left: np.ndarray, right: np.ndarray, block: int, starts: list[int], enough: int) -> tuple[np.ndarray, np.ndarray]:
    """How many registers are equal, and which pairs are links whose first block
    of equal registers is ``block``."""
    if len(left) * len(right) <= 256:
        equal = left[:, None, :] == right[None, :, :]
        n = equal.sum(axis=2)
        shared = np.logical_and.reduceat(equal[:, :, : starts[-1]], starts[:-1], axis=2)
        return n, (n >= enough) & shared[:, :, block] & ~shared[:, :, :block].any(axis=2)
    a, b = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    n, before, here = np.zeros((len(left), len(right)), np.uint16), np.zeros((len(left), len(right)), bool), None
    ends = {s: k for k, s in enumerate(starts[1:])}
    run = None
    for i in range(len(a)):
        equal = a[i][:, None] == b[i][None, :]
        n += equal
        if i < starts[block + 1]:
            run = equal if run is None else np.logical_and(run, equal, out=run)
            if i + 1 in ends:
                if ends[i + 1] == block:
                    here = run
                else:
                    before |= run
                run = None
    return n, (n >= enough) & here & ~before


def _compared(firsts: DataFrame, hashes: int, n_bands: int, key: str, least: float, schema: StructType, found: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], list]) -> DataFrame:
    """What ``found`` says of (keys, left, right, equal registers) of the links,
    each of which comes once. Sets meet in buckets of equal blocks; a bucket of
    more than ``CHUNK`` sets is dealt out, and each two of its parts are compared
    by themselves."""
    ship(firsts.sparkSession)
    enough, starts = _blocks(hashes, n_bands, least)
    blocks = [F.xxhash64(F.slice("_h", s + 1, e - s)) for s, e in itertools.pairwise(starts)]
    rows = firsts.select(F.col(key).alias("_key"), "_h", F.posexplode(F.array(*blocks)).alias("_block", "_bucket"))
    large = rows.groupBy("_block", "_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK).withColumn("_n", F.ceil(F.col("_n") / CHUNK))
    rows = rows.join(F.broadcast(large), ["_block", "_bucket"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))  # a row in CHUNK at most
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("_key"), F.col("_n"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = rows.withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")})
    place = ["_block", "_bucket", "_low", "_high"]
    # Of a given number, since little to read is much to compare.
    rows = rows.repartition(parts(rows.sparkSession), *place).sortWithinPartitions(*place).select(*place, "_own", "_key", "_h")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, h, left, right, same in _together(batches, hashes):
            for k in range(0, len(left), 256):
                some = left[k : k + 256]
                n, links = _linked(h[some], h[right], block, starts, enough)
                if same:  # each two once
                    links &= some[:, None] < right[None, :]
                if links.any():
                    x, y = np.nonzero(links)
                    columns = found(keys, some[x], right[y], n[x, y])
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def classes(sketch: DataFrame, key: str, cut: Callable[[DataFrame], DataFrame] = tables.cut) -> tuple[DataFrame, DataFrame]:
    """(members, firsts): sets of equal signatures are a class, named by its
    smallest; ``members`` is (key, class), ``firsts`` the smallest with their
    registers (key, _h). Signatures are written once (``cut``)."""
    text = F.array_join(F.transform("_r", lambda s: F.concat_ws(":", s["i"].cast("string"), s["h"].cast("string"))), ",")
    # 32 bits a register, as a signed number.
    packed = F.transform("_r", lambda s: (s["h"] - 2**31).cast("int"))
    signed = sketch.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("_r"))
    signed = cut(signed.select(key, F.md5(text).alias("_s"), packed.alias("_h")))
    named = signed.groupBy("_s").agg(F.min(key).alias("class"))
    members = signed.select(key, "_s").join(named, "_s").select(key, "class")
    return members, signed.join(named.select(F.col("class").alias(key)), key, "left_semi").select(key, "_h")


def _key_type(df: DataFrame, key: str) -> DataType:
    return df.schema[key].dataType


def similar_classes(sketch: DataFrame, hashes: int, n_bands: int, key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` of classes is (key, class), ``links`` (a, b,
    similarity) has the pairs of classes with at least that similarity that share
    a band, a < b. Copies meet in no bucket, and nothing grows with the square of
    a class. Every set has all registers, as ``signatures`` gives them."""
    members, firsts = classes(sketch, key)
    kind = _key_type(firsts, key)
    schema = StructType([StructField("_a", kind), StructField("_b", kind), StructField("_n", IntegerType())])
    links = _compared(firsts, hashes, n_bands, key, least, schema, lambda keys, x, y, n: [keys.take(pa.array(x)), keys.take(pa.array(y)), pa.array(n)])
    return members, links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), (F.col("_n") / F.lit(float(hashes))).alias("similarity"))


def linked_classes(sketch: DataFrame, hashes: int, n_bands: int, key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(members, numbers): the same with the number of links of each class that
    has one, (class, links), added up where sets are compared: no pair is
    written."""
    members, firsts = classes(sketch, key)
    schema = StructType([StructField("class", _key_type(firsts, key)), StructField("links", LongType())])

    def counted(keys: pa.Array, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list:
        links = np.bincount(x, minlength=len(keys)) + np.bincount(y, minlength=len(keys))
        own = np.nonzero(links)[0]
        return [keys.take(pa.array(own)), pa.array(links[own])]

    numbers = _compared(firsts, hashes, n_bands, key, least, schema, counted)
    return members, numbers.groupBy("class").agg(F.sum("links").alias("links"))


def expanded(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity), a < b: ``similar_classes`` with every pair of sets
    written out, copies at similarity 1. Two parts of classes, of about ``PART``
    members each, are one row until tasks have them; these are of a given number,
    so that few and small rows that make many pairs are still spread."""
    large = members.groupBy("class").agg(F.count("*").alias("_n")).where(F.col("_n") > PART).withColumn("_n", F.ceil(F.col("_n") / PART))
    dealt = members.join(F.broadcast(large), "class", "left")  # a row in PART at most
    dealt = dealt.select("class", F.col(key).alias("_key"), F.coalesce(F.pmod(F.xxhash64(key), F.col("_n")), F.lit(0)).alias("_part"))
    rows = dealt.groupBy("class", "_part").agg(F.collect_list("_key").alias("_keys"))
    x, y = (rows.select(F.col("class").alias(f"_{k}"), F.col("_part").alias(f"_p{k}"), F.col("_keys").alias(f"_m{k}")) for k in "ab")
    far = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "similarity").join(x, "_a").join(y, "_b").withColumn("_far", F.lit(True))
    own = x.join(y, (F.col("_a") == F.col("_b")) & (F.col("_pa") <= F.col("_pb"))).withColumns({"similarity": F.lit(1.0), "_far": F.col("_pa") < F.col("_pb")})
    own = own.where(F.col("_far") | (F.size("_ma") > 1))
    both = far.unionByName(own).repartition(parts(members.sparkSession), "_a", "_pa", "_b", "_pb")
    pairs = both.select("_far", "similarity", F.explode("_ma").alias("_x"), "_mb").select("_far", "similarity", "_x", F.explode("_mb").alias("_y"))
    return pairs.where("_far or _x < _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")


def similar_pairs(sketch: DataFrame, hashes: int, n_bands: int, key: str, least: float) -> DataFrame:
    """(a, b, similarity), a < b: the same with every pair of sets written out,
    as many as the square of a class."""
    members, links = similar_classes(sketch, hashes, n_bands, key, least)
    out = expanded(members, links, key)
    return out if least <= 1 else out.limit(0)


# Feature hashing -----------------------------------------------------------

TRICK_SEED = 123456


def hashing_trick(df: DataFrame, x: str, value: str, bits: int, by: Sequence[str] = (), seed: int = TRICK_SEED) -> DataFrame:
    """(by, index, value): values added up by a hash of their key in [0, 2^bits),
    with a sign from another bit; zero sums are dropped."""
    summed = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(value).alias("_v")).withColumn("_d", hashing.digest(seed, x))
    sign = F.when(hashing.hex32(F.col("_d"), 1) % 2 == 1, F.col("_v")).otherwise(-F.col("_v"))
    rows = summed.select(*by, (hashing.hex32(F.col("_d"), 0) % 2**bits).alias("index"), sign.alias("_v"))
    return rows.groupBy(*by, "index").agg(F.sum("_v").alias("value")).where("value != 0")
