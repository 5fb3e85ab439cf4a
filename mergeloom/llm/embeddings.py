"""Embedding near-duplicates by iterative quantisation.

Vectors are scaled to unit length. On a bounded sample rotations of their
principal components are learned such that signs lose as little as possible
(ITQ), each from another start: balanced binary codes of ``BITS`` bits a rotation.
Dimensions below that are filled up with signs of random projections.

Retrieval is multi-index hashing: codes are cut into substrings of ``width`` bits,
each is a table, and two vectors meet if they are equal in some table. Width and
number of tables come from the sample. The width begins at that of the largest
label's number of vectors, so that few meet by chance. The tables are as many as
bring pairs of a cosine of just ``least`` together with a chance of
``AIM`` at least: pairs made of sample vectors, moved in any direction and along
differences of the data, of which the worse counts. If all ``ROTATIONS`` together
do not reach that, as with vectors that all lie close to a common mean, the width
shrinks until they do; there is no cap on tables, bits or candidates beside it.
A pair is taken in the first table where it meets and compared by the cosine of
the original vectors in double precision, in Arrow batches. Vectors only meet
within their label; labels are part of the key.

Models are fitted for the ``FITTED_LENGTHS`` commonest lengths, each on its own
sample of distinct vectors: those with the smallest hashes, at most ``SAMPLE``
and at most ``SAMPLE_VALUES`` components in all, as the driver holds them. Vectors
of other lengths take signs of random projections about the origin, which part
two vectors by their angle alone, whatever the data: their number of tables
follows from the cosine.

Each vector is read and written once, with a number, its keys and a digest of
its components; equal vectors of a label are one entry with a count, so groups
of copies are not expanded, and what returns to the rows goes by number. Of a
pair only numbers and counts are written, and only if it links: vectors travel
to the comparison in their own element type and end there. Buckets have no cap; a
hot bucket is a skewed join that adaptive execution splits. n_links needs every
link between different vectors, so the work grows with the square of a group of
near copies.

Vectors that are null, empty, zero or hold null or non-finite components, and
vectors with a null label, link with nothing. Vectors of unequal length do not
link. A null vec_id gets its row; it names a component only if no other can.
Very long vectors are compared whole. Repeated rows are vectors of their own,
linked as equal ones; vectors at exactly the least cosine link. Other columns,
whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, materialize, pick
from mergeloom.llm.components import components

BITS, ROTATIONS = 64, 12
WIDEST, NARROWEST = 24, 4
AIM = 0.998
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
LEAST_COSINE = 0.98
FITTED_LENGTHS = 8
#: Sample vectors that the tables are tried on.
TRIED = 2000


@dataclass(frozen=True)
class Model:
    """Signs of (x - mean) @ projections, in ``tables`` keys of ``width`` bits."""

    mean: np.ndarray
    projections: tuple[np.ndarray, ...]
    width: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables): the keys of unit vectors of the model's length."""
        return np.hstack([sliced((x - self.mean) @ p >= 0, self.width) for p in self.projections])[:, : self.tables]


def sliced(signs: np.ndarray, width: int) -> np.ndarray:
    """The numbers that consecutive ``width`` signs spell, the rest left out."""
    whole = signs.shape[1] // width * width
    return signs[:, :whole].reshape(len(signs), -1, width) @ (1 << np.arange(width, dtype=np.int64))


def itq(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are the code."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(0)
    values, vectors = np.linalg.eigh((sample - mean).T @ (sample - mean))
    own = vectors[:, ::-1][:, : min(bits, d)]
    parts = (sample - mean) @ own
    turn = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(parts @ turn >= 0, 1.0, -1.0).T @ parts)
        turn = (u @ v).T
    rest = rng.normal(size=(d, bits - own.shape[1]))
    return mean, np.hstack([own @ turn, rest])


def moved(x: np.ndarray, cosine: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Two sets of partners at just that cosine of unit vectors: moved in any
    direction, and along the differences between vectors of the data."""
    out = []
    for step in (rng.normal(size=x.shape), x[rng.permutation(len(x))] - x[rng.permutation(len(x))] + 1e-9 * rng.normal(size=x.shape)):
        step = step - (step * x).sum(1)[:, None] * x
        size = np.sqrt((step * step).sum(1))[:, None]
        out.append(cosine * x + np.sqrt(1 - cosine * cosine) * step / np.where(size > 0, size, 1))
    return out


def modelled(sample: np.ndarray, most: int, least: float = LEAST_COSINE) -> Model:
    """The model of a sample of unit vectors, for labels of at most ``most``."""
    tried = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    partners = moved(tried, least, np.random.default_rng(1))
    projections, signs, mean = [], [], sample.mean(0)
    width = min(WIDEST, max(NARROWEST, most.bit_length() + 2))
    while True:
        per, meet, need = BITS // width, [np.zeros(len(tried), bool) for _ in partners], 0
        for r in range(ROTATIONS):
            if r == len(projections):
                projections.append(itq(sample, BITS, 30 if r == 0 else 8, r)[1])
                signs.append([(y - mean) @ projections[r] >= 0 for y in (tried, *partners)])
            own, *others = (sliced(y, width) for y in signs[r])
            for t in range(per):
                need += 1
                meet = [m | (own[:, t] == y[:, t]) for m, y in zip(meet, others, strict=True)]
                if min(m.mean() for m in meet) >= AIM:
                    return Model(mean, tuple(projections[: r + 1]), width, need)
        if width == NARROWEST:
            return Model(mean, tuple(projections), width, need)
        width = max(NARROWEST, width - 2)


def about_origin(d: int, most: int, least: float = LEAST_COSINE) -> Model:
    """Random projections: two vectors agree in a sign with chance 1 - angle / pi."""
    width = min(16, max(NARROWEST, most.bit_length() + 2))
    equal = (1 - np.arccos(least) / np.pi) ** width
    tables = int(np.ceil(np.log(1 - AIM) / np.log(1 - equal)))
    rng = np.random.default_rng(d)
    return Model(np.zeros(d), tuple(rng.normal(size=(d, BITS)) for _ in range(-(-tables // (BITS // width)))), width, tables)


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vector: their places in the column, the vectors themselves
    and the vectors at length 1 in double precision. Null, empty and zero ones
    and those with null or non-finite components are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(0)) if len(column) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    flat = column.flatten()
    values, whole = flat.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(flat.is_valid())
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.nonzero(sizes == d)[0]
        index = (ends[at] - d)[:, None] + np.arange(d)
        own = values[index]
        x = own.astype(np.float64)
        top = np.abs(x).max(1)
        sound = whole[index].all(1) & np.isfinite(top) & (top > 0)
        x = x[sound] / top[sound][:, None]
        yield at[sound], own[sound], x / np.sqrt((x * x).sum(1))[:, None]


def samples(rows: DataFrame, sample: int = SAMPLE) -> Iterator[tuple[int, int, list[list[float]]]]:
    """(length, rows of it, a bounded sample of its distinct vectors) for each of
    the commonest lengths of ``rows`` (embedding)."""
    sized = rows.select("embedding", F.size("embedding").alias("d"), F.xxhash64("embedding").alias("h")).where("d > 0")
    common = sized.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").limit(FITTED_LENGTHS).collect()
    for d, n in map(tuple, common):
        most = min(sample, SAMPLE_VALUES // d)
        if most < 2:
            continue
        # Hashes are even: of a range that holds four times as many as needed, the smallest.
        share = min(1.0, (4 * most + 1000) / n)
        low = F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)
        one = sized.where((F.col("d") == d) & low).groupBy("h").agg(F.first("embedding").alias("embedding"))
        yield d, n, [r[0] for r in one.orderBy("h").limit(most).select("embedding").collect()]


def fit(rows: DataFrame, most: int, sample: int = SAMPLE, least: float = LEAST_COSINE) -> dict[int, Model]:
    """A model for each of the commonest lengths of ``rows`` (embedding)."""
    models = {}
    for d, _, found in samples(rows, sample):
        for _, _, x in units(pa.array(found, pa.list_(pa.float64()))):
            if len(x) > 1:
                models[d] = modelled(x, most, least)
    return models


def encoded(rows: DataFrame, models: dict[int, Model], most: int, least: float = LEAST_COSINE) -> DataFrame:
    """(row, vec_id, label, d, keys, digest, vector) of (row, vec_id, label,
    embedding); of vectors that link with nothing d and what follows is null."""
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "vec_id", "label", "d", "keys", "digest", "vector"]
        made = dict(models)
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel(), t))
        for b in batches(found):
            labelled, alone = np.asarray(b.column(2).is_valid()), np.ones(b.num_rows, bool)
            element = b.column(3).type.value_type
            for at, own, x in units(b.column(3)):
                keep = labelled[at]
                at, own, x = at[keep], own[keep] + 0.0, x[keep]  # minus zero is zero
                if not len(at):
                    continue
                alone[at], d = False, own.shape[1]
                model = made.get(d) or about_origin(d, most, least)
                if len(made) < 64:
                    made[d] = model
                digests = [xxhash.xxh3_128_digest(v.tobytes()) for v in own]
                heads = [c.take(pa.array(at)) for c in b.columns[:3]]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(np.full(len(at), d, np.int32)), lists(model.keys(x), pa.int32()), pa.array(digests, pa.binary()), lists(own, element)], names)
            at = pa.array(np.nonzero(alone)[0])
            nulls = [pa.nulls(len(at), t) for t in (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(element))]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:3]), *nulls], names)

    return rows.select("row", "vec_id", "label", "embedding").mapInArrow(run, f"row long, vec_id long, label long, d int, keys array<int>, digest binary, vector {kind}")


def candidates(coded: DataFrame) -> DataFrame:
    """(x, y), x < y: pairs of gids whose keys are equal in some table, once."""
    tables = coded.agg(F.max(F.size("keys"))).first()[0] or 0
    index = coded.select("gid", "label", "d", "keys", F.posexplode("keys").alias("t", "key"))
    # Entries that are alone in their bucket go before the join.
    shared = index.groupBy("label", "d", "t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    index = index.join(shared, ["label", "d", "t", "key"])
    x, y = index.alias("x"), index.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "d", "t", "key")]
    first = F.expr(" and ".join(f"(x.t <= {t} or get(x.keys, {t}) <> get(y.keys, {t}))" for t in range(tables - 1)) or "true")
    return x.join(y, [*same, F.col("x.gid") < F.col("y.gid"), first]).select(F.col("x.gid").alias("x"), F.col("y.gid").alias("y"))


def linked(pairs: DataFrame, vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(x, y, n_x, n_y): the candidate pairs with a cosine of ``least`` or more,
    by the original vectors (gid, n, vector), and the copies of either."""
    left, right = (vectors.select(F.col("gid").alias(k), F.col("n").alias(f"n_{k}"), F.col("vector").alias(f"v_{k}")) for k in "xy")
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "n_x", "n_y", "v_x", "v_y")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found):
            for (at, _, x), (_, _, y) in zip(units(b.column(4)), units(b.column(5)), strict=True):  # the same lengths and places
                near = pa.array(at[(x * y).sum(1) >= least])
                yield pa.RecordBatch.from_arrays([c.take(near) for c in b.columns[:4]], ["x", "y", "n_x", "n_y"])

    return both.mapInArrow(run, "x long, y long, n_x long, n_y long")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a vector."""
    kind = next(f.dataType.simpleString() for f in vectors.schema if f.name == "embedding")
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = pick(vectors, vec_id="long", label="long", embedding=kind)
    labelled = rows.where("label is not null and size(embedding) > 0")
    most = labelled.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    models = fit(labelled, most, least=least)
    coded = materialize(encoded(rows.withColumn("row", F.monotonically_increasing_id()), models, most, least), "coded")
    sound = coded.where("keys is not null")
    entries = sound.groupBy("label", "digest").agg(F.min("row").alias("gid"), F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("d").alias("d"), F.first("keys").alias("keys"))
    entries = materialize(entries, "entries")
    firsts = sound.select(F.col("row").alias("gid"), "vector").join(entries.select("gid", "n"), "gid")
    links = materialize(linked(candidates(entries), firsts, least), "links")
    others = links.select(F.explode(F.array(F.struct(F.col("x").alias("gid"), F.col("n_y").alias("k")), F.struct(F.col("y").alias("gid"), F.col("n_x").alias("k")))).alias("o"))
    counts = others.groupBy("o.gid").agg(F.sum("o.k").alias("k"))
    roots = components(links, "x", "y").withColumnRenamed("id", "gid")
    named = entries.select("label", "digest", "gid", "least", "n").join(roots, "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    ids = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = named.join(ids, "component").join(counts, "gid", "left")
    named = materialize(named.select("label", "digest", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "component_id"), "named")
    found = sound.select("vec_id", "label", "digest").join(named, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = coded.where("keys is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
