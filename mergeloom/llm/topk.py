"""Exact top-k by inner product: ball trees searched by branch and bound.

Components become whole numbers, floor(``SCALE`` * x), and a score is the whole
inner product. Vectors of one length are dealt to shards of at most about
``SHARD_VALUES`` components: to the nearest of up to ``MOST_CENTRES`` centres, which
are fitted on a bounded sample and only make the search faster, and by row number
where a centre has more than a shard holds. Each shard becomes a ball tree, one
row of a written table: a node is a ball of centre c and radius r, so that no
vector in it scores above q.c + |q| r with a query q.

Queries search their own shard first, which gives each a k-th score to beat. They
then meet the balls of all other shards, in blocks of balls, and only go to shards
whose bound reaches that score: first each to the one of the highest bound, then,
with the k-th score that came out, to those that are left. In a shard all queries
of a batch go down the tree together: each first to the leaf of its best bounds,
then nodes in the order of their highest bound, with the queries whose current
k-th score the bound reaches. Leaves are multiplied out. Trees that many queries
go to are copied for every ``QUERIES_A_TASK`` of them, so neither a hot shard nor
the number of queries or vectors makes a task large.

Everything is exact: the order of search decides what is looked at, never what is
found. Products are exact doubles where norms are below 2^26 and Python's whole
numbers otherwise (slow, meant for stray vectors); scores beyond 64 bits count as
the nearest 64-bit number.

Vectors that are null or hold null or non-finite components (or such as are no
longer finite times ``SCALE``) take no part, nor do vectors of another length in a
query's search; empty vectors score 0 with each other. Equal scores rank by the
smaller vec_id, null last. A null vec_id is a candidate but never a query; of rows
that share a vec_id each is a query and the others its candidates. Very long
vectors are shards of their own. Other columns, whatever their names, are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, keyed_stream, materialize, pick, scratch_path, sized_join
from mergeloom.llm.embeddings import samples

SCALE, TOP = 256, 5
SHARD_VALUES, MOST_CENTRES = 1 << 19, 256
LEAF = 64
BALLS_A_BLOCK, QUERIES_A_TASK = 1024, 50_000
#: Norms below this multiply exactly in double precision.
TAME = 2.0**26
LONGS = (-(2**63), 2**63 - 1)


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: places in the column and the vectors' whole numbers, as
    doubles, which hold them exactly."""
    sizes = np.asarray(column.value_lengths().fill_null(0)) if len(column) else np.zeros(0, np.int64)
    ends, there, flat = np.cumsum(sizes), np.asarray(column.is_valid()), column.flatten()
    values, whole = flat.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(flat.is_valid())
    for d in np.unique(sizes[there]).tolist():
        at = np.nonzero((sizes == d) & there)[0]
        index = (ends[at] - d)[:, None] + np.arange(d)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(values[index].astype(np.float64) * SCALE)
        sound = whole[index].all(1) & np.isfinite(x).all(1)
        if sound.any():
            yield at[sound], x[sound] + 0.0


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def centres(x: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """At most ``most`` centres of the sample by Lloyd's rounds."""
    found = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)]
    for _ in range(rounds):
        own = nearest(x, found)
        sums, n = np.zeros_like(found), np.bincount(own, minlength=len(found))
        np.add.at(sums, own, x)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points * points).sum(1) - 2 * (x @ points.T)).argmin(1)


def shard_size(d: Column | int) -> Column | int:
    return F.greatest(F.lit(1), F.floor(SHARD_VALUES / F.greatest(F.lit(1), d))) if isinstance(d, Column) else max(1, SHARD_VALUES // max(1, d))


def fit(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres for the commonest lengths that need more than one shard."""
    found = {}
    for d, n, vectors in samples(rows):
        if n > shard_size(d):
            for _, x in whole_numbers(pa.array(vectors, pa.list_(pa.float64()))):
                x = x[norms(x) < TAME]
                if len(x):
                    found[d] = centres(x, min(MOST_CENTRES, -(-n // shard_size(d))))
    return found


def items(rows: DataFrame, asks: Column, models: dict[int, np.ndarray]) -> DataFrame:
    """(row, vec_id, asks, d, wild, leaf, vector): vectors that take part, packed
    as 32-bit whole numbers, or as doubles where they are ``wild``."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found):
            for at, x in whole_numbers(b.column(3)):
                tame, d = norms(x) < TAME, x.shape[1]
                for wild, own in ((False, np.nonzero(tame)[0]), (True, np.nonzero(~tame)[0])):
                    if not len(own):
                        continue
                    v, n = x[own], len(own)
                    leaf = nearest(v, models[d]) if d in models and not wild else np.zeros(n, int)
                    packed = [r.tobytes() for r in (v if wild else v.astype(np.int32))]
                    heads = [c.take(pa.array(at[own])) for c in b.columns[:3]]
                    rest = [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, wild)), pa.array(leaf.astype(np.int32)), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*heads, *rest], ["row", "vec_id", "asks", "d", "wild", "leaf", "vector"])

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce(asks, F.lit(False)).alias("asks"), "embedding")
    return rows.mapInArrow(run, "row long, vec_id long, asks boolean, d int, wild boolean, leaf int, vector binary")


def unpacked(vectors: list[bytes], wild: bool, d: int) -> np.ndarray:
    kind = np.float64 if wild else np.int32
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), d).astype(np.float64)


# Trees -----------------------------------------------------------------


def spans(n: int) -> list[tuple[int, int]]:
    """The range of rows of each node; node i has the children 2i + 1, 2i + 2."""
    out, level = [], [(0, n)]
    while True:
        out += level
        if max(hi - lo for lo, hi in level) <= LEAF:
            return out
        level = [x for lo, hi in level for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]


def grown(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, centres, radii): rows ordered so that ``spans`` are balls, each
    halved along the line between two far vectors of it."""
    order, nodes = np.arange(len(x)), spans(len(x))
    middles, radii = np.zeros((len(nodes), x.shape[1])), np.zeros(len(nodes))
    with np.errstate(over="ignore", invalid="ignore"):
        for i, (lo, hi) in enumerate(nodes):
            own = x[order[lo:hi]]
            if not len(own):
                continue
            middles[i] = own.mean(0)
            away = norms(own - middles[i])
            radii[i] = away.max()
            if 2 * i + 2 < len(nodes):
                far = own[away.argmax()]
                along = (own - far) @ (own[norms(own - far).argmax()] - far)
                order[lo:hi] = order[lo:hi][np.argpartition(along, (hi - lo) // 2)] if hi - lo > 1 else order[lo:hi]
    return order, middles, radii


def trees(found: DataFrame) -> DataFrame:
    """(shard, d, wild, n, rows, ids, null_ids, asks, vectors, centres, radii): a
    row a shard of (row, vec_id, asks, d, wild, vector, shard)."""
    schema = "shard string, d int, wild boolean, n int, rows binary, ids binary, null_ids binary, asks binary, vectors binary, centres binary, radii binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            d, wild = t.column(4)[0].as_py(), t.column(5)[0].as_py()
            x = unpacked(t.column(6).to_pylist(), wild, d)
            order, middles, radii = grown(x)
            ids, rows, asks = (t.column(i).combine_chunks() for i in (2, 1, 3))
            arrays = [np.asarray(rows)[order], np.asarray(ids.fill_null(LONGS[1]))[order], ~np.asarray(ids.is_valid())[order], np.asarray(asks)[order], x[order].astype(np.float64 if wild else np.int32), middles, radii]
            columns = [pa.array([v], k) for v, k in zip((t.column(0)[0].as_py(), d, wild, len(x)), (pa.string(), pa.int32(), pa.bool_(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays)], names)

        for b in batches(batches_in):
            shards = b.column(0).to_pylist()
            start = 0
            for i in range(1, len(shards) + 1):
                if i == len(shards) or shards[i] != shards[start]:
                    if held and held[0].column(0)[0].as_py() != shards[start]:
                        yield tree()
                        held = []
                    held.append(b.slice(start, i - start))
                    start = i
        if held:
            yield tree()

    rows = found.select("shard", "row", "vec_id", "asks", "d", "wild", "vector")
    out = keyed_stream(rows, ["shard"], ["row"], run, schema)
    path = scratch_path(found.sparkSession, "trees")
    # Some tens of megabytes a file: the scan holds the rows of a batch at once.
    out.write.option("maxRecordsPerFile", 32).parquet(path)
    return found.sparkSession.read.schema(out.schema).parquet(path)


class Tree:
    """A shard's tree as its task reads it."""

    def __init__(self, shard: str, d: int, wild: bool, n: int, rows: bytes, ids: bytes, null_ids: bytes, asks: bytes, vectors: bytes, middles: bytes, radii: bytes) -> None:
        self.shard, self.wild, self.spans = shard, wild, spans(n)
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.null_ids, self.asks = np.frombuffer(null_ids, bool), np.frombuffer(asks, bool)
        self.x = np.frombuffer(vectors, np.float64 if wild else np.int32).reshape(n, d).astype(np.float64)
        self.radii = np.frombuffer(radii)
        self.middles = np.frombuffer(middles).reshape(len(self.spans), d)

    def search(self, q: np.ndarray, own: np.ndarray, wild: bool, least: np.ndarray, k: int) -> list[list[tuple]]:
        """For each query (numbered ``own``) the at most k best (-score, id is
        null, id, row) that reach ``least``, its k-th score so far."""
        best: list[list[tuple]] = [[] for _ in q]
        least, lengths, seen = least.copy(), norms(q), np.full(len(q), -1)

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore", invalid="ignore"):
                reach = lengths[at] * self.radii[node]
                value = q[at] @ self.middles[node]
                # Roundings are far below this.
                value = value + reach + 1 + 1e-9 * (reach + lengths[at] * norms(self.middles[node : node + 1]))
            return np.where(np.isnan(value), np.inf, value)

        def visit(node: int, at: np.ndarray) -> None:
            lo, hi = self.spans[node]
            if lo == hi or not len(at):
                return
            scores = products(q[at], self.x[lo:hi], wild or self.wild)
            for r in np.nonzero(scores.max(1) >= least[at])[0].tolist():
                i, s = at[r], scores[r]
                if len(s) > 4 * k:  # of one leaf the k best beside the query itself
                    s_least = max(least[i], np.partition(s, -k - 1)[-k - 1])
                else:
                    s_least = least[i]
                for c in (np.nonzero(s >= s_least)[0] + lo).tolist():
                    if self.rows[c] != own[i]:
                        best[i].append((-int(s[c - lo]), bool(self.null_ids[c]), int(self.ids[c]), int(self.rows[c])))
                best[i] = heapq.nsmallest(k, best[i])
                if len(best[i]) == k:
                    least[i] = max(least[i], threshold(-best[i][-1][0]))

        def down(node: int, at: np.ndarray) -> None:
            """Each query to the leaf of its best bounds."""
            while 2 * node + 2 < len(self.spans):
                right = bound(2 * node + 2, at) > bound(2 * node + 1, at)
                if right.any() and not right.all():
                    down(2 * node + 2, at[right])
                    node, at = 2 * node + 1, at[~right]
                else:
                    node = 2 * node + (2 if right.any() else 1)
            seen[at] = node
            visit(node, at)

        down(0, np.arange(len(q)))
        heap = [(0.0, 0, np.arange(len(q)), bound(0, np.arange(len(q))))]
        while heap:
            _, node, at, upper = heapq.heappop(heap)
            at = at[upper >= least[at]]
            if not len(at):
                continue
            if 2 * node + 2 >= len(self.spans):
                visit(node, at[seen[at] != node])
                continue
            for child in (2 * node + 1, 2 * node + 2):
                upper = bound(child, at)
                if (upper >= least[at]).any():
                    heapq.heappush(heap, (-upper.max(), child, at, upper))
        return best


def threshold(score: int) -> float:
    """A double that no score from ``score`` on falls below."""
    return float(score) if abs(score) < 2**53 else float(score) - abs(float(score)) * 1e-12


def products(q: np.ndarray, x: np.ndarray, wild: bool) -> np.ndarray:
    """Inner products: exact doubles, or 64-bit numbers of Python's own."""
    if not wild:
        return q @ x.T
    whole = np.frompyfunc(int, 1, 1)
    out = np.zeros((len(q), len(x)), np.int64)
    if q.shape[1]:
        out[:] = np.clip(whole(q).dot(whole(x).T), *LONGS)
    return out


# Searching -------------------------------------------------------------

FOUND = "q long, vec_id long, row long, score long"


def _hits(queries: list[int], best: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(i, None if none else vec, row, -s) for i, own in zip(queries, best, strict=True) for s, none, vec, row in own]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["q", "vec_id", "row", "score"])


def at_home(built: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, row, score): what the queries of each shard find there."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found):
            for row in range(b.num_rows):
                tree = Tree(*[c[row].as_py() for c in b.columns])
                own = np.nonzero(tree.asks)[0]
                for i in range(0, len(own), 1000):
                    at = own[i : i + 1000]
                    yield _hits(tree.rows[at].tolist(), tree.search(tree.x[at], tree.rows[at], tree.wild, np.full(len(at), -np.inf), k))

    return built.mapInArrow(run, FOUND)


def routed(queries: DataFrame, built: DataFrame) -> DataFrame:
    """(q, shard, upper): the other shards whose ball reaches the k-th score of
    (q, d, wild, home, vector, least)."""
    roots, asked = built.count(), queries.count()
    blocks, salts = max(1, -(-roots // BALLS_A_BLOCK)), max(1, -(-asked // QUERIES_A_TASK))
    first = F.expr("substring(centres, 1, 8 * d)")
    balls = built.select("d", F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int").alias("block"), "shard", first.alias("c"), F.expr("substring(radii, 1, 8)").alias("r"))
    balls = balls.groupBy("d", "block").agg(F.collect_list(F.struct("shard", "c", "r")).alias("balls"))
    none = lambda kind: F.lit(None).cast(kind)
    balls = balls.select("d", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), none("long").alias("q"), none("boolean").alias("wild"), none("string").alias("home"), none("binary").alias("vector"), none("double").alias("least"), F.col("balls.shard").alias("shards"), F.col("balls.c").alias("c"), F.col("balls.r").alias("r"))
    own = queries.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "q", "wild", "home", "vector", "least", none("array<string>").alias("shards"), none("array<binary>").alias("c"), none("array<binary>").alias("r"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shards, middles, radii = None, [], None, None
        for b in batches(found):
            keys = list(zip(*[b.column(i).to_pylist() for i in range(4)], strict=True))
            start = 0
            while start < len(keys):
                end = start + 1
                if keys[start][3] == 0:
                    key, shards = keys[start][:3], b.column(9)[start].as_py()
                    middles = np.stack([np.frombuffer(c, np.float64) for c in b.column(10)[start].as_py()])
                    radii = np.array([np.frombuffer(r, np.float64)[0] for r in b.column(11)[start].as_py()])
                    start = end
                    continue
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                part, start = b.slice(start, end - start), end
                if keys[end - 1][:3] != key:
                    continue  # no ball of this length in the block
                for wild in (False, True):
                    at = np.nonzero(np.asarray(part.column(5)) == wild)[0]
                    if len(at):
                        yield _reached(part.take(pa.array(at)), wild, keys[end - 1][0], shards, middles, radii)

    return keyed_stream(balls.unionByName(own), ["d", "block", "salt"], ["kind"], run, "q long, shard string, upper double")


def _reached(part: pa.RecordBatch, wild: bool, d: int, shards: list[str], middles: np.ndarray, radii: np.ndarray) -> pa.RecordBatch:
    q, least = unpacked(part.column(7).to_pylist(), wild, d), part.column(8).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = norms(q)[:, None]
        upper = q @ middles.T + lengths * radii * (1 + 1e-9) + 1 + 1e-9 * lengths * norms(middles)
    upper = np.where(np.isnan(upper), np.inf, upper)
    home = np.array(part.column(6).to_pylist(), object)[:, None] == np.array(shards, object)[None]
    i, j = np.nonzero((upper >= least[:, None]) & ~home)
    ids = part.column(4).to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array([shards[x] for x in j.tolist()], pa.string()), pa.array(upper[i, j])], ["q", "shard", "upper"])


def elsewhere(visits: DataFrame, queries: DataFrame, built: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, row, score) of written visits (q, shard, least): what reaches
    the k-th score there."""
    salts = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("salts"))
    salts = materialize(salts, "visited")
    none = lambda kind: F.lit(None).cast(kind)
    fields = built.columns[1:]
    one = sized_join(built, salts, ["shard"]).select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none("long").alias("q"), none("boolean").alias("q_wild"), none("binary").alias("vector"), none("double").alias("least"), *fields)
    own = sized_join(visits, salts, ["shard"]).join(queries.select("q", "wild", "vector"), "q")
    own = own.select("shard", F.pmod(F.xxhash64("q"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "q", F.col("wild").alias("q_wild"), "vector", "least", *[none(built.schema[f].dataType).alias(f) for f in fields])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches(found):
            heads = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True))
            start = 0
            while start < len(heads):
                end = start + 1
                if heads[start][2] == 0:
                    tree = Tree(heads[start][0], *[c[start].as_py() for c in b.columns[7:]])
                else:
                    while end < len(heads) and heads[end] == heads[start]:
                        end += 1
                    part, wild = b.slice(start, end - start), heads[start][3]
                    queries = part.column(3).to_numpy()
                    q = unpacked(part.column(5).to_pylist(), wild, tree.x.shape[1])
                    yield _hits(queries.tolist(), tree.search(q, queries, wild, part.column(6).to_numpy().astype(np.float64), k))
                start = end

    return keyed_stream(one.unionByName(own), ["shard", "salt"], ["kind", "q_wild"], run, FOUND)


def kth_scores(found: DataFrame, k: int) -> DataFrame:
    """(q, kth): the k-th of the scores found so far, as a double that no
    equal score falls below; null where there are fewer."""
    rows = found.groupBy("q").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # at most k a shard searched
    score = F.get("s", F.lit(k - 1))
    return rows.select("q", F.when(F.abs(score.cast("double")) < 2.0**53, score.cast("double")).otherwise(score.cast("double") - F.abs(score.cast("double")) * 1e-12).alias("kth"))


def top_k(vectors: DataFrame, asks: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row
    of (vec_id, embedding) for which ``asks`` holds, against all other rows."""
    kind = next(f.dataType.simpleString() for f in vectors.schema if f.name == "embedding")
    rows = pick(vectors, vec_id="long", embedding=kind if kind in ("array<float>", "array<double>") else "array<double>")
    found = materialize(items(rows, asks, fit(rows)), "items")
    per = shard_size(F.col("d"))
    counts = materialize(found.groupBy("d", "wild", "leaf").agg(F.ceil(F.count("*") / F.max(per)).cast("int").alias("pieces")), "leaves")
    dealt = sized_join(found, counts, ["d", "wild", "leaf"])
    shard = F.concat_ws("/", "d", F.col("wild").cast("string"), "leaf", F.pmod(F.xxhash64("row"), F.col("pieces")))
    dealt = dealt.withColumn("shard", shard)
    built = trees(dealt)
    queries = dealt.where("asks").select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "d", "wild", F.col("shard").alias("home"), "vector")
    home = materialize(at_home(built, k), "home")
    queries = materialize(queries.join(kth_scores(home, k), "q", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth"), "queries")
    ways = materialize(routed(queries, built), "ways")
    first = ways.groupBy("q").agg(F.max_by("shard", F.struct("upper", "shard")).alias("shard"))
    visits = materialize(first.join(queries.select("q", "least"), "q"), "visits")
    nearest_hits = materialize(elsewhere(visits, queries, built, k), "first")
    better = queries.select("q", "least").join(kth_scores(home.unionByName(nearest_hits), k), "q", "left")
    better = better.select("q", F.greatest("least", F.coalesce("kth", F.lit(float("-inf")))).alias("least"))
    left = ways.join(first.withColumnRenamed("shard", "_first"), "q").where("shard <> _first").join(better, "q")
    visits = materialize(left.where("upper >= least").select("q", "shard", "least"), "visits")
    rest_hits = elsewhere(visits, queries, built, k)
    hits = home.unionByName(nearest_hits).unionByName(rest_hits)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", "score")


def oracle_sql() -> str:
    return """
        with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as x from embeddings
                where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
            scores as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score, c.r as cr
                from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r and len(q.x) = len(c.x))
        select query_id, (row_number() over (partition by r order by score desc, vec_id nulls last, cr))::int as rank, vec_id, score
        from scores qualify row_number() over (partition by r order by score desc, vec_id nulls last, cr) <= 5
    """
