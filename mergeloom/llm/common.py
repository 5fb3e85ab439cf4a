"""Helpers that all training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mergeloom.session import ship

#: A word, wherever words are counted: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Where nothing has set one, a fresh temporary folder in local
    mode; on a cluster, whose machines share no such folder, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = f"file://{tempfile.mkdtemp(prefix='mergeloom-')}"
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mergeloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths that ``materialize`` writes meanwhile, for
    ``remove`` once nothing reads them any more."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)


def remove(spark: SparkSession, paths: list[str], which: Callable[[str], bool] = lambda path: True) -> None:
    """Delete those of the folders, and take them from the list."""
    for path in [p for p in paths if which(p)]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        paths.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it
    again. Survives lost executors. The folder can go with the application, or
    earlier through ``scratch_scope``."""
    path = scratch_path(df.sparkSession, name)
    for paths in _scopes:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one bitmap covers (as a power of two; an eighth of that in bytes),
#: and the bitmaps that are broadcast at once: 128 MB.
COVERED_BITS, MOST_BITMAPS = 15, 1 << 15


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, each row with a number ``_row`` of its own."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), name)


def by_number(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of a ``numbered`` table whose numbers are among the column
    ``_row`` of ``marked``. The table is filtered where it lies: it does not
    shuffle, whatever its size.

    The marked numbers become bitmaps of 2^``COVERED_BITS`` rows each. At most
    ``MOST_BITMAPS`` of them, a proven 128 MB, are broadcast for one range of
    numbers; the next range of the table, which Parquet's statistics tell apart,
    gets a broadcast of its own. Ranges end between the tasks that wrote the
    table; the driver holds a row a task."""
    number, places = F.col("_row"), 33 - COVERED_BITS  # bits of a place within a task
    place = F.shiftright(number, COVERED_BITS)
    at = number.bitwiseAND((1 << COVERED_BITS) - 1)
    maps = materialize(marked.groupBy(place.alias("_place")).agg(F.bitmap_construct_agg(at).alias("_bits")), "bitmaps")
    by_task = maps.groupBy(F.shiftright("_place", places).alias("task")).agg(F.count("*").alias("n"), F.max("_place").alias("high")).collect()
    cuts, held = [0], 0
    for task, n, high in sorted(map(tuple, by_task)):
        if held and held + n > MOST_BITMAPS:
            cuts.append(task << places)
            held = 0
        if n > MOST_BITMAPS:  # a task's places are consecutive
            cuts += range((task << places) + MOST_BITMAPS, high + 1, MOST_BITMAPS)
            n = high + 1 - cuts[-1]
        held += n
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    out = None
    for low, high in zip(cuts, [*cuts[1:], None], strict=True):
        own, ones = rows, maps
        if low:
            own, ones = own.where(number >= low << COVERED_BITS), ones.where(F.col("_place") >= low)
        if high is not None:
            own, ones = own.where(number < high << COVERED_BITS), ones.where(F.col("_place") < high)
        found = own.join(F.broadcast(ones), place == F.col("_place")).where(hit).select(*rows.columns)
        out = found if out is None else out.union(found)
    return out


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast. Names match exactly, the first of equal
    names counts, so other columns may bear any names, also in other case."""
    ship(df.sparkSession)
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_c{names.index(n)}").cast(t).alias(n) for n, t in types.items()])


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, by way of Arrow: rows of Python objects
    would start Python workers of their own on the executors, which stay."""
    kind = StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in kind]
    made = to_arrow_schema(kind)
    arrays = [pa.array(list(x), f.type) for x, f in zip(columns, made, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=made), kind)


def sized_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = 50_000, salts: int = 64,
    weight: Column | None = None, most_bytes: int = 64 << 20,
) -> DataFrame:
    """Join ``big`` with a per-group table ``small`` (unique, null-safe keys).

    ``small`` must be materialized: its rows are counted first, and the bytes of
    what may be long in them, ``weight``, added up. Up to ``limit`` rows and
    ``most_bytes`` it is broadcast. Beyond that both sides are salted, so that a key with
    a third of all rows is dealt over ``salts`` tasks."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    cond = lambda l, r: [F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    left = big.select("*", *[F.col(k).alias(f"_l_{k}") for k in keys])
    right = small.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    counted = small.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()
    if counted[0] <= limit and counted[1] <= most_bytes:
        out = left.join(F.broadcast(right), cond(left, right), how)
    else:
        # By what the row says, so that a task that runs again deals its rows alike.
        own = [F.col(f"`{f.name}`") for f in big.schema if "map<" not in f.dataType.simpleString()]
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
        right = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = left.join(right, [F.col("_salt") == F.col("_rsalt"), *cond(left, right)], how).drop("_salt", "_rsalt")
    return out.drop(*[f"_l_{k}" for k in keys], *[f"_r_{k}" for k in keys])


def keyed_stream(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the rows as Arrow batches, those of a key in one task, one
    key after the other, each in ``order``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def flattened(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """All columns under position names ``_c0``, ``_c1`` ..., the own names, and
    for each own name the position name of its first bearer."""
    ship(docs.sparkSession)
    names = docs.columns
    return docs.toDF(*[f"_c{i}" for i in range(len(names))]), names, {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: What ``worker_cache`` made in this process.
_caches: list[Callable] = []


def worker_cache(make: Callable) -> Callable:
    """``functools.cache`` for what an operator's tasks share in a worker. It is
    cleared when a task of another operator begins there (``batches``)."""
    kept = cache(make)
    _caches.append(kept)
    return kept


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold unused:
    workers live on idle beside the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def batches(rows: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20, keep: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes``, so that long texts do
    not pile up in a worker. Caches of the worker but ``keep`` go first; at the
    end unused memory does."""
    for kept in _caches:
        if kept is not keep:
            kept.cache_clear()
    for batch in rows:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    give_back()
