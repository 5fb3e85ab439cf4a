"""Reading tables, and storing buffers that are merged later."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.plans import spec
from mergeloom.plans.spec import Agg


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(time: str) -> Column:
    """A TIMESTAMP or TIMESTAMP_NTZ column as seconds, a double."""
    return F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)


def stream(spark: SparkSession, folder: str, name: str, files_a_batch: int | None = None) -> DataFrame:
    """The table's files as a stream."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's name under ``spark.checkpoint.dir``, or the folder that
    ``setCheckpointDir`` was given. Where the session has neither, under a temporary
    folder in local mode; on a cluster, whose machines share no such folder, an
    error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='mergeloom-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written there and read again: a lineage of one step, which
    survives lost executors."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str], path: str, mode: str = "append") -> None:
    """Write the buffers of ``aggs`` by key."""
    spec.buffers(df, aggs, by).write.mode(mode).parquet(path)


def load(spark: SparkSession, aggs: Mapping[str, Agg], by: Sequence[str], path: str) -> DataFrame:
    """The results of all buffers stored in ``path``, merged by coarser keys."""
    return spec.present_buffers(spec.merge(spark.read.parquet(path), aggs, by), aggs, by)


def union_all(*frames: DataFrame) -> DataFrame:
    """The monoid of tables: rows of all, none of them merged."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def is_nonzero(df: DataFrame) -> bool:
    return not df.isEmpty()
