"""Keyed pre-aggregation of streams.

A flush is a micro-batch: each batch's buffers are written once under the
batch's number, so a repeated batch overwrites itself, and readers merge all
buffers. Partial sums may repeat keys; merging makes that invisible.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mergeloom.operators import monoid
from mergeloom.operators.sketches.exphist import ExpHist
from mergeloom.plans import spec
from mergeloom.plans.spec import Agg
from mergeloom.session import ship


def buffered(stream: DataFrame, aggs: Mapping[str, Agg], by: Sequence[str], path: str, checkpoint: str, trigger: Mapping[str, Any] | None = None):
    """Start a query that flushes buffers of ``aggs`` by key to ``path``. The
    trigger is the flush frequency (default: all there is, then stop)."""

    def flush(batch: DataFrame, number: int) -> None:
        spec.buffers(batch, aggs, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, aggs: Mapping[str, Agg], by: Sequence[str], path: str) -> DataFrame:
    """The results over all buffers flushed so far."""
    stored = spark.read.parquet(path).drop("batch")
    return spec.present_buffers(spec.merge(stored, aggs, by), aggs, by)


def sum_by_key(stream: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A streaming running sum by key, for output modes update or complete."""
    return stream.groupBy(*key).agg(F.sum(value).alias(value))


def windowed(stream: DataFrame, time: str, late: str, length: str, aggs: Mapping[str, Agg], by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Aggregations by key and event-time window; rows that come more than
    ``late`` after newer ones are dropped with their window."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(*[a.column().alias(n) for n, a in aggs.items()])


def sessions(stream: DataFrame, time: str, late: str, gap: str, aggs: Mapping[str, Agg], by: Sequence[str]) -> DataFrame:
    """The same by sessions that end after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(*[a.column().alias(n) for n, a in aggs.items()])


def null_summer(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """No pre-aggregation: rows pass through."""
    return df.select(*key, value)


def summing_queue(df: DataFrame, key: Sequence[str], value: str, capacity: int, schema: str) -> DataFrame:
    """Each task adds up by key, for ``capacity`` keys at most, before it lets
    sums go; a final sum by key is the same as without. Nulls do not count,
    whole numbers stay exact."""
    added = monoid.of_reduce(operator.add)
    sums = monoid.partials(df, added, [value], key, capacity)
    own = StructType.fromDDL(schema)
    return monoid.present(sums, added, f"{value} {own[value].dataType.simpleString()}", key).select(*own.names)


def salted_sum_by_key(df: DataFrame, key: Sequence[str], value: str, salts: int = 64) -> DataFrame:
    """Sums in two stages, by key and salt, then by key: for values whose sums
    no map-side aggregate can pre-combine well because hot keys dominate."""
    salted = df.select(*key, value, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt"))
    return salted.groupBy(*key, "_salt").agg(F.sum(value).alias(value)).groupBy(*key).agg(F.sum(value).alias(value))


def hot_keys(df: DataFrame, key: str, share: float, depth: int = 4, width: int = 1000) -> DataFrame:
    """(key, estimate): keys with at least that share of rows, by a count-min
    sketch: those that deserve a buffer of their own."""
    from mergeloom.operators.sketches import cms

    return cms.top_pct(df, key, depth, width, share)


def route(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``df`` with ``hot``: does the row's key deserve a buffer?"""
    marked = hot.select(F.col(key).alias("_k"), F.lit(True).alias("_hot"))
    return df.join(marked, F.col(key) == F.col("_k"), "left").withColumn("hot", F.coalesce("_hot", F.lit(False))).drop("_k", "_hot")


def prefix_sums(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Each row with the sum before it, as in a chain where each learns what
    came before."""
    from mergeloom.operators import scan

    return df.withColumn("before", scan.exclusive_sum(value, scan.ordered(order, by)))


def exp_hist_stream(stream: DataFrame, key: str, time: str, n: str, epsilon: float, window: int, key_type: str = "string") -> DataFrame:
    """(key, time, guess, low, high) after each micro-batch of a key, from a
    bounded exponential histogram as state. ``time`` is a whole number; rows
    are sorted within a batch, and time never goes back."""
    ship(stream.sparkSession)
    stream = stream.withColumn(n, F.coalesce(n, F.lit(0)))  # beside a null, numbers would become doubles

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        hist = ExpHist.of_state(epsilon, window, *state.get) if state.exists else ExpHist(epsilon, window)
        counts: dict[int, int] = {}
        for frame in frames:  # one at a time: only the batch's distinct times are held
            for t, count in frame.groupby(time)[n].sum().items():
                counts[int(t)] = counts.get(int(t), 0) + int(count)
        hist = hist.add_all([(counts[t], t) for t in sorted(counts)])
        state.update(hist.state())
        low, high = hist.bounds()
        yield pd.DataFrame([(k[0], hist.time, hist.guess(), low, high)], columns=[key, "time", "guess", "low", "high"])

    out = f"{key} {key_type}, time long, guess double, low long, high long"
    held = "number array<long>, times array<long>, counts array<long>, now long"
    return stream.groupBy(key).applyInPandasWithState(update, out, held, "update", "NoTimeout")


def counted_calls(df: DataFrame, name: str, *aggs: Column) -> tuple[DataFrame, Any]:
    """The rows under observation: counts or any aggregates of what passes."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("calls"), *aggs), seen
