"""Pre-aggregation of a stream with buffers that flush by size and by time.

Rows go to ``parts`` buffers by a hash of their key. A buffer is a stateful
operator's state: sums by key that wait, and a small count-min sketch of the keys
seen of late. A key that the sketch thinks hot waits in the buffer, where its
sums add up; the others are given on at once, added up by micro-batch. A buffer
lets all its sums go when it has taken ``most_rows`` rows or holds ``most_keys``
keys, and when nothing has come for ``after`` milliseconds of processing time.
Counts in the sketch are halved each time it has seen ``roll`` rows, so what is hot
may change.

What comes out are partial sums: keys repeat, and adding them up by key gives the
sums of all rows that have left the buffers. State and output are exactly what
Spark's checkpoint makes of them: a restarted query goes on from both. Nulls in the
value add nothing; a null key is a key.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mergeloom.operators.sketches.states import linear
from mergeloom.session import ship

DEPTH, WIDTH, SEED = 4, 512, 5


@dataclass
class Buffer:
    """The state of one part."""

    most_rows: int
    most_keys: int
    share: float
    roll: int
    sums: dict[str | None, int] = field(default_factory=dict)
    rows: int = 0
    seen: int = 0
    cells: np.ndarray = field(default_factory=lambda: np.zeros((DEPTH, WIDTH), np.int64))

    def take(self, rows: Iterable[tuple[str | None, int, int]]) -> Iterator[tuple[str | None, int, str]]:
        """(key, hash, value) of a micro-batch; what leaves the buffer comes out
        with the reason."""
        added: dict[str | None, list[int]] = {}
        for key, h, value in rows:
            own = added.setdefault(key, [h, 0, 0])
            own[1] += 1
            own[2] += value
        if not added:
            return
        hot = self._counted(np.array([a[0] for a in added.values()], np.int64), np.array([a[1] for a in added.values()], np.int64))
        for (key, (_, n, value)), waits in zip(added.items(), hot.tolist(), strict=True):
            if waits or key in self.sums:
                self.sums[key] = self.sums.get(key, 0) + value
                self.rows += n
            else:
                yield key, value, "cold"
        if self.rows >= self.most_rows or len(self.sums) > self.most_keys:
            yield from self.drained("size")

    def _counted(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Counts the keys; is each at least ``share`` of what was seen?"""
        places = linear(hashes, DEPTH, WIDTH, SEED)
        for row, at in enumerate(places):
            np.add.at(self.cells[row], at, n)
        self.seen += int(n.sum())
        hot = np.min([self.cells[row][at] for row, at in enumerate(places)], axis=0) >= self.share * self.seen
        while self.seen >= self.roll:
            self.cells //= 2
            self.seen //= 2
        return hot

    def drained(self, why: str) -> list[tuple[str | None, int, str]]:
        out = [(k, v, why) for k, v in self.sums.items()]
        self.sums, self.rows = {}, 0
        return out

    def state(self) -> tuple:
        return list(self.sums), list(self.sums.values()), self.rows, self.seen, self.cells.astype("<i8").tobytes()

    def restore(self, keys: list[str | None], sums: list[int], rows: int, seen: int, cells: bytes) -> Buffer:
        self.sums, self.rows, self.seen = dict(zip(list(keys), [int(s) for s in sums], strict=True)), int(rows), int(seen)
        self.cells = np.frombuffer(bytes(cells), "<i8").reshape(DEPTH, WIDTH).astype(np.int64)
        return self


def timed_sums(stream: DataFrame, key: str, value: str, most_rows: int, after: int, parts: int = 64, most_keys: int = 10_000, share: float = 0.01, roll: int = 1_000_000) -> DataFrame:
    """(key, value, flushed): partial sums as they leave the buffers, ``flushed``
    being ``size``, ``time`` or ``cold``. For output mode append."""
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.col(key).cast("string").alias("k"), F.xxhash64(key).alias("h"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"))

    def update(part: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        buffer = Buffer(most_rows, most_keys, share, roll)
        if state.exists:
            buffer.restore(*state.get)
        if state.hasTimedOut:
            out = buffer.drained("time")
            state.remove()
        else:
            out = []
            for f in frames:
                keys = [None if k is None or k != k else k for k in f["k"].tolist()]
                out += buffer.take(zip(keys, f["h"].tolist(), f["v"].tolist(), strict=True))
            state.update(buffer.state())
            state.setTimeoutDuration(after)
        yield pd.DataFrame({"k": pd.Series([o[0] for o in out], dtype=object), "v": pd.Series([o[1] for o in out], dtype="int64"), "flushed": pd.Series([o[2] for o in out], dtype=object)})

    held = "keys array<string>, sums array<long>, rows long, seen long, cells binary"
    out = rows.groupBy("part").applyInPandasWithState(update, "k string, v long, flushed string", held, "append", "ProcessingTimeTimeout")
    return out.select(F.col("k").cast(kind).alias(key), F.col("v").alias(value), "flushed")


def start(sums: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Partial sums to Parquet files. The trigger is how often timers are looked at."""
    return sums.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def _wait(query: StreamingQuery, done: Callable[[dict], bool], most_seconds: float, what: str) -> None:
    """Timers keep such a query in micro-batches, so it is never idle: what the
    last of them did says how far it is."""
    until = time.monotonic() + most_seconds
    while not ((last := query.lastProgress) and done(last)):
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() > until:
            raise TimeoutError(what)
        time.sleep(0.1)


def read_all(query: StreamingQuery, most_seconds: float = 600) -> None:
    """Wait until a micro-batch found nothing new."""
    _wait(query, lambda last: last["numInputRows"] == 0, most_seconds, "there is still more to read")


def drain(query: StreamingQuery, most_seconds: float = 600) -> None:
    """Wait until all there is has been read and every buffer has let go, then
    stop. Raises if buffers still hold sums after ``most_seconds``."""
    try:
        _wait(query, lambda last: last["numInputRows"] == 0 and last["stateOperators"] and last["stateOperators"][0]["numRowsTotal"] == 0, most_seconds, "buffers still hold sums")
    finally:
        query.stop()
