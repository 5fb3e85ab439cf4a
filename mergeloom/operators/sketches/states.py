"""Sketches as one binary value a group: exact while small, then registers or
cells, stored anywhere and merged as they are.

A state holds what it counts exactly until that is more than ``most`` items and
turns into the sketch's registers or cells then, by the hashes that the relations
of ``hll`` and ``cms`` use: it gives the same registers and cells as those, and
either becomes the other. Exact and full states merge with each other. States are
``monoid`` states: built in every task, shuffled as bytes, merged by key.

The bytes are a tag of four letters, the parameters as little-endian 32-bit
numbers, and arrays of little-endian numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions import hashing
from mergeloom.operators import monoid
from mergeloom.operators.monoid import Monoid
from mergeloom.operators.sketches import bloom, cms, hll
from mergeloom.plans.spec import null_safe


def _head(tag: bytes, *numbers: int) -> bytes:
    return tag + struct.pack(f"<{len(numbers)}i", *numbers)


def _opened(data: bytes, tag: bytes, n: int) -> tuple[tuple[int, ...], bytes]:
    if data[:4] != tag:
        raise ValueError(f"these bytes are no {tag.decode()} state")
    return struct.unpack(f"<{n}i", data[4 : 4 + 4 * n]), data[4 + 4 * n :]


# Sets (HyperLogLog) ---------------------------------------------------------


class SetState:
    """Distinct 64-bit hashes, or registers of their first half's remainder."""

    TAG = b"MSET"

    def __init__(self, bits: int, most: int, hashes: set[int] | None = None, registers: np.ndarray | None = None) -> None:
        self.bits, self.most, self.hashes, self.registers = bits, most, hashes if hashes is not None or registers is not None else set(), registers

    def add(self, h: int | None) -> SetState:
        if h is None:
            return self
        if self.hashes is None:
            self._put([h])
        else:
            self.hashes.add(h)
            self._bounded()
        return self

    def add_all(self, column: pa.Array) -> SetState:
        hashes = column.drop_null().to_numpy()
        if self.hashes is None:
            self._put(hashes)
        else:
            self.hashes.update(np.unique(hashes).tolist())
            self._bounded()
        return self

    def _bounded(self) -> None:
        if len(self.hashes) > self.most:
            hashes, self.hashes, self.registers = self.hashes, None, np.zeros(2**self.bits, np.uint8)
            self._put(list(hashes))

    def _put(self, hashes: list[int]) -> None:
        h = np.array(hashes, np.int64).view(np.uint64)
        place, rest = (h >> np.uint64(32)) % np.uint64(2**self.bits), h & np.uint64(2**32 - 1)
        # The place of the first 1 among 32 bits; of none, 33. Doubles hold 32 bits exactly.
        rho = np.where(rest == 0, 33, 33 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint8)
        np.maximum.at(self.registers, place.astype(np.int64), rho)

    def __add__(self, other: SetState) -> SetState:
        if self.hashes is None and other.hashes is None:
            self.registers = np.maximum(self.registers, other.registers)
            return self
        full, small = (self, other) if self.hashes is None else (other, self)
        if full.hashes is None:
            if small.hashes:
                full._put(list(small.hashes))
            return full
        full.hashes |= small.hashes
        full._bounded()
        return full

    def size(self) -> tuple[float, bool]:
        """(number of distinct items, is it exact?)."""
        if self.hashes is not None:
            return float(len(self.hashes)), True
        m, filled = float(2**self.bits), self.registers[self.registers > 0]
        empty = m - len(filled)
        raw = hll.alpha(self.bits) * m * m / (float((2.0 ** -filled.astype(float)).sum()) + empty)
        return (m * float(np.log(m / empty)) if raw <= 2.5 * m and empty else raw), False

    def rows(self) -> list[tuple]:
        """(j, rho) of what is set, whatever the state's form."""
        full = self if self.hashes is None else SetState(self.bits, -1, set(self.hashes))
        if full.hashes is not None:
            full._bounded()
        return [(int(j), int(full.registers[j])) for j in np.nonzero(full.registers)[0]]

    def dumps(self) -> bytes:
        exact = self.hashes is not None
        body = np.array(sorted(self.hashes), "<i8").tobytes() if exact else self.registers.tobytes()
        return _head(self.TAG, self.bits, self.most, int(exact)) + body

    @classmethod
    def loads(cls, data: bytes) -> SetState:
        (bits, most, exact), body = _opened(data, cls.TAG, 3)
        return cls(bits, most, set(np.frombuffer(body, "<i8").tolist())) if exact else cls(bits, most, None, np.frombuffer(body, np.uint8).copy())


def set_monoid(bits: int, most: int, present: Any = lambda s: s.size()) -> Monoid:
    return Monoid(lambda h: SetState(bits, most).add(h), lambda a, b: a + b, present, lambda: SetState(bits, most), lambda s, h: s.add(h), bulk=lambda s, c: (s or SetState(bits, most)).add_all(c[0]), dumps=SetState.dumps, loads=SetState.loads)


def set_hash(*keys: str) -> Column:
    """The 64 bits that ``hll.registers`` reads; null where a key is."""
    d = hashing.digest(hll.SEED, *keys)
    return F.when(hashing.known(*keys), F.shiftleft(hashing.hex32(d, 0), 32).bitwiseOR(hashing.hex32(d, 1)))


def sets(df: DataFrame, x: str | Sequence[str], bits: int, most: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """(by, _state): the distinct items of each group."""
    m = set_monoid(bits, most)
    rows = df.select(*by, set_hash(*([x] if isinstance(x, str) else x)).alias("_h"))
    return monoid.merge(monoid.partials(rows, m, ["_h"], by), m, by)


def merge_sets(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return monoid.merge(stored, set_monoid(0, 0), by)


def set_sizes(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, size, exact)."""
    return monoid.present(stored, set_monoid(0, 0), "size double, exact boolean", by)


def registers(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, j, rho): the relation that ``hll`` works on."""
    rows = monoid.present(stored, set_monoid(0, 0, lambda s: (s.rows(),)), "r array<struct<j:int,rho:int>>", by)
    return rows.select(*by, F.inline("r"))


def of_registers(relation: DataFrame, bits: int, by: Sequence[str] = ()) -> DataFrame:
    """Such a relation as states."""

    def made(j: int, rho: int) -> SetState:
        s = SetState(bits, -1, None, np.zeros(2**bits, np.uint8))
        s.registers[j] = rho
        return s

    def put(s: SetState, j: int, rho: int) -> SetState:
        s.registers[j] = max(s.registers[j], rho)
        return s

    m = Monoid(made, lambda a, b: a + b, append=put, dumps=SetState.dumps, loads=SetState.loads)
    return monoid.merge(monoid.partials(relation, m, ["j", "rho"], by, held=500), m, by)


# Counts (count-min) ------------------------------------------------------------


class CountState:
    """Counts by 64-bit key, or the cells of the linear family."""

    TAG = b"MCNT"

    def __init__(self, depth: int, width: int, seed: int, most: int, counts: dict[int, int] | None = None, cells: np.ndarray | None = None) -> None:
        self.depth, self.width, self.seed, self.most = depth, width, seed, most
        self.counts, self.cells = counts if counts is not None or cells is not None else {}, cells

    def add(self, key: int | None, n: int = 1) -> CountState:
        if key is None or n is None:
            return self
        if self.counts is None:
            self._put([key], [n])
        else:
            self.counts[key] = self.counts.get(key, 0) + n
            self._bounded()
        return self

    def add_all(self, key: pa.Array, n: pa.Array | None) -> CountState:
        known = np.asarray(key.is_valid()) if n is None else np.asarray(key.is_valid()) & np.asarray(n.is_valid())
        keys, own = np.unique(key.fill_null(0).to_numpy()[known], return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, own, 1 if n is None else n.fill_null(0).to_numpy()[known])
        if self.counts is None:
            self._put(keys, sums)
        else:
            for k, v in zip(keys.tolist(), sums.tolist(), strict=True):
                self.counts[k] = self.counts.get(k, 0) + v
            self._bounded()
        return self

    def _bounded(self) -> None:
        if len(self.counts) > self.most:
            counts, self.counts, self.cells = self.counts, None, np.zeros((self.depth, self.width), np.int64)
            self._put(list(counts), list(counts.values()))

    def _put(self, keys: list[int], n: list[int]) -> None:
        for row, at in enumerate(linear(np.array(keys, np.int64), self.depth, self.width, self.seed)):
            np.add.at(self.cells[row], at, np.array(n, np.int64))

    def __add__(self, other: CountState) -> CountState:
        if self.counts is None and other.counts is None:
            self.cells = self.cells + other.cells
            return self
        full, small = (self, other) if self.counts is None else (other, self)
        if full.counts is None:
            if small.counts:
                full._put(list(small.counts), list(small.counts.values()))
            return full
        for key, n in small.counts.items():
            full.counts[key] = full.counts.get(key, 0) + n
        full._bounded()
        return full

    def total(self) -> int:
        return sum(self.counts.values()) if self.counts is not None else int(self.cells[0].sum())

    def rows(self) -> list[tuple]:
        """(key, null, null, n) while exact, (null, row, col, n) beyond."""
        if self.counts is not None:
            return [(k, None, None, n) for k, n in self.counts.items()]
        return [(None, int(r), int(c), int(self.cells[r, c])) for r, c in zip(*np.nonzero(self.cells), strict=True)]

    def dumps(self) -> bytes:
        exact = self.counts is not None
        body = np.array([*self.counts, *self.counts.values()], "<i8") if exact else self.cells.astype("<i8")
        return _head(self.TAG, self.depth, self.width, self.seed, self.most, int(exact)) + body.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> CountState:
        (depth, width, seed, most, exact), body = _opened(data, cls.TAG, 5)
        values = np.frombuffer(body, "<i8")
        if exact:
            half = len(values) // 2
            return cls(depth, width, seed, most, dict(zip(values[:half].tolist(), values[half:].tolist(), strict=True)))
        return cls(depth, width, seed, most, None, values.reshape(depth, width).copy())


def linear(keys: np.ndarray, rows: int, width: int, seed: int) -> list[np.ndarray]:
    """``hashing.linear_rows`` for an array of 64-bit numbers."""
    mask = (1 << hashing.PIECE) - 1
    low, mid, high = keys & mask, keys >> hashing.PIECE & mask, keys >> 2 * hashing.PIECE & 15
    return [(low * a + mid * b + high * c + d) % hashing.PRIME % width for a, b, c, d in (hashing.coefficients(seed, r) for r in range(rows))]


def count_monoid(depth: int, width: int, most: int, seed: int = cms.SEED, present: Any = lambda s: (s.total(), s.counts is not None)) -> Monoid:
    return Monoid(lambda k, n=1: CountState(depth, width, seed, most).add(k, n), lambda a, b: a + b, present, lambda: CountState(depth, width, seed, most), lambda s, k, n=1: s.add(k, n), bulk=lambda s, c: (s or CountState(depth, width, seed, most)).add_all(*c, *[None] * (2 - len(c))), dumps=CountState.dumps, loads=CountState.loads)


def counts(df: DataFrame, x: str, depth: int, width: int, most: int = 100, by: Sequence[str] = (), n: Column | None = None, seed: int = cms.SEED, family: str = "md5") -> DataFrame:
    """(by, _state): the counts (or sums of ``n``) of each group's items."""
    m = count_monoid(depth, width, most, seed)
    key = hashing.fingerprint(x, df.schema[x].dataType, family)
    rows = df.select(*by, key.alias("_k"), *([] if n is None else [n.cast("long").alias("_n")]))
    return monoid.merge(monoid.partials(rows, m, ["_k"] if n is None else ["_k", "_n"], by), m, by)


def merge_counts(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return monoid.merge(stored, count_monoid(0, 0, 0), by)


def totals(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, total, exact)."""
    return monoid.present(stored, count_monoid(0, 0, 0), "total long, exact boolean", by)


def count_rows(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, row, col, n): exact counts by key, or the cells that ``cms``
    works on."""
    rows = monoid.present(stored, count_monoid(0, 0, 0, present=lambda s: (s.rows(),)), "r array<struct<key:long,row:int,col:int,n:long>>", by)
    return rows.select(*by, F.inline("r"))


def frequency(stored: DataFrame, items: DataFrame, x: str, depth: int, width: int, by: Sequence[str] = (), seed: int = cms.SEED, family: str = "md5") -> DataFrame:
    """(by, x, estimate, exact) for each distinct row of ``items`` (by, x): the
    count itself in groups that are still exact, the least cell in others."""
    rows, keys = count_rows(stored, by), [f"_b{i}" for i in range(len(by))]
    asked = items.where(F.col(x).isNotNull()).select(*by, x).distinct()
    asked = asked.withColumn("_key", hashing.fingerprint(x, items.schema[x].dataType, family))
    rename = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    exact = totals(stored, by).where("exact").select(*rename, F.lit(True).alias("_exact"))
    marked = asked.join(exact, null_safe(by, keys), "left").drop(*keys) if by else asked.crossJoin(F.broadcast(totals(stored).select(F.col("exact").alias("_exact"))))
    known = rows.where("key is not null").select(*rename, F.col("key").alias("_k"), "n")
    own = marked.where("_exact").join(known, null_safe([*by, "_key"], [*keys, "_k"]), "left")
    own = own.select(*by, x, F.coalesce("n", F.lit(0)).alias("estimate"), F.lit(True).alias("exact"))
    rest = marked.where("_exact is null or not _exact").select(*by, x)
    cells = rows.where("row is not null").select(*by, "row", "col", "n")
    return own.unionByName(cms.frequency(cells, rest, x, depth, width, by, seed, family).withColumn("exact", F.lit(False)))


# Bit sets (Bloom) --------------------------------------------------------------


class BitState:
    """A Bloom filter's bits, eight a byte."""

    TAG = b"MBIT"

    def __init__(self, width: int, bits: np.ndarray | None = None) -> None:
        self.width, self.bits = width, bits if bits is not None else np.zeros(-(-width // 8), np.uint8)

    def add(self, places: list[int] | None) -> BitState:
        for p in places or ():
            self.bits[p >> 3] |= 1 << (p & 7)
        return self

    def __add__(self, other: BitState) -> BitState:
        if self.width != other.width:
            raise ValueError("filters of different widths do not merge")
        self.bits = self.bits | other.bits
        return self

    def rows(self) -> list[int]:
        return np.nonzero(np.unpackbits(self.bits, bitorder="little"))[0].tolist()

    def dumps(self) -> bytes:
        return _head(self.TAG, self.width) + self.bits.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> BitState:
        (width,), body = _opened(data, cls.TAG, 1)
        return cls(width, np.frombuffer(body, np.uint8).copy())


def bit_monoid(width: int) -> Monoid:
    return Monoid(lambda p: BitState(width).add(p), lambda a, b: a + b, lambda s: (s.rows(),), lambda: BitState(width), lambda s, p: s.add(p), dumps=BitState.dumps, loads=BitState.loads)


def filters(df: DataFrame, x: str, hashes: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, _state): the Bloom filter of each group's items."""
    m = bit_monoid(width)
    rows = df.where(F.col(x).isNotNull()).select(*by, bloom.bits_of(x, hashes, width).alias("_p"))
    return monoid.merge(monoid.partials(rows, m, ["_p"], by, held=500), m, by)


def merge_filters(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return monoid.merge(stored, bit_monoid(0), by)


def bits(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, bit): the relation that ``bloom`` works on."""
    rows = monoid.present(stored, bit_monoid(0), "p array<long>", by)
    return rows.select(*by, F.explode("p").alias("bit"))


# Bounded counters (space saver) --------------------------------------------------


def pack_saver(saver: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, _state): the counters (item, low, n, high, guaranteed) of
    ``ordered.space_saver``, at most as many as its capacity, as one binary value
    of JSON after the tag: each counter's numbers and item, largest first."""
    item = F.struct(F.col("n"), F.col("low"), F.col("item").cast("string").alias("item"))
    grouped = saver.groupBy(*by) if by else saver.groupBy()
    held = grouped.agg(F.sort_array(F.collect_list(item), False).alias("c"))
    return held.select(*by, F.encode(F.concat(F.lit("MSAV"), F.to_json("c")), "UTF-8").alias("_state"))


def unpack_saver(stored: DataFrame, by: Sequence[str] = (), item_type: str = "string") -> DataFrame:
    """Such values as counters again."""
    text = F.decode("_state", "UTF-8")
    checked = F.when(F.substring(text, 1, 4) == "MSAV", F.substring(text, 5, 2**31 - 1)).otherwise(F.raise_error(F.lit("these bytes are no MSAV state")))
    rows = stored.select(*by, F.inline(F.from_json(checked, "array<struct<n:long,low:long,item:string>>")))
    return rows.select(*by, F.col("item").cast(item_type).alias("item"), "low", "n", F.col("n").alias("high"), (F.col("low") == F.col("n")).alias("guaranteed"))
