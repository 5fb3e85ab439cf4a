"""Hash families for sketches, from md5 (exact in any engine) or xxhash64.

``linear`` is the family for counting: an item is one 64-bit number (a whole number
is its own, ``fingerprint`` makes one of anything else), hashed once however many
rows a sketch has, and each row is a linear function of it modulo a prime. It is
plain 64-bit arithmetic, the same in any engine.

``slice32(i, seed, key)`` is the i-th of four 32-bit numbers of one digest.
Keys are hashed by their text; pass whole numbers, strings or binary.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType


def text_key(*keys: Column | str) -> Column:
    return F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])


def known(*keys: Column | str) -> Column:
    """All keys are there: plain null checks, which reach the scan."""
    checks = [(F.col(k) if isinstance(k, str) else k).isNotNull() for k in keys]
    return _and(checks)


def _and(checks: list[Column]) -> Column:
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def digest(seed: int | Column, *keys: Column | str) -> Column:
    """The md5 of "seed:key", as 32 hex digits."""
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws(":", s, text_key(*keys)))


def hex32(digest: Column, i: int) -> Column:
    """The i-th eight digits of a digest as a number in [0, 2^32). Never null, so
    that no filter of a join repeats the hash."""
    return F.coalesce(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(0).cast("long"))


def slice32(i: int, seed: int | Column, *keys: Column | str) -> Column:
    return hex32(digest(seed, *keys), i)


def fast64(seed: int, *keys: Column | str) -> Column:
    """xxHash64 of typed values: faster, but not the same in other engines."""
    return F.xxhash64(F.lit(seed), *keys)


def bucket(width: int, seed: int | Column, *keys: Column | str) -> Column:
    """A number in [0, width)."""
    return slice32(0, seed, *keys) % width


def rho32(h: Column) -> Column:
    """The position of the first 1 among 32 bits, from 1; 33 if there is none."""
    return F.when(h == 0, 33).otherwise(33 - F.length(F.bin(h)))


# Linear families -------------------------------------------------------------

PRIME = 2**31 - 1
#: A 64-bit number is two pieces of so many bits and four bits more.
PIECE = 30
WHOLE = (ByteType, ShortType, IntegerType, LongType)


def fingerprint(x: Column | str, kind: DataType, family: str = "md5") -> Column:
    """64 bits of an item: a whole number itself, the first 60 bits of the md5 of
    anything else's text, or its xxHash64 with ``family`` "xxhash64", which is
    faster and not in every engine."""
    x = F.col(x) if isinstance(x, str) else x
    if isinstance(kind, WHOLE):
        return x.cast("long")
    if family == "xxhash64":
        return F.xxhash64(x)
    if family != "md5":
        raise ValueError(family)
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("long")


def hash128(*keys: Column | str) -> Column:
    """128 bits as a struct (high, low): the xxHash64 of the keys, seed 42, and
    that of the keys after it."""
    first = F.xxhash64(*keys)
    return F.struct(first.alias("high"), F.xxhash64(first, *keys).alias("low"))


def coefficients(seed: int, row: int) -> tuple[int, int, int, int]:
    """The four numbers below the prime that a row's function multiplies the
    pieces by and adds."""
    digest = hashlib.sha256(f"{seed}/{row}".encode()).digest()
    return tuple(int.from_bytes(digest[8 * i : 8 * i + 8], "big") % PRIME for i in range(4))


def linear_rows(key: Column, rows: int, width: int, seed: int) -> list[Column]:
    """``rows`` numbers in [0, width) from a 64-bit key. Two keys meet in a row
    with chance about 1 / width, whatever they are; no step overflows."""
    low, mid, high = key.bitwiseAND((1 << PIECE) - 1), F.shiftright(key, PIECE).bitwiseAND((1 << PIECE) - 1), F.shiftright(key, 2 * PIECE).bitwiseAND(15)
    long = lambda n: F.lit(n).cast("long")
    each = [(low * long(a) + mid * long(b) + high * long(c) + long(d)) % PRIME % width for a, b, c, d in (coefficients(seed, r) for r in range(rows))]
    return [e.cast("int") for e in each]


def linear(key: Column, rows: int, width: int, seed: int) -> Column:
    """The same as an array."""
    return F.array(*linear_rows(key, rows, width, seed))


def linear_sql(key: str, row: str, rows: int, width: int, seed: int) -> str:
    """The same in SQL, for the row that ``row`` says."""
    a, b, c, d = (f"([{', '.join(map(str, x))}])[{row} + 1]" for x in zip(*[coefficients(seed, r) for r in range(rows)], strict=True))
    mask = (1 << PIECE) - 1
    return f"((({key}) & {mask}) * {a} + ((({key}) >> {PIECE}) & {mask}) * {b} + ((({key}) >> {2 * PIECE}) & 15) * {c} + {d}) % {PRIME} % {width}"
