"""Approximate numbers and truth values as structs.

An approximate number is (min, estimate, max, prob): the value lies between
min and max with at least that probability. A truth value is (is_true, prob).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approximate(low: Column, estimate: Column, high: Column, prob: Column) -> Column:
    return F.struct(low.alias("min"), estimate.alias("estimate"), high.alias("max"), prob.alias("prob"))


def exact(x: Column) -> Column:
    return approximate(x, x, x, F.lit(1.0))


def plus(a: Column, b: Column) -> Column:
    return approximate(a["min"] + b["min"], a["estimate"] + b["estimate"], a["max"] + b["max"], a["prob"] * b["prob"])


def negate(a: Column) -> Column:
    return approximate(-a["max"], -a["estimate"], -a["min"], a["prob"])


def minus(a: Column, b: Column) -> Column:
    return plus(a, negate(b))


def times(a: Column, b: Column) -> Column:
    ends = [a[x] * b[y] for x in ("min", "max") for y in ("min", "max")]
    return approximate(F.least(*ends), a["estimate"] * b["estimate"], F.greatest(*ends), a["prob"] * b["prob"])


def with_min(a: Column, low: Column) -> Column:
    """The lower bound is known to be at least ``low``."""
    return approximate(F.greatest(a["min"], low), F.greatest(a["estimate"], low), F.greatest(a["max"], low), a["prob"])


def with_max(a: Column, high: Column) -> Column:
    return approximate(F.least(a["min"], high), F.least(a["estimate"], high), F.least(a["max"], high), a["prob"])


def contains(a: Column, x: Column) -> Column:
    """The truth value of "the number is x"."""
    return truth((a["min"] <= x) & (x <= a["max"]), a["prob"])


def bounds_contain(a: Column, x: Column) -> Column:
    return (a["min"] <= x) & (x <= a["max"])


def same(a: Column, b: Column) -> Column:
    """Could the two be equal: do their bounds meet?"""
    return (a["min"] <= b["max"]) & (b["min"] <= a["max"])


def truth(is_true: Column, prob: Column) -> Column:
    return F.struct(is_true.alias("is_true"), prob.alias("prob"))


def not_(a: Column) -> Column:
    return truth(~a["is_true"], a["prob"])


def xor(a: Column, b: Column) -> Column:
    return truth(a["is_true"] != b["is_true"], a["prob"] * b["prob"])


def and_(a: Column, b: Column) -> Column:
    """False is as sure as the surer false side."""
    t, u, p, q = a["is_true"], b["is_true"], a["prob"], b["prob"]
    return F.when(t & u, truth(F.lit(True), p * q)).when(~t & ~u, truth(F.lit(False), F.greatest(p, q))).when(~t, truth(F.lit(False), p)).otherwise(truth(F.lit(False), q))


def or_(a: Column, b: Column) -> Column:
    return not_(and_(not_(a), not_(b)))
