"""Rounding that goes by a double's exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions.regex import let

#: Splits a double in two halves of 26 bits.
_HALVES = 134217729.0


def rounded(value: Column, digits: int) -> Column:
    """value to `digits` decimals by its exact binary value, exact ties to even; null and values without decimals stay.

    The double nearest to the midpoint between two results decides, and where the value is
    that double, the sign of its own error, found without rounding from its two halves.
    """
    ten = float(10**digits)

    def near(a: Column) -> Column:
        return let(F.floor(a * ten).cast("double"), lambda k: F.when(k / ten > a, k - 1.0).otherwise(k))

    def between(a: Column, k: Column) -> Column:
        return let((k * 2.0 + 1.0) / (ten * 2.0), lambda m: let(m * _HALVES - (m * _HALVES - m), lambda h: up(a, k, m, h)))

    def up(a: Column, k: Column, m: Column, high: Column) -> Column:
        error = (high * (ten * 2.0) - (k * 2.0 + 1.0)) + (m - high) * (ten * 2.0)
        over = (a > m) | (a == m) & ((error > 0) | (error == 0) & (k % 2 == 1))
        return F.when(over, k + 1.0).otherwise(k) / ten

    x = value.cast("double")
    return let(x, lambda v: F.when(F.abs(v) < 2.0**52 / ten, F.signum(v) * let(F.abs(v), lambda a: let(near(a), lambda k: between(a, k)))).otherwise(v))


def rounded_sql(value: str, digits: int) -> str:
    """The same in DuckDB SQL."""
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    ten, two = d(float(10**digits)), d(float(10**digits) * 2)

    def let_(x: str, name: str, body: str) -> str:
        return f"list_transform([{x}], lambda {name}: {body})[1]"

    error = f"((rh * {two} - (rk * 2 + 1)) + (rm - rh) * {two})"
    body = f"(CASE WHEN ra > rm OR ra = rm AND ({error} > 0 OR {error} = 0 AND rk % 2 = 1) THEN rk + 1 ELSE rk END) / {ten}"
    half = let_(f"(rm * {d(_HALVES)} - (rm * {d(_HALVES)} - rm))", "rh", body)
    mid = let_(f"((rk * 2 + 1) / {two})", "rm", half)
    key = let_(let_(f"CAST(floor(ra * {ten}) AS DOUBLE)", "r0", f"CASE WHEN r0 / {ten} > ra THEN r0 - 1 ELSE r0 END"), "rk", mid)
    return let_(f"CAST({value} AS DOUBLE)", "rv", f"CASE WHEN rv < 0 THEN -1 ELSE 1 END * {let_('abs(rv)', 'ra', key)}")
