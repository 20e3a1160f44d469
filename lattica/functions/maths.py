"""Arithmetic, comparison, bits and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.types import spark_type


def divide(a: Column, b: Column) -> Column:
    """Real division, also of integers."""
    return a.cast("double") / b.cast("double")


def quotient(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b)


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def root(a: Column) -> Column:
    return F.sqrt(a)


def absolute(a: Column) -> Column:
    return F.abs(a)


def convert(a: Column, kind: str) -> Column:
    """Constructor-style cast to a logical type."""
    return a.cast(spark_type(kind))


def hashed(*columns: Column) -> Column:
    """64-bit hash of the values in order."""
    return F.xxhash64(*columns)


def missing(a: Column, real: bool = False) -> Column:
    """Null test; for real numbers NaN counts as null."""
    return a.isNull() | F.isnan(a) if real else a.isNull()


def case_of(value: Column, pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """Simple CASE: the result beside the first equal value."""
    return case_when([(value == v, r) for v, r in pairs], otherwise)


def case_when(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """Searched CASE: the result beside the first true test. There is always an else branch."""
    out = otherwise
    for test, result in reversed(pairs):
        out = F.when(test, result).otherwise(out)
    return out


def among(value: Column, values: list) -> Column:
    """Membership in a list of constants."""
    return value.isin(values)
