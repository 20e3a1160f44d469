"""Strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(value: Column, pattern: str) -> Column:
    """Regular expression found anywhere in the value."""
    return value.rlike(pattern)


def like(value: Column, pattern: str) -> Column:
    """% and _ wildcards with backslash escapes, over the whole value."""
    return value.like(pattern)


def to_string(value: Column) -> Column:
    return value.cast("string")


def first_byte(value: Column) -> Column:
    """Number of the first byte, 0 for the empty string."""
    return F.coalesce(F.conv(F.nullif(F.substring(F.hex(F.encode(value, "UTF-8")), 1, 2), F.lit("")), 16, 10).cast("int"), F.when(value.isNotNull(), F.lit(0)))


def n_bytes(value: Column) -> Column:
    return F.octet_length(value)


def char_at(value: Column, index: Column | int) -> Column:
    """Character at a position from 0; empty beyond the end."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.substring(value, at + 1, F.lit(1))
