"""Arrays, sets of names and bit sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, index: Column | int) -> Column:
    """Element at a position from 0; null beyond the end."""
    return F.get(a, F.lit(index) if isinstance(index, int) else index)


def front(a: Column) -> Column:
    return F.get(a, F.lit(0))


def back(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def size(a: Column) -> Column:
    return F.size(a)


def view(a: Column) -> Column:
    """A view of an array is the column itself."""
    return a


def bits(b: Column) -> Column:
    """Number of set bits."""
    return F.bit_count(b)


def is_set(b: Column, index: Column | int) -> Column:
    return F.getbit(b, F.lit(index) if isinstance(index, int) else index) == 1


def named_bits(b: Column, names: list[str]) -> dict[str, Column]:
    """A boolean for each name, by its place."""
    return {n: is_set(b, i) for i, n in enumerate(names)}


def set_mask(a: Column, names: list[str]) -> Column:
    """A set of names as a bit mask."""
    out = F.lit(0).cast("bigint")
    for i, n in enumerate(names):
        out = out.bitwiseOR(F.when(F.array_contains(a, n), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out
