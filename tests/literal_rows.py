"""Rows of a frame in a form that tests can compare."""

from __future__ import annotations


def rows(df) -> list[tuple]:
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
