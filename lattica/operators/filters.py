"""Selection and derived columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.types import spark_type


def filter_by(df: DataFrame, *tests: Column) -> DataFrame:
    """Rows for which all tests hold; no tests keep all."""
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def generate(df: DataFrame, columns: dict[str, Column], kinds: dict[str, str] | None = None) -> DataFrame:
    """df with further columns, of given logical types where named."""
    kinds = kinds or {}
    return df.withColumns({n: c.cast(spark_type(kinds[n])) if n in kinds else c for n, c in columns.items()})


def bernoulli(df: DataFrame, p: float = 0.5, seed: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Each row stays with probability p; with ``key``, by a hash of those columns, the same in every run."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    if key is None:
        return df.sample(fraction=p, seed=seed)
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(seed or 0)), F.lit(1 << 20)) < int(p * (1 << 20)))


def pattern(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Rows whose column holds a match of the regular expression."""
    return df.filter(F.col(column).rlike(expression))


def filter_with(df: DataFrame, test: Callable[..., Column], *inputs: str, states: list[DataFrame] | None = None, **arguments) -> DataFrame:
    """User filter: ``test`` gets the input columns (and those of one-row states) and returns a boolean column.

    A state is a DataFrame with one row, such as the result of an aggregate over everything; more rows are an error.
    """
    names = df.columns
    for state in states or []:
        one = state.agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in state.columns])
        checked = one.select(F.assert_true(F.col("__n") <= 1, F.lit("a state of a filter has one row")).alias("__ok"), *state.columns)
        df = df.join(F.broadcast(checked), F.lit(True)).drop("__ok")
    return df.filter(test(*[F.col(i) for i in inputs], **arguments)).select(*names)
