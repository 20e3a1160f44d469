"""One-to-many and run-wise transforms. Their outputs are added to the input's columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.aggregates import Aggregate


def value_range(df: DataFrame, columns: dict[str, str], distance: float, increment: float = 1, initial: float = 0) -> DataFrame:
    """For each row, v + sign(distance) * d with d = initial, initial + increment, ... up to abs(distance), in lockstep.

    ``columns`` maps output names to input columns.
    """
    if distance == 0 or increment <= 0 or initial < 0:
        raise ValueError("distance must not be zero, increment positive, initial not negative")
    n = int((abs(distance) - initial) // increment)
    sign = 1 if distance > 0 else -1
    if n < 0:
        return df.withColumns({out: F.col(c) for out, c in columns.items()}).limit(0)
    steps = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    move = (F.col("__k") * F.lit(increment) + F.lit(initial)) * sign
    return steps.withColumns({out: (F.col(c) + move).cast(df.schema[c].dataType) for out, c in columns.items()}).drop("__k")


def interval_to_discrete(df: DataFrame, start: str, end: str, out: str, inclusive: bool = True) -> DataFrame:
    """A row for each whole number between two values, whichever is larger; the larger end only if inclusive."""
    low, high = F.least(start, end), F.greatest(start, end)
    last = high if inclusive else high - 1
    return df.withColumn(out, F.explode(F.when(low <= last, F.sequence(low, last))))


def runs(df: DataFrame, key: str, inner: Aggregate, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """``inner`` over runs of equal consecutive keys.

    Order has to be named; runs end where a partition ends. ``run`` numbers the runs of a partition from 0. Without
    ``partition_by`` the rows are range-partitioned by the order and a run is cut at a partition's end, as it is at the
    end of a chunk.
    """
    own = df
    parts = partition_by
    if parts is None:
        own = df.repartitionByRange(*order_by).withColumn("__part", F.spark_partition_id())
        parts = ["__part"]
    w = Window.partitionBy(*parts).orderBy(*order_by)
    changed = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = own.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return inner.apply(numbered.drop("__new"), [*parts, "run", key]).drop("__part")


def apply_single(df: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """User transform with at most one result for each row: new columns, and a test of whether there is one."""
    out = df.withColumns(columns)
    return out if keep is None else out.filter(keep)


def apply_multi(df: DataFrame, results: Column, names: list[str]) -> DataFrame:
    """User transform with any number of results: an array of structs, spread out under the given names."""
    out = df.withColumn("__r", F.explode(results))
    return out.withColumns({n: F.col("__r")[n] for n in names}).drop("__r")


def apply_batches(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """User transform in Python over batches of a partition."""
    return df.mapInPandas(function, schema)
