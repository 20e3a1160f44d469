"""Categorical values: names with declared ids. Their order is that of the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_id(name: Column, ids: dict[str, int]) -> Column:
    """Id of a name; null for names that aren't declared."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.try_element_at(table, name)


def category_name(number: Column, ids: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in ids.items() for x in (v, k)])
    return F.try_element_at(table, number)


def is_valid(name: Column, ids: dict[str, int]) -> Column:
    return F.coalesce(name.isin(list(ids)), F.lit(False))


def factor(df: DataFrame, column: str, out: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with ids, dictionary) for a column whose dictionary is its different values in order.

    Ids are positions over a range-partitioned sort: each partition numbers its own values and adds the number of
    values in the partitions before it, so that no single task sees all values.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    dictionary = numbered(values, [F.col(column)], out)
    return df.join(dictionary, column, "left"), dictionary


def numbered(df: DataFrame, order: list[Column], out: str, first: int = 0) -> DataFrame:
    """df with row numbers in the given total order, without gathering all rows in one task."""
    from lattica.operators.ranking import global_position

    return global_position(df, order, out, first)
