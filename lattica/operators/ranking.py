"""Order, top-k and extreme rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def direction(name: str, way: str) -> Column:
    """Sort expression for one column; ASC, ASCENDING, + or >, else DESC, DESCENDING, DES, DSC, - or <."""
    if way.upper() in ("ASC", "ASCENDING", "+", ">"):
        return F.col(name).asc_nulls_first()
    if way.upper() in ("DESC", "DESCENDING", "DES", "DSC", "-", "<"):
        return F.col(name).desc_nulls_last()
    raise ValueError(f"unknown order {way}")


def global_position(df: DataFrame, order: list[Column], out: str, first: int = 1) -> DataFrame:
    """df with positions in a total order.

    Rows are range-partitioned and numbered within their partition; each partition starts after the number of rows
    before it. Only a count for each partition meets in one place. The sorted rows are computed twice unless the
    caller persists df; the order should be total, so that both computations agree.
    """
    own, pid = "__within", "__partition"
    # the number of partitions is set, or else adaptive execution might cut the two computations differently
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn(pid, F.spark_partition_id())
    numbered = ranged.withColumn(own, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
    sizes = ranged.groupBy(pid).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(pid), before.alias("__before"))
    joined = numbered.join(F.broadcast(starts), pid)  # a row for each partition
    return joined.withColumn(out, (F.col("__before") + F.col(own) - 1 + first).cast("long")).drop(pid, own, "__before")


def order_by(df: DataFrame, order: dict[str, str], limit: int | None = None, rank: str | None = None, keys: list[str] | None = None, keep_ties: bool | None = None) -> DataFrame:
    """Sorted rows, the first ``limit`` of them, or the first of each group; ``rank`` names the position from 1.

    Ties at the limit are cut. ``keep_ties`` settles which of the tied rows stay: those that come first (True) or last
    (False) in the order of their other columns.
    """
    by = [direction(n, w) for n, w in order.items()]
    if keep_ties is not None:
        by += [direction(c, "ASC" if keep_ties else "DESC") for c in df.columns if c not in order and c not in (keys or [])]
    if keys:
        ranked = df.withColumn(rank or "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
        out = ranked if limit is None else ranked.filter(F.col(rank or "__rank") <= limit)
        return out if rank else out.drop("__rank")
    if limit is not None:
        top = df.orderBy(*by).limit(limit)
        # at most ``limit`` rows meet in one task
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*by))) if rank else top
    return global_position(df, by, rank) if rank else df.orderBy(*by)  # positions come in order: range partitions, sorted


def top_k(df: DataFrame, score: str, k: int, tie_break: list[str] | None = None) -> DataFrame:
    """The k rows with the largest score."""
    return df.orderBy(F.desc(score), *(tie_break or [])).limit(k)



def extreme_tuples(df: DataFrame, extremes: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """All rows tied at the lexicographic extreme, overall or in each group.

    Overall, each column is settled by one aggregate over the rows that tie on the columns before it; the extreme value
    comes back as a one-row broadcast, so that no rows are shuffled. Groups use a ranking window.
    """
    wants_max = {}
    for name, way in extremes.items():
        up = way.upper()
        if up not in ("MIN", "MINIMUM", "-", "<", "MAX", "MAXIMUM", "+", ">"):
            raise ValueError(f"unknown extreme {way}")
        wants_max[name] = up in ("MAX", "MAXIMUM", "+", ">")
    if keys:
        by = [F.col(n).desc_nulls_last() if m else F.col(n).asc_nulls_last() for n, m in wants_max.items()]
        return df.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(*by))).filter("__rank = 1").drop("__rank")
    out = df
    for name, is_max in wants_max.items():
        best = out.agg((F.max(name) if is_max else F.min(name)).alias("__best"))
        out = out.join(F.broadcast(best), F.col(name) == F.col("__best"), "left_semi")
    return out
