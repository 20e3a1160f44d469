"""Joins: equal keys, existence, and values in intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Estimated size of a state up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20

#: Level of the bin that holds every value. Intervals to a level of their key up to which they are all put there.
WHOLE, FEW = 4096, 4


def _equal(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], null_safe: bool) -> Column:
    same = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
    return reduce(lambda x, y: x & y, same)


def _pairs(left_keys: list[str], right_keys: list[str]) -> list[tuple[str, str]]:
    if len(left_keys) != len(right_keys):
        raise ValueError("both sides need as many keys")
    return list(zip(left_keys, right_keys, strict=True))


def inner(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], null_safe: bool = False) -> DataFrame:
    return left.join(right, _equal(left, right, _pairs(left_keys, right_keys), null_safe), "inner")


def left_outer(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], null_safe: bool = False) -> DataFrame:
    return left.join(right, _equal(left, right, _pairs(left_keys, right_keys), null_safe), "left")


def exists_in(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], null_safe: bool = False) -> DataFrame:
    """Each left row once if the right side has its key."""
    return left.join(right, _equal(left, right, _pairs(left_keys, right_keys), null_safe), "left_semi")


def not_exists_in(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], null_safe: bool = False) -> DataFrame:
    """Left rows whose key the right side lacks; a plain not-exists, so that nulls on the right hide nothing."""
    return left.join(right, _equal(left, right, _pairs(left_keys, right_keys), null_safe), "left_anti")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a relation's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def known_distinct(df: DataFrame, keys: list[str]) -> bool:
    """Whether the optimizer knows, as after a group-by, that no two rows have the same keys."""
    return not df.select(*keys)._jdf.queryExecution().optimizedPlan().distinctKeys().isEmpty()


def with_state(left: DataFrame, left_keys: list[str], state: DataFrame, state_keys: list[str], keep_missing: bool = False) -> DataFrame:
    """Join against a state that every task holds: all matches; broadcast while its estimated size allows."""
    small = estimated_bytes(state) <= BROADCAST_BYTES
    side = state.hint("broadcast") if small else state
    return left.join(side, _equal(left, side, _pairs(left_keys, state_keys), False), "left" if keep_missing else "inner")


def _number(df: DataFrame, c: str) -> Column:
    """A column as a double that keeps its order: numbers, seconds or days."""
    kind, at = df.schema[c].dataType, df[c]
    if isinstance(kind, T.TimestampNTZType):  # by its parts: an hour that a zone skips would be out of order
        return F.unix_date(at.cast("date")) * 86_400.0 + F.hour(at) * 3600 + F.minute(at) * 60 + F.date_part(F.lit("second"), at).cast("double")
    return (F.unix_date(at) if isinstance(kind, T.DateType) else at).cast("double")


def _row_bytes(df: DataFrame, extra: int = 0) -> Column:
    """About what a row takes in Spark's row format, with so many columns of fixed size beside its own."""
    wide = [F.octet_length(df[f.name]) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.length(F.to_json(F.struct(df[f.name]))) for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType)]
    return reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0)).cast("long") for c in wide], F.lit(8 * (len(df.columns) + extra + 1)).cast("long"))


def _hinted(df: DataFrame, size: int | None) -> DataFrame:
    """Broadcast by hint if its counted bytes allow: left to itself Spark shuffles few rows that lie in few partitions."""
    return df.hint("broadcast") if (size or 0) <= BROADCAST_BYTES else df


def _binned(points: DataFrame, value: str, intervals: DataFrame, lower: str, upper: str, width: float | None, keys: list[tuple[str, str]], closed: bool, how: str) -> DataFrame:
    """Join on the bin of the value and each bin that an interval touches; exact bounds are tested again.

    Bins double in width from level to level, and an interval lies on the level where it touches few bins, however long
    it is; ``width`` is that of the least bins, without it an interval's own length alone tells its level. A value is
    looked up on each of the levels in use, at most some dozens; rows that are kept without an interval are found level
    by level. With keys, a value is looked up on the levels of its own key, and a key with few intervals to a level has
    all of them in one bin (level ``WHOLE``), as have intervals without a finite length. Levels and bytes are counted
    first, in one job over the intervals; few bytes are broadcast, so that rows with equal values aren't brought together.
    """
    low, high, step = _number(intervals, lower), _number(intervals, upper), width or 1.0
    least = [F.lit(1.0)] if width else [F.abs(low) * 2.0**-52, F.abs(high) * 2.0**-52, F.lit(2.0**-1000)]
    long = F.greatest((high - low) / step, *least)
    placed = intervals.withColumn("__level", F.when(long < float("inf"), F.ceil(F.log2(long)).cast("int")).otherwise(WHOLE))
    bin_of = lambda c, level: F.floor(c / (step * F.pow(F.lit(2.0), level))).cast("long")
    bins = lambda df: (bin_of(_number(df, lower), df["__level"]), bin_of(_number(df, upper), df["__level"]))
    first, last = bins(placed)
    size = F.sum(_row_bytes(intervals, 2) * (last - first + 1))
    by_key = None
    if keys:
        own = [F.col(b).alias(f"__b{i}") for i, (_, b) in enumerate(keys)]
        counted = placed.groupBy(*own).agg(F.collect_set("__level").alias("__levels"), F.count(F.lit(1)).alias("__n"), size.alias("__size"))
        few = F.col("__n") <= FEW * F.size("__levels")
        counted = counted.withColumn("__levels", F.when(few, F.array(F.lit(WHOLE))).otherwise(F.col("__levels")))
        by_key = counted.drop("__n", "__size")
        each = counted.select(F.posexplode("__levels").alias("__i", "__level"), "__size", _row_bytes(by_key).alias("__row"))
        once = lambda c: F.sum(F.when(F.col("__i") == 0, F.col(c)))
        found, size, key_size = each.agg(F.collect_set("__level"), once("__size"), once("__row")).first()
        by_key = _hinted(by_key, key_size)
    else:
        found, size = placed.agg(F.collect_set("__level"), size).first()
    levels = sorted(found) or [WHOLE]
    test_of = lambda at, side: [*[at[a] == side[b] for a, b in keys], at[value] >= side[lower], (at[value] <= side[upper]) if closed else (at[value] < side[upper])]
    if levels == [WHOLE]:
        side = _hinted(intervals, size)
        return points.join(side, reduce(lambda x, y: x & y, test_of(points, side)), how)

    def with_levels(df: DataFrame, on: list[str]) -> DataFrame:
        """Rows with the levels of their key."""
        if by_key is None:
            return df.withColumn("__levels", F.array(*[F.lit(x) for x in levels]))
        same = reduce(lambda x, y: x & y, [df[c] == by_key[f"__b{i}"] for i, c in enumerate(on)])
        return df.join(by_key, same).drop(*[f"__b{i}" for i in range(len(on))])

    if by_key is not None and levels[-1] == WHOLE:
        held = F.array_contains("__levels", F.col("__level"))
        placed = with_levels(placed, [b for _, b in keys]).withColumn("__level", F.when(held, F.col("__level")).otherwise(WHOLE)).drop("__levels")
    spread = _hinted(placed.withColumn("__bin", F.explode(F.sequence(*bins(placed)))), size)

    def met(at: DataFrame, on: Column, way: str) -> DataFrame:
        at = at.withColumn("__on", on)
        at = at.withColumn("__at", bin_of(_number(at, value), F.col("__on")))
        test = [at["__on"] == spread["__level"], at["__at"] == spread["__bin"], *test_of(at, spread)]
        return at.join(spread, reduce(lambda x, y: x & y, test), way).drop("__on", "__at", "__level", "__bin", "__levels")

    if len(levels) == 1:
        return met(points, F.lit(levels[0]), how)
    every = met(with_levels(points, [a for a, _ in keys]), F.explode("__levels"), "inner")
    if how == "inner":
        return every
    rest = points
    for level in levels:
        rest = met(rest, F.lit(level), "left_anti")
    return every.unionByName(rest, allowMissingColumns=True)


def interval_join(points: DataFrame, value: str, intervals: DataFrame, lower: str, upper: str, width: float, keep_missing: bool = False) -> DataFrame:
    """Rows with the interval that their value lies in, both ends included.

    ``width`` is the width of a bin, about the length of a typical interval: values and intervals then meet in an
    equi-join that spreads over the cluster, instead of every row against every interval. Empty intervals
    (lower > upper) match nothing. Overlapping intervals all match.
    """
    real = intervals.filter(F.col(lower) <= F.col(upper))
    return _binned(points, value, real, lower, upper, width, [], True, "left" if keep_missing else "inner")


def group_interval_join(points: DataFrame, keys: list[str], value: str, intervals: DataFrame, interval_keys: list[str], lower: str, upper: str, width: float | None = None, keep_missing: bool = False) -> DataFrame:
    """Per key, rows with the interval [lower, upper) that their value lies in.

    A key that has no intervals drops its rows, also with ``keep_missing``; otherwise that keeps rows without an
    interval, all of whose outputs are null. Intervals of a key are binned by their lengths, or by ``width``; not
    where a key is known to have only one, nor other types than numbers, timestamps and dates, which have no lengths.
    """
    real = intervals.filter(F.col(lower) < F.col(upper))
    pairs = _pairs(keys, interval_keys)
    if keep_missing:
        points = exists_in(points, keys, intervals.select(*interval_keys).distinct(), interval_keys)
    how = "left" if keep_missing else "inner"
    types = [points.schema[value].dataType, real.schema[lower].dataType, real.schema[upper].dataType]
    lengths = any(all(isinstance(t, kind) for t in types) for kind in (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))
    if width is not None or (lengths and not known_distinct(real, interval_keys)):
        return _binned(points, value, real, lower, upper, width, pairs, False, how)
    return points.join(real, _equal(points, real, pairs, False) & (points[value] >= real[lower]) & (points[value] < real[upper]), how)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, take: list[str], bucket_seconds: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; null if there is none.

    Both sides are laid into one stream and the last known values carried forward, so that a key is sorted once and
    never paired with itself. With ``bucket_seconds`` a key's stream is cut into buckets of time, for keys that are too
    hot for one task; each bucket opens with the last values of those before it, of which there is one row for each.
    """
    stamped = left.withColumns({"__t": F.col(left_time), "__left": F.lit(1), **{f"__{c}": F.lit(None).cast(right.schema[c].dataType) for c in take}})
    other = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__left"), *[F.col(c).alias(f"__{c}") for c in take])
    both = stamped.unionByName(other, allowMissingColumns=True)
    known = F.when(F.col("__left") == 0, F.struct(*[F.col(f"__{c}").alias(c) for c in take]))
    by = list(keys)
    if bucket_seconds:
        both = both.withColumn("__bucket", F.floor(F.unix_seconds(F.col("__t").cast("timestamp")) / bucket_seconds))
        by.append("__bucket")
    past = Window.partitionBy(*by).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("__last", F.last(known, ignorenulls=True).over(past))
    if bucket_seconds:
        closing = both.groupBy(*by).agg(F.max_by(known, F.when(F.col("__left") == 0, F.col("__t"))).alias("__carry"))
        before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        opening = closing.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.last("__carry", ignorenulls=True).over(before).alias("__carry"))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
        filled = filled.filter("__left = 1").join(opening, same, "left").withColumn("__last", F.coalesce("__last", "__carry"))
    return filled.filter("__left = 1").select(*left.columns, *[F.col("__last")[c].alias(c) for c in take])
