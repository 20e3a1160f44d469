"""Aggregates that work over everything or inside groups, alone or several in one pass.

An aggregate is either a list of columns, which all end in one ``agg`` that Catalyst sees as a whole, or a function from
a DataFrame and group keys to a DataFrame, for results of several rows. Both kinds nest in ``group_by``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators import ranking


@dataclass
class Columns:
    """One-row aggregate."""

    columns: Callable[[DataFrame], dict[str, Column]]

    def apply(self, df: DataFrame, keys: list[str]) -> DataFrame:
        cols = [c.alias(n) for n, c in self.columns(df).items()]
        return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


@dataclass
class Rows:
    """Aggregate with any number of rows for each group."""

    apply: Callable[[DataFrame, list[str]], DataFrame]


Aggregate = Columns | Rows

#: States of a user aggregate that a task holds before it hands them on.
STATES = 100_000


def count(out: str = "count", as_json: bool = False) -> Columns:
    """Number of rows, nulls included."""
    n = F.count(F.lit(1))
    return Columns(lambda df: {out: F.to_json(F.struct(n.alias("count"))) if as_json else n})


def _as_sum(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    return F.sum(c.cast("bigint")) if isinstance(kind, (T.BooleanType, T.IntegralType)) else F.sum(c) if isinstance(kind, T.DecimalType) else F.sum(c.cast("double"))


def sums(names: dict[str, str], zero_if_empty: bool = True) -> Columns:
    """Sums by output name: integers and booleans as bigint, reals as double; 0 rather than null over no rows."""

    def cols(df: DataFrame) -> dict[str, Column]:
        return {out: F.coalesce(s, F.lit(0).cast(s_type(df, c))) if zero_if_empty else s for out, c in names.items() for s in [_as_sum(df, c)]}

    def s_type(df: DataFrame, name: str) -> str:
        kind = df.schema[name].dataType
        return "bigint" if isinstance(kind, (T.BooleanType, T.IntegralType)) else "decimal(38,6)" if isinstance(kind, T.DecimalType) else "double"

    return Columns(cols)


def averages(names: dict[str, str]) -> Columns:
    return Columns(lambda df: {out: F.avg(c) for out, c in names.items()})


def count_sum_average(name: str) -> Columns:
    """Number, sum and average of one column."""
    return Columns(lambda df: {"count": F.count(F.lit(1)), "sum": F.sum(name), "average": F.avg(name)})


def minima(names: dict[str, str]) -> Columns:
    return Columns(lambda df: {out: F.min(c) for out, c in names.items()})


def maxima(names: dict[str, str]) -> Columns:
    return Columns(lambda df: {out: F.max(c) for out, c in names.items()})


def count_distinct(names: list[str], out: str = "count", null_check: bool = False) -> Columns:
    """Exact number of different tuples; ``null_check`` leaves out those with a null."""
    return Columns(lambda df: {out: F.count_distinct(*names) if null_check else F.count_distinct(F.struct(*names))})


def hyper_log_log(name: str, out: str = "estimate", bins_exponent: int = 12) -> Columns:
    """Sketched number of different values with 2**bins_exponent registers, from 4 to 21."""
    if not 4 <= bins_exponent <= 21:
        raise ValueError("bins_exponent must lie between 4 and 21")
    return Columns(lambda df: {out: F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(name), F.lit(bins_exponent)))})


def linear_counting(names: list[str], out: str = "estimate", exponent: int = 16, null_check: bool = False) -> Rows:
    """Number of different tuples from the filled share of 2**exponent bits; the row count once all are filled.

    Bits meet as positions: first distinct, then counted, so that any exponent up to 62 works without large buffers.
    """
    m = 1 << exponent

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        own = df.dropna(subset=names) if null_check else df
        bits = own.withColumn("__bit", F.pmod(F.xxhash64(*names), F.lit(m))).groupBy(*keys, "__bit").agg(F.count(F.lit(1)).alias("__n"))
        x, n = F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))
        estimate = F.when(x == m, n.cast("double")).otherwise(-float(m) * F.log(1 - x / F.lit(float(m))) + 0.0).alias(out)
        return bits.groupBy(*keys).agg(estimate) if keys else bits.agg(estimate)

    return Rows(run)


def distinct(names: list[str], null_check: bool | list[str] = False) -> Rows:
    """Different tuples; ``null_check`` (all inputs, or a list) leaves out those that are null there."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        own = df.select(*keys, *names)
        return (own.dropna(subset=names if null_check is True else null_check) if null_check else own).distinct()

    return Rows(run)


def order_by(order: dict[str, str], limit: int | None = None, rank: str | None = None, keep_ties: bool | None = None) -> Rows:
    return Rows(lambda df, keys: ranking.order_by(df, order, limit, rank, keys, keep_ties))


def multi_hash(keys: list[str], values: list[str]) -> Rows:
    """State that maps a key to all of its values: rows of the key columns, then the value columns."""
    return Rows(lambda df, outer: df.select(*outer, *keys, *values))


def interval_map(lower: str, upper: str, values: list[str]) -> Rows:
    """State that maps closed intervals to values; empty intervals are left out, and overlapping ones all count."""
    return Rows(lambda df, outer: df.filter(F.col(lower) <= F.col(upper)).select(*outer, lower, upper, *values))


def iterable(state: Any, step: Callable[[DataFrame, Any], Any], again: Callable[[Any, Any, int], bool], finish: Callable[[Any], list[tuple]], schema: str, max_rounds: int = 100) -> Rows:
    """Aggregate that asks for another round over the same rows while ``again`` says so; ``finish`` gives its rows."""
    from lattica.operators import iterate

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        if keys:
            raise ValueError("an iterable aggregate within groups is iterate.iterate_groups")
        return df.sparkSession.createDataFrame(finish(iterate.iterate_aggregate(df, state, step, again, max_rounds)[0]), schema)

    return Rows(run)


def top_k(score: str, k: int, tie_break: list[str] | None = None) -> Rows:
    by = {score: "DESC"} | {c: "ASC" for c in tie_break or []}
    return Rows(lambda df, keys: ranking.order_by(df, by, k, None, keys))


def extreme_tuples(extremes: dict[str, str]) -> Rows:
    return Rows(lambda df, keys: ranking.extreme_tuples(df, extremes, keys))


def gather(names: list[str], out: str | None = None) -> Aggregate:
    """All tuples as rows, or as one array column if ``out`` names it (for groups that are known to be small)."""
    if out is None:
        return Rows(lambda df, keys: df.select(*keys, *names))
    return Columns(lambda df: {out: F.collect_list(F.struct(*names))})


def frequencies(name: str, out: str = "frequency") -> Rows:
    """Each value with its number of rows."""
    return Rows(lambda df, keys: df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias(out)))


def group_by(keys: list[str] | dict[str, str], inner: Aggregate) -> Rows:
    """``inner`` within each group; nests, as keys add up. A dict renames keys from input to output."""
    names = keys if isinstance(keys, dict) else {k: k for k in keys}

    def run(df: DataFrame, outer: list[str]) -> DataFrame:
        own = df
        for old, new in names.items():
            own = own if old == new else own.withColumn(new, F.col(old))
        return inner.apply(own, [*outer, *names.values()])

    return Rows(run)


def multiplex(parts: list[Aggregate]) -> Aggregate:
    """Several aggregates over the same rows.

    One-row aggregates become one ``agg``. Parts with several rows are laid side by side by position, each in the
    order of its own columns; a shorter part repeats its last row.
    """
    if all(isinstance(p, Columns) for p in parts):
        return Columns(lambda df: {n: c for p in parts for n, c in p.columns(df).items()})

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        from pyspark.sql.window import Window

        laid = []
        for i, p in enumerate(parts):
            own = p.apply(df, keys)
            rest = [c for c in own.columns if c not in keys]
            if keys:
                placed = own.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)).cast("long"))
            else:
                placed = ranking.global_position(own, [F.col(c) for c in rest], "__pos")
            laid.append((placed, rest))
        most = None
        for i, (own, _) in enumerate(laid):
            n = own.select(*keys, "__pos")
            most = n if most is None else most.unionByName(n)
        out = most.distinct()
        for i, (own, rest) in enumerate(laid):
            size = own.groupBy(*keys).agg(F.max("__pos").alias(f"__n{i}")) if keys else own.agg(F.max("__pos").alias(f"__n{i}"))
            out = out.join(size, keys, "left") if keys else out.join(F.broadcast(size), F.lit(True))
            out = out.withColumn("__at", F.least("__pos", f"__n{i}"))
            out = out.join(own.select(*keys, F.col("__pos").alias("__at"), *rest), [*keys, "__at"], "left").drop("__at", f"__n{i}")
        return out.drop("__pos")

    return Rows(run)


def segment(key: str, inner: Aggregate, segments: int = 64, passes: int = 1) -> Rows:
    """``inner`` in each hash segment of the key, and the union of the results.

    Right if ``inner`` treats different keys apart. Each of several passes reads the input again and takes its share of
    the segments, which bounds what is shuffled at once.
    """
    if passes < 1:
        raise ValueError("passes must be positive")

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        own, out = df.withColumn("__segment", F.pmod(F.xxhash64(key), F.lit(segments * passes))), None
        for n in range(passes):
            mine = own if passes == 1 else own.filter(F.pmod("__segment", F.lit(passes)) == n)
            part = inner.apply(mine, [*keys, "__segment"]).drop("__segment")
            out = part if out is None else out.unionByName(part)
        return out

    return Rows(run)


def chunk_count() -> Rows:
    """How many partitions hold how many rows."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        sizes = df.groupBy(*keys, F.spark_partition_id().alias("__p")).agg(F.count(F.lit(1)).alias("tuples"))
        return sizes.groupBy(*keys, "tuples").agg(F.count(F.lit(1)).alias("chunks"))

    return Rows(run)


def histogram(name: str, low: float, high: float, bins: int) -> Rows:
    """Number of rows in each of equally wide bins; values outside fall into the first or last."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(name) - low) / ((high - low) / bins)))).cast("int")
    return Rows(lambda df, keys: df.filter(F.col(name).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def evaluate(df: DataFrame, aggregate: Aggregate) -> DataFrame:
    """An aggregate over all rows."""
    return aggregate.apply(df, [])


@dataclass
class UserAggregate:
    """User-defined aggregate by init, add, merge and finish, run as partial states that are merged by key.

    ``add`` and ``merge`` return the new state; ``finish`` returns the result rows as tuples. States travel pickled.
    Built-in aggregates are much faster; this is for what they can't express.
    """

    init: Callable[[], Any]
    add: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Iterable[tuple]]
    inputs: list[str]
    schema: str
    fan_in: int = 64

    def apply(self, df: DataFrame, keys: list[str]) -> DataFrame:
        init, add, merge, finish, inputs = self.init, self.add, self.merge, self.finish, self.inputs

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states: dict[tuple, Any] = {}

            def out() -> pd.DataFrame:
                return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "__state"])

            for pdf in batches:
                columns = [pdf[c].tolist() for c in pdf.columns]
                for row in zip(*columns, strict=True):
                    key = row[: len(keys)]
                    states[key] = add(states[key] if key in states else init(), *row[len(keys) :])
                if len(states) > STATES:  # partial states are merged anyway
                    yield out()
                    states.clear()
            yield out()

        def merged(pdf: pd.DataFrame) -> Any:
            out = init()
            for s in pdf["__state"]:
                out = merge(out, pickle.loads(s))
            return out

        key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        own = ", ".join(x for x in (key_schema, "__state binary") if x)
        states = df.select(*keys, *inputs).mapInPandas(partial, own)
        # a first merge by (key, salt) bounds the number of states that meet for one key
        salted = states.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(self.fan_in)))
        step = salted.groupBy(*keys, "__salt").applyInPandas(lambda pdf: pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], pickle.dumps(merged(pdf)))], columns=[*keys, "__state"]), own)
        out_names = T.StructType.fromDDL(self.schema).names if hasattr(T.StructType, "fromDDL") else [x.split()[0] for x in self.schema.split(",")]
        last = step if keys else step.withColumn("__all", F.lit(0))

        def end(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], *row) for row in finish(merged(pdf))], columns=[*keys, *out_names])

        return last.groupBy(*(keys or ["__all"])).applyInPandas(end, ", ".join(x for x in (key_schema, self.schema) if x))
