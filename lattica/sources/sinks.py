"""Writing relations and printing results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def store(df: DataFrame, path: str, columns: dict[str, Column] | None = None, overwrite: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Append df to a relation, or replace it; ``columns`` maps the relation's columns, else names are taken as they are."""
    out = df.select(*[c.alias(n) for n, c in columns.items()]) if columns else df
    if schema is not None:
        out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    out.write.mode("overwrite" if overwrite else "append").parquet(path)
    return out


def printed(df: DataFrame, columns: dict[str, Column], kind: str = "csv", sep: str = ",", limit: int | None = None) -> DataFrame:
    """One column ``line``: fields joined by the separator, or a JSON array for each row. limit takes any n rows."""
    own = df if limit is None else df.limit(limit)
    if kind == "json":
        return own.select(F.to_json(F.array(*[c.cast("string") for c in columns.values()])).alias("line"))
    if kind != "csv":
        raise ValueError("kind is csv or json")
    return own.select(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NULL")) for c in columns.values()]).alias("line"))


def with_types(lines: DataFrame, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Printed JSON rows and, as one further line, the names and types of their columns."""
    fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.select(*[c.alias(n) for n, c in columns.items()]).schema]
    one = df.sparkSession.range(1).select(F.lit(json.dumps({"types": fields}, separators=(",", ":"))).alias("line"))
    return lines.unionAll(one)


def print_to(df: DataFrame, columns: dict[str, Column], path: str, kind: str = "csv", header: bool = False, sep: str = ",", limit: int | None = None, single: bool = False) -> None:
    """Write text files; ``single`` brings all rows into one file and is for results that are known to be small."""
    own = df if limit is None else df.limit(limit)
    own = own.select(*[c.alias(n) for n, c in columns.items()])
    own = own.coalesce(1) if single else own
    if kind == "json":
        own.write.mode("overwrite").json(path)
    else:
        own.write.mode("overwrite").csv(path, header=header, sep=sep, nullValue="NULL")


def json_envelope(df: DataFrame, limit: int = 1000) -> str:
    """{"content": rows as arrays, "types": column types} of at most ``limit`` rows, for clients."""
    rows = df.limit(limit).collect()
    return json.dumps({"content": [list(r) for r in rows], "types": json.loads(df.schema.json())["fields"]}, default=str)


def cluster(df: DataFrame, column: str, path: str, files: int | None = None) -> DataFrame:
    """Write df range-partitioned and sorted by a column, so that range loads skip files; returns the zone map."""
    ranged = df.repartitionByRange(files, column) if files else df.repartitionByRange(column)
    ranged.sortWithinPartitions(column).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return zone_map(back, column)


def zone_map(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value and number of rows of each file."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"))


def cache(df: DataFrame) -> DataFrame:
    """Kept between uses; spills to disk."""
    return df.persist()


def compact(df: DataFrame) -> DataFrame:
    """Filters are physical here; this only merges small partitions, through adaptive rebalancing."""
    return df.hint("rebalance")
