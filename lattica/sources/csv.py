"""Separated text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.types import parse_as


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    columns: list[tuple[str, str]],
    sep: str = ",",
    quote: str | None = '"',
    escape: str = "\\",
    skip: int = 0,
    n: int | None = None,
    simple: bool = False,
    trim_cr: bool = False,
    line_number: str | None = None,
    nullable: bool | list[str] | dict[str, str] = False,
    null_text: str = "NULL",
) -> DataFrame:
    """Files (or globs) with a fixed list of (name, logical type).

    ``skip`` header lines and at most ``n`` rows count for each file; ``line_number`` names a leading column with the
    number of the data row in its file from 1; ``simple`` splits without quotes; ``nullable`` names the columns (True:
    all, a dict: with their own null texts) in which a field that is exactly the null text is null.

    Without skip, n and line_number the files split freely. Otherwise lines have to be numbered: each file is read
    whole by one task, and numbering needs no exchange between files.
    """
    sep = "\t" if sep == "tab" else sep
    if len(sep) != 1:
        raise ValueError("the separator is one character or 'tab'")
    paths = [paths] if isinstance(paths, str) else paths
    nulls = dict.fromkeys([c for c, _ in columns] if nullable is True else nullable or [], null_text) if not isinstance(nullable, dict) else nullable
    names = [c for c, _ in columns]
    number = None
    if skip or n is not None or line_number:
        lines = spark.read.text(paths, wholetext=True).select(F.monotonically_increasing_id().alias("__file"), F.split("value", "\n").alias("__lines"))
        rows = lines.select("__file", F.posexplode("__lines").alias("__pos", "__line"), F.size("__lines").alias("__n"))
        rows = rows.filter(~((F.col("__pos") == F.col("__n") - 1) & (F.col("__line") == ""))).filter(F.col("__pos") >= skip)
        number = (F.col("__pos") - skip + 1).cast("long")
        rows = rows if n is None else rows.filter(number <= n)
        rows = rows.withColumn("__number", number)
    else:
        rows = spark.read.text(paths, lineSep="\n").select(F.col("value").alias("__line"), F.lit(None).cast("long").alias("__number"))
    if trim_cr:
        rows = rows.withColumn("__line", F.regexp_replace("__line", "\r$", ""))
    if simple or quote is None:
        parts = F.split("__line", f"[{sep}]" if sep not in "\\^" else "\\" + sep)
        fields = [F.get(parts, F.lit(i)) for i in range(len(names))]
    else:
        options = {"sep": sep, "quote": quote, "escape": escape, "emptyValue": "", "nullValue": "\u0000", "mode": "PERMISSIVE"}
        raw = T.StructType([T.StructField(c, T.StringType()) for c in names])
        rows = rows.withColumn("__row", F.from_csv("__line", raw.simpleString()[7:-1].replace(":", " "), options))
        fields = [F.coalesce(F.col("__row")[c], F.lit("")) for c in names]  # an empty field is the empty text
    out = []
    for (name, kind), f in zip(columns, fields, strict=True):
        f = F.when(f != nulls[name], f) if name in nulls else f
        out.append(parse_as(f, kind).alias(name))
    return rows.select(*([F.col("__number").alias(line_number)] if line_number else []), *out)


def read_netflow(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ip, flow) files."""
    return read_csv(spark, paths, [("ip", "IPV4ADDR"), ("flow", "INT")], simple=True)


def read_text(spark: SparkSession, paths: str | list[str], columns: list[tuple[str, str]], sep: str = "|") -> DataFrame:
    """Fixed-separator files, as benchmark tables come; a trailing separator is harmless."""
    return read_csv(spark, paths, columns, sep=sep, simple=True)
