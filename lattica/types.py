"""Logical column types and their Spark counterparts. Nulls are SQL nulls throughout; no value stands in for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGICAL: dict[str, T.DataType] = {
    "BYTE": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "UINT": T.LongType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "BOOL": T.BooleanType(),
    "STRING": T.StringType(),
    "VARCHAR": T.StringType(),
    "STRING_LITERAL": T.StringType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampType(),
    "POSIXTIME": T.TimestampType(),
    "TIME": T.IntegerType(),  # milliseconds of the day
    "CATEGORY": T.StringType(),
    "FACTOR": T.StringType(),
    "CATEGORYSET": T.ArrayType(T.StringType()),
    "BITSET": T.LongType(),
    "JSON": T.StringType(),
    "IPV4ADDR": T.LongType(),
    "MACADDR": T.LongType(),
    "UUID": T.StringType(),
    "HEX": T.BinaryType(),
    "BASE64": T.BinaryType(),
    "LOCATION": T.StructType([T.StructField(k, T.DoubleType()) for k in ("lat", "lng", "elv")]),
    "ARRAY": T.ArrayType(T.DoubleType()),
}


def spark_type(name: str) -> T.DataType:
    """Spark type of a logical type name, in any casing."""
    try:
        return LOGICAL[name.upper()]
    except KeyError:
        raise ValueError(f"unknown type {name}") from None


def parse_as(text: Column, name: str) -> Column:
    """Text turned into a logical type; what can't be read is null."""
    from lattica.functions import network

    kind = name.upper()
    if kind == "IPV4ADDR":
        return network.ipv4(text)
    if kind == "MACADDR":
        return network.mac(text)
    if kind == "HEX":
        return F.unhex(text)
    if kind == "BASE64":
        return F.try_to_binary(text, F.lit("base64"))
    if kind == "DATE":
        return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy/MM/dd"))
    if kind == "UINT":
        value = text.try_cast("bigint")
        return F.when(value.between(0, 2**32 - 1), value)
    return text.try_cast(spark_type(kind))


def schema(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, spark_type(t)) for n, t in columns])
