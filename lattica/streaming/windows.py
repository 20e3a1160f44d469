"""Windows over event time with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _grouped(df: DataFrame, time: str, delay: str, window: Column, keys: list[str], values: dict[str, Column]) -> DataFrame:
    own = df.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take no timestamps without a zone
    own = own.withWatermark(time, delay) if df.isStreaming else own
    out = own.groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in values.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *values)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], values: dict[str, Column], delay: str = "0 seconds") -> DataFrame:
    return _grouped(df, time, delay, F.window(time, width), keys, values)


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: list[str], values: dict[str, Column], delay: str = "0 seconds") -> DataFrame:
    return _grouped(df, time, delay, F.window(time, width, slide), keys, values)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], values: dict[str, Column], delay: str = "0 seconds") -> DataFrame:
    """Sessions of a key end after a gap without rows."""
    return _grouped(df, time, delay, F.session_window(time, gap), keys, values)


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result table; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
