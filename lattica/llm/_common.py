"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of texts, that a worker holds as Python objects at once; a longer text is held alone.
ROWS, BYTES = 256, 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of few rows and few bytes in the column ``text``."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield b.slice(at, to - at)
            at = to


def library_threads() -> None:
    """In a worker: as many threads of the tokenizers library as the task has cores, as its idle ones spin."""
    cores = TaskContext.get().cpus()
    os.environ |= {"RAYON_NUM_THREADS": str(cores), "TOKENIZERS_PARALLELISM": "true" if cores > 1 else "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is chosen only on one machine where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor loses nothing.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=compression)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df, written first if its partitions hang on an exchange and might come out otherwise when it is computed again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df, "settled") if "Exchange" in plan else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
