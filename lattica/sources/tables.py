"""Stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.types import schema


def load(spark: SparkSession, path: str, alias: str | None = None, ranges: list[tuple] | None = None, on: str | None = None) -> DataFrame:
    """A stored relation; with ranges, only rows of ``on`` inside one of them (None: open end).

    Ranges are exact for rows, and the files' statistics skip what lies outside.
    """
    df = spark.read.parquet(path)
    if ranges:
        test: Column | None = None
        for low, high in ranges:
            own = F.lit(True)
            own = own if low is None else own & (F.col(on) >= F.lit(low))
            own = own if high is None else own & (F.col(on) <= F.lit(high))
            test = own if test is None else test | own
        df = df.filter(test)
    return df.alias(alias) if alias else df


def create(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    """An empty relation with logical column types."""
    return spark.createDataFrame([], schema(columns))


class Relations:
    """Relations by name under a folder: create, store, load, empty and drop."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def create(self, name: str, columns: list[tuple[str, str]]) -> None:
        self.schemas[name] = schema(columns)

    def known(self, name: str) -> bool:
        return name in self.schemas

    def load(self, name: str, **options) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return load(self.spark, self.path(name), **options)
        except AnalysisException:
            if name not in self.schemas:
                raise
            return self.spark.createDataFrame([], self.schemas[name])

    def store(self, df: DataFrame, name: str, columns: dict[str, Column] | None = None, overwrite: bool = False) -> None:
        from lattica.sources.sinks import store

        out = store(df, self.path(name), columns, overwrite, self.schemas.get(name))
        self.schemas.setdefault(name, out.schema)

    def cluster(self, name: str, column: str) -> DataFrame:
        """Rewrite the relation in the order of a column, so that range loads skip files; returns the zone map."""
        from lattica.sources.sinks import cluster, zone_map

        beside = self.path(name) + ".clustered"
        cluster(self.load(name), column, beside)
        jvm = self.spark._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(self.path(name)), jvm.org.apache.hadoop.fs.Path(beside)
        files = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.rename(new, old)
        self.spark.catalog.refreshByPath(self.path(name))
        return zone_map(self.load(name), column)

    def delete_content(self, name: str) -> None:
        own = self.schemas.get(name) or self.load(name).schema
        self.schemas[name] = own
        self.spark.createDataFrame([], own).write.mode("overwrite").parquet(self.path(name))

    def delete(self, name: str) -> None:
        """Forget the relation and remove its files, through the file system that the path names."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.schemas.pop(name, None)
