"""Readers for snapshots, live databases and recorded traces, and the trace sink."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .schemas import TRACE, schema


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's Parquet snapshot under its fixed schema."""
    return spark.read.schema(schema(table)).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options) -> DataFrame:
    """A table of a live database, read in ranges of ``key`` where that is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def now_millis() -> int:
    """The clock, sampled once on the driver; queries take it as an argument."""
    return time.time_ns() // 1_000_000


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Recorded traces, one JSON document each, with the file they came from."""
    return spark.read.schema(TRACE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def trace_records(traces: DataFrame) -> DataFrame:
    """One row for each record, in the order of commits."""
    return traces.select("test", "backend", "topics", F.explode("records").alias("r")).select("test", "backend", "topics", "r.*")


def newest_traces(traces: DataFrame, created: str) -> DataFrame:
    """Of several recordings of one test, the latest."""
    w = W.partitionBy("test").orderBy(F.desc(created), F.desc("database"))
    return traces.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_traces(traces: DataFrame, path: str) -> None:
    """One folder for each test."""
    traces.withColumn("name", F.col("test")).write.partitionBy("name").mode("overwrite").json(path)


def registry(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Definitions that a process registers, as a small table."""
    return spark.createDataFrame(rows, ddl)
