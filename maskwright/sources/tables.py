"""Tables as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that a task works on at most.
PART = 16 << 20


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table, in tasks for all cores and of up to PART bytes of it each. Unless it has as many files as that, its rows
    go through an exchange, so that a task's work does not grow with the table: a row group is one task's, however it is split."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-size_of(spark, path) // (PART * cores)))  # so that all cores end together
    return df if len(df.inputFiles()) >= tasks and df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
