"""Dumps of pages in XML, and tables by name in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_pages(spark: SparkSession, path: str, schema: str, row: str = "page") -> DataFrame:
    """Elements of a dump as rows; files are split by element, so large dumps are read in parallel."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def recoverable(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the tables in a folder that begin with a prefix."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)) if fs.exists(p) else []
