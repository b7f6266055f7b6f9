"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``, only the given columns if any; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path`` with ``schema``; an absent path is an empty table."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
