"""Readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Tables:
    """Parquet tables of one folder, each a lazy scan: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             null_value: str = "NA") -> DataFrame:
    """Delimited file with a header.  A given schema saves the inference pass."""
    reader = spark.read.option("header", True).option("nullValue", null_value)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def sink_csv(df: DataFrame, path: str, null_value: str = "NA", mode: str = "errorifexists") -> str:
    """Write one part file per partition; readers take the folder as one table."""
    df.write.mode(mode).option("header", True).option("nullValue", null_value).csv(path)
    return path


def rename_clean(df: DataFrame, pattern: str = " ", to: str = "_") -> DataFrame:
    """Repair every column name with one regex replacement."""
    return df.toDF(*[re.sub(pattern, to, name) for name in df.columns])
