"""Parquet tables by name; timestamps without zone are read as UTC wall time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    name = column if isinstance(column, str) else column._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views over the Parquet tables, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
