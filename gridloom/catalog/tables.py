"""The Parquet tables that the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def show_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make tables known to SQL under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
