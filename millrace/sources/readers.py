"""Reading relations: parquet folders, tables and small CSV files of fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def relation(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, or a table, or a path of parquet files."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def csv_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and an explicit schema; quoted fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
