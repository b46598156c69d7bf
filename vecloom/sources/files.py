"""Reading and writing tables with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.codec import format_vector, parse_vector


def write_csv(df: DataFrame, path: str, vector_col: str = "vec") -> None:
    df.withColumn(vector_col, format_vector(F.col(vector_col))).write.option("header", True).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, vector_col: str = "vec") -> DataFrame:
    """``schema`` names the vector column as string; it comes back as array<float>."""
    return spark.read.option("header", True).schema(schema).csv(path).withColumn(vector_col, parse_vector(vector_col))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
