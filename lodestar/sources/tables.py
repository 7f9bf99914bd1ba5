"""Sources and guards: reading tables, unique keys and validated indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, failing at run time if a key occurs twice."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("an item with the same key has already been added"))).otherwise(F.col("_row"))
    return counts.select(checked.alias("_row")).select("_row.*")


def valid(df: DataFrame, condition: str, message: str) -> DataFrame:
    """`df`, failing at run time on a row for which the condition is not true."""
    guard = F.when(F.expr(condition), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.withColumn("_ok", guard).where("_ok").drop("_ok")
