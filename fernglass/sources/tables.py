"""Table scans with an empty fallback."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_empty(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The table with the columns of ``schema``; columns it lacks are null, and a missing table is empty."""
    try:
        found = table(spark, folder, name)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([], schema).unionByName(found, allowMissingColumns=True).select(*schema.names)
