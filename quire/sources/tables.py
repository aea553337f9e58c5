"""The driver's parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
