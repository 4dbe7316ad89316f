"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import relational as rel


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return rel.scan(self.spark, f"{self.sf_dir}/{name}.parquet")
