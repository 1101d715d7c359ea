"""Typed access to a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TEXT_TABLES = ("documents", "pages")


class Tables:
    """`Tables(spark, dir).orders` reads `dir/orders.parquet`; Catalyst prunes columns and pushes filters.

    With `partitions` the text tables are dealt out over that many, which a caller asks for where one small file would
    keep a single core busy; otherwise a table is read as its files lie.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.partitions = partitions

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return df.repartition(self.partitions) if self.partitions and name in TEXT_TABLES else df
