"""Intermediate tables in the shared checkpoint folder, dropped when a later table replaces them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import checkpoint_dir, write_parquet


class Scratch:
    """One folder below `spark.checkpoint.dir`. Tables are written with Spark's commit protocol, so a lost executor only
    repeats its tasks; what a returned DataFrame still reads stays, everything else is dropped as soon as it is used up."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/tessera-llm/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.write(df.write, name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write(self, writer, name: str) -> None:
        """Write as Parquet; the shuffle files behind the table go as soon as it is there."""
        write_parquet(writer, self.path(name), self.spark)

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
