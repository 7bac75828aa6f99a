"""Session construction. Cluster settings win: only unset keys get a default."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage; a local one is made only when the cluster names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(writer: DataFrameWriter, path: str, spark: SparkSession) -> None:
    """Write as Parquet; the shuffle files behind the table go as soon as it is there."""
    kept = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)


def store(df: DataFrame) -> str:
    """The path of a new table of `df` in the shared checkpoint folder: one file per task, its rows in their order."""
    path = f"{checkpoint_dir(df.sparkSession)}/tessera/staged-{uuid.uuid4().hex}"
    write_parquet(df.write.option("compression", "zstd").option("maxRecordsPerFile", 0), path, df.sparkSession)
    return path


def staged(df: DataFrame) -> DataFrame:
    """A reduced intermediate result as a table in the shared checkpoint folder: later steps neither recompute nor re-plan
    it, read only the columns they need, and a lost executor costs nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete tables of `store` that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
