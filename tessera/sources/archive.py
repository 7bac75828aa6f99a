"""A partitioned archive whose newest state is swapped in whole, and an append-only ledger of import runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

ENTRIES = "part string, folder string, rows long"
LEDGER = "run_key string, run_id string, input_hash decimal(38,0), input_rows long, accepted_rows long, rejected_rows long, warning_rows long, importer_version string, status string"


class Files:
    """The few file-system calls that Spark's writers do not cover, on whatever store the path names."""

    def __init__(self, spark: SparkSession):
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def _of(self, path: str):
        p = self._path(path)
        return p, p.getFileSystem(self._conf)

    def names(self, path: str) -> list[str]:
        p, fs = self._of(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def rename(self, source: str, target: str) -> bool:
        """False when the target is there already: the first writer wins."""
        p, fs = self._of(source)
        q = self._path(target)
        fs.mkdirs(q.getParent())
        return not fs.exists(q) and fs.rename(p, q)

    def delete(self, path: str) -> None:
        p, fs = self._of(path)
        fs.delete(p, True)


class Archive:
    """Rows of a table by partition value below one folder.

    A refresh writes its partitions beside the current ones, validates what was written, and then renames a manifest into place that
    names, for every partition value, the folder that holds it. Readers follow the newest manifest, so a refresh that fails or is killed
    at any point leaves the old archive as it was. Two refreshes at once: the second to finish fails and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, partition: str, keys: list[str], writers: int = 4):
        self.spark, self.folder, self.partition, self.keys, self.writers = spark, folder, partition, keys, writers
        self.files, self.schema = Files(spark), schema

    def _manifests(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.folder}/manifests") if n.isdigit())

    def entries(self) -> dict[str, tuple[str, int]]:
        """Folder and rows of every partition of the newest state; one entry per partition value."""
        found = self._manifests()
        if not found:
            return {}
        rows = self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/manifests/{found[-1]}").collect()
        return {r["part"]: (r["folder"], r["rows"]) for r in rows}

    def read(self) -> DataFrame:
        folders = [f"{self.folder}/data/{folder}/{part}" for part, (folder, _) in sorted(self.entries().items())]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def publish(self, df: DataFrame) -> int:
        """Replace the partitions that `df` holds; returns the rows written. Rows of a partition are dealt to `writers` tasks by the hash of their
        keys, so a partition with most rows is not one task's work. `df` is computed once."""
        based_on, current = self._manifests(), self.entries()
        version = f"v-{uuid.uuid4().hex}"
        stage = f"{self.folder}/data/{version}"
        dealt = df.withColumn("_part", F.col(self.partition)).withColumn("_writer", F.pmod(F.xxhash64(*self.keys), F.lit(self.writers)))
        dealt.repartition("_part", "_writer").drop("_writer").write.partitionBy("_part").parquet(stage)
        parts = [n for n in self.files.names(stage) if n.startswith("_part=")]
        counts = self._validated(stage, parts)
        rows = [(part, folder, n) for part, (folder, n) in {**current, **{p: (version, counts[p]) for p in parts}}.items()]
        waiting = f"{self.folder}/data/{version}/_manifest"
        self.spark.createDataFrame(rows, ENTRIES).coalesce(1).write.parquet(waiting)
        if not self.files.rename(waiting, f"{self.folder}/manifests/{(based_on or [0])[-1] + 1}"):
            self.files.delete(stage)
            raise RuntimeError("another refresh came first; nothing was changed")
        return sum(counts.values())

    def _validated(self, stage: str, parts: list[str]) -> dict[str, int]:
        """Rows per written partition; raises, and removes what was written, when keys repeat or are missing."""
        out: dict[str, int] = {}
        if parts:
            written = self.spark.read.schema(self.schema).parquet(*[f"{stage}/{p}" for p in parts])
            missing = F.lit(False)
            for key in self.keys:
                missing = missing | F.col(key).isNull()
            checked = written.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"), F.max(missing).alias("_missing")).agg(F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if("_missing").alias("missing")).first()
            if checked["repeated"] or checked["missing"]:
                self.files.delete(stage)
                raise ValueError(f"{checked['repeated']} repeated and {checked['missing']} missing values of {self.keys}; the archive stays as it was")
            by_part = written.groupBy(F.regexp_extract(F.input_file_name(), "/(_part=[^/]*)/", 1).alias("part")).count()
            out = {r["part"]: r["count"] for r in by_part.collect()}
        return {p: out.get(p, 0) for p in parts}

    def sweep(self) -> list[str]:
        """Delete versions that the newest manifest does not name, and older manifests; for times without readers or refreshes."""
        found, used = self._manifests(), {folder for folder, _ in self.entries().values()}
        gone = [v for v in self.files.names(f"{self.folder}/data") if v not in used]
        for v in gone:
            self.files.delete(f"{self.folder}/data/{v}")
        for n in found[:-1]:
            self.files.delete(f"{self.folder}/manifests/{n}")
        return gone


def append_run(spark: SparkSession, folder: str, row: DataFrame) -> bool:
    """Add one run (columns of `LEDGER`) to the ledger below `folder`; False when a run of the same key is there already. Every run is a folder
    named by its key and renamed into place, so repeats and retries add nothing and no earlier row is touched."""
    files = Files(spark)
    waiting = f"{folder}/waiting/{uuid.uuid4().hex}"
    row.select([f.name for f in StructType.fromDDL(LEDGER)]).coalesce(1).write.parquet(waiting)
    key = spark.read.schema(LEDGER).parquet(waiting).first()["run_key"]
    added = files.rename(waiting, f"{folder}/runs/{key}")
    files.delete(f"{folder}/waiting")
    return added


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    keys = Files(spark).names(f"{folder}/runs")
    return spark.read.schema(LEDGER).parquet(*[f"{folder}/runs/{k}" for k in keys]) if keys else spark.createDataFrame([], LEDGER)
