"""Removal of repeated lines with levelled sorted runs of line hashes.

Documents arrive in batches. The store keeps, for every line key seen so far, its two hashes and the document that owns it,
in runs: tables bucketed and sorted by hash, with one file per bucket. A new batch is reduced to its distinct keys (a
combinable minimum, so a line that a third of all documents share costs one row per task) in the same buckets. They are
merge-anti-joined with one run after the other; what is left is new and becomes a run of level 0. When a level has `fanout`
runs they are compacted, bucket by bucket, into one run of the next level, so a key is rewritten once per level. Every key is in one
run only. Runs are read in place: no exchange and no sort stands between a run and the join that reads it.

A store below a folder of its own can be opened again: the list of runs is written after every batch, and the newest whole list counts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z as a-z. Keys of at least `min_chars` code points that
occur in several documents lose all lines except those of the owner.

Defined cases: null or empty text is one empty line. Rows with a null doc_id keep all lines and own none. Rows with the same
doc_id are one document for ownership; each row keeps or loses its own lines. A batch without a key adds no run; an empty table gives no
rows. Extra columns stay where the function returns documents.

Only DataFrame functions run here.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.staging import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a batch.
BATCH_DOCS = 50_000_000
LISTED = "level int, place int, run string, buckets int"
IN_PLACE = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, other letters as they are; the fast path is for plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of every line whose key is long enough; version tells texts of one doc_id apart."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = rows.select("doc_id", "version", "pos", F.btrim("line", F.lit(BLANKS)).alias("bare")).where(F.char_length("bare") >= min_chars)
    keys = keys.select("doc_id", "version", "pos", ascii_lower(F.col("bare")).alias("key"))
    return keys.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The store of line hashes. `add` takes a batch and returns the lines it must lose. `root` names the folder of a store that
    later sessions open again; without it the store lives in the scratch folder until `close`."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2, min_chars: int = 10, root: str | None = None):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.scratch = Scratch(spark, "line-runs")
        self.root, self.lasting = root or self.scratch.path("store"), root is not None
        self.name, self.lists = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.lasting:
            self._reopen()

    # -- the list of runs -------------------------------------------------------------------------------------------

    def _reopen(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lists")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        whole = [int(n) for n in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/lists/{n}/_SUCCESS"))]
        if not whole:
            return
        self.lists = max(whole) + 1
        for r in self.spark.read.schema(LISTED).parquet(f"{self.root}/lists/{max(whole)}").orderBy("level", "place").collect():
            self.buckets = r["buckets"]
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            if r["run"]:
                self.levels[r["level"]].append(r["run"])
                self.spark.sql(f"CREATE TABLE {self._table(r['run'])} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS "
                               f"LOCATION '{self.root}/{r['run']}'")

    def _list(self) -> None:
        if not self.lasting:
            return
        rows = [(level, place, run, self.buckets) for level, runs in enumerate(self.levels) for place, run in enumerate(runs)] or [(0, 0, None, self.buckets)]
        self.spark.createDataFrame(rows, LISTED).coalesce(1).write.parquet(f"{self.root}/lists/{self.lists}")
        self.lists += 1

    # -- runs -------------------------------------------------------------------------------------------------------

    def _table(self, run: str) -> str:
        return f"{self.name}_{run.replace('-', '_')}"

    def _write(self, df: DataFrame, kind: str) -> str:
        """Write rows that are already dealt to the buckets by hash."""
        run = f"{kind}-{uuid.uuid4().hex}"
        with _in_place(self.spark):
            df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{run}").saveAsTable(self._table(run))
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {self._table(run)}")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{run}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _rows(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The bucketed keys that no run holds."""
        for run in self.runs:
            keys = keys.join(self._rows(run).hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def older(self, keys: DataFrame) -> DataFrame | None:
        """(h1, h2, owner) of the bucketed keys that a run holds."""
        found = [keys.join(self._rows(run).hint("merge"), ["h1", "h2"]).select("h1", "h2", "owner") for run in self.runs]
        return reduce(DataFrame.union, found) if found else None

    # -- batches ----------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, version, gone): positions of the lines that a document of this batch (doc_id, text) loses."""
        name = f"lines-{uuid.uuid4().hex}"
        lost = self.add_lines(self.scratch.keep(hashed_lines(docs, self.min_chars), name))
        self.scratch.drop(name)
        return lost

    def add_lines(self, lines: DataFrame) -> DataFrame:
        """As `add`, for a stored batch of hashed lines."""
        keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):  # otherwise the aggregate has dealt them to the buckets
            keys = keys.repartition(self.buckets, "h1", "h2")
        batch = self._write(keys, "batch")
        keys = self._rows(batch)
        with _in_place(self.spark):
            new = self._write(self.fresh(keys).select("h1", "h2", F.col("first").alias("owner")), "run")
            older = self.older(keys)
            # a key that repeats in this batch only is of no run but the new one: its owner is its own first document
            repeated = keys.where("first < last")
            if older is not None:
                repeated = repeated.join(self._rows(new).hint("merge"), ["h1", "h2"], "left_semi")
            repeated = repeated.select("h1", "h2", F.col("first").alias("owner"))
            repeated = self.scratch.keep(repeated if older is None else repeated.union(older), f"repeated-{batch}")
        # both sides are shuffled here, so the rows of a very common line can be split over tasks
        lost = lines.join(repeated, ["h1", "h2"]).where("doc_id <> owner").groupBy("doc_id", "version").agg(F.collect_list("pos").alias("gone"))
        lost = self.scratch.keep(lost, f"lost-{batch}")
        self.scratch.drop(f"repeated-{batch}")
        self._drop(batch)
        replaced: list[str] = []
        self._place(new, 0, replaced)
        self._list()
        for run in replaced:
            self._drop(run)
        return lost

    def _place(self, run: str, level: int, replaced: list[str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self.merged(self.levels[level]), "run")
            replaced += self.levels[level]
            self.levels[level] = []
            self._place(merged, level + 1, replaced)

    def merged(self, runs: list[str]) -> DataFrame:
        """Runs as one, bucket by bucket. Runs share no key, so a full merge join interleaves them in order."""
        found = self._rows(runs[0])
        for run in runs[1:]:
            other = self._rows(run).select("h1", "h2", F.col("owner").alias("other")).hint("merge")
            found = found.join(other, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))
        return found

    def close(self) -> None:
        """Forget the tables; a store without a folder of its own is deleted."""
        for run in self.runs:
            if self.lasting:
                self.spark.sql(f"DROP TABLE {self._table(run)}")
            else:
                self._drop(run)
        self.levels = []


@contextmanager
def _in_place(spark: SparkSession):
    """Plans made here read bucketed tables by bucket and trust their sort order, which holds as each bucket is one file."""
    kept = {key: spark.conf.get(key) for key in IN_PLACE}
    try:
        for key, value in IN_PLACE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def lost_lines(docs: DataFrame, batches: int | None = None, min_chars: int = 10) -> DataFrame:
    """(doc_id, version, gone) over all documents: batches follow doc_id, so the smallest doc_id owns a line. By default a batch has
    about `BATCH_DOCS` documents, and there are four at least."""
    spark = docs.sparkSession
    store, lost = LineRuns(spark, min_chars=min_chars), None
    lines = hashed_lines(docs, min_chars)
    named = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    batches = batches or max(4, -(-named.count() // BATCH_DOCS))
    cuts = [i / batches for i in range(1, batches)]
    cuts = sorted(set(named.approxQuantile("doc_id", cuts, 0.1 / batches))) if cuts else []
    lines = lines.withColumn("batch", sum(((F.col("doc_id") > cut).cast("int") for cut in cuts), F.lit(0)))
    store.scratch.write(lines.write.partitionBy("batch"), "lines")
    lines = spark.read.schema(lines.schema).parquet(store.scratch.path("lines"))
    for number in range(len(cuts) + 1):
        found = store.add_lines(lines.where(F.col("batch") == number).drop("batch"))
        lost = found if lost is None else lost.union(found)
    store.scratch.drop("lines")
    store.close()
    return lost


def _kept(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """All columns plus `_lines`, `_gone` and `_kept` (the text that stays)."""
    lost = lost_lines(docs, batches, min_chars).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("gone").alias("_gone"))
    rows = docs.withColumn("_hash", F.xxhash64("text")).join(lost, (F.col("doc_id") == F.col("_doc")) & (F.col("_hash") == F.col("_version")), "left")
    rows = rows.withColumn("_lines", lines_of(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rows = rows.withColumn("_stay", F.when(F.col("_gone").isNotNull(), stay))
    text = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n"))
    return rows.withColumn("_kept", text)


def line_digests(docs: DataFrame, batches: int | None = None, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the remaining text) of every row of `docs` (doc_id, text)."""
    rows = _kept(docs.select("doc_id", "text"), batches, min_chars)
    n = F.size("_lines").cast("long")
    dropped = F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("_stay"))
    return rows.select("doc_id", n.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, batches: int | None = None, min_chars: int = 10) -> DataFrame:
    """The documents with repeated lines removed; columns as in `docs`, `n_chars` recounted where there is one."""
    rows = _kept(docs, batches, min_chars).withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.col("_kept")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)
