"""The archive that is swapped in whole, the ledger of runs, and the content hash."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.sources import tables as IO
from tessera.sources.archive import LEDGER, Archive, append_run, read_ledger

SCHEMA = "k long, day date, v double, year int"


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "a"), SCHEMA, "year", ["k", "day"])


def rows(spark, years, v, n=20):
    return spark.createDataFrame([(k, dt.date(y, 1, 1 + k), v, y) for y in years for k in range(n)] , SCHEMA)


def state(archive):
    return {(r["year"], r["v"]): r["n"] for r in archive.read().groupBy("year", "v").agg(F.count("*").alias("n")).collect()}


def test_refresh_replaces_its_partitions_only(spark, archive):
    assert archive.read().count() == 0
    assert archive.publish(rows(spark, [2000, 2001], 1.0)) == 40
    archive.publish(rows(spark, [2001, 2002], 2.0))
    assert state(archive) == {(2000, 1.0): 20, (2001, 2.0): 20, (2002, 2.0): 20} and archive.read().columns == ["k", "day", "v", "year"]
    archive.publish(rows(spark, [], 3.0))
    archive.publish(spark.createDataFrame([(1, dt.date(1990, 1, 1), 9.0, None)], SCHEMA))
    assert state(archive)[(None, 9.0)] == 1 and len(state(archive)) == 4
    before = state(archive)
    assert len(archive.sweep()) == 1 and state(archive) == before and archive.sweep() == []


def test_a_killed_or_invalid_refresh_changes_nothing(spark, archive, monkeypatch):
    archive.publish(rows(spark, [2000, 2001], 1.0))
    before = state(archive)
    with pytest.raises(ValueError, match="20 repeated"):
        archive.publish(rows(spark, [2001], 2.0).union(rows(spark, [2001], 3.0)))
    with pytest.raises(ValueError, match="1 missing"):
        archive.publish(spark.createDataFrame([(None, dt.date(2001, 1, 1), 1.0, 2001)], SCHEMA))
    assert state(archive) == before
    with monkeypatch.context() as m:
        m.setattr(archive.files, "rename", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            archive.publish(rows(spark, [2000, 2001], 5.0))
    assert state(archive) == before
    with pytest.raises(Exception, match="(?i)divide|division"):
        archive.publish(rows(spark, [2001], 2.0).withColumn("v", F.lit(1.0) / F.col("k")))
    assert state(archive) == before
    other = Archive(spark, archive.folder, SCHEMA, "year", ["k", "day"])
    sound = other._validated
    monkeypatch.setattr(other, "_validated", lambda *a: (archive.publish(rows(spark, [2000], 7.0)), sound(*a))[1])
    with pytest.raises(RuntimeError, match="came first"):
        other.publish(rows(spark, [2000], 8.0))
    assert state(archive) == {(2000, 7.0): 20, (2001, 1.0): 20}


def test_a_large_partition_has_several_writers(spark, archive):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archive.publish(rows(spark, [2000], 1.0, n=28))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (part, (folder, n)), = archive.entries().items()
    files = [f for f in archive.files.names(f"{archive.folder}/data/{folder}/{part}") if f.endswith(".parquet")]
    assert n == 28 and 1 < len(files) <= 4


def test_ledger_keeps_one_row_per_run(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    verdicts = spark.createDataFrame([(True, ""), (False, "x"), (True, "y")], "accepted boolean, warning_reason string")
    source = spark.createDataFrame([("a", None), ("b", "")], "k string, v string")
    assert read_ledger(spark, folder).count() == 0
    assert append_run(spark, folder, IO.ledger_row(verdicts, source, "assets"))
    assert not append_run(spark, folder, IO.ledger_row(verdicts, source.orderBy(F.desc("k")), "assets"))
    assert append_run(spark, folder, IO.ledger_row(verdicts, source.fillna("z"), "assets")) and append_run(spark, folder, IO.ledger_row(verdicts, source, "prices"))
    got = read_ledger(spark, folder).collect()
    assert len(got) == 3 == len({r["run_key"] for r in got}) and {(r["accepted_rows"], r["rejected_rows"], r["warning_rows"], r["status"]) for r in got} == {(2, 1, 2, "completed_with_rejections")}
    assert [f.split()[0] for f in LEDGER.split(", ")] == got[0].__fields__


def test_content_hash_tells_missing_from_empty_and_fields_apart(spark):
    def of(*rows):
        return IO.fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first()["checksum"]

    assert of(("x", None)) != of(("x", "")) != of(("", "x")) and of(("a;", "b")) != of(("a", ";b")) and of(("N", None)) != of((None, "N"))
    assert of(("x", "y"), ("p", "q")) == of(("p", "q"), ("x", "y")) != of(("x", "y"), ("x", "y"))
    assert IO.fingerprint(spark.createDataFrame([], "a string")).first()["checksum"] == 0
