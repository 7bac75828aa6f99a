"""Readers and sinks of the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.functions.columns import first_nonblank
from tessera.operators.series import PRICE_EVENTS, QUARTERLY_EVENTS, keep_last
from tessera.session import checkpoint_dir

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV; a row that does not fit the schema keeps its text in `_corrupt_record`."""
    fields = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return (spark.read.schema(f"{fields}, {CORRUPT} STRING").option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} STRING" for c in columns)).option("header", True).csv(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area."""
    return f"{checkpoint_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def conform(df: DataFrame, fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Fixed column order and types; each target takes the first alias that exists and is filled, else NULL."""
    out = []
    for name, (kind, aliases) in fields.items():
        present = [c for c in aliases if c in df.columns]
        if not present:
            value: Column = F.lit(None)
        elif kind == "string":
            value = first_nonblank(*present)
        else:
            value = F.coalesce(*[F.col(c).cast("string").try_cast(kind) for c in present])
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def union_keep_last(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Stacked sources; the row of the last source, then the last in `order`, wins each key."""
    ranked = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    return keep_last(both, keys, ["_src", *order]).drop("_src")


def secondary_view(observations: DataFrame) -> DataFrame:
    """Secondary-market observations with their provenance."""
    o = observations.filter(F.col("event_type").isin(PRICE_EVENTS) & (F.col("price_per_share") > 0))
    return o.withColumn("source", F.concat_ws(":", F.lit("manual"), "event_type", "precision_status"))


def quarterly_view(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("event_type").isin(QUARTERLY_EVENTS) & (F.col("price_per_share") > 0) & F.col("period_end").isNotNull())


# --- sinks --------------------------------------------------------------------------------

def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")


def write_json_lines(df: DataFrame, folder: str) -> None:
    """One JSON document per row; a large report stays many part files."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def encoded_row(columns: list[str]) -> Column:
    """A row as one text that no other row has: every field with its length, a missing one as N."""
    fields = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.when(f.isNull(), F.lit("N;")).otherwise(F.concat(F.char_length(f).cast("string"), F.lit(":"), f, F.lit(";"))) for f in fields])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash and row count of a table as a multiset: sums of 60-bit row hashes, no sort and no collected rows."""
    part = F.conv(F.substring(F.md5(encoded_row(df.columns)), 1, 15), 16, 10).cast("bigint")
    return df.agg(F.coalesce(F.sum(part.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"), F.count(F.lit(1)).alias("rows"))


def ledger_row(verdicts: DataFrame, source: DataFrame, importer: str, version: str = "1") -> DataFrame:
    """One audit row of an import: counts of accepted, rejected and warned rows, the content hash of its source, and the key that a
    repeat of the same import has as well."""
    counts = verdicts.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if("accepted").alias("accepted_rows"), F.count_if(~F.col("accepted")).alias("rejected_rows"),
                          F.count_if(F.col("warning_reason") != "").alias("warning_rows"))
    content = fingerprint(source).select(F.col("checksum").alias("input_hash"), F.col("rows").alias("_rows"))
    key = F.sha2(F.concat_ws("|", F.lit(importer), F.lit(version), F.col("input_hash").cast("string"), F.col("_rows").cast("string")), 256)
    return counts.join(content).select(
        key.alias("run_key"), F.concat(F.lit(f"{importer}-"), F.substring(key, 1, 12)).alias("run_id"), "input_hash", "input_rows", "accepted_rows", "rejected_rows", "warning_rows",
        F.lit(version).alias("importer_version"), F.when(F.col("rejected_rows") > 0, "completed_with_rejections").otherwise("completed").alias("status"))
