"""The corpus pipeline: accept good documents, drop repeated lines, keep one of each near-duplicate group, mix the sources, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.jaccard import jaccard_components
from tessera.llm.linededup import drop_repeated_lines
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import pack
from tessera.llm.quality import accept
from tessera.llm.staging import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by shingle similarity; a null id links with nothing here. Repeated rows of that id with one text stay
    one row each."""
    groups = jaccard_components(docs).select(F.col("doc_id").alias("member"), "component_id").where("member <> component_id").distinct()
    return docs.join(groups, docs["doc_id"] == groups["member"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in training order; a document appears once per pass that takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed into sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: The classifier, the tokenizer and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
