"""Exact token counts: a histogram of encoded lengths, and suffix sums over it that answer every context limit.

The histogram is a combinable aggregate, so a frequent length costs one row per task. Its rows are the distinct lengths. The
running sums go over blocks of lengths first and within each block second, so no task sorts all lengths at once.

Defined cases: null text is empty and has length 0 (plus the end token if asked for). Repeated rows count each. No documents:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.staging import Scratch
from tessera.llm.tokens import encode_all, vocabulary_path

BLOCK = 1_024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(ids) for ids in encode_all(batch.column("text").to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) of `docs` (text)."""
    lengths = docs.select("text").mapInArrow(_lengths(vocabulary or vocabulary_path()), "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For every encoded length L, taken as a context limit: documents of that length, documents and tokens of at least it,
    all tokens of documents cut at L, tokens lost by the cut, and the share of documents of at most L (a quantile's inverse). Between two rows all values follow from the upper row: `truncated_tokens` falls by `docs_at_least` per token."""
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block"))
    later = after.rowsBetween(Window.unboundedPreceding, -1)
    every = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("block", F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
                           F.sum("block_docs").over(every).alias("all_docs"), F.sum("block_tokens").over(every).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(totals, "block").withColumn("docs_at_least", F.sum("n_docs").over(own) + F.col("later_docs")).withColumn("tokens_at_least", F.sum("tokens").over(own) + F.col("later_tokens"))
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")
    return rows.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), (F.col("all_tokens") - cut).alias("lost_tokens"), share.alias("share_at_most"), "all_docs", "all_tokens")


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The context table of `docs`. The histogram is stored, so texts are encoded once although totals and rows both read it."""
    return context_table(Scratch(docs.sparkSession, "token-counts").keep(length_histogram(docs, vocabulary), "histogram"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context, longer_docs, truncated_tokens, lost_tokens) for any context limits, from a context table: documents above the limit, all tokens
    of documents cut at it, and the tokens lost by the cut. Between two lengths every value follows from the upper one."""
    limit, n = F.col("context"), F.col("n_tokens")
    rows = table.withColumn("context", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in limits])))
    above = F.when(n >= limit, n)
    found = rows.groupBy("context").agg(
        F.min(above).alias("upper"), F.min_by(F.struct("docs_at_least", "n_docs", "truncated_tokens"), above).alias("row"), F.max("all_tokens").alias("all_tokens"))
    docs = F.when(F.col("upper") == limit, F.col("row.docs_at_least") - F.col("row.n_docs")).otherwise(F.coalesce("row.docs_at_least", F.lit(0)))
    kept = F.coalesce(F.col("row.truncated_tokens") - F.col("row.docs_at_least") * (F.col("upper") - limit), F.col("all_tokens"))
    return found.select("context", F.when(F.col("upper").isNull(), 0).otherwise(docs).alias("longer_docs"), kept.alias("truncated_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"))


def length_quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    wanted = table.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where("share_at_most >= share")
    return wanted.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
