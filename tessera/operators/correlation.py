"""Pairwise correlation structure of many return series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import staged

#: Subjects of a block, and array cells that ranking holds at once.
PER_BLOCK, RANK_CELLS = 128, 1 << 22
PAIR_SCHEMA = "a string, b string, correlation double, overlap bigint, first bigint, last bigint"


def _ranks(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis inside the mask, a bounded number of rows at a time."""
    rows = max(1, RANK_CELLS // max(1, x.shape[1] ** 2))
    if len(x) > rows:
        return np.concatenate([_ranks(x[k : k + rows], mask[k : k + rows]) for k in range(0, len(x), rows)])
    both = mask[:, :, None] & mask[:, None, :]
    less = ((x[:, None, :] < x[:, :, None]) & both).sum(2)
    same = ((x[:, None, :] == x[:, :, None]) & both).sum(2)
    return less + (same + 1) / 2.0


def _block_pairs(left: np.ndarray, right: np.ndarray, method: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Correlation and overlap of each left row with all right rows."""
    for row in left:
        mask = ~np.isnan(row)[None, :] & ~np.isnan(right)
        n = mask.sum(1)
        x, y = np.broadcast_to(row, right.shape), right
        if method == "spearman":
            x, y = _ranks(np.where(mask, x, 0.0), mask), _ranks(np.where(mask, y, 0.0), mask)
        x, y = np.where(mask, x, 0.0), np.where(mask, y, 0.0)
        safe = np.maximum(n, 1)
        xc = np.where(mask, x - (x.sum(1) / safe)[:, None], 0.0)
        yc = np.where(mask, y - (y.sum(1) / safe)[:, None], 0.0)

        def varies(v: np.ndarray) -> np.ndarray:
            return np.where(mask, v, -np.inf).max(1) > np.where(mask, v, np.inf).min(1)

        ok = varies(x) & varies(y)
        scale = np.sqrt((xc * xc).sum(1) * (yc * yc).sum(1))
        corr = np.where(ok & (scale > 0), (xc * yc).sum(1) / np.where(scale > 0, scale, 1.0), np.nan)
        yield corr, n, mask


def correlation_pairs(returns: DataFrame, method: str = "pearson", minimum_overlap: int = 6, per_block: int = PER_BLOCK) -> DataFrame:
    """All unordered pairs `(a, b)` with a < b from `(subject_id, date, ret)`.

    Each subject becomes one vector over the shared calendar. Subjects are dealt to blocks of about `per_block`, so their number grows with the
    subjects, and each pair of blocks is one task of dense array work that holds two blocks, however many subjects there are. Pairs are
    never expanded to rows per period.
    """
    rows = returns.filter("ret IS NOT NULL")
    calendar = rows.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    vectors = rows.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("date", "ret"))).alias("cells"))
    count = rows.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("subject_id") / F.lit(per_block))).cast("int").alias("blocks"))
    dense = vectors.join(calendar).join(count).select("subject_id", "blocks", F.transform("dates", lambda d: F.col("cells")[d]).alias("v"))
    placed = dense.withColumn("block", F.pmod(F.xxhash64("subject_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("subject_id", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        matrix = lambda f: np.array([np.array(v, dtype=float) for v in f["v"]]).reshape(len(f), -1)
        names, parts = right["subject_id"].to_numpy(), []
        if len(left) and len(right):
            for name, (corr, n, mask) in zip(left["subject_id"], _block_pairs(matrix(left), matrix(right), method)):
                keep = (names != name if i != j else names > name)
                first, last = mask.argmax(1), mask.shape[1] - 1 - mask[:, ::-1].argmax(1)
                enough, none = (n >= minimum_overlap) & ~np.isnan(corr), n == 0
                part = pd.DataFrame({"a": name, "b": names, "correlation": np.where(enough, corr, np.nan), "overlap": n, "first": np.where(none, -1, first), "last": np.where(none, -1, last)})[keep]
                swap = part["a"] > part["b"]
                part.loc[swap, ["a", "b"]] = part.loc[swap, ["b", "a"]].to_numpy()
                parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in PAIR_SCHEMA.split(", ")})

    pairs = placed.groupBy("i", "j").applyInPandas(solve, PAIR_SCHEMA).join(calendar)
    value = F.when(~F.isnan("correlation"), F.col("correlation"))
    day = lambda c: F.when(F.col(c) >= 0, F.get("dates", F.col(c).cast("int")))
    return pairs.select("a", "b", value.alias("correlation"), "overlap", day("first").alias("overlap_start"), day("last").alias("overlap_end"))


def distance(correlation: Column | str, method: str = "sqrt") -> Column:
    c = F.col(correlation) if isinstance(correlation, str) else correlation
    clipped = F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    return F.sqrt(0.5 * (1 - clipped)) if method == "sqrt" else 1 - clipped


def clusters(pairs: DataFrame, subjects: DataFrame, cut: float) -> DataFrame:
    """Single-linkage clusters at a distance cut: connected components by minimum-label propagation.

    Every round is kept in the checkpoint folder; labels also jump to the label of their label, so the number of
    rounds grows with the logarithm of the longest chain rather than its length.
    """
    near = pairs.filter(F.col("distance") <= cut)
    edges = staged(near.select(F.col("a").alias("u"), F.col("b").alias("v")).union(near.select("b", "a")))
    labels = staged(subjects.select(F.col("subject_id").alias("v"), F.col("subject_id").alias("label")))
    while True:
        heard = edges.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("heard"))
        step = labels.join(heard, "v", "left").select("v", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("further"))
        fresh = staged(step.join(jump, "label", "left").select("v", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        if fresh.filter("label <> old").isEmpty():
            return fresh.select(F.col("v").alias("subject_id"), F.col("label").alias("cluster_id"))
        labels = fresh.select("v", "label")
