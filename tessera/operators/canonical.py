"""Canonical quarterly history: one actually available observation per asset and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import series as S

ORDER = ["observed_at", "s1", "s2", "s3"]


def canonical_rows(observations: DataFrame, cutoff: str | None = None) -> DataFrame:
    """The latest observation of each asset and quarter that was known at the cutoff."""
    known = observations.filter("observed_at IS NOT NULL AND period_end IS NOT NULL AND price_per_share > 0")
    if cutoff:
        known = known.filter(F.col("observed_at") <= F.lit(cutoff).cast("date"))
    rows = known.select("asset_id", "category", F.col("period_end").alias("canonical_period"), F.col("observed_at").alias("available_at"),
                        "price_per_share", "market_cap", "s1", "s2", "s3")
    return S.keep_last(rows, ["asset_id", "canonical_period"], ["available_at", "s1", "s2", "s3"])


def resolve_history(observations: DataFrame, cutoff: str) -> DataFrame:
    """Every observation with its fate: canonical, lost a collision, after the cutoff, or undated.

    Winners come from a combinable aggregate and are joined back; the skew-join rule may split the large side.
    """
    limit = F.lit(cutoff).cast("date")
    dated = F.col("observed_at").isNotNull() & F.col("period_end").isNotNull()
    known = observations.filter(dated & (F.col("observed_at") <= limit))
    winners = known.groupBy("asset_id", "period_end").agg(F.max(F.struct(*ORDER)).alias("_winner"))
    rows = observations.join(winners, ["asset_id", "period_end"], "left")
    reason = (F.when(~dated, "not_canonical_frequency_or_invalid_date").when(F.col("observed_at") > limit, "after_availability_cutoff")
              .when(F.struct(*ORDER) == F.col("_winner"), "canonical").otherwise("canonical_period_collision"))
    return rows.withColumn("resolution", reason).drop("_winner")


def eligibility_timeline(canonical: DataFrame, baskets: DataFrame) -> DataFrame:
    """Member x period grid of each basket; a period counts only when every member was observed, and nothing is filled."""
    seen = canonical.select("asset_id", "canonical_period", "available_at").join(baskets, "asset_id")
    members = baskets.groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    periods = seen.groupBy("def_id", "canonical_period").agg(F.count(F.lit(1)).alias("n")).join(members, "def_id")
    grid = baskets.join(periods, "def_id").join(seen, ["def_id", "asset_id", "canonical_period"], "left")
    has, whole = F.col("available_at").isNotNull(), F.col("n") == F.col("members")
    return grid.withColumn("has_observation", has).withColumn("eligible", has & whole).withColumn(
        "reason", F.when(~has, "missing_observation_no_fill").when(~whole, "excluded_by_intersection").otherwise("observed"))


def align_history(canonical: DataFrame, baskets: DataFrame) -> DataFrame:
    keep = eligibility_timeline(canonical, baskets).filter("eligible").select("def_id", "asset_id", "canonical_period")
    return keep.join(canonical, ["asset_id", "canonical_period"])


def phase_zero(observations: DataFrame, baskets: DataFrame) -> DataFrame:
    """Counts of raw, unique and shared dates of each basket before anything is simulated."""
    rows = observations.select("asset_id", "observed_at", "period_end").join(baskets, "asset_id")
    members = baskets.groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    unique = rows.groupBy("def_id", "asset_id", "observed_at").agg(F.max("period_end").alias("period_end"), F.count(F.lit(1)).alias("raw"))
    periods = unique.groupBy("def_id", "asset_id", "period_end").agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("unique"))

    def shared(df: DataFrame, column: str, name: str) -> DataFrame:
        per = df.groupBy("def_id", column).agg(F.count(F.lit(1)).alias("n")).join(members, "def_id")
        return per.groupBy("def_id").agg(F.count_if(F.col("n") == F.col("members")).alias(name))

    totals = periods.groupBy("def_id").agg(F.sum("raw").alias("raw_observation_rows"), F.sum("unique").alias("unique_observation_rows"),
                                           F.count(F.lit(1)).alias("unique_canonical_rows"))
    return totals.join(shared(unique, "observed_at", "common_observed_dates"), "def_id").join(
        shared(periods, "period_end", "common_periods"), "def_id")
