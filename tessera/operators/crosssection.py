"""Cross-sectional tables: exports, filters, scores, rankings and point-in-time metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change, clip, ratio
from tessera.operators import series as S
from tessera.operators.market import contains_text
from tessera.operators.quantiles import exact_quantiles
from tessera.session import staged


def quality_band(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.45, "medium").otherwise("low")


def universe_export(quotes: DataFrame, liquidity: DataFrame, confidence: DataFrame) -> DataFrame:
    rows = S.with_returns(quotes, "asset_id")
    latest = quotes.groupBy("asset_id").agg(F.max("date").alias("latest"))
    down = F.when(F.col("ret") < 0, F.col("ret"))

    def back(days: int):
        return F.max_by("price", F.when(F.col("date") <= F.date_sub("latest", days), F.col("date")))

    now = F.max_by("price", "date")
    agg = rows.join(latest, "asset_id").groupBy("asset_id").agg(
        now.alias("price"), *[change(now, back(d)).alias(f"return_{d}d") for d in (1, 7, 30)],
        F.stddev_pop("ret").alias("sd"), F.avg("ret").alias("mean"), F.stddev_pop(down).alias("dsd"), F.count(down).alias("dn"))
    year = 252**0.5
    return agg.join(liquidity.select("asset_id", "max_drawdown"), "asset_id").join(confidence, "asset_id").select(
        "asset_id", "price", "return_1d", "return_7d", "return_30d", F.coalesce(F.col("sd") * year, F.lit(0.0)).alias("volatility"),
        ratio(F.col("mean") * 252, F.nullif(F.col("sd") * year, F.lit(0.0))).alias("sharpe"),
        F.when(F.col("dn") > 1, ratio(F.col("mean") * 252, F.nullif(F.col("dsd") * year, F.lit(0.0)))).alias("sortino"),
        "max_drawdown", quality_band(F.col("source_confidence")).alias("source_quality"))


def filter_market(table: DataFrame, search: str = "", categories: list[str] | None = None, valuation: str = "all",
                  min_confidence: float = 0.0, listed_only: bool = True) -> DataFrame:
    out = table.filter("is_current_listed") if listed_only else table
    if search:
        out = out.filter(contains_text(["ticker", "name"], search))
    if categories:
        out = out.filter(F.col("category").isin(categories))
    if valuation == "above":
        out = out.filter("premium_discount_to_fair_value > 0")
    elif valuation == "below":
        out = out.filter("premium_discount_to_fair_value < 0")
    if min_confidence > 0:
        out = out.filter(F.coalesce("nav_confidence", F.lit(0.0)) >= min_confidence)
    return out


# --- subjects and point-in-time metrics ---------------------------------------------------

# Metric -> (lower is better, minimum returns, minimum years of history).
LEADERBOARD_METRICS = {
    "latest_quarter_return": (False, 1, 0.0), "trailing_2q_return": (False, 2, 0.45), "trailing_1y_return": (False, 4, 1.0),
    "trailing_2y_return": (False, 8, 2.0), "trailing_3y_return": (False, 12, 3.0), "total_return": (False, 1, 0.0),
    "cagr": (False, 1, 1.0), "annualized_mean_return": (False, 1, 0.0), "annualized_volatility": (True, 2, 0.0),
    "maximum_drawdown": (True, 1, 0.0), "downside_deviation": (True, 2, 0.0), "sharpe_ratio": (False, 2, 0.0),
    "sortino_ratio": (False, 2, 0.0), "calmar_ratio": (False, 1, 1.0), "positive_period_percentage": (False, 1, 0.0),
    "consecutive_positive_periods": (False, 1, 0.0), "best_quarter": (False, 1, 0.0), "worst_quarter": (True, 1, 0.0),
    "median_period_return": (False, 1, 0.0), "current_price": (False, 1, 0.0), "market_cap": (False, 1, 0.0),
    "offering_valuation": (False, 1, 0.0), "premium_to_offering": (False, 1, 0.0), "observation_count": (False, 1, 0.0),
    "history_years": (False, 1, 0.0), "observation_age_days": (True, 1, 0.0),
}
STALE_DAYS = 186
#: Digits that decide a rank: money to five digits, finer than any price and coarser than what sums lose; all else to the precision that sums keep. What then is equal goes by id.
RANK_DIGITS, MONEY_DIGITS, MONEY = 9, 5, ("current_price", "market_cap", "offering_valuation")


def collect_subjects(assets: DataFrame, observations: DataFrame, indices: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """One long series `(subject_id, subject_type, category, date, value, shares, offering_price)` over everything ranked."""
    meta = assets.select("asset_id", F.col("share_count").alias("shares"), F.col("offering_price_usd").alias("offering_price"))
    last = observations.filter("price_per_share > 0").groupBy("asset_id", "category", F.col("observed_at").alias("date")).agg(
        F.max_by("price_per_share", F.struct("s1", "s2", "s3")).alias("value"))
    a = last.join(meta, "asset_id").select(
        F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("subject_id"), F.lit("asset").alias("subject_type"),
        "category", "date", "value", "shares", "offering_price")
    kind = F.when(F.col("family") == "all", "market_index").when(F.col("weighting") == "equal", "equal_weight_index").otherwise("cap_weight_index")
    i = indices.select(F.concat_ws(":", F.lit("index"), "family", "weighting").alias("subject_id"), kind.alias("subject_type"),
                       F.col("family").alias("category"), "date", F.col("index_level").alias("value"))
    b = benchmarks.select(F.concat(F.lit("benchmark:"), "ticker").alias("subject_id"), F.lit("benchmark").alias("subject_type"),
                          F.lit("public").alias("category"), "date", F.col("adjusted_close").alias("value"))
    return a.unionByName(i, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)


def point_in_time_metrics(subjects: DataFrame, start: str, end: str) -> DataFrame:
    """All metrics of every subject at every quarter end, from what was known by then.

    The quarterly as-of value of a subject does not depend on the snapshot, so each metric is an expanding window over
    one row per subject and quarter instead of one recomputation per snapshot.
    """
    ids, meta = ["subject_id"], ["subject_type", "category", "shares", "offering_price"]
    first = F.row_number().over(S.over([*ids, *meta])) == 1
    rows = subjects.withColumns({"obs_no": F.row_number().over(S.over(ids)), "_first": first, "first_observed": F.col("date")})
    # the quarters of a subject come out of its first row, so observations and quarters meet where they are: rows are shuffled once
    known = F.struct(F.col("date").alias("effective_date"), "value", "obs_no")
    quarters = F.transform(S.period_array(F.lit(start).cast("date"), F.lit(end).cast("date"), "quarter"), lambda d: F.struct(
        d.alias("date"), F.lit(1).alias("_grid"), F.when(F.lit(False), known).alias("_known")))
    observed = F.array(F.struct("date", F.lit(0).alias("_grid"), known.alias("_known")))
    q = rows.select(*ids, *meta, "first_observed", F.explode(F.when(F.col("_first"), F.concat(observed, quarters)).otherwise(observed)).alias("_row"))
    upto_day = Window.partitionBy(*ids).orderBy("date", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    q = q.select(*ids, *meta, "first_observed", "_row.*").withColumn("_seen", F.last("_known", ignorenulls=True).over(upto_day))
    q = q.filter("_grid = 1").select(*ids, "date", *meta, "first_observed", "_seen.*")
    age = F.datediff("date", "effective_date")
    q = q.withColumns({"age": age, "v": F.when(age <= STALE_DAYS, F.col("value"))})
    w, upto = S.over(ids), S.running(ids)
    before = S.over(ids).rowsBetween(Window.unboundedPreceding, -1)
    known_date = F.when(F.col("v").isNotNull(), F.col("date"))
    q = q.withColumns({
        "prev": F.last("v", ignorenulls=True).over(before), "prev_date": F.last(known_date, ignorenulls=True).over(before),
        "now": F.last("v", ignorenulls=True).over(upto), "first": F.first("v", ignorenulls=True).over(upto),
        "now_date": F.last(known_date, ignorenulls=True).over(upto), "first_date": F.first(known_date, ignorenulls=True).over(upto),
        "peak": F.max("v").over(upto)})
    # returns below 1e-12 are rounding noise of a flat series
    q = q.withColumns({"ret": F.round(change("v", "prev"), 12), "dd": F.round(change("v", "peak"), 12),
                       "gap": F.when(F.col("v").isNotNull(), F.datediff("date", "prev_date")),
                       "island": F.count_if(F.round(change("v", "prev"), 12) <= 0).over(upto)})
    short_back = F.last_day(F.add_months("date", -6)) == F.add_months("date", -6)

    def trailing(rows: int) -> Column:
        return change("now", F.lag("now", rows).over(w))

    down2 = F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).when(F.col("ret").isNotNull(), 0.0)).over(upto)
    years = F.datediff("now_date", "first_date") / 365.25
    q = q.withColumns({
        "latest_quarter_return": F.last("ret", ignorenulls=True).over(upto),
        "trailing_2q_return": F.when(short_back, trailing(2)).otherwise(trailing(3)),
        "trailing_1y_return": trailing(4), "trailing_2y_return": trailing(8), "trailing_3y_return": trailing(12),
        "n_ret": F.count("ret").over(upto), "mean": F.avg("ret").over(upto), "sd": F.stddev_samp("ret").over(upto),
        "down": F.sqrt(down2), "mdd": F.min("dd").over(upto), "best_quarter": F.max("ret").over(upto), "worst_quarter": F.min("ret").over(upto),
        "median_period_return": F.percentile("ret", F.lit(0.5)).over(upto), "history_years": years,
        "hits": F.count_if(F.col("ret") > 0).over(upto), "median_gap": F.percentile("gap", F.lit(0.5)).over(upto),
        "streak": F.count_if(F.col("ret") > 0).over(Window.partitionBy("subject_id", "island").orderBy("date").rowsBetween(
            Window.unboundedPreceding, 0))})
    some = F.col("n_ret") > 0
    ppy = S.periods_by_spacing("median_gap")
    down_dev = F.col("down") * F.sqrt(ppy)
    annual = F.pow(F.col("now") / F.col("first"), ppy / F.col("n_ret")) - 1
    return q.withColumns({
        "total_return": F.when(some, change("now", "first")),
        "cagr": F.when(years > 0, F.pow(F.col("now") / F.col("first"), 1 / years) - 1),
        "annualized_mean_return": F.col("mean") * 4, "annualized_volatility": F.col("sd") * 2, "maximum_drawdown": F.col("mdd"),
        "downside_deviation": F.col("down") * 2,
        "sharpe_ratio": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(ppy)),
        "sortino_ratio": F.when(down_dev > 0, F.col("mean") * ppy / down_dev),
        "calmar_ratio": F.when(some & (F.col("mdd") < 0), annual / F.abs("mdd")),
        "positive_period_percentage": F.when(some, F.col("hits") / F.col("n_ret")),
        "consecutive_positive_periods": F.when(F.col("now").isNotNull(), F.col("streak").cast("double")),
        "current_price": F.col("now"), "market_cap": F.when(F.col("shares") > 0, F.col("now") * F.col("shares")),
        "offering_valuation": F.when(F.col("obs_no").isNotNull(), F.col("offering_price") * F.col("shares")),
        "premium_to_offering": F.when(F.col("offering_price") > 0, change("now", "offering_price")),
        "observation_count": F.col("obs_no").cast("double"), "observation_age_days": F.col("age").cast("double")})


def _rules() -> Column:
    return F.create_map(*[x for n, (low, r, y) in LEADERBOARD_METRICS.items() for x in (
        F.lit(n), F.struct(F.lit(low).alias("low"), F.lit(r).alias("returns"), F.lit(y).alias("years")))])[F.col("metric")]


def archive_states(metrics: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One row per subject, quarter and metric with eligibility and the reason against it; rows are made in place, without a shuffle.
    `wanted` limits the metrics, and with them what is computed."""
    names = wanted or list(LEADERBOARD_METRICS)
    ids = ["date", "subject_id", "subject_type", "obs_no", "age", "years"]
    wide = metrics.withColumn("years", F.col("history_years")).select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    rule = _rules()
    reason = (F.when(F.col("obs_no").isNull(), "not_yet_launched").when(F.col("age") > STALE_DAYS, "stale_latest_observation")
              .when(F.col("obs_no") - 1 < rule["returns"], "insufficient_observations")
              .when(F.col("years") < rule["years"], "insufficient_trailing_history")
              .when(F.col("value").isNull(), "invalid_metric_value").otherwise(""))
    return wide.unpivot(ids, names, "metric", "value").withColumns({"exclusion_reason": reason, "eligible": reason == ""})


CARRIED = ("subject_type", "obs_no", "age", "years")
#: Metrics whose rows are shuffled and stored together; the shuffle of one such set is on disk at a time.
RANKED_TOGETHER = 4


def leaderboard_archive(metrics: DataFrame, wanted: list[str] | None = None, carried: Sequence[str] = CARRIED, dates: Sequence[str] | None = None) -> DataFrame:
    """Long archive: `archive_states` with rank and percentile. Only eligible rows are ranked, each (quarter, metric) over many tasks, and only
    they are shuffled, a few metrics at a time, and stored, with what is `carried` along; the others stay where they were made. A quarter is
    ranked by itself, so where a caller shows some `dates` only, only theirs are stored and ranked."""
    names = wanted or list(LEADERBOARD_METRICS)
    used = ["date", "subject_id", "subject_type", "obs_no", "age", "history_years", *[n for n in names if n != "history_years"]]
    shown = metrics if dates is None else metrics.filter(F.col("date").isin(*[dt.date.fromisoformat(d) for d in dates]))
    wide = staged(shown.select(*used))
    # rank on rounded values: ties are ties, whatever the order sums were taken in
    key = F.when(F.col("metric").isin(*MONEY), F.round("value", MONEY_DIGITS)).otherwise(F.round("value", RANK_DIGITS))
    directed = F.when(_rules()["low"], key).otherwise(-key)
    kept = ["date", "subject_id", *carried, "metric", "value"]
    # inside, a metric is its place among the names: names would be most of a row
    place, named = F.array_position(F.array(*map(F.lit, names)), F.col("metric")).cast("int"), F.element_at(F.array(*map(F.lit, names)), F.col("metric"))
    sets = [archive_states(wide, names[i:i + RANKED_TOGETHER]).filter("eligible").select(*kept, directed.alias("_order")).withColumn("metric", place)
            for i in range(0, len(names), RANKED_TOGETHER)]
    ranked, counts = S.ranked_in_parts(sets, ["date", "metric"], ["_order", "subject_id"], kept, "eligible_universe_size")
    ranked = ranked.withColumns({"metric": named, "exclusion_reason": F.lit(""), "eligible": F.lit(True)})
    # a row per quarter and metric: small by construction, so the long rows need not move to meet it
    rest = archive_states(wide, names).filter("NOT eligible").select(*kept, "exclusion_reason", "eligible", F.lit(None).cast("bigint").alias("rank"))
    rest = rest.join(F.broadcast(counts.withColumn("metric", named)), ["date", "metric"], "left").withColumn("eligible_universe_size", F.coalesce("eligible_universe_size", F.lit(0)))
    return ranked.unionByName(rest).withColumn("percentile_rank", F.when(F.col("rank").isNotNull(), F.when(F.col("eligible_universe_size") == 1, 1.0).otherwise(
        ratio(F.col("eligible_universe_size") - F.col("rank"), F.col("eligible_universe_size") - 1))))


def rank_movement(archive: DataFrame, metric: str, start: str, end: str) -> DataFrame:
    """Entrants, dropouts and rank changes between two quarters, by one conditional aggregate."""
    rows = archive.filter((F.col("metric") == metric) & F.col("date").isin(start, end))

    def at(day: str, c: str) -> Column:
        return F.max(F.when(F.col("date") == day, F.col(c)))

    m = rows.groupBy("subject_id").agg(
        at(start, "rank").alias("start_rank"), at(end, "rank").alias("end_rank"), at(start, "value").alias("start_value"),
        at(end, "value").alias("end_value"), F.coalesce(at(start, "eligible"), F.lit(False)).alias("a"),
        F.coalesce(at(end, "eligible"), F.lit(False)).alias("b"))
    label = (F.when(F.col("a") & F.col("b"), "Remained eligible").when(F.col("b"), "New entrant").when(F.col("a"), "Dropped out")
             .otherwise("Ineligible both"))
    return m.select("subject_id", "start_rank", "end_rank", (F.col("start_rank") - F.col("end_rank")).alias("rank_change"),
                    (F.col("end_value") - F.col("start_value")).alias("value_change"), label.alias("transition"))


def validate_archive(archive: DataFrame) -> DataFrame:
    """Counts that must be zero before an archive is published. The metrics of a subject and quarter meet in one row with a bit per known
    metric; only where rows outnumber bits are the states themselves grouped, and the archive is read again only where there are such."""
    place = F.create_map(*[F.lit(x) for i, n in enumerate(LEADERBOARD_METRICS) for x in (n, 1 << i)])[F.col("metric")]
    leak = F.col("age") < 0
    met = archive.groupBy("date", "subject_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_or(place), F.lit(0)).alias("bits"), F.count_if(leak).alias("leaks"))
    # what is clear is one sum; each subject and quarter in doubt stays by itself
    doubt = F.when(F.bit_count("bits") != F.col("n"), F.struct(F.col("date").alias("_d"), F.col("subject_id").alias("_s")))
    sums = staged(met.groupBy(doubt.alias("_doubt")).agg(F.sum("leaks").alias("leaks"), F.sum("n").alias("n")))
    doubtful = sums.filter("_doubt IS NOT NULL").select("_doubt.*")
    sums = sums.agg(F.coalesce(F.sum(F.when(F.col("_doubt").isNull(), F.col("leaks"))), F.lit(0)).alias("future"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    if doubtful.isEmpty():
        return sums.select(F.lit(0).cast("bigint").alias("duplicate_states"), F.col("future").alias("future_observations"), "rows")
    keys = archive.join(doubtful, F.col("date").eqNullSafe(F.col("_d")) & F.col("subject_id").eqNullSafe(F.col("_s")), "left_semi").groupBy(
        "date", "subject_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.max(leak).alias("leak"))
    found = keys.agg(F.count_if(F.col("n") > 1).alias("duplicate_states"), F.count_if("leak").alias("more"))
    return sums.join(found).select("duplicate_states", (F.col("future") + F.col("more")).alias("future_observations"), "rows")


# --- scatter table ------------------------------------------------------------------------

def asset_metric_table(assets: DataFrame, quotes: DataFrame, minimum_returns: int = 4) -> DataFrame:
    """Per-asset statistics of the observed price series; one window pass, one aggregate."""
    w = S.over("asset_id")
    rows = quotes.withColumns({"ret": change("price", F.lag("price").over(w)), "gap": F.datediff("date", F.lag("date").over(w)),
                               "dd": change("price", F.max("price").over(S.running("asset_id")))})
    r = F.col("ret")
    a = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("ret").alias("return_observation_count"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.min_by("price", "date").alias("p0"), F.max_by("price", "date").alias("current_price"),
        F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("down2"),
        F.min("dd").alias("mdd"), F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("hits"), F.max(r).alias("best"), F.min(r).alias("worst"),
        F.max_by("cap", F.when(F.col("cap").isNotNull(), F.col("date"))).alias("last_cap"))
    a = S.periods_per_year_regular(a).join(assets, "asset_id")
    enough = (F.col("return_observation_count") >= minimum_returns) & F.col("periods").isNotNull()
    years, ppy = F.col("history_years"), F.col("periods")
    down = F.sqrt(F.col("down2") / F.col("return_observation_count")) * F.sqrt(ppy)
    cagr = F.when(years > 0, F.pow(F.col("current_price") / F.col("p0"), 1 / years) - 1)

    def known(c: Column) -> Column:
        return F.when(enough, c)

    return a.select(
        "asset_id", "ticker", "name", "category", "status", F.col("n").alias("observation_count"), "return_observation_count", "first_date", "last_date",
        "history_years", "current_price", F.col("periods").alias("periods_per_year"), F.col("median_gap").alias("median_observation_gap_days"),
        known(F.col("mean") * ppy).alias("annualized_mean_return"), known(F.col("sd") * F.sqrt(ppy)).alias("annualized_volatility"),
        known(cagr).alias("cagr"), known(change("current_price", "p0")).alias("total_return"), known(F.col("mean")).alias("mean_period_return"),
        known(F.col("sd")).alias("period_volatility"), known(F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(ppy))).alias("sharpe_ratio"),
        known(F.when(down > 0, F.col("mean") * ppy / down)).alias("sortino_ratio"), known(F.col("mdd")).alias("maximum_drawdown"),
        known(F.when(F.col("mdd") < 0, cagr / F.abs("mdd"))).alias("calmar_ratio"), known(F.col("hits")).alias("positive_period_percentage"),
        known(F.col("best")).alias("best_period_return"), known(F.col("worst")).alias("worst_period_return"),
        F.col("offering_price_usd").alias("offering_price"), (F.col("offering_price_usd") * F.col("share_count")).alias("offering_valuation"),
        F.col("share_count").alias("shares_outstanding"), F.coalesce("last_cap", F.col("current_price") * F.col("share_count")).alias("market_cap"),
        change("current_price", "offering_price_usd").alias("return_since_offering"), F.year("offering_date").alias("offering_year"),
        F.when(F.lower("status") == "trading", "Active").otherwise("Exited / other").alias("active_exited"))


def filter_universe(table: DataFrame, categories: list[str] | None = None, include_exited: bool = False, search: str = "",
                    minimum_observations: int = 0, minimum_years: float = 0.0, need_cap: bool = False) -> DataFrame:
    out = table.filter(F.col("category").isin(categories)) if categories else table
    if not include_exited:
        out = out.filter(F.lower("status") == "trading")
    if search:
        out = out.filter(contains_text(["ticker", "name"], search))
    out = out.filter((F.coalesce("return_observation_count", F.lit(0)) >= minimum_observations)
                     & (F.coalesce("history_years", F.lit(0.0)) >= minimum_years))
    return out.filter("market_cap IS NOT NULL") if need_cap else out


def marker_sizes(table: DataFrame, column: str, low: float = 8.0, high: float = 30.0, uniform: float = 14.0) -> DataFrame:
    """Bounded marker diameter: winsorised at the 95th percentile, log-scaled, min-max to [low, high]."""
    value = F.when(F.col(column) > 0, F.col(column))
    cap = exact_quantiles(table.withColumn("_v", value), [], "_v", {"_cap": 0.95})
    rows = table.join(cap).withColumn("_t", F.log1p(F.least(value, F.col("_cap"))))
    span = rows.agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), low + (F.col("_t") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (high - low)).otherwise(
        F.when(F.col("_hi").isNotNull(), uniform).otherwise(uniform))
    return rows.join(span).withColumn("marker_size", F.coalesce(scaled, F.lit(low))).drop("_t", "_lo", "_hi", "_cap")


# --- scores, exports and picks ------------------------------------------------------------

# Weights of the composite score.
SCORE_WEIGHTS = {
    "valuation_score": 0.30, "liquidity_score": 0.20, "category_momentum_score": 0.15, "rarity_score": 0.15,
    "data_quality_score": 0.10, "exit_probability_score": 0.10,
}


def composite_scores(df: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Six clipped scores and their weighted sum, in points of 100."""
    d = F.col("discount")
    spread = F.coalesce("bid_ask_spread_pct", F.lit(0.30))
    stale = F.when(F.coalesce("stale_mark_flag", F.lit(False)), 0.25).otherwise(0.0)
    s = df.withColumns({
        "valuation_score": F.coalesce(clip(0.5 - d), F.lit(0.5)), "liquidity_score": clip(1 - spread - stale),
        "category_momentum_score": F.lit(0.55), "rarity_score": clip(F.coalesce("rarity", F.lit(0.5))),
        "data_quality_score": clip((F.coalesce("source_confidence", F.lit(0.5)) + F.coalesce("nav_confidence", F.lit(0.5))) / 2)})
    s = s.withColumn("exit_probability_score", clip(0.45 + F.col("rarity_score") * 0.20 + F.col("liquidity_score") * 0.10))
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    shown = [c for c in weights if c != "category_momentum_score"]
    return s.select("asset_id", *[(F.col(c) * 100).alias(c) for c in shown], (total * 100).alias("investment_score"))


def newsletters(d: DataFrame) -> DataFrame:
    """Four bounded lists: movers against offering, discounts, recent exits and weak data."""
    def pick(name: str, rows: DataFrame, value: Column, order: list[Column], n: int) -> DataFrame:
        return rows.orderBy(*order, "asset_id").limit(n).select(F.lit(name).alias("list"), "asset_id", value.alias("value"))

    weak = (F.col("current_market_cap_usd").isNull() | F.col("offering_market_cap_usd").isNull() | (F.coalesce("comp_count", F.lit(0)) == 0)
            | (F.coalesce("nav_confidence", F.lit(0.0)) < 0.25))
    exit_return = change("exit_market_cap_usd", "offering_market_cap_usd")
    return (
        pick("market_movers", d.filter("current_market_cap_usd IS NOT NULL"), F.col("premium_to_offering"),
             [F.round(F.abs("premium_to_offering"), 9).desc()], 25)
        .union(pick("notable_discounts", d.filter("status = 'trading' AND discount < 0"), F.col("discount"), [F.round("discount", 9)], 25))
        .union(pick("recent_exits", d.filter("exit_market_cap_usd IS NOT NULL"), exit_return, [F.col("exit_date").desc()], 25))
        .union(pick("weak_data", d.filter(weak), F.col("nav_confidence"), [F.col("category")], 50))
    )


def bottom_top(df: DataFrame, keys: list[str], value: str, k: int, tie: str = "asset_id") -> DataFrame:
    """The k smallest and k largest rows of each group; each side prunes before its shuffle."""
    def side(order: Column) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order, tie)
        return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")

    return side(F.col(value).asc()).union(side(F.col(value).desc())).dropDuplicates([*keys, tie])


def top_plus_other(contributions: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Contribution per date of the n largest contributors, everything else lumped, with running sums."""
    totals = contributions.groupBy(*keys, "asset_id").agg(F.round(F.sum(value), 9).alias("_t"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_t"), "asset_id"))
    named = totals.withColumn("_k", rank).filter(F.col("_k") <= n).select(*keys, "asset_id", F.lit(True).alias("_named"))
    label = F.when(F.col("_named"), F.concat(F.lit("asset:"), F.col("asset_id").cast("string"))).otherwise("Other")
    sums = contributions.join(named, [*keys, "asset_id"], "left").groupBy(*keys, "date", label.alias("label")).agg(F.sum(value).alias("contribution"))
    return sums.withColumn("cumulative", F.sum("contribution").over(S.running([*keys, "label"])))
