"""Reconciliation and rule-based validation of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import ratio, rule_names
from tessera.operators.series import period_array


def reconcile_caps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two market-cap sources side by side with the reasons they differ and each asset's share of the gap."""
    joined = left.join(right, "asset_id", "full_outer").withColumn(
        "difference", F.coalesce("cap", F.lit(0.0)) - F.coalesce("observed_cap", F.lit(0.0)))
    total = joined.agg(F.sum(F.abs("difference")).alias("_gap"))
    reasons = rule_names({
        "missing_in_exchange": F.col("cap").isNull(), "missing_in_observations": F.col("observed_cap").isNull(),
        "stale_price": F.coalesce("is_stale", F.lit(False)),
        "carried_forward": F.coalesce(F.col("price_source") == "carried_forward", F.lit(False))})
    return joined.join(total).withColumn("gap_share", ratio(F.abs("difference"), "_gap")).withColumn(
        "reasons", F.array_join(reasons, "|"))


# --- import rules -------------------------------------------------------------------------

# Accepted spellings of imported fields.
ASSET_STATUSES = ["announced", "offering", "funded", "holding_period", "trading", "buyout_pending", "exit_pending", "accepting_orders", "suspended",
                  "asset_sale_pending", "exit_announced", "pending_approval", "liquidated", "delisted", "sold", "buyout", "exited", "unknown"]
EVENT_TYPES = ["executed_trade", "daily_close", "chart_observation", "offering_price", "distribution", "asset_sale", "buyout", "pending_buyout", "unknown"]
PRECISION_STATUSES = ["exact", "rounded", "chart_estimate", "unverified"]
EXIT_TYPES = ["buyout", "asset_sale", "redemption", "liquidation", "delisting", "issuer_repurchase", "auction_sale", "private_sale", "other", "distribution", "unknown"]


def number(c: str) -> Column:
    return F.regexp_replace(c, "[$,\\s]", "").try_cast("double")


def date(c: str) -> Column:
    return F.col(c).try_cast("date")


def text(c: str) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\\s+", " ")


def material_difference(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) > tolerance


def mark_repeats(rows: DataFrame, keys: list[str], seq: str, out: str) -> DataFrame:
    """True for every row of a key after its first. The first row comes from a combinable aggregate joined back, so a key
    that fills a third of the input is not sorted in one task."""
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(seq).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(first, same, "left").withColumn(out, F.col(seq) != F.col("_first"))
    return joined.drop("_first", *[f"_k{i}" for i in range(len(keys))])


def _verdict(rows: DataFrame, reasons: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    out = rows.withColumns({"_reasons": rule_names(reasons), "_warnings": rule_names(warnings)})
    return out.withColumns({"accepted": F.size("_reasons") == 0, "rejection_reason": F.array_join("_reasons", "; "),
                            "warning_reason": F.array_join("_warnings", "; ")}).drop("_reasons", "_warnings")


def validate_assets(raw: DataFrame, seq: str, tolerance: float = 0.01) -> DataFrame:
    """Imported asset rows (all text) with acceptance, rejection reasons and warnings."""
    rows = raw.withColumns({
        "asset_id": text("asset_id"), "status": F.when(text("status") == "", "unknown").otherwise(F.lower(text("status"))), "currency": F.upper(text("currency")),
        "exit_type": F.lower(text("exit_type")), "shares": number("shares_outstanding"), "price": number("offering_price_per_share"),
        "cap": number("offering_market_cap"), "exit_value": number("exit_value_total")})
    rows = mark_repeats(rows, ["asset_id"], seq, "_repeat")
    implied = F.col("shares") * F.col("price")
    reasons = {
        "missing_asset_id": F.col("asset_id") == "", "duplicate_asset_id": (F.col("asset_id") != "") & F.col("_repeat"),
        "missing_asset_name": text("asset_name") == "", "missing_category": text("category") == "", "missing_source_reference": text("source_reference") == "",
        "invalid_status": ~F.col("status").isin(ASSET_STATUSES), "invalid_currency": (F.col("currency") != "") & ~F.col("currency").rlike("^[A-Z]{3}$"),
        "nonpositive_shares_outstanding": F.col("shares") <= 0, "negative_offering_price_per_share": F.col("price") < 0, "negative_offering_market_cap": F.col("cap") < 0,
        "negative_exit_value_total": F.col("exit_value") < 0, "invalid_offering_date": (text("offering_date") != "") & date("offering_date").isNull(),
        "invalid_exit_type": (F.col("exit_type") != "") & ~F.col("exit_type").isin(EXIT_TYPES)}
    warnings = {"exit_value_total_is_not_shareholder_proceeds": F.col("exit_value").isNotNull(),
                "offering_market_cap_reconciliation_difference": material_difference(implied, F.col("cap"), tolerance)}
    return _verdict(rows, reasons, warnings).drop("_repeat")


def validate_prices(raw: DataFrame, master: DataFrame, seq: str, tolerance: float = 0.01, lookback_days: int = 14) -> DataFrame:
    """Imported price rows (all text) checked against the master, against each other, and for dates and enums."""
    rows = raw.withColumns({
        "asset_id": text("asset_id"), "period": date("period_end"), "observed": date("observed_at"), "price": number("price_per_share"), "cap": number("market_cap"),
        "event": F.lower(text("event_type")), "precision": F.lower(text("precision_status")), "vol": number("volume")})
    key = ["asset_id", "period", "event"]
    # rows are aggregated once, by key and payload, and meet the result in one join: when a payload came first, and which one its key began with
    whole = [*key, "price", "cap"]
    met = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(whole)]).agg(F.min(seq).alias("_first"))
    payload = F.struct(F.col("_k3").alias("price"), F.col("_k4").alias("cap"))
    began = met.groupBy(*[F.col(f"_k{i}").alias(f"_b{i}") for i in range(len(key))]).agg(F.min_by(payload, "_first").alias("_payload"))
    first = met.join(began, [F.col(f"_k{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(key))]).drop("_b0", "_b1", "_b2")
    rows = rows.join(first, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(whole)], "left").withColumn("_repeat", F.col(seq) != F.col("_first"))
    known = master.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("share_count").alias("_shares"), F.col("exit_date").alias("_exit"), F.lit(True).alias("_known"))
    rows = rows.join(known, "asset_id", "left")
    early = F.datediff("period", "observed")
    reasons = {
        "missing_asset_id": F.col("asset_id") == "", "unknown_asset_id": (F.col("asset_id") != "") & F.col("_known").isNull(), "invalid_period_end": F.col("period").isNull(),
        "period_end_not_calendar_quarter_end": ~((F.month("period") % 3 == 0) & (F.last_day("period") == F.col("period"))), "invalid_observed_at": F.col("observed").isNull(),
        "observed_at_after_verified_exit_date": F.col("observed") > F.col("_exit"), "missing_source_reference": text("source_reference") == "",
        "nonpositive_price_per_share": F.col("price") <= 0, "nonpositive_market_cap": F.col("cap") <= 0, "negative_volume": F.col("vol") < 0,
        "invalid_event_type": ~F.col("event").isin(EVENT_TYPES), "invalid_precision_status": ~F.col("precision").isin(PRECISION_STATUSES),
        "duplicate_price_observation": F.col("_repeat"),
        "conflicting_price_observation": ~(F.col("_payload.price").eqNullSafe(F.col("price")) & F.col("_payload.cap").eqNullSafe(F.col("cap")))}
    warnings = {
        "observed_at_after_period_end": early < 0, "observed_at_exceeds_quarter_lookback": early > lookback_days,
        "chart_observation_marked_exact": (F.col("event") == "chart_observation") & (F.col("precision") == "exact"),
        "offering_price_excluded_from_secondary_returns": F.col("event") == "offering_price",
        "non_price_event_has_price": F.col("event").isin("distribution", "asset_sale") & F.col("price").isNotNull(),
        "observed_market_cap_reconciliation_difference": material_difference(F.col("_shares") * F.col("price"), F.col("cap"), tolerance)}
    out = _verdict(rows, reasons, warnings)
    return out.drop("_repeat", "_first", "_payload", "_shares", "_exit", "_known", *[f"_k{i}" for i in range(len(whole))])


def merge_assets(stored: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Upsert by asset_id with the list of changed columns."""
    s = stored.select("asset_id", F.struct(*columns).alias("_s"))
    n = incoming.select("asset_id", F.struct(*columns).alias("_n"))
    j = s.join(n, "asset_id", "full_outer")
    changed = rule_names({c: F.col("_s").isNotNull() & F.col("_n").isNotNull() & ~F.col("_s")[c].eqNullSafe(F.col("_n")[c]) for c in columns})
    action = (F.when(F.col("_s").isNull(), "inserted").when(F.col("_n").isNull(), "kept").when(F.size(changed) > 0, "updated").otherwise("unchanged"))
    return j.select("asset_id", *[F.coalesce(F.col("_n")[c], F.col("_s")[c]).alias(c) for c in columns], action.alias("action"), F.array_join(changed, ",").alias("changed"))


def merge_prices(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that are already stored, conflict with a stored row of the same period and event, or are new."""
    key, exact = ["asset_id", "period_end", "event_type"], ["asset_id", "period_end", "event_type", "observed_at", "price_per_share", "market_cap"]
    same = stored.select(*[F.col(c).alias(f"e_{c}") for c in exact]).distinct().withColumn("_same", F.lit(True))
    there = stored.select(*key).distinct().withColumn("_there", F.lit(True))
    j = incoming.join(same, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in exact], "left").join(there, key, "left")
    action = F.when(F.col("_same"), "skipped_exact").when(F.col("_there"), "existing_price_observation_conflict").otherwise("appended")
    return j.withColumn("action", action).drop("_same", "_there", *[f"e_{c}" for c in exact])


def exchange_input_warnings(assets: DataFrame, quotes: DataFrame, exits: DataFrame) -> DataFrame:
    """Non-blocking warnings about offering fields, prices and exits before the offering."""
    rules = rule_names({
        "missing_offering_date": F.col("offering_date").isNull(), "missing_shares_outstanding": F.col("share_count").isNull(),
        "missing_offering_price": F.col("offering_price_usd").isNull(), "non_positive_share_count": F.col("share_count") <= 0,
        "non_positive_offering_price": F.col("offering_price_usd") <= 0})
    none = F.lit(None).cast("date")
    a = assets.select("asset_id", none.alias("date"), F.explode(rules).alias("warning"))
    start = assets.select("asset_id", "offering_date")
    p = quotes.join(start, "asset_id").filter("date < offering_date").select("asset_id", "date", F.lit("price_before_offering_date").alias("warning"))
    e = exits.join(start, "asset_id").filter("sale_date < offering_date").select("asset_id", F.col("sale_date").alias("date"), F.lit("exit_before_offering_date").alias("warning"))
    out = a.unionByName(p).unionByName(e)
    return out.withColumn("severity", F.when(F.startswith("warning", F.lit("non_positive")), "error").otherwise("warning"))


def registry_errors(registry: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per broken registry rule; `latest` has the newest observation of each asset."""
    tickers = registry.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    r = registry.join(tickers, "ticker", "left").join(latest, "asset_id", "left")
    offer, ref = F.col("offer_price"), F.col("reference_price")
    near = lambda a, b, tol: F.abs(a - b) <= tol
    has = offer.isNotNull()
    votes = sum((F.coalesce(c, F.lit(0.0)) for c in ("vote_yes", "vote_no", "vote_advisory")), F.lit(0.0))
    rules = rule_names({
        "duplicate_ticker": F.col("_n") > 1, "invalid_status": ~F.col("status").isin(ASSET_STATUSES),
        "offering_total_does_not_reconcile": ~F.coalesce(near(F.col("offering_total"), F.col("share_count") * F.col("offering_price_usd"), 0.01), F.lit(False)),
        "nonpositive_offer": offer <= 0, "offer_total_does_not_reconcile": has & ~F.coalesce(near(F.col("offer_total"), offer * F.col("share_count"), 0.01), F.lit(False)),
        "reference_is_not_latest_observation": has & ~F.coalesce(near(F.col("latest_price"), ref, 1e-9) & (F.col("latest_date") == F.col("reference_date")), F.lit(False)),
        "premium_does_not_reconcile": has & ~F.coalesce(near(F.col("premium"), ratio(offer, ref) - 1, 1e-9), F.lit(False)),
        "pending_buyout_not_halted": (F.col("status") == "buyout_pending") & (F.col("trading_state") != "halted"),
        "votes_exceed_tolerance": votes > 100.5})
    return r.select("asset_id", F.explode(rules).alias("error"))


def quote_ranges(quotes: DataFrame) -> DataFrame:
    rules = rule_names({"price_not_positive": ~(F.col("price") > 0), "bid_negative": F.col("bid") < 0, "ask_below_bid": F.col("ask") < F.col("bid"),
                        "volume_negative": F.col("volume") < 0, "currency_not_three_letters": ~F.upper("currency").rlike("^[A-Z]{3}$")})
    return quotes.withColumns({"currency": F.upper("currency"), "violations": F.array_join(rules, "; ")})


def research_coverage(assets: DataFrame, observations: DataFrame, as_of: str) -> DataFrame:
    """Per-asset counts by precision, expected against captured quarters, gaps and index eligibility."""
    price = observations.filter(F.col("event_type").isin("executed_trade", "daily_close", "chart_observation"))
    quarters = price.groupBy("asset_id", "period_end").agg(F.count(F.lit(1)).alias("n"))
    per = quarters.groupBy("asset_id").agg(F.count(F.lit(1)).alias("captured_quarters"), F.count_if(F.col("n") > 1).alias("duplicate_periods"),
                                           F.collect_set("period_end").alias("_seen"), F.min("period_end").alias("first_period_end"), F.max("period_end").alias("last_period_end"))
    days = price.select("asset_id", "observed_at").distinct()
    gap = F.datediff("observed_at", F.lag("observed_at").over(Window.partitionBy("asset_id").orderBy("observed_at")))
    gaps = days.withColumn("gap", gap).groupBy("asset_id").agg(F.max("gap").alias("largest_observation_gap_days"))
    agg = price.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("observation_count"), *[F.count_if(F.col("precision_status") == p).alias(f"{p}_observation_count") for p in ("exact", "rounded")],
        (F.max("price_per_share") > 0).alias("_price"), F.coalesce(F.max("market_cap") > 0, F.lit(False)).alias("_cap"))
    end = F.coalesce("exit_date", F.lit(as_of).cast("date"))
    expected = period_array(F.col("offering_date"), end, "quarter")
    j = assets.join(agg, "asset_id", "left").join(per, "asset_id", "left").join(gaps, "asset_id", "left")
    has_price, has_cap = F.coalesce("_price", F.lit(False)), F.coalesce("_cap", F.lit(False))
    missing = F.array_except(expected, F.coalesce("_seen", F.array().cast("array<date>")))
    reasons = rule_names({"missing_secondary_price_observation": ~has_price, "missing_shares_outstanding": F.col("share_count").isNull(), "missing_observed_market_cap": ~has_cap})
    return j.select(
        "asset_id", F.coalesce("observation_count", F.lit(0)).alias("observation_count"), "exact_observation_count", "rounded_observation_count",
        F.size(expected).alias("expected_quarters"), F.coalesce("captured_quarters", F.lit(0)).alias("captured_quarters"), F.size(missing).alias("missing_quarters"),
        F.coalesce("duplicate_periods", F.lit(0)).alias("duplicate_periods"), "largest_observation_gap_days", "first_period_end", "last_period_end",
        has_price.alias("index_eligible_equal_weight"), (has_price & has_cap & F.col("share_count").isNotNull()).alias("index_eligible_market_cap"),
        F.array_join(reasons, "; ").alias("exclusion_reasons"))


def reading_notes(readings: DataFrame, as_of: str) -> DataFrame:
    """Checks of recognised chart readings; `shares` may be NULL."""
    implied = ratio("market_cap", F.nullif("price", F.lit(0.0)))
    rules = rule_names({
        "missing_or_ambiguous_date": F.col("observation_date").isNull(), "future_date": F.col("observation_date") > F.lit(as_of).cast("date"),
        "missing_price": F.col("price").isNull(), "nonpositive_price": F.col("price") <= 0, "nonpositive_market_cap": F.col("market_cap") <= 0,
        "implied_share_count_mismatch": ratio(F.abs(implied - F.col("shares")), F.nullif("shares", F.lit(0.0))) > 0.05})
    return readings.withColumns({"notes": F.array_join(rules, "; "), "validation_status": F.when(F.size(rules) == 0, "pass").otherwise("fail")})


def consensus(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Modal (price, cap) of repeated readings with support, conflict flag and confidence."""
    votes = readings.groupBy(*keys, "price", "market_cap").agg(
        F.count(F.lit(1)).alias("support"), F.min("seq").alias("first_seq"),
        F.max(F.struct(F.coalesce("ocr_confidence", F.lit(0.0)).alias("o"), F.col("parse_confidence").alias("p"))).alias("best"))
    top = votes.groupBy(*keys).agg(
        F.max(F.struct("support", (-F.col("first_seq")).alias("_s"), "price", "market_cap", "best")).alias("w"), F.count(F.lit(1)).alias("alternatives"), F.sum("support").alias("n"))
    score = 0.45 * F.col("w.best.p") + 0.35 * F.col("w.best.o") + 0.2 * F.col("w.support") / F.col("n")
    return top.select(*keys, F.col("w.price").alias("price"), F.col("w.market_cap").alias("market_cap"), F.col("w.support").alias("support"), "alternatives",
                      (F.col("alternatives") > 1).alias("has_conflict"), F.least(F.lit(1.0), score).alias("confidence"))


def truth_evaluation(extracted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Matched, missing and unexpected dates and the exact-price rate."""
    e = extracted.select(*keys, F.col("price").alias("got"), F.lit(1).alias("_e"))
    t = truth.select(*keys, F.col("price").alias("want"), F.lit(1).alias("_t"))
    j = e.join(t, keys, "full_outer")
    both = F.col("_e").isNotNull() & F.col("_t").isNotNull()
    exact = both & (F.col("got") == F.col("want"))
    counts = j.agg(F.count("_t").alias("expected"), F.count("_e").alias("found"), F.count_if(both).alias("matched"), F.count_if(F.col("_e").isNull()).alias("missing"),
                   F.count_if(F.col("_t").isNull()).alias("unexpected"), F.count_if(exact).alias("exact_price_matches"))
    return counts.withColumns({"date_recall": ratio("matched", "expected"), "extraction_precision": ratio("matched", "found"),
                               "price_accuracy": ratio("exact_price_matches", "matched")})


def unsupported_numbers(generated: Column, evidence: Column) -> Column:
    """Numbers of a generated text that the evidence does not contain."""
    pattern = F.lit(r"\d+(?:\.\d+)?")
    return F.array_sort(F.array_except(F.regexp_extract_all(generated, pattern, F.lit(0)), F.regexp_extract_all(evidence, pattern, F.lit(0))))


def data_diagnostics(assets: DataFrame, comps: DataFrame, matched: DataFrame) -> DataFrame:
    """Metric/value table about missing prices, estimates, attributes and repeated lots."""
    lots = comps.groupBy("brand", "model", "sale_date", "realized_price_usd").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_possible_lots"))
    c = comps.agg(
        F.count(F.lit(1)).alias("comparable_sales"), F.count_if(F.col("realized_price_usd").isNull()).alias("comps_missing_sale_price"),
        F.count_if(F.col("estimate_low_usd").isNull() | F.col("estimate_high_usd").isNull()).alias("comps_missing_estimate"),
        F.count_if(F.col("size").isNull() | F.col("material").isNull() | F.col("color").isNull()).alias("comps_missing_size_material_color"))
    a = assets.agg(F.count(F.lit(1)).alias("assets"))
    none = assets.join(matched.select("asset_id").distinct(), "asset_id", "left_anti").agg(F.count(F.lit(1)).alias("assets_with_no_comps"))
    wide = a.join(c).join(lots).join(none)
    return wide.unpivot([], wide.columns, "metric", "value")
