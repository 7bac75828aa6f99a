"""Validation, quarantine, merge, coverage and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.columns import change, rnd

from tessera.operators import quality as Q
from tessera.operators import range_rules as R

from tessera.plans.index_plans import family
from tessera.plans.market_plans import rounded
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import AS_OF, daily, quarterly
from tessera.sources.market_views import SOURCE_ORDER, Market


def raw_assets(m: Market) -> DataFrame:
    """Imported master rows as text, with the faults a manual transcription has."""
    k = F.col("asset_id")

    def fault(every: int, at: int, bad: str, good) -> Column:
        return F.when(k % every == at, bad).otherwise(good)

    base = m.assets.select(
        k.alias("seq"), fault(50, 7, "  ", k.cast("string")).alias("asset_id"), fault(47, 5, "", F.col("name")).alias("asset_name"), fault(53, 6, "", F.col("category")).alias("category"),
        fault(41, 9, "", F.lit("sheet")).alias("source_reference"), fault(60, 5, "Bogus", F.col("status")).alias("status"),
        fault(45, 4, "US1", F.lit("usd")).alias("currency"), fault(33, 8, "-5", F.col("share_count").cast("string")).alias("shares_outstanding"),
        F.concat(F.lit("$ "), F.col("offering_price_usd").cast("string")).alias("offering_price_per_share"),
        F.when(k % 25 == 6, F.col("share_count") * F.col("offering_price_usd") * 1.2).otherwise(F.col("share_count") * F.col("offering_price_usd")).cast("string").alias("offering_market_cap"),
        fault(70, 9, "1995-13-40", F.col("offering_date").cast("string")).alias("offering_date"),
        F.when(F.col("status") == "exited", F.when(k % 40 == 0, "asset_sale").otherwise("vanished")).otherwise("").alias("exit_type"),
        F.when(k % 40 == 0, F.col("exit_price_per_share") * F.col("share_count")).cast("string").alias("exit_value_total"))
    again = base.filter("seq % 40 = 3").withColumn("seq", F.col("seq") + 1_000_000_000_000)
    return base.unionByName(again)


@query("validate_assets", """
    WITH b AS (SELECT *, asset_id AS k, asset_id AS seq, FALSE AS rep FROM assets UNION ALL SELECT *, asset_id, asset_id + 1000000000000, asset_id % 50 <> 7 FROM assets WHERE asset_id % 40 = 3),
    r AS (SELECT *, list_filter([CASE WHEN k % 50 = 7 THEN 'missing_asset_id' END, CASE WHEN rep THEN 'duplicate_asset_id' END, CASE WHEN k % 47 = 5 THEN 'missing_asset_name' END,
          CASE WHEN k % 53 = 6 THEN 'missing_category' END, CASE WHEN k % 41 = 9 THEN 'missing_source_reference' END, CASE WHEN k % 60 = 5 THEN 'invalid_status' END,
          CASE WHEN k % 45 = 4 THEN 'invalid_currency' END, CASE WHEN k % 33 = 8 THEN 'nonpositive_shares_outstanding' END, CASE WHEN k % 70 = 9 THEN 'invalid_offering_date' END,
          CASE WHEN status = 'exited' AND k % 40 <> 0 THEN 'invalid_exit_type' END], lambda x: x IS NOT NULL) AS why,
          list_filter([CASE WHEN k % 40 = 0 THEN 'exit_value_total_is_not_shareholder_proceeds' END,
          CASE WHEN k % 25 = 6 OR k % 33 = 8 THEN 'offering_market_cap_reconciliation_difference' END], lambda x: x IS NOT NULL) AS warn FROM b)
    SELECT seq, len(why) = 0 AS accepted, array_to_string(why, '; ') AS rejection_reason, array_to_string(warn, '; ') AS warning_reason FROM r""")
def _(m):
    return Q.validate_assets(raw_assets(m), "seq").select("seq", "accepted", "rejection_reason", "warning_reason")


def raw_prices(m: Market) -> DataFrame:
    s = F.col("s1")

    def fault(every: int, at: int, bad, good) -> Column:
        return F.when(s % every == at, bad).otherwise(good)

    return m.observations.select(
        F.struct(*SOURCE_ORDER, "asset_id").alias("seq"), "s1", "s2", "s3", fault(97, 3, F.concat(F.lit("X"), F.col("asset_id").cast("string")), F.col("asset_id").cast("string")).alias("asset_id"),
        fault(89, 4, F.date_sub("period_end", 1).cast("string"), F.col("period_end").cast("string")).alias("period_end"),
        fault(83, 5, "soon", F.col("observed_at").cast("string")).alias("observed_at"), fault(79, 6, "-1", F.round("price_per_share", 4).cast("string")).alias("price_per_share"),
        F.round("market_cap", 2).cast("string").alias("market_cap"), fault(73, 7, "Weird", F.col("event_type")).alias("event_type"),
        fault(71, 8, "guess", F.col("precision_status")).alias("precision_status"), F.col("volume").cast("string").alias("volume"), fault(67, 9, "", F.lit("chart")).alias("source_reference"))


@query("validate_prices", """
    WITH b AS (SELECT o.*, s1 AS k, CASE WHEN s1 % 97 = 3 THEN 'X' || o.asset_id ELSE CAST(o.asset_id AS VARCHAR) END AS aid, CASE WHEN s1 % 89 = 4 THEN period_end - 1 ELSE period_end END AS per,
               CASE WHEN s1 % 83 <> 5 THEN observed_at END AS obs, CASE WHEN s1 % 79 = 6 THEN -1 ELSE round(price_per_share, 4) END AS pr, round(market_cap, 2) AS mc,
               CASE WHEN s1 % 73 = 7 THEN 'weird' ELSE event_type END AS ev, CASE WHEN s1 % 71 = 8 THEN 'guess' ELSE precision_status END AS prec FROM observations o),
    w AS (SELECT *, row_number() OVER (PARTITION BY aid, per, ev, pr, mc ORDER BY observed_at, s1, s2, s3, asset_id) > 1 AS rep,
                 first_value(pr) OVER (PARTITION BY aid, per, ev ORDER BY observed_at, s1, s2, s3, asset_id) AS fp,
                 first_value(mc) OVER (PARTITION BY aid, per, ev ORDER BY observed_at, s1, s2, s3, asset_id) AS fm FROM b),
    j AS (SELECT w.*, a.share_count, a.exit_date, a.asset_id IS NOT NULL AS known FROM w LEFT JOIN assets a ON CAST(a.asset_id AS VARCHAR) = w.aid),
    r AS (SELECT *, list_filter([CASE WHEN NOT known THEN 'unknown_asset_id' END, CASE WHEN k % 89 = 4 THEN 'period_end_not_calendar_quarter_end' END, CASE WHEN obs IS NULL THEN 'invalid_observed_at' END,
          CASE WHEN obs > exit_date THEN 'observed_at_after_verified_exit_date' END, CASE WHEN k % 67 = 9 THEN 'missing_source_reference' END, CASE WHEN pr <= 0 THEN 'nonpositive_price_per_share' END,
          CASE WHEN ev = 'weird' THEN 'invalid_event_type' END, CASE WHEN prec = 'guess' THEN 'invalid_precision_status' END, CASE WHEN rep THEN 'duplicate_price_observation' END,
          CASE WHEN fp IS DISTINCT FROM pr OR fm IS DISTINCT FROM mc THEN 'conflicting_price_observation' END], lambda x: x IS NOT NULL) AS why,
          list_filter([CASE WHEN obs > per THEN 'observed_at_after_period_end' END, CASE WHEN per - obs > 14 THEN 'observed_at_exceeds_quarter_lookback' END,
          CASE WHEN ev = 'chart_observation' AND prec = 'exact' THEN 'chart_observation_marked_exact' END, CASE WHEN ev = 'offering_price' THEN 'offering_price_excluded_from_secondary_returns' END,
          CASE WHEN ev = 'distribution' THEN 'non_price_event_has_price' END,
          CASE WHEN abs(share_count * pr - mc) / greatest(abs(share_count * pr), abs(mc), 1) > .01 THEN 'observed_market_cap_reconciliation_difference' END], lambda x: x IS NOT NULL) AS warn FROM j)
    SELECT s1, s2, s3, aid AS asset_id, len(why) = 0 AS accepted, array_to_string(why, '; ') AS rejection_reason, array_to_string(warn, '; ') AS warning_reason FROM r""")
def _(m):
    return Q.validate_prices(raw_prices(m), m.assets, "seq").select("s1", "s2", "s3", "asset_id", "accepted", "rejection_reason", "warning_reason")


@query("merge_assets", """
    WITH s AS (SELECT asset_id, name, share_count FROM assets WHERE asset_id % 10 <> 0),
    n AS (SELECT asset_id, CASE WHEN asset_id % 6 = 0 THEN name || ' II' ELSE name END AS name, CASE WHEN asset_id % 9 = 0 THEN share_count + 1 ELSE share_count END AS share_count FROM assets WHERE asset_id % 3 = 0 OR asset_id % 10 = 0)
    SELECT coalesce(s.asset_id, n.asset_id) AS asset_id, coalesce(n.name, s.name) AS name, coalesce(n.share_count, s.share_count) AS share_count,
           CASE WHEN s.asset_id IS NULL THEN 'inserted' WHEN n.asset_id IS NULL THEN 'kept' WHEN s.name <> n.name OR s.share_count <> n.share_count THEN 'updated' ELSE 'unchanged' END AS action,
           CASE WHEN s.name <> n.name AND s.share_count <> n.share_count THEN 'name,share_count' WHEN s.name <> n.name THEN 'name' WHEN s.share_count <> n.share_count THEN 'share_count' ELSE '' END AS changed
    FROM s FULL JOIN n ON s.asset_id = n.asset_id""")
def _(m):
    a = m.assets.select("asset_id", "name", "share_count")
    k = F.col("asset_id")
    fresh = a.filter((k % 3 == 0) | (k % 10 == 0)).select("asset_id", F.when(k % 6 == 0, F.concat("name", F.lit(" II"))).otherwise(F.col("name")).alias("name"),
                                        F.when(k % 9 == 0, F.col("share_count") + 1).otherwise(F.col("share_count")).alias("share_count"))
    return Q.merge_assets(a.filter(k % 10 != 0), fresh, ["name", "share_count"])


MERGE_SQL = """
    WITH s AS (SELECT * FROM observations WHERE observed_at <= DATE '2000-12-31'),
    n AS (SELECT o.* REPLACE (CASE WHEN s1 % 7 = 0 THEN price_per_share + 1 ELSE price_per_share END AS price_per_share) FROM observations o WHERE observed_at >= DATE '2000-10-01')
    SELECT n.asset_id, n.s1, n.s2, n.s3, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.asset_id = n.asset_id AND s.period_end = n.period_end AND s.event_type = n.event_type AND s.observed_at = n.observed_at
             AND s.price_per_share = n.price_per_share AND s.market_cap IS NOT DISTINCT FROM n.market_cap) THEN 'skipped_exact'
           WHEN EXISTS (SELECT 1 FROM s WHERE s.asset_id = n.asset_id AND s.period_end = n.period_end AND s.event_type = n.event_type) THEN 'existing_price_observation_conflict' ELSE 'appended' END AS action FROM n"""


def merged(m: Market) -> DataFrame:
    o = m.observations
    fresh = o.filter("observed_at >= DATE '2000-10-01'").withColumn("price_per_share", F.when(F.col("s1") % 7 == 0, F.col("price_per_share") + 1).otherwise(F.col("price_per_share")))
    return Q.merge_prices(o.filter("observed_at <= DATE '2000-12-31'"), fresh)


@query("merge_prices", MERGE_SQL)
def _(m):
    return merged(m).select("asset_id", "s1", "s2", "s3", "action")


@query("anti_new_rows", "SELECT asset_id, count(*) AS appended FROM (" + MERGE_SQL + ") WHERE action = 'appended' GROUP BY 1")
def _(m):
    return merged(m).filter("action = 'appended'").groupBy("asset_id").agg(F.count(F.lit(1)).alias("appended"))


@query("validate_exchange_inputs", """
    WITH a AS (SELECT * REPLACE (CASE WHEN asset_id % 31 = 4 THEN NULL ELSE offering_date END AS offering_date, CASE WHEN asset_id % 29 = 3 THEN 0 ELSE share_count END AS share_count,
               CASE WHEN asset_id % 37 = 5 THEN NULL ELSE offering_price_usd END AS offering_price_usd) FROM assets),
    w AS (SELECT asset_id, NULL::DATE AS date, 'missing_offering_date' AS warning FROM a WHERE offering_date IS NULL UNION ALL SELECT asset_id, NULL, 'missing_offering_price' FROM a WHERE offering_price_usd IS NULL
          UNION ALL SELECT asset_id, NULL, 'non_positive_share_count' FROM a WHERE share_count <= 0
          UNION ALL SELECT q.asset_id, q.date, 'price_before_offering_date' FROM q_quotes q JOIN a USING (asset_id) WHERE q.date < a.offering_date
          UNION ALL SELECT e.asset_id, e.sale_date, 'exit_before_offering_date' FROM exits e JOIN a USING (asset_id) WHERE e.sale_date < a.offering_date)
    SELECT *, CASE WHEN starts_with(warning, 'non_positive') THEN 'error' ELSE 'warning' END AS severity FROM w""")
def _(m):
    k = F.col("asset_id")
    a = m.assets.withColumns({"offering_date": F.when(k % 31 != 4, F.col("offering_date")), "share_count": F.when(k % 29 == 3, 0.0).otherwise(F.col("share_count")),
                              "offering_price_usd": F.when(k % 37 != 5, F.col("offering_price_usd"))})
    return Q.exchange_input_warnings(a, quarterly(m), m.exits)


@query("price_before_offering", "SELECT o.asset_id, count(*) AS n FROM observations o JOIN assets a USING (asset_id) WHERE o.observed_at < a.offering_date GROUP BY 1")
def _(m):
    a = m.assets.select("asset_id", "offering_date")
    return m.observations.join(a, "asset_id").filter("observed_at < offering_date").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


@query("validate_registry", """
    WITH l AS (SELECT asset_id, max(date) AS ld, arg_max(price, date) AS lp FROM d_quotes GROUP BY 1),
    r AS (SELECT a.asset_id AS k, CASE WHEN a.asset_id % 90 = 2 THEN '#DUP' ELSE ticker END AS ticker, CASE WHEN a.asset_id % 60 = 5 THEN 'bogus' ELSE status END AS status, ld, lp FROM assets a LEFT JOIN l USING (asset_id)),
    d AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, status = 'buyout_pending' AS off FROM r),
    e AS (SELECT k, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_ticker' END, CASE WHEN status = 'bogus' THEN 'invalid_status' END, CASE WHEN k % 25 = 6 THEN 'offering_total_does_not_reconcile' END,
          CASE WHEN off AND k % 3 = 0 THEN 'offer_total_does_not_reconcile' END, CASE WHEN off AND (lp IS NULL OR k % 4 = 1) THEN 'reference_is_not_latest_observation' END,
          CASE WHEN off AND (lp IS NULL OR k % 7 = 1) THEN 'premium_does_not_reconcile' END, CASE WHEN off AND k % 8 = 5 THEN 'pending_buyout_not_halted' END,
          CASE WHEN off AND k % 9 = 2 THEN 'votes_exceed_tolerance' END], lambda x: x IS NOT NULL)) AS error FROM d)
    SELECT k AS asset_id, error FROM e""")
def _(m):
    k = F.col("asset_id")
    latest = daily(m).groupBy("asset_id").agg(F.max("date").alias("latest_date"), F.max_by("price", "date").alias("latest_price"))
    off = F.col("status") == "buyout_pending"
    r = m.assets.withColumns({"ticker": F.when(k % 90 == 2, "#DUP").otherwise(F.col("ticker")), "status": F.when(k % 60 == 5, "bogus").otherwise(F.col("status"))}).join(
        latest.select("asset_id", F.col("latest_date").alias("ld"), F.col("latest_price").alias("lp")), "asset_id", "left")
    offer = F.when(off, F.col("offering_price_usd") * 1.3)
    r = r.withColumns({
        "offering_total": F.col("share_count") * F.col("offering_price_usd") * F.when(k % 25 == 6, 1.2).otherwise(1.0), "offer_price": offer,
        "offer_total": offer * F.col("share_count") * F.when(k % 3 == 0, 1.1).otherwise(1.0), "reference_price": F.when(off, F.col("lp")),
        "reference_date": F.when(off, F.when(k % 4 == 1, F.date_sub("ld", 1)).otherwise(F.col("ld"))), "trading_state": F.when(off & (k % 8 != 5), "halted").otherwise("open"),
        "vote_yes": F.when(off, 60.0), "vote_no": F.when(off, F.when(k % 9 == 2, 50.0).otherwise(30.0)), "vote_advisory": F.when(off, 5.0)})
    r = r.withColumn("premium", F.when(off, change("offer_price", "reference_price") + F.when(k % 7 == 1, 0.1).otherwise(0.0)))
    return Q.registry_errors(r.drop("ld", "lp"), latest).select("asset_id", "error")


@query("pydantic_ranges", """
    WITH q AS (SELECT asset_id, date, CASE WHEN asset_id % 17 = 3 THEN ask - 2000 ELSE ask END AS ask, bid, CASE WHEN asset_id % 19 = 4 THEN -1 ELSE volume END AS volume,
                      CASE WHEN asset_id % 23 = 5 THEN 'US' ELSE 'USD' END AS currency FROM d_quotes)
    SELECT asset_id, date, currency, array_to_string(list_filter([CASE WHEN ask < bid THEN 'ask_below_bid' END, CASE WHEN volume < 0 THEN 'volume_negative' END,
           CASE WHEN currency = 'US' THEN 'currency_not_three_letters' END], lambda x: x IS NOT NULL), '; ') AS violations FROM q""")
def _(m):
    k = F.col("asset_id")
    q = daily(m).withColumns({"ask": F.when(k % 17 == 3, F.col("ask") - 2000).otherwise(F.col("ask")), "volume": F.when(k % 19 == 4, -1.0).otherwise(F.col("volume")),
                              "currency": F.when(k % 23 == 5, "us").otherwise("usd")})
    return Q.quote_ranges(q).select("asset_id", "date", "currency", "violations")


#: A sound value and a broken one per rule; record k breaks its type's rule k % FAULTS and no other.
FAULTS = 23
SOUND = {"text": "USD", "number": "0.5", "integer": "3", "date": "2000-01-31", "flag": "true"}
BROKEN = {"positive": "0", "non_negative": "-1", "non_positive": "0.5", "unit": "1.5", "percent": "100.5", "nonempty": "", "category": "Watches", "three_letters": "US", "not_below_bid": "0.25"}
NAMED_WRONG = {"date": "2000-02-31", "number": "ten", "integer": "3.x", "flag": "perhaps"}


def faulty_rules(model: str) -> list[tuple[str, str, str | None]]:
    """(field, rule that must be reported, bad text) for every rule of a model."""
    out = []
    for name, kind, required, rule in R.RULES[model]:
        out.append((name, rule, BROKEN[rule]) if rule else (name, "missing", None) if required else (name, f"not_{kind}", NAMED_WRONG[kind]))
    return out


MODEL_FAULTS_SQL = ", ".join(f"('{model}', {i}, '{name}', '{rule}')" for model in R.RULES for i, (name, rule, _) in enumerate(faulty_rules(model)))


@query("model_ranges", f"""
    SELECT asset_id, f.model AS model, field, rule FROM assets JOIN (VALUES {MODEL_FAULTS_SQL}) AS f(model, i, field, rule) ON asset_id % {FAULTS} = i""")
def _(m):
    parts = []
    for model, rules in R.RULES.items():
        bad, columns = faulty_rules(model), {}
        for name, kind, _, rule in rules:
            value = F.lit("other" if name == "category" else "-0.5" if rule == "non_positive" else SOUND[kind])
            for i, (field, _, text) in enumerate(bad):
                if field == name:
                    value = F.when(F.col("asset_id") % FAULTS == i, F.lit(text)).otherwise(value)
                if name == "bid" and (field, text) == ("ask", BROKEN["positive"]):  # an ask of 0 is below any bid
                    value = F.when(F.col("asset_id") % FAULTS == i, F.lit(None)).otherwise(value)
            columns.setdefault(name, value)
        frame = m.assets.select(F.col("asset_id").alias("_id"), *[c.alias(name) for name, c in columns.items()])
        parts.append(R.range_violations(frame, model, ["_id"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_id").alias("asset_id"), "model", "field", "rule")


@query("research_coverage", """
    WITH p AS (SELECT * FROM observations WHERE event_type IN ('executed_trade', 'daily_close', 'chart_observation')),
    g AS (SELECT asset_id, count(*) AS n, count(*) FILTER (precision_status = 'exact') AS ex, count(*) FILTER (precision_status = 'rounded') AS ro, count(DISTINCT period_end) AS cap_q,
                 min(period_end) AS f, max(period_end) AS l, max(market_cap) > 0 AS hc FROM p GROUP BY 1),
    d AS (SELECT asset_id, count(*) FILTER (c > 1) AS dup FROM (SELECT asset_id, period_end, count(*) AS c FROM p GROUP BY ALL) GROUP BY 1),
    gp AS (SELECT asset_id, max(x) AS gap FROM (SELECT asset_id, o - lag(o) OVER (PARTITION BY asset_id ORDER BY o) AS x FROM (SELECT DISTINCT asset_id, observed_at AS o FROM p)) GROUP BY 1),
    dd AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS q), qe AS (SELECT q FROM dd WHERE last_day(q) = q AND month(q) % 3 = 0),
    e AS (SELECT a.asset_id, count(*) AS expected, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p WHERE p.asset_id = a.asset_id AND p.period_end = qe.q)) AS missing
          FROM assets a JOIN qe ON qe.q BETWEEN a.offering_date AND coalesce(a.exit_date, DATE '2001-12-31') GROUP BY 1)
    SELECT a.asset_id, coalesce(n, 0) AS observation_count, ex AS exact_observation_count, ro AS rounded_observation_count, CAST(expected AS INT) AS expected_quarters, coalesce(cap_q, 0) AS captured_quarters,
           CAST(missing AS INT) AS missing_quarters, coalesce(dup, 0) AS duplicate_periods, CAST(gap AS INT) AS largest_observation_gap_days, f AS first_period_end, l AS last_period_end,
           n IS NOT NULL AS index_eligible_equal_weight, coalesce(hc, FALSE) AS index_eligible_market_cap, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'missing_secondary_price_observation' END,
           CASE WHEN NOT coalesce(hc, FALSE) THEN 'missing_observed_market_cap' END], lambda x: x IS NOT NULL), '; ') AS exclusion_reasons
    FROM assets a LEFT JOIN g USING (asset_id) LEFT JOIN d USING (asset_id) LEFT JOIN gp USING (asset_id) LEFT JOIN e USING (asset_id)""")
def _(m):
    return Q.research_coverage(m.assets, m.observations, AS_OF)


@query("completed_categories", """
    SELECT category, bool_and(q.asset_id IS NOT NULL) AS completed, count(*) AS targets FROM assets a LEFT JOIN (SELECT DISTINCT asset_id FROM q_quotes) q USING (asset_id)
    WHERE a.status = 'trading' GROUP BY category""")
def _(m):
    seen = quarterly(m).select("asset_id").distinct().withColumn("_s", F.lit(True))
    return m.assets.filter("status = 'trading'").join(seen, "asset_id", "left").groupBy("category").agg(
        F.bool_and(F.col("_s").isNotNull()).alias("completed"), F.count(F.lit(1)).alias("targets"))


@query("sector_performance", """
    WITH s AS (SELECT *, max(date) OVER (PARTITION BY family) AS latest FROM qidx_series WHERE weighting = 'equal' AND family <> 'all'),
    g AS (SELECT family, arg_max(index_level, date) AS v1, arg_min(index_level, date) AS v0, max_by(index_level, date) FILTER (date <= CAST(latest - INTERVAL 12 MONTH AS DATE)) AS vy,
                 stddev_samp(period_return) * 2 AS vol, arg_max(constituent_count, date) AS n FROM s GROUP BY 1),
    c AS (SELECT category, count(*) AS targets, count(q.asset_id) AS researched FROM assets a LEFT JOIN (SELECT DISTINCT asset_id FROM q_quotes) q USING (asset_id) WHERE status = 'trading' GROUP BY 1)
    SELECT family AS category, r6(v1 / v0 - 1) AS since_inception, r6(v1 / vy - 1) AS last_year, r6(vol) AS annualized_volatility, CASE WHEN vol < .15 THEN 'Low' WHEN vol < .30 THEN 'Medium' ELSE 'High' END AS volatility_band,
           n AS constituent_count, researched AS researched_asset_count, targets AS target_asset_count, r6(researched / targets) AS coverage_pct, CASE WHEN researched >= targets THEN 'Complete' ELSE 'Building' END AS coverage_status
    FROM g JOIN c ON c.category = g.family""")
def _(m):
    s = family(m).series.filter("weighting = 'equal' AND family <> 'all'")
    latest = s.groupBy("family").agg(F.max("date").alias("latest"))
    g = s.join(latest, "family").groupBy("family").agg(
        change(F.max_by("index_level", "date"), F.min_by("index_level", "date")).alias("since_inception"),
        change(F.max_by("index_level", "date"), F.max_by("index_level", F.when(F.col("date") <= F.add_months("latest", -12), F.col("date")))).alias("last_year"),
        (F.stddev_samp("period_return") * 2).alias("vol"), F.max_by("constituent_count", "date").alias("constituent_count"))
    seen = quarterly(m).select("asset_id").distinct().withColumn("_s", F.lit(1))
    c = m.assets.filter("status = 'trading'").join(seen, "asset_id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("t"), F.count("_s").alias("r"))
    band = F.when(F.col("vol").isNull(), "Unavailable").when(F.col("vol") < 0.15, "Low").when(F.col("vol") < 0.30, "Medium").otherwise("High")
    return g.join(c, F.col("category") == F.col("family")).select(
        "category", rnd("since_inception").alias("since_inception"), rnd("last_year").alias("last_year"), rnd("vol").alias("annualized_volatility"), band.alias("volatility_band"),
        "constituent_count", F.col("r").alias("researched_asset_count"), F.col("t").alias("target_asset_count"), rnd(F.col("r") / F.col("t")).alias("coverage_pct"),
        F.when(F.col("r") >= F.col("t"), "Complete").otherwise("Building").alias("coverage_status"))


@query("data_diagnostics", """
    WITH c AS (SELECT *, CASE WHEN size % 13 <> 0 THEN realized_price_usd END AS p, CASE WHEN year <> 1997 THEN estimate_low_usd END AS lo, CASE WHEN hardware <> 'R' THEN color END AS col FROM comps)
    SELECT 'assets' AS metric, (SELECT count(*) FROM assets) AS value UNION ALL SELECT 'comparable_sales', count(*) FROM c UNION ALL SELECT 'comps_missing_sale_price', count(*) FILTER (p IS NULL) FROM c
    UNION ALL SELECT 'comps_missing_estimate', count(*) FILTER (lo IS NULL) FROM c UNION ALL SELECT 'comps_missing_size_material_color', count(*) FILTER (col IS NULL) FROM c
    UNION ALL SELECT 'duplicate_possible_lots', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT brand, model, sale_date, p, count(*) AS n FROM c GROUP BY ALL)
    UNION ALL SELECT 'assets_with_no_comps', count(*) FROM assets a WHERE NOT EXISTS (SELECT 1 FROM comps c WHERE c.asset_id = a.asset_id)""")
def _(m):
    c = m.comps.withColumns({"realized_price_usd": F.when(F.col("size") % 13 != 0, F.col("realized_price_usd")), "estimate_low_usd": F.when(F.col("year") != 1997, F.col("estimate_low_usd")),
                             "color": F.when(F.col("hardware") != "R", F.col("color"))})
    return Q.data_diagnostics(m.assets, c, m.comps)


def readings(m: Market) -> DataFrame:
    """Recognised chart readings: several per asset and date, some misread."""
    k = F.col("s1")
    o = m.observations
    price = F.when(k % 11 == 3, -F.col("price_per_share")).when(k % 13 == 4, None).otherwise(F.round("price_per_share", 4))
    return o.select("asset_id", "s1", "s2", "s3", F.struct("s1", "s2", "s3").alias("_q"), F.xxhash64("s1", "s2", "s3").alias("_h"),
                    F.when(k % 17 == 5, None).when(k % 19 == 6, F.lit("2002-06-01").cast("date")).otherwise(F.col("observed_at")).alias("observation_date"), price.alias("price"),
                    F.round("market_cap", 2).alias("market_cap"), (k * 1_000_000 + F.col("s3") * 10 + F.col("s2")).alias("seq"),
                    ((k % 10) / 10.0).alias("ocr_confidence"), ((k % 3 + 1) / 3.0).alias("parse_confidence"))


shared_sql("read_rows", """
    SELECT asset_id, s1, s2, s3, CASE WHEN s1 % 17 = 5 THEN NULL WHEN s1 % 19 = 6 THEN DATE '2002-06-01' ELSE observed_at END AS d,
           CASE WHEN s1 % 11 = 3 THEN -price_per_share WHEN s1 % 13 = 4 THEN NULL ELSE round(price_per_share, 4) END AS p, round(market_cap, 2) AS c,
           s1 * 1000000 + s3 * 10 + s2 AS seq, (s1 % 10) / 10.0 AS oc, (s1 % 3 + 1) / 3.0 AS pc FROM observations""")


@query("reading_validation", """
    WITH r AS (SELECT r.*, CASE WHEN asset_id % 5 = 0 THEN share_count * 1.2 ELSE share_count END AS sh FROM read_rows r JOIN assets USING (asset_id)),
    n AS (SELECT *, list_filter([CASE WHEN d IS NULL THEN 'missing_or_ambiguous_date' END, CASE WHEN d > DATE '2001-12-31' THEN 'future_date' END, CASE WHEN p IS NULL THEN 'missing_price' END,
          CASE WHEN p <= 0 THEN 'nonpositive_price' END, CASE WHEN c <= 0 THEN 'nonpositive_market_cap' END, CASE WHEN abs(c / p - sh) / sh > .05 THEN 'implied_share_count_mismatch' END], lambda x: x IS NOT NULL) AS w FROM r)
    SELECT s1, s2, s3, asset_id, array_to_string(w, '; ') AS notes, CASE WHEN len(w) = 0 THEN 'pass' ELSE 'fail' END AS validation_status FROM n""")
def _(m):
    shares = m.assets.select("asset_id", F.when(F.col("asset_id") % 5 == 0, F.col("share_count") * 1.2).otherwise(F.col("share_count")).alias("shares"))
    return Q.reading_notes(readings(m).join(shares, "asset_id"), AS_OF).select("s1", "s2", "s3", "asset_id", "notes", "validation_status")


CONSENSUS_SQL = """
    WITH v AS (SELECT asset_id, d, p, c, count(*) AS support, min(seq) AS fs, arg_max(oc, (oc, pc)) AS bo, arg_max(pc, (oc, pc)) AS bp FROM read_rows WHERE d IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, count(*) OVER w AS alts, sum(support) OVER w AS n FROM v WINDOW w AS (PARTITION BY asset_id, d)),
    t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY asset_id, d ORDER BY support DESC, fs) = 1)"""


def agreed(m: Market) -> DataFrame:
    return Q.consensus(readings(m).filter("observation_date IS NOT NULL"), ["asset_id", "observation_date"])


@query("consensus_vote", CONSENSUS_SQL + """
    SELECT asset_id, d AS observation_date, r4(p) AS price, r2(c) AS market_cap, support, alts AS alternatives, alts > 1 AS has_conflict, r6(least(1, .45 * bp + .35 * bo + .2 * support / n)) AS confidence FROM t""")
def _(m):
    return agreed(m).withColumns({"price": rnd("price", 4), "market_cap": rnd("market_cap", 2), "confidence": rnd("confidence")})


@query("reviewed_export", CONSENSUS_SQL + """
    SELECT asset_id, d AS observation_date, r4(p) AS price, 'accepted' AS review_status FROM t WHERE alts = 1 AND p > 0""")
def _(m):
    return agreed(m).filter("NOT has_conflict AND price > 0").select("asset_id", "observation_date", rnd("price", 4).alias("price"), F.lit("accepted").alias("review_status"))


@query("truth_evaluation", CONSENSUS_SQL + """,
    tr AS (SELECT asset_id, date AS d, round(price, 4) AS p FROM d_quotes),
    j AS (SELECT t.asset_id IS NOT NULL AS e, tr.asset_id IS NOT NULL AS w, t.p AS got, tr.p AS want FROM t FULL JOIN tr ON tr.asset_id = t.asset_id AND tr.d = t.d)
    SELECT count(*) FILTER (w) AS expected, count(*) FILTER (e) AS found, count(*) FILTER (e AND w) AS matched, count(*) FILTER (NOT e) AS missing, count(*) FILTER (NOT w) AS unexpected,
           count(*) FILTER (e AND w AND got = want) AS exact_price_matches, r6(count(*) FILTER (e AND w) / count(*) FILTER (w)) AS date_recall,
           r6(count(*) FILTER (e AND w) / count(*) FILTER (e)) AS extraction_precision, r6(count(*) FILTER (e AND w AND got = want) / count(*) FILTER (e AND w)) AS price_accuracy FROM j""")
def _(m):
    truth = daily(m).select("asset_id", F.col("date").alias("observation_date"), F.round("price", 4).alias("price"))
    return rounded(Q.truth_evaluation(agreed(m), truth, ["asset_id", "observation_date"]))


@query("numeric_token_audit", r"""
    SELECT a.conv_id, a.turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(a.text, '\d+(?:\.\d+)?'), lambda x: NOT list_contains(regexp_extract_all(b.text, '\d+(?:\.\d+)?'), x)))), ',')
           AS unsupported FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def _(m):
    c = m.table("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(Q.unsupported_numbers(F.col("text"), F.col("evidence")), ",").alias("unsupported"))


@query("material_difference", """
    SELECT asset_id, abs(a - b) / greatest(abs(a), abs(b), 1) > .05 AS differs FROM (SELECT asset_id, arg_max(price, date) AS a, arg_min(price, date) AS b FROM q_quotes GROUP BY 1)""")
def _(m):
    g = quarterly(m).groupBy("asset_id").agg(F.max_by("price", "date").alias("a"), F.min_by("price", "date").alias("b"))
    return g.select("asset_id", Q.material_difference(F.col("a"), F.col("b"), 0.05).alias("differs"))


