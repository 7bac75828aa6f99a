"""Exits, market-cap history, universes and market-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import change, ratio, rnd
from tessera.operators import market as M
from tessera.operators import series as S
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import AS_OF, daily, exact_changes, quarterly
from tessera.plans.index_plans import family
from tessera.sources.market_views import Market


def exit_rows(m: Market, quotes: DataFrame | None = None) -> DataFrame:
    """All exit events. A seventh of the raw rows name their asset by series only."""
    raw = m.exits.withColumn("asset_id", F.when(F.col("asset_id") % 7 != 0, F.col("asset_id")))
    return M.normalize_exits(raw, m.assets, quarterly(m) if quotes is None else quotes)


def exits(m: Market, quotes: DataFrame | None = None) -> DataFrame:
    return M.standing_exits(exit_rows(m, quotes))


def history(m: Market) -> DataFrame:
    return M.exchange_asset_history(m.assets, quarterly(m), exits(m), AS_OF)


def rounded(df: DataFrame, money: tuple[str, ...] = (), digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[rnd(c, 2 if c in money else digits).alias(c) if t == "double" and c not in exact else F.col(c)
                       for c, t in df.dtypes])


shared_sql("status_map", """
    SELECT unnest(['trading', 'buyout_pending', 'exited']) AS status,
           unnest(['active_tradable', 'trading_paused', 'exited']) AS canonical_status""")
shared_sql("exit_all", """
    WITH d AS (
      SELECT e.*, coalesce(announcement_date, sale_date) AS exit_announcement_date, coalesce(last_trading_date, sale_date) AS traded_until,
             coalesce(valuation_date, sale_date) AS exit_valuation_date, e.status <> 'cancelled_exit' AND coalesce(is_confirmed, 'true') <> 'no' AS sure FROM exits e)
    SELECT e.asset_id, a.ticker, a.category,
           CASE lower(e.type) WHEN 'sale' THEN 'asset_sale' WHEN 'buyout_offer' THEN 'buyout' ELSE lower(e.type) END AS exit_type, e.status AS exit_status,
           e.exit_announcement_date, e.traded_until AS last_trading_date, e.exit_valuation_date,
           e.sale_date AS exit_effective_date, coalesce(e.settlement_date, e.sale_date) AS settlement_date,
           a.share_count AS shares_at_exit, p.price AS last_observed_price_before_exit, a.offering_price_usd, a.offering_date, e.source_url AS payout_source,
           sure AS is_confirmed,
           CASE WHEN sure THEN coalesce(e.exit_price_per_share, e.exit_total_value / a.share_count, p.price) END AS terminal_price,
           CASE WHEN NOT sure THEN 'missing'
                WHEN e.exit_price_per_share > 0 THEN 'confirmed_per_share_payout'
                WHEN e.exit_total_value > 0 THEN 'confirmed_total_payout_divided_by_shares'
                WHEN p.price > 0 THEN 'last_valid_secondary_market_price' ELSE 'missing' END AS terminal_price_source
    FROM d e JOIN assets a USING (asset_id)
    ASOF LEFT JOIN q_quotes p ON p.asset_id = e.asset_id AND e.traded_until >= p.date""")
shared_sql("exit_events", """
    SELECT * FROM exit_all QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY exit_status = 'cancelled_exit', exit_effective_date) = 1""")
shared_sql("px", """
    SELECT asset_id, date, price, event_type <> 'offering_price' AS is_direct FROM q_quotes
    UNION ALL SELECT asset_id, offering_date, offering_price_usd, FALSE FROM assets a
    WHERE NOT EXISTS (SELECT 1 FROM q_quotes q WHERE q.asset_id = a.asset_id AND q.date = a.offering_date)""")
shared_sql("xhist", """
    WITH cal AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS date),
    qe AS (SELECT date FROM cal WHERE last_day(date) = date AND month(date) % 3 = 0),
    live AS (SELECT * FROM exit_events WHERE exit_status <> 'cancelled_exit'),
    g AS (SELECT a.*, l.exit_effective_date AS gone, l.terminal_price, l.terminal_price_source, qe.date
          FROM assets a LEFT JOIN live l USING (asset_id)
          JOIN qe ON qe.date BETWEEN a.offering_date AND coalesce(l.exit_effective_date, DATE '2001-12-31')),
    h AS (SELECT g.asset_id, g.ticker, g.name, g.category, g.status, g.share_count, g.date, g.gone, g.terminal_price,
                 g.terminal_price_source, p.price, p.date AS eff, p.is_direct
          FROM g ASOF LEFT JOIN px p ON p.asset_id = g.asset_id AND g.date >= p.date),
    w AS (SELECT *, CAST(date - eff AS INT) AS observation_age_days, date = eff AND is_direct AS is_direct_observation,
                 lag(price) OVER (PARTITION BY asset_id ORDER BY date) AS previous_price,
                 row_number() OVER (PARTITION BY asset_id ORDER BY date) = 1 AS is_first,
                 gone IS NOT NULL AND row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) = 1 AS leaving FROM h)
    SELECT asset_id, ticker, name, category, status, share_count, date, price, observation_age_days, is_direct_observation,
           CASE WHEN is_direct_observation THEN 'observed_price' WHEN observation_age_days = 0 THEN 'offering_price'
                ELSE 'carried_forward' END AS price_source,
           observation_age_days > 120 AS is_stale, price / previous_price - 1 AS asset_return,
           CASE WHEN is_first THEN price * share_count ELSE 0 END AS new_issuance,
           CASE WHEN is_first THEN 0 ELSE (price - previous_price) * share_count END AS price_effect,
           CASE WHEN leaving THEN price * share_count ELSE 0 END AS removed_capital,
           CASE WHEN leaving THEN 0 ELSE price * share_count END AS market_cap,
           leaving AS is_exit_effective_date, terminal_price, terminal_price_source
    FROM w""")
shared_sql("xtotal", """
    WITH t AS (SELECT date, sum(market_cap) AS total_market_cap, count(*) AS active_asset_count,
                 count(*) FILTER (is_direct_observation) AS direct_observation_asset_count,
                 count(*) FILTER (price_source = 'carried_forward') AS carried_forward_asset_count,
                 count(*) FILTER (is_stale) AS stale_asset_count, median(observation_age_days) AS median_observation_age_days,
                 max(observation_age_days) AS max_observation_age_days,
                 sum(CASE WHEN is_direct_observation THEN market_cap ELSE 0 END) AS direct_cap,
                 sum(CASE WHEN price_source = 'carried_forward' THEN market_cap ELSE 0 END) AS carried_cap,
                 sum(new_issuance) AS new_issuance, sum(price_effect) AS price_effect, sum(removed_capital) AS removed_capital,
                 sum(CAST(market_cap AS DECIMAL(28, 8))) AS exact_cap,
                 sum(CAST(price_effect AS DECIMAL(28, 8))) + sum(CAST(new_issuance AS DECIMAL(28, 8))) - sum(CAST(removed_capital AS DECIMAL(28, 8))) AS exact_change,
                 avg(asset_return) AS mean_asset_return, count(*) FILTER (new_issuance > 0) AS assets_added_count
          FROM xhist GROUP BY date),
    p AS (SELECT *, coalesce(lag(total_market_cap) OVER (ORDER BY date), 0) AS prior_market_cap,
                 new_issuance - removed_capital AS flow FROM t),
    r AS (SELECT *, CASE WHEN prior_market_cap > 0 THEN (total_market_cap - flow) / prior_market_cap - 1 ELSE 0 END
                 AS period_return FROM p)
    SELECT *, 100 * product(1 + period_return) OVER (ORDER BY date) AS return_index,
           100 * product(1 + coalesce(mean_asset_return, 0)) OVER (ORDER BY date) AS equal_weighted_index,
           sum(flow) OVER (ORDER BY date) AS invested,
           CAST(exact_cap - coalesce(lag(exact_cap) OVER (ORDER BY date), 0) - exact_change AS DOUBLE) AS diff FROM r""")


EXIT_COLUMNS = ["asset_id", "ticker", "exit_type", "exit_status", "exit_announcement_date", "last_trading_date", "exit_valuation_date", "exit_effective_date", "settlement_date",
                "is_confirmed", "payout_source", "data_quality_flag", "last_price", "last_cap", "terminal_price", "terminal_price_source", "terminal_price_quality", "terminal_value",
                "terminal_return", "exit_premium_vs_last_trade", "exit_return_vs_offering", "annualized_exit_return"]


@query("normalize_exits", """
    SELECT asset_id, ticker, exit_type, exit_status, exit_announcement_date, last_trading_date, exit_valuation_date, exit_effective_date, settlement_date, is_confirmed, payout_source,
           CASE terminal_price_source WHEN 'last_valid_secondary_market_price' THEN ';terminal_price_fallback_last_trade' ELSE '' END AS data_quality_flag,
           r6(last_observed_price_before_exit) AS last_price, r2(last_observed_price_before_exit * shares_at_exit) AS last_cap, r6(terminal_price) AS terminal_price, terminal_price_source,
           CASE terminal_price_source WHEN 'missing' THEN 'blocking' WHEN 'last_valid_secondary_market_price' THEN 'fallback'
                ELSE 'confirmed' END AS terminal_price_quality,
           r2(terminal_price * shares_at_exit) AS terminal_value,
           r6(terminal_price / last_observed_price_before_exit - 1) AS terminal_return, r6(terminal_price / last_observed_price_before_exit - 1) AS exit_premium_vs_last_trade,
           r6(terminal_price / offering_price_usd - 1) AS exit_return_vs_offering,
           r6((terminal_price / offering_price_usd) ** (1 / ((exit_effective_date - offering_date) / 365.25)) - 1)
             AS annualized_exit_return
    FROM exit_all""")
def _(m):
    out = exit_rows(m).withColumnsRenamed({"last_observed_price_before_exit": "last_price", "last_observed_market_cap_before_exit": "last_cap"}).select(EXIT_COLUMNS)
    return rounded(out, ("terminal_value", "last_cap"))


@query("exit_states", """
    WITH i AS (
      SELECT asset_id, 1 AS rank, exit_announcement_date AS f, CASE WHEN exit_status = 'cancelled_exit' THEN exit_effective_date ELSE least(last_trading_date, exit_effective_date) END AS t FROM exit_all
      UNION ALL SELECT asset_id, 2, least(last_trading_date, exit_effective_date), exit_effective_date FROM exit_all WHERE exit_status <> 'cancelled_exit'
      UNION ALL SELECT asset_id, 3, exit_effective_date, greatest(exit_effective_date, settlement_date) FROM exit_all WHERE exit_status <> 'cancelled_exit'
      UNION ALL SELECT asset_id, 4, greatest(exit_effective_date, settlement_date), DATE '9999-12-31' FROM exit_all WHERE exit_status <> 'cancelled_exit'),
    k AS (SELECT * FROM i WHERE f < t),
    d AS (SELECT asset_id, f AS date FROM k UNION SELECT asset_id, t FROM k WHERE t < DATE '9999-12-31'),
    s AS (SELECT d.asset_id, d.date, coalesce(max(k.rank), 0) AS rank FROM d LEFT JOIN k ON k.asset_id = d.asset_id AND d.date >= k.f AND d.date < k.t GROUP BY ALL),
    c AS (SELECT * FROM s QUALIFY rank IS DISTINCT FROM lag(rank) OVER (PARTITION BY asset_id ORDER BY date))
    SELECT asset_id, ['trading', 'announced', 'trading_ended', 'pending_settlement', 'settled'][rank + 1] AS state, date AS from_date, lead(date) OVER (PARTITION BY asset_id ORDER BY date) AS to_date FROM c""")
def _(m):
    return M.exit_states(exit_rows(m))


@query("exit_analytics", """
    SELECT asset_id, ticker, category, CAST(exit_effective_date - offering_date AS INT) AS holding_period_days,
           r6(terminal_price / offering_price_usd - 1) AS total_return,
           r6(terminal_price / last_observed_price_before_exit - 1) AS premium_vs_last_trade,
           r2(offering_price_usd * shares_at_exit) AS initial_market_cap, r2(terminal_price * shares_at_exit) AS exit_market_cap,
           r2((terminal_price - offering_price_usd) * shares_at_exit) AS realized_pl
    FROM exit_events WHERE is_confirmed""")
def _(m):
    initial = F.col("offering_price_usd") * F.col("shares_at_exit")
    return M.live_exits(exits(m)).select(
        "asset_id", "ticker", "category", F.datediff("exit_effective_date", "offering_date").alias("holding_period_days"),
        rnd("exit_return_vs_offering").alias("total_return"), rnd("terminal_return").alias("premium_vs_last_trade"),
        rnd(initial, 2).alias("initial_market_cap"), rnd("terminal_value", 2).alias("exit_market_cap"),
        rnd((F.col("terminal_price") - F.col("offering_price_usd")) * F.col("shares_at_exit"), 2).alias("realized_pl"))


@query("exit_kpis", """
    SELECT category, count(*) AS exits, r2(sum(terminal_price * shares_at_exit)) AS sale_value, count(DISTINCT ticker) AS series
    FROM exit_events WHERE is_confirmed GROUP BY category""")
def _(m):
    return M.live_exits(exits(m)).groupBy("category").agg(
        F.count(F.lit(1)).alias("exits"), rnd(F.sum("terminal_value"), 2).alias("sale_value"), F.countDistinct("ticker").alias("series"))


@query("exits_from_assets", """
    SELECT asset_id, 'asset_sale' AS exit_type, 'settled' AS exit_status, exit_date AS exit_effective_date,
           r6(exit_price_per_share) AS exit_price_per_share, r2(exit_price_per_share * share_count) AS exit_total_value
    FROM assets WHERE exit_date IS NOT NULL AND status NOT IN ('buyout_pending')""")
def _(m):
    return m.assets.filter(F.col("exit_date").isNotNull() & (M.canonical_status("status") == "exited")).select(
        "asset_id", F.lit("asset_sale").alias("exit_type"), F.lit("settled").alias("exit_status"),
        F.col("exit_date").alias("exit_effective_date"), rnd("exit_price_per_share").alias("exit_price_per_share"),
        rnd(F.col("exit_price_per_share") * F.col("share_count"), 2).alias("exit_total_value"))


@query("strategy_exit_rows", """
    SELECT asset_id, exit_date AS sale_date,
           last_day(CAST(date_trunc('quarter', exit_date) + INTERVAL 2 MONTH AS DATE)) AS exit_period
    FROM assets WHERE exit_date IS NOT NULL""")
def _(m):
    from tessera.functions.columns import quarter_end

    return m.assets.filter("exit_date IS NOT NULL").select(
        "asset_id", F.col("exit_date").alias("sale_date"), quarter_end("exit_date").alias("exit_period"))


@query("exchange_asset_history", """
    SELECT asset_id, date, category, r6(price) AS price, observation_age_days, is_direct_observation, price_source, is_stale,
           r6(asset_return) AS asset_return, r2(new_issuance) AS new_issuance, r2(price_effect) AS price_effect,
           r2(removed_capital) AS removed_capital, r2(market_cap) AS market_cap, is_exit_effective_date FROM xhist""")
def _(m):
    out = history(m).select(
        "asset_id", "date", "category", "price", "observation_age_days", "is_direct_observation", "price_source", "is_stale",
        "asset_return", "new_issuance", "price_effect", "removed_capital", "market_cap", "is_exit_effective_date")
    return rounded(out, ("new_issuance", "price_effect", "removed_capital", "market_cap"))


MONEY = ("total_market_cap", "new_issuance", "price_effect", "removed_capital", "prior_market_cap", "reconciliation_difference",
         "cumulative_invested_capital", "cumulative_flow_adjusted_pl", "category_market_cap", "prior_category_market_cap")


@query("exchange_total_history", """
    SELECT date, r2(total_market_cap) AS total_market_cap, active_asset_count, r2(new_issuance) AS new_issuance,
           r2(price_effect) AS price_effect, r2(removed_capital) AS removed_capital, r6(period_return) AS period_return,
           r6(return_index) AS return_index, r6(equal_weighted_index) AS equal_weighted_index,
           r2(invested) AS cumulative_invested_capital, r2(total_market_cap - invested) AS cumulative_flow_adjusted_pl,
           r6(return_index / max(return_index) OVER (ORDER BY date) - 1) AS drawdown, assets_added_count FROM xtotal""")
def _(m):
    return rounded(M.exchange_total_history(history(m)).select(
        "date", "total_market_cap", "active_asset_count", "new_issuance", "price_effect", "removed_capital", "period_return",
        "return_index", "equal_weighted_index", "cumulative_invested_capital", "cumulative_flow_adjusted_pl", "drawdown",
        "assets_added_count"), MONEY)


@query("exchange_quality_report", """
    SELECT date, active_asset_count, direct_observation_asset_count, carried_forward_asset_count, stale_asset_count,
           r6(median_observation_age_days) AS median_observation_age_days, max_observation_age_days,
           r6(direct_cap / total_market_cap) AS direct_coverage_pct, r6(carried_cap / total_market_cap) AS carried_forward_coverage_pct
    FROM xtotal""")
def _(m):
    return rounded(M.exchange_total_history(history(m)).select(
        "date", "active_asset_count", "direct_observation_asset_count", "carried_forward_asset_count", "stale_asset_count",
        "median_observation_age_days", "max_observation_age_days", "direct_coverage_pct", "carried_forward_coverage_pct"))


@query("exchange_reconciliation", """
    SELECT date, r2(prior_market_cap) AS prior_market_cap, r2(price_effect) AS price_effect, r2(new_issuance) AS new_issuance,
           r2(removed_capital) AS removed_capital, r2(total_market_cap) AS total_market_cap, r2(diff) AS reconciliation_difference,
           abs(diff) <= 0.01 AS reconciles FROM xtotal""")
def _(m):
    return rounded(M.exchange_total_history(history(m)).select(
        "date", "prior_market_cap", "price_effect", "new_issuance", "removed_capital", "total_market_cap",
        "reconciliation_difference", "reconciles"), MONEY)


@query("exchange_category_history", """
    WITH c AS (SELECT category, date, sum(market_cap) AS cap, count(*) AS n, sum(new_issuance) AS iss, sum(removed_capital) AS rem,
                      sum(price_effect) AS eff FROM xhist GROUP BY ALL),
    p AS (SELECT *, coalesce(lag(cap) OVER (PARTITION BY category ORDER BY date), 0) AS prior,
                 cap / sum(cap) OVER (PARTITION BY date) AS weight FROM c),
    r AS (SELECT *, CASE WHEN prior > 0 THEN (cap - iss + rem) / prior - 1 ELSE 0 END AS ret FROM p)
    SELECT category, date, r2(cap) AS category_market_cap, n AS active_asset_count, r6(weight) AS category_weight,
           r2(prior) AS prior_category_market_cap, r2(eff) AS price_effect, r6(ret) AS period_return,
           r6(100 * product(1 + ret) OVER (PARTITION BY category ORDER BY date)) AS return_index FROM r""")
def _(m):
    return rounded(M.exchange_category_history(history(m)).withColumnRenamed("total_market_cap", "category_market_cap").select(
        "category", "date", "category_market_cap", "active_asset_count", "category_weight", "prior_category_market_cap",
        "price_effect", "period_return", "return_index"), MONEY)


@query("exchange_additions", """
    SELECT date, asset_id, ticker || ' — ' || name || ' ($' || format('{:,}', CAST(round(new_issuance) AS BIGINT)) || ')' AS label
    FROM xhist WHERE new_issuance > 0""")
def _(m):
    return M.exchange_additions(history(m))


@query("hash_group_agg", """
    SELECT date, count(*) AS rows, count(DISTINCT category) AS categories, r2(sum(market_cap)) AS market_cap, r6(avg(price)) AS mean_price,
           r6(min(price)) AS min_price, r6(max(price)) AS max_price FROM xhist GROUP BY date""")
def _(m):
    return history(m).groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("category").alias("categories"), rnd(F.sum("market_cap"), 2).alias("market_cap"),
        rnd(F.avg("price")).alias("mean_price"), rnd(F.min("price")).alias("min_price"), rnd(F.max("price")).alias("max_price"))


@query("conditional_agg", """
    SELECT category, date, r2(coalesce(sum(market_cap) FILTER (is_direct_observation), 0)) AS direct_cap,
           r2(coalesce(sum(market_cap) FILTER (price_source = 'carried_forward'), 0)) AS carried_cap FROM xhist GROUP BY ALL""")
def _(m):
    t = M.exchange_totals(history(m), ["category"])
    return t.select("category", "date", rnd("direct_observation_market_cap", 2).alias("direct_cap"),
                    rnd("carried_forward_market_cap", 2).alias("carried_cap"))


@query("interval_membership", """
    SELECT date, count(*) AS listed, count(*) FILTER (is_exit_effective_date) AS leaving FROM xhist GROUP BY date""")
def _(m):
    return history(m).groupBy("date").agg(F.count(F.lit(1)).alias("listed"), F.count_if("is_exit_effective_date").alias("leaving"))


@query("cross_grid", """
    SELECT asset_id, count(*) AS periods, min(date) AS first_period, max(date) AS last_period FROM xhist GROUP BY asset_id""")
def _(m):
    return history(m).groupBy("asset_id").agg(F.count(F.lit(1)).alias("periods"), F.min("date").alias("first_period"),
                                              F.max("date").alias("last_period"))


@query("bounded_rebuild", """
    SELECT category, date, count(*) AS n, r2(sum(market_cap)) AS market_cap FROM xhist
    WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY ALL""")
def _(m):
    # flows need the whole history of each asset, so the date bound applies to the result
    h = history(m).filter(F.col("date").between("1998-01-01", "1999-12-31"))
    return h.groupBy("category", "date").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("market_cap"), 2).alias("market_cap"))


@query("performance_summary", """
    SELECT r6(arg_max(return_index, date) / arg_min(return_index, date) - 1) AS since_inception_return,
           r6((arg_max(return_index, date) / arg_min(return_index, date)) ** (1 / (count(*) / 4)) - 1) AS annualized_return,
           r6(stddev_pop(period_return) * 2) AS annualized_volatility, r6(min(dd)) AS max_drawdown, r6(arg_max(dd, date)) AS current_drawdown
    FROM (SELECT *, return_index / max(return_index) OVER (ORDER BY date) - 1 AS dd FROM xtotal)""")
def _(m):
    return rounded(M.performance_summary(M.exchange_total_history(history(m)), 4))


@query("group_small_as_other", """
    WITH c AS (SELECT category, sum(market_cap) AS cap FROM xhist WHERE date = DATE '2001-12-31' GROUP BY 1)
    SELECT grp AS category, r2(sum(cap)) AS market_cap, r6(sum(w)) AS weight
    FROM (SELECT CASE WHEN cap / sum(cap) OVER () >= 0.17 THEN category ELSE 'Other' END AS grp, cap, cap / sum(cap) OVER () AS w FROM c)
    GROUP BY grp""")
def _(m):
    c = history(m).filter(F.col("date") == AS_OF).groupBy("category").agg(F.sum("market_cap").alias("cap"))
    total = c.agg(F.sum("cap").alias("total"))
    w = ratio("cap", "total")
    shares = c.join(total).withColumn("weight", w).withColumn("category", F.when(w >= 0.17, F.col("category")).otherwise("Other"))
    return shares.groupBy("category").agg(rnd(F.sum("cap"), 2).alias("market_cap"), rnd(F.sum("weight")).alias("weight"))


@query("staleness_filter", """
    SELECT asset_id, date, r6(price) AS price, observation_age_days FROM xhist h WHERE observation_age_days <= 120
    AND EXISTS (SELECT 1 FROM q_quotes q WHERE q.asset_id = h.asset_id AND q.date = h.date)""")
def _(m):
    h = history(m).filter("observation_age_days <= 120")
    return h.join(quarterly(m).select("asset_id", "date"), ["asset_id", "date"], "left_semi").select(
        "asset_id", "date", rnd("price").alias("price"), "observation_age_days")


# --- universes ----------------------------------------------------------------------------

shared_sql("universe", """
    SELECT a.asset_id, a.ticker, a.category, a.status, s.canonical_status, coalesce(n, 0) AS history_row_count, first_d, last_d,
           coalesce(has_cap, FALSE) AS has_cap, a.offering_date <= DATE '2001-12-31' AS entered,
           NOT regexp_matches(lower(a.asset_id || ' ' || a.ticker || ' ' || a.name),
                              'fixture|sample|demo|mock|placeholder|synthetic|example') AS production
    FROM assets a JOIN status_map s USING (status)
    LEFT JOIN (SELECT asset_id, count(*) AS n, min(date) AS first_d, max(date) AS last_d, max(cap) > 0 AS has_cap
               FROM q_quotes GROUP BY 1) USING (asset_id)""")


@query("asset_universe", """
    WITH u AS (SELECT *, list_filter([CASE WHEN NOT production THEN 'not_production_asset' END,
             CASE WHEN canonical_status <> 'active_tradable' THEN 'status_excluded_active_only' END,
             CASE WHEN NOT entered THEN 'not_entered_by_as_of_date' END,
             CASE WHEN history_row_count = 0 THEN 'missing_price_history' END], lambda x: x IS NOT NULL) AS why FROM universe)
    SELECT asset_id, ticker, category, canonical_status, history_row_count, first_d AS first_observation_date,
           last_d AS last_observation_date, has_cap AS has_market_cap_history, len(why) = 0 AS is_universe_eligible,
           CASE WHEN len(why) = 0 THEN 'included' ELSE array_to_string(why, '|') END AS exclusion_reason FROM u""")
def _(m):
    return M.asset_universe(m.assets, quarterly(m), AS_OF).select(
        "asset_id", "ticker", "category", "canonical_status", F.col("history_row_count").cast("bigint"), "first_observation_date",
        "last_observation_date", "has_market_cap_history", "is_universe_eligible", "exclusion_reason")


@query("universe_diagnostics", """
    SELECT asset_id, canonical_status, production AND entered AND history_row_count > 0 AS quarterly_eligible,
           production AND entered AND history_row_count > 0 AND has_cap AS market_cap_weight_eligible,
           canonical_status IN ('exited', 'pending_settlement') OR asset_id IN (SELECT asset_id FROM exits) AS exit_recognized
    FROM universe""")
def _(m):
    u = M.asset_universe(m.assets, quarterly(m), AS_OF, include_exited=True)
    recognised = m.exits.select("asset_id", F.lit(True).alias("_x")).distinct()
    return u.join(recognised, "asset_id", "left").select(
        "asset_id", "canonical_status", F.col("is_universe_eligible").alias("quarterly_eligible"),
        (F.col("is_universe_eligible") & F.col("has_market_cap_history")).alias("market_cap_weight_eligible"),
        (F.coalesce("_x", F.lit(False)) | F.col("canonical_status").isin("exited", "pending_settlement")).alias("exit_recognized"))


@query("status_canonical", "SELECT asset_id, status, canonical_status FROM assets JOIN status_map USING (status)")
def _(m):
    return m.assets.select("asset_id", "status", M.canonical_status("status").alias("canonical_status"))


@query("is_production_row", """
    SELECT doc_id, NOT regexp_matches(lower(coalesce(source, '') || ' ' || text),
           'fixture|sample|demo|mock|placeholder|synthetic|example') AS is_production FROM documents""")
def _(m):
    return m.table("documents").select("doc_id", M.is_production(["source", "text"]).alias("is_production"))


@query("semi_allowed_ids", """
    SELECT asset_id, date, r6(price) AS price FROM q_quotes WHERE asset_id IN (
        SELECT asset_id FROM universe WHERE production AND entered AND canonical_status = 'active_tradable' AND history_row_count > 0)""")
def _(m):
    q = quarterly(m)
    eligible = M.asset_universe(m.assets, q, AS_OF).filter("is_universe_eligible").select("asset_id")
    return q.join(eligible, "asset_id", "left_semi").select("asset_id", "date", rnd("price").alias("price"))


@query("registry_views", """
    SELECT asset_id, status, CASE status WHEN 'trading' THEN 'active' WHEN 'buyout_pending' THEN 'pending_buyout' ELSE 'historical' END
           AS registry FROM assets""")
def _(m):
    s = M.canonical_status("status")
    return m.assets.select("asset_id", "status", F.when(s == "active_tradable", "active").when(
        s == "trading_paused", "pending_buyout").otherwise("historical").alias("registry"))


shared_sql("current_rows", """
    SELECT h.asset_id, h.ticker, h.category, h.date, h.price, h.price * h.share_count AS cap, h.observation_age_days, h.price_source,
           h.is_direct_observation, h.is_stale, s.canonical_status,
           s.canonical_status = 'active_tradable' AND h.observation_age_days <= 120 AND h.price_source <> 'offering_price' AS tradable,
           s.canonical_status IN ('active_tradable', 'trading_paused', 'pending_settlement') AS represented
    FROM xhist h JOIN status_map s USING (status) WHERE h.date = (SELECT max(date) FROM xhist)""")


@query("current_universe", """
    SELECT asset_id, ticker, category, canonical_status, r6(price) AS price, r2(cap) AS market_cap, observation_age_days, price_source,
           tradable AS is_current_tradable, represented AS is_represented_asset FROM current_rows""")
def _(m):
    u = M.current_universe(m.assets, history(m), AS_OF)
    return u.select("asset_id", "ticker", "category", "canonical_status", rnd("price").alias("price"),
                    rnd("canonical_market_cap", 2).alias("market_cap"), "observation_age_days", "price_source",
                    "is_current_tradable", "is_represented_asset")


@query("current_universe_summary", """
    SELECT max(date) AS as_of_date, count(*) AS unique_asset_count, count(*) FILTER (tradable) AS tradable_asset_count,
           r2(sum(cap)) AS tradable_market_cap, count(DISTINCT category) AS category_count,
           count(*) FILTER (is_direct_observation) AS direct_price_count,
           count(*) FILTER (price_source = 'carried_forward') AS carried_forward_count, count(*) FILTER (is_stale) AS stale_value_count,
           count(*) FILTER (cap IS NULL) AS missing_value_count FROM current_rows WHERE tradable""")
def _(m):
    u = M.current_universe(m.assets, history(m), AS_OF).filter("is_current_tradable")
    return rounded(M.current_summary(u), ("tradable_market_cap",))


@query("universe_reconciliation", """
    WITH o AS (SELECT asset_id, arg_max(cap, date) AS observed_cap FROM q_quotes WHERE cap IS NOT NULL GROUP BY 1),
    j AS (SELECT coalesce(c.asset_id, o.asset_id) AS asset_id, c.cap, o.observed_cap, c.price_source, c.is_stale FROM current_rows c
          FULL JOIN o ON o.asset_id = c.asset_id)
    SELECT asset_id, r2(cap) AS exchange_cap, r2(observed_cap) AS observed_cap, r2(coalesce(cap, 0) - coalesce(observed_cap, 0)) AS difference,
           r8(abs(coalesce(cap, 0) - coalesce(observed_cap, 0)) / sum(abs(coalesce(cap, 0) - coalesce(observed_cap, 0))) OVER ()) AS gap_share,
           array_to_string(list_filter([CASE WHEN cap IS NULL THEN 'missing_in_exchange' END, CASE WHEN observed_cap IS NULL THEN
           'missing_in_observations' END, CASE WHEN is_stale THEN 'stale_price' END, CASE WHEN price_source = 'carried_forward' THEN
           'carried_forward' END], lambda x: x IS NOT NULL), '|') AS reasons FROM j""")
def _(m):
    from tessera.operators.quality import reconcile_caps

    u = M.current_universe(m.assets, history(m), AS_OF).select(
        "asset_id", F.col("canonical_market_cap").alias("cap"), "price_source", "is_stale")
    o = quarterly(m).filter("cap IS NOT NULL").groupBy("asset_id").agg(F.max_by("cap", "date").alias("observed_cap"))
    out = reconcile_caps(u, o)
    return out.select("asset_id", rnd("cap", 2).alias("exchange_cap"), rnd("observed_cap", 2).alias("observed_cap"),
                      rnd("difference", 2).alias("difference"), rnd("gap_share", 8).alias("gap_share"), "reasons")


@query("asset_master", """
    WITH s AS (SELECT a.*, q.last_quote, CASE WHEN a.asset_id % 11 = 0 THEN NULL ELSE offering_price_usd * share_count END AS val
               FROM assets a LEFT JOIN (SELECT asset_id, max(date) AS last_quote FROM d_quotes GROUP BY 1) q USING (asset_id)),
    p AS (SELECT *, val / share_count AS op, exit_price_per_share * share_count AS ev,
                 list_filter([CASE WHEN val IS NULL THEN 'missing_offering_price' END, CASE WHEN last_quote IS NULL THEN 'missing_quote_snapshot' END,
                 CASE WHEN DATE '2001-12-31' - last_quote > 30 THEN 'stale_quote_snapshot' END], lambda x: x IS NOT NULL) AS why FROM s)
    SELECT asset_id, ticker, r6(op) AS offering_price, r2(ev) AS exit_value_usd, r6(ev / share_count / op - 1) AS total_return_at_exit,
           last_quote AS last_quote_observed_at, CASE WHEN len(why) = 0 THEN 'usable' WHEN val IS NULL THEN 'incomplete' ELSE 'limited' END
           AS data_quality_status, array_to_string(why, '; ') AS data_quality_warnings FROM p""")
def _(m):
    a = m.assets.withColumn("offering_valuation_usd", F.when(F.col("asset_id") % 11 != 0, F.col("offering_price_usd") * F.col("share_count")))
    return M.asset_master(a, daily(m), AS_OF).select(
        "asset_id", "ticker", rnd("offering_price").alias("offering_price"), rnd("exit_value_usd", 2).alias("exit_value_usd"),
        rnd("total_return_at_exit").alias("total_return_at_exit"), "last_quote_observed_at", "data_quality_status", "data_quality_warnings")


# --- returns, liquidity, market table -----------------------------------------------------

shared_sql("asset_rets", """
    WITH l AS (SELECT asset_id, max(date) AS latest, arg_max(price, date) AS p1, arg_min(price, date) AS p0, count(*) AS n
               FROM q_quotes GROUP BY 1)
    SELECT l.asset_id, p1 / max_by(q.price, q.date) FILTER (q.date <= CAST(latest - INTERVAL 3 MONTH AS DATE)) - 1 AS return_1q,
           p1 / max_by(q.price, q.date) FILTER (q.date <= CAST(latest - INTERVAL 12 MONTH AS DATE)) - 1 AS return_1y,
           CASE WHEN n >= 2 THEN p1 / p0 - 1 END AS return_full_history
    FROM l JOIN q_quotes q USING (asset_id) GROUP BY l.asset_id, p1, p0, n""")
shared_sql("liq", """
    WITH r AS (SELECT *, price / lag(price) OVER w - 1 AS ret, price / max(price) OVER w - 1 AS dd FROM d_quotes
               WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
    g AS (SELECT asset_id, arg_max(bid, date) AS bid, arg_max(ask, date) AS ask, arg_max(price, date) AS p1, sum(volume) AS volume,
                 max(date) FILTER (volume > 0) AS last_trade, count(*) FILTER (volume = 0) AS zero_days, stddev_pop(ret) AS sd, min(dd) AS mdd
          FROM r GROUP BY 1)
    SELECT asset_id, (ask - bid) / ((ask + bid) / 2) AS bid_ask_spread_pct, volume / share_count AS turnover,
           CAST(DATE '2001-12-31' - last_trade AS INT) AS days_since_last_trade, zero_days AS days_with_zero_trades,
           coalesce(sd * sqrt(252), 0) AS realized_volatility, mdd AS max_drawdown, p1 / offering_price_usd - 1 AS return_since_offering,
           DATE '2001-12-31' - last_trade > 14 AS stale_mark_flag
    FROM g JOIN assets USING (asset_id)""")


@query("asset_return_summary", """
    SELECT asset_id, r6(return_1q) AS return_1q, r6(return_1y) AS return_1y, r6(return_full_history) AS return_full_history FROM asset_rets""")
def _(m):
    return rounded(M.asset_returns(quarterly(m)))


@query("liquidity_metrics", """
    SELECT asset_id, r6(bid_ask_spread_pct) AS bid_ask_spread_pct, r6(turnover) AS turnover, days_since_last_trade,
           days_with_zero_trades, r6(realized_volatility) AS realized_volatility, r6(max_drawdown) AS max_drawdown,
           r6(return_since_offering) AS return_since_offering, stale_mark_flag FROM liq""")
def _(m):
    return rounded(M.liquidity_metrics(m.assets, daily(m), AS_OF))


@query("universe_export", """
    WITH r AS (SELECT *, price / lag(price) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS ret FROM d_quotes),
    l AS (SELECT asset_id, max(date) AS latest, arg_max(price, date) AS p1, stddev_pop(ret) AS sd, avg(ret) AS mean,
                 stddev_pop(ret) FILTER (ret < 0) AS dsd, count(*) FILTER (ret < 0) AS dn FROM r GROUP BY 1),
    b AS (SELECT l.asset_id, max_by(price, date) FILTER (date <= latest - 1) AS b1, max_by(price, date) FILTER (date <= latest - 7) AS b7,
                 max_by(price, date) FILTER (date <= latest - 30) AS b30 FROM l JOIN d_quotes USING (asset_id) GROUP BY 1)
    SELECT asset_id, r6(p1) AS price, r6(p1 / b1 - 1) AS return_1d, r6(p1 / b7 - 1) AS return_7d, r6(p1 / b30 - 1) AS return_30d,
           r6(coalesce(sd * sqrt(252), 0)) AS volatility, r6(mean * 252 / nullif(sd * sqrt(252), 0)) AS sharpe,
           r6(CASE WHEN dn > 1 THEN mean * 252 / nullif(dsd * sqrt(252), 0) END) AS sortino, r6(q.max_drawdown) AS max_drawdown,
           CASE WHEN 1 - (asset_id % 10) / 10.0 >= .75 THEN 'high' WHEN 1 - (asset_id % 10) / 10.0 >= .45 THEN 'medium' ELSE 'low' END AS source_quality
    FROM l JOIN b USING (asset_id) JOIN liq q USING (asset_id)""")
def _(m):
    from tessera.operators.crosssection import universe_export

    q = daily(m)
    confidence = m.assets.select("asset_id", (1 - (F.col("asset_id") % 10) / 10.0).alias("source_confidence"))
    return rounded(universe_export(q, M.liquidity_metrics(m.assets, q, AS_OF), confidence))


@query("market_table", """
    WITH l AS (SELECT asset_id, max(date) AS quoted, arg_max(price, date) AS last_price, arg_max(bid, date) AS best_bid,
                      arg_max(ask, date) AS best_ask FROM d_quotes GROUP BY 1),
    n AS (SELECT asset_id, sum(realized_price_usd * exactness_score) / sum(exactness_score) AS nav FROM comps GROUP BY 1)
    SELECT a.asset_id, a.ticker, r6(last_price) AS last_price, r6(return_1q) AS return_1q, r6(return_1y) AS return_1y, r8(best_bid) AS best_bid,
           r8(best_ask) AS best_ask, r6(bid_ask_spread_pct) AS bid_ask_spread_pct, r2(last_price * share_count) AS current_market_cap_usd,
           r2(nav) AS estimated_fair_value_usd, r6(last_price * share_count / nav - 1) AS premium_discount_to_fair_value,
           a.status = 'trading' AND (quoted IS NOT NULL OR offering_price_usd IS NOT NULL) AS is_current_listed
    FROM assets a LEFT JOIN l USING (asset_id) LEFT JOIN asset_rets USING (asset_id) LEFT JOIN liq USING (asset_id) LEFT JOIN n USING (asset_id)""")
def _(m):
    out = market_table(m).select(
        "asset_id", "ticker", "last_price", "return_1q", "return_1y", "best_bid", "best_ask", "bid_ask_spread_pct",
        "current_market_cap_usd", "estimated_fair_value_usd", "premium_discount_to_fair_value", "is_current_listed")
    bids = ("best_bid", "best_ask")
    return rounded(out, ("current_market_cap_usd", "estimated_fair_value_usd"), exact=bids).withColumns(
        {c: rnd(c, 8) for c in bids})


def market_table(m: Market) -> DataFrame:
    q = daily(m)
    latest = q.groupBy("asset_id").agg(F.max("date").alias("quoted"), F.max_by(F.struct("price", "bid", "ask"), "date").alias("l"))
    nav = m.comps.groupBy("asset_id").agg(
        (F.sum(F.col("realized_price_usd") * F.col("exactness_score")) / F.sum("exactness_score")).alias("estimated_fair_value_usd"),
        F.avg("source_confidence").alias("nav_confidence"))
    t = (m.assets.join(latest, "asset_id", "left").join(M.asset_returns(quarterly(m)), "asset_id", "left")
         .join(M.liquidity_metrics(m.assets, q, AS_OF).select("asset_id", "bid_ask_spread_pct"), "asset_id", "left")
         .join(nav, "asset_id", "left"))
    cap = F.col("l.price") * F.col("share_count")
    has_quote = F.col("quoted").isNotNull() & F.col("l.price").isNotNull()
    evidence = F.col("share_count").isNotNull() & F.col("offering_price_usd").isNotNull()
    return (t.withColumn("last_price", F.col("l.price")).withColumn("best_bid", F.col("l.bid")).withColumn("best_ask", F.col("l.ask"))
            .withColumn("current_market_cap_usd", cap)
            .withColumn("premium_discount_to_fair_value", change(cap, F.nullif("estimated_fair_value_usd", F.lit(0.0))))
            .withColumn("is_current_listed", F.lower("status").isin("trading", "accepting_orders") & (has_quote | evidence)))


@query("current_listed_flag", """
    SELECT category, count(*) AS assets, count(*) FILTER (status = 'trading') AS listed FROM assets GROUP BY category""")
def _(m):
    return market_table(m).groupBy("category").agg(F.count(F.lit(1)).alias("assets"), F.count_if("is_current_listed").alias("listed"))


@query("filter_market_table", """
    WITH l AS (SELECT asset_id, arg_max(price, date) AS p FROM d_quotes GROUP BY 1),
    n AS (SELECT asset_id, sum(realized_price_usd * exactness_score) / sum(exactness_score) AS nav, avg(source_confidence) AS conf
          FROM comps GROUP BY 1)
    SELECT asset_id, ticker, name, category FROM assets a JOIN l USING (asset_id) JOIN n USING (asset_id)
    WHERE status = 'trading' AND contains(lower(name), 'ring') AND category IN ('ECONOMY', 'PROMO', 'STANDARD')
      AND p * share_count / nav - 1 < 0 AND conf >= 0.9""")
def _(m):
    from tessera.operators.crosssection import filter_market

    return filter_market(market_table(m), search="Ring ", categories=["ECONOMY", "PROMO", "STANDARD"], valuation="below",
                         min_confidence=0.9).select("asset_id", "ticker", "name", "category")


@query("equi_left_enrich", """
    SELECT a.asset_id, a.category, r6(l.turnover) AS turnover, r6(r.return_1y) AS return_1y
    FROM assets a LEFT JOIN liq l USING (asset_id) LEFT JOIN asset_rets r USING (asset_id)""")
def _(m):
    return (m.assets.join(M.liquidity_metrics(m.assets, daily(m), AS_OF), "asset_id", "left")
            .join(M.asset_returns(quarterly(m)), "asset_id", "left")
            .select("asset_id", "category", rnd("turnover").alias("turnover"), rnd("return_1y").alias("return_1y")))


@query("tape_candidates", """
    WITH q AS (SELECT 'asset' AS kind, CAST(asset_id AS VARCHAR) AS object_id, date, price AS v FROM q_quotes
               UNION ALL SELECT 'index', family || ':' || weighting, date, index_level FROM qidx_series),
    k AS (SELECT *, year(date) * 4 + quarter(date) AS o FROM q),
    c AS (SELECT a.kind, a.object_id, a.date, a.v / b.v - 1 AS qoq, a.v / y.v - 1 AS yoy FROM k a
          LEFT JOIN k b ON b.kind = a.kind AND b.object_id = a.object_id AND b.o = a.o - 1
          LEFT JOIN k y ON y.kind = a.kind AND y.object_id = a.object_id AND y.o = a.o - 4),
    l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY kind, object_id ORDER BY date DESC) = 1)
    SELECT kind, object_id, date, 'return_1q' AS metric, r6(qoq) AS value FROM l WHERE qoq IS NOT NULL
    UNION ALL SELECT kind, object_id, date, 'return_1y', r6(yoy) FROM l WHERE yoy IS NOT NULL""")
def _(m):
    assets = quarterly(m).select(F.lit("asset").alias("kind"), F.col("asset_id").cast("string").alias("object_id"), "date", "price")
    idx = family(m).series.select(F.lit("index").alias("kind"), F.concat_ws(":", "family", "weighting").alias("object_id"), "date",
                                  F.col("index_level").alias("price"))
    both = exact_changes(assets.unionByName(idx).withColumn("_key", F.concat_ws("|", "kind", "object_id")), "_key")
    last = both.groupBy("kind", "object_id").agg(F.max_by(F.struct("date", "qoq", "yoy"), "date").alias("l"))
    return last.select("kind", "object_id", F.col("l.date").alias("date"), F.col("l.qoq").alias("return_1q"),
                       F.col("l.yoy").alias("return_1y")).unpivot(
        ["kind", "object_id", "date"], ["return_1q", "return_1y"], "metric", "value").filter("value IS NOT NULL").withColumn(
        "value", rnd("value"))
