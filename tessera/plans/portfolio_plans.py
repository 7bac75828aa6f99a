"""Portfolio, total-return and rule-backtest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import rnd
from tessera.operators import market as M
from tessera.operators import portfolios as P
from tessera.operators import rules as R
from tessera.operators import series as S
from tessera.operators import replication as N
from tessera.operators.canonical import canonical_rows
from tessera.session import staged
from tessera.plans.index_plans import baskets, family, trios
from tessera.plans.market_plans import exits, rounded
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import AS_OF, quarterly
from tessera.sources.market_views import Market

UW = ["universe", "weighting"]


def known_dates(m: Market) -> DataFrame:
    events = m.exits.select(*[c.alias(name) for name, c in M.exit_dates(m.exits).items()])
    return P.known_dates(m.assets, m.observations.select(F.col("period_end").alias("date")), events)


def total_return(m: Market) -> P.TotalReturn:
    known = known_dates(m)
    quotes = quarterly(m)
    return P.total_return_index(m.assets, quotes, exits(m, quotes), P.grid_dates(known, "month"))


def simulation_sql(prefix: str, panel: str, keys: str, absolute: bool = False) -> None:
    """Segment factors by joining each date to the last rebalance before it. The panel view has the keys, asset_id, date,
    worth, bucket, is_rebalance and target."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys.split(", "))
    b_on = " AND ".join(f"t.{k} = b.{k}" for k in keys.split(", "))
    w = "b.target" if absolute else "b.target / s.total"
    rest = "greatest(0, 1 - sum(target))" if absolute else "0.0"
    shared_sql(f"{prefix}_seg", f"""
        SELECT {keys}, date, sum(target) AS total, count(*) AS n, {rest} AS rest FROM {panel}
        WHERE is_rebalance AND target > 0 GROUP BY {keys}, date""")
    shared_sql(f"{prefix}_days", f"SELECT DISTINCT {keys}, date FROM {panel}")
    shared_sql(f"{prefix}_own", f"""
        SELECT t.*, s.date AS sdate, s.total, s.rest FROM {prefix}_days t ASOF JOIN {prefix}_seg s ON {on} AND t.date > s.date""")
    shared_sql(f"{prefix}_leg", f"""
        SELECT {", ".join("t." + k for k in keys.split(", "))}, t.date, t.asset_id, t.bucket, {w} * t.worth / b.worth AS wf
        FROM {panel} t JOIN {prefix}_own s ON {on} AND t.date = s.date
        JOIN {panel} b ON {b_on} AND b.asset_id = t.asset_id AND b.date = s.sdate AND b.target > 0""")
    shared_sql(f"{prefix}_g", f"""
        SELECT {keys}, date, sum(wf) AS g, coalesce(sum(wf) FILTER (bucket = 'cash'), 0) AS cash_w,
               coalesce(sum(wf) FILTER (bucket = 'pending'), 0) AS pend_w, count(*) FILTER (bucket = 'held' AND wf > 0) AS active
        FROM {prefix}_leg GROUP BY {keys}, date""")
    shared_sql(f"{prefix}_path", f"""
        WITH d AS (SELECT y.*, CASE WHEN o.sdate IS NULL THEN 1 ELSE coalesce(g.g, 0) + o.rest END AS growth, o.sdate, o.rest AS leg, g.cash_w,
                          g.pend_w, g.active, s.n, s.rest
                   FROM {prefix}_days y LEFT JOIN {prefix}_own o USING ({keys}, date) LEFT JOIN {prefix}_g g USING ({keys}, date)
                   LEFT JOIN {prefix}_seg s USING ({keys}, date)),
        v AS (SELECT *, 100 * coalesce(product(CASE WHEN n IS NULL THEN 1 ELSE growth END) OVER (PARTITION BY {keys} ORDER BY date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS opening FROM d)
        SELECT *, opening * growth AS value,
               CASE WHEN n IS NOT NULL THEN opening * growth * rest WHEN sdate IS NULL THEN 100
                    ELSE opening * (coalesce(cash_w, 0) + leg) END AS cash_value,
               CASE WHEN n IS NOT NULL THEN 0 ELSE opening * coalesce(pend_w, 0) END AS pending_value,
               coalesce(n, active, 0) AS active_count FROM v""")


# --- total return -------------------------------------------------------------------------

shared_sql("tr_known", """
    SELECT offering_date AS date FROM assets UNION SELECT date FROM px UNION SELECT exit_effective_date FROM exit_all
    UNION SELECT settlement_date FROM exit_all UNION SELECT exit_announcement_date FROM exit_all UNION SELECT last_trading_date FROM exit_all""")
shared_sql("tr_grid", """
    WITH b AS (SELECT min(date) AS s, max(date) AS e FROM tr_known),
    d AS (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS date, s, e FROM b)
    SELECT date FROM d WHERE last_day(date) = date OR date = s OR date = e""")
shared_sql("tr_marks", """
    WITH q AS (SELECT date AS p FROM tr_grid WHERE last_day(date) = date AND month(date) % 3 = 0)
    SELECT min(g.date) AS date FROM q JOIN tr_grid g ON g.date >= p GROUP BY p UNION SELECT min(date) FROM tr_grid""")
shared_sql("tr_panel", """
    WITH pg AS (SELECT px.* FROM px SEMI JOIN tr_grid USING (date)),
    a AS (SELECT assets.*, x.exit_effective_date AS gone, x.settlement_date AS settles, x.exit_status, x.terminal_price AS terminal, g.date
          FROM assets LEFT JOIN (SELECT * FROM exit_events WHERE exit_status <> 'cancelled_exit') x USING (asset_id) CROSS JOIN tr_grid g),
    j AS (SELECT a.*, p.price FROM a ASOF JOIN pg p ON p.asset_id = a.asset_id AND a.date >= p.date),
    f AS (SELECT *, coalesce(date >= gone, FALSE) AS is_out FROM j)
    SELECT u.universe, w.weighting, f.asset_id, f.date, CASE WHEN is_out THEN coalesce(terminal, 0) ELSE price END AS worth,
           CASE WHEN is_out AND exit_status = 'pending_settlement' AND f.date < settles THEN 'pending' WHEN is_out THEN 'cash' ELSE 'held' END AS bucket,
           f.date IN (SELECT date FROM tr_marks) AS is_rebalance,
           CASE WHEN NOT is_out AND offering_date <= f.date THEN CASE w.weighting WHEN 'equal_weight' THEN 1.0 ELSE price * share_count END END AS target
    FROM f, LATERAL (SELECT unnest(['all', f.category]) AS universe) u, (VALUES ('equal_weight'), ('market_cap_weight')) w(weighting)""")
simulation_sql("tr", "tr_panel", "universe, weighting")
# the index keeps its base level from the first grid date on, also before anything can be bought
shared_sql("tr_full", """
    SELECT k.universe, k.weighting, g.date, coalesce(p.value, 100) AS value, coalesce(p.cash_value, 100) AS cash_value,
           coalesce(p.pending_value, 0) AS pending_value, coalesce(p.active_count, 0) AS active_count
    FROM (SELECT DISTINCT universe, weighting FROM tr_panel) k CROSS JOIN tr_grid g LEFT JOIN tr_path p USING (universe, weighting, date)""")


@query("total_return_index", """
    SELECT universe, weighting, date, r6(value) AS index_level, r6(cash_value) AS cash_value, r6(pending_value) AS pending_value,
           active_count, r6(value / max(value) OVER (PARTITION BY universe, weighting ORDER BY date) - 1) AS drawdown,
           r6(coalesce(value / lag(value) OVER (PARTITION BY universe, weighting ORDER BY date) - 1, 0)) AS period_return FROM tr_full""")
def _(m):
    return rounded(total_return(m).series.select(*UW, "date", F.col("value").alias("index_level"), "cash_value", "pending_value",
                                                 "active_count", "drawdown", "period_return"))


@query("total_return_constituents", """
    WITH s AS (SELECT t.universe, t.weighting, t.date, t.asset_id, t.target / s.total AS w, t.worth FROM tr_panel t
               JOIN tr_seg s USING (universe, weighting, date) WHERE t.is_rebalance AND t.target > 0),
    n AS (SELECT l.universe, l.weighting, l.date, l.asset_id, l.wf FROM tr_leg l ANTI JOIN tr_seg s USING (universe, weighting, date)
          WHERE bucket = 'held')
    SELECT universe, weighting, date, asset_id, r6(w * p.value) AS position_value, r8(w) AS portfolio_weight
    FROM s JOIN tr_path p USING (universe, weighting, date)
    UNION ALL SELECT universe, weighting, date, asset_id, r6(wf * p.opening), r8(wf / p.growth) FROM n JOIN tr_path p USING (universe, weighting, date)""")
def _(m):
    return total_return(m).positions().select(*UW, "date", "asset_id", rnd("position_value").alias("position_value"),
                                            rnd("portfolio_weight", 8).alias("portfolio_weight"))


@query("total_return_window", """
    WITH w AS (SELECT *, value / max(value) OVER (PARTITION BY universe, weighting, yrs ORDER BY date) - 1 AS dd
               FROM tr_full, (VALUES (1), (3)) y(yrs) WHERE date >= CAST((SELECT max(date) FROM tr_grid) - to_months(CAST(12 * yrs AS INT)) AS DATE))
    SELECT universe, weighting, yrs AS years, r6(arg_max(value, date) / arg_min(value, date) - 1) AS total_return,
           r6((arg_max(value, date) / arg_min(value, date)) ** (365.25 / (max(date) - min(date))) - 1) AS cagr, r6(min(dd)) AS maximum_drawdown
    FROM w GROUP BY ALL""")
def _(m):
    s = total_return(m).series.select(*UW, "date", "value")
    newest = s.agg(F.max("date").alias("_end"))
    cut = s.join(newest).withColumn("years", F.explode(F.array(F.lit(1), F.lit(3)))).filter(
        F.col("date") >= F.add_months("_end", -12 * F.col("years")))
    keys = [*UW, "years"]
    dd = S.with_drawdown(cut, keys, "value")
    grown = F.max_by("value", "date") / F.min_by("value", "date")
    return dd.groupBy(*keys).agg(
        rnd(grown - 1).alias("total_return"),
        rnd(F.pow(grown, 365.25 / F.datediff(F.max("date"), F.min("date"))) - 1).alias("cagr"), rnd(F.min("drawdown")).alias("maximum_drawdown"))


@query("canonical_index_slice", """
    WITH s AS (SELECT t.universe, t.weighting, t.date, t.asset_id, t.target / s.total AS w FROM tr_panel t
               JOIN tr_seg s USING (universe, weighting, date) WHERE t.is_rebalance AND t.target > 0)
    SELECT universe, weighting, asset_id, r8(w) AS weight FROM s
    WHERE date = (SELECT max(date) FROM s s2 WHERE s2.universe = s.universe AND s2.weighting = s.weighting)""")
def _(m):
    return total_return(m).positions(last_only=True).select(*UW, "asset_id", rnd("portfolio_weight", 8).alias("weight"))


@query("event_date_grids", "SELECT DISTINCT date FROM tr_known")
def _(m):
    return P.grid_dates(known_dates(m), "native")


# --- baskets ------------------------------------------------------------------------------

shared_sql("bk_grid", """
    SELECT DISTINCT def_id, date FROM (SELECT asset_id, date FROM px UNION ALL SELECT asset_id, exit_effective_date FROM exit_events
        UNION ALL SELECT asset_id, settlement_date FROM exit_events) JOIN baskets USING (asset_id)""")
shared_sql("bk_marks", """
    WITH y AS (SELECT def_id, make_date(yr, 12, 31) AS p FROM (SELECT def_id, min(date) AS s, max(date) AS e FROM bk_grid GROUP BY 1),
               LATERAL (SELECT unnest(generate_series(year(s), year(e))) AS yr) WHERE make_date(yr, 12, 31) BETWEEN s AND e)
    SELECT g.def_id, min(g.date) AS date FROM y JOIN bk_grid g ON g.def_id = y.def_id AND g.date >= p GROUP BY g.def_id, p
    UNION SELECT def_id, min(date) FROM bk_grid GROUP BY 1""")
shared_sql("bk_panel", """
    WITH a AS (SELECT b.def_id, b.weight, s.*, x.exit_effective_date AS gone, x.settlement_date AS settles, x.exit_status,
                      x.terminal_price AS terminal, g.date
               FROM baskets b JOIN assets s USING (asset_id)
               LEFT JOIN (SELECT * FROM exit_events WHERE exit_status <> 'cancelled_exit') x USING (asset_id) JOIN bk_grid g USING (def_id)),
    f AS (SELECT a.*, p.price, coalesce(a.date >= gone, FALSE) AS is_out FROM a ASOF JOIN px p ON p.asset_id = a.asset_id AND a.date >= p.date)
    SELECT f.def_id, f.asset_id, f.date, CASE WHEN is_out THEN coalesce(terminal, 0) ELSE price END AS worth,
           CASE WHEN is_out AND exit_status = 'pending_settlement' AND f.date < settles THEN 'pending' WHEN is_out THEN 'cash' ELSE 'held' END AS bucket,
           k.date IS NOT NULL AS is_rebalance, CASE WHEN NOT is_out AND offering_date <= f.date THEN weight END AS target
    FROM f LEFT JOIN bk_marks k ON k.def_id = f.def_id AND k.date = f.date""")
simulation_sql("bk", "bk_panel", "def_id")
shared_sql("bk_full", """
    SELECT g.def_id, g.date, coalesce(value, 100) AS value, coalesce(cash_value, 100) AS cash_value, coalesce(pending_value, 0) AS pending_value,
           coalesce(active_count, 0) AS active_count FROM bk_grid g LEFT JOIN bk_path USING (def_id, date)""")


def custom(m: Market) -> P.PortfolioResult:
    quotes = quarterly(m)
    return P.basket_portfolio(baskets(m).select("def_id", "asset_id", "weight"), m.assets, quotes, exits(m, quotes), "year")


@query("custom_portfolio", """
    SELECT def_id, date, r6(value) AS portfolio_value, r6(cash_value + pending_value) AS cash_value, active_count,
           r6(value / 100 - 1) AS cumulative_return FROM bk_full""")
def _(m):
    return custom(m).series.select(
        "def_id", "date", rnd("value").alias("portfolio_value"), rnd(F.col("cash_value") + F.col("pending_value")).alias("cash_value"),
        "active_count", rnd("cumulative_return").alias("cumulative_return"))


shared_sql("bk_pos", """
    SELECT t.def_id, t.date, t.asset_id, t.target / s.total * p.value AS v FROM bk_panel t JOIN bk_seg s USING (def_id, date)
    JOIN bk_path p USING (def_id, date) WHERE t.is_rebalance AND t.target > 0
    UNION ALL SELECT l.def_id, l.date, l.asset_id, l.wf * p.opening FROM bk_leg l JOIN bk_path p USING (def_id, date)
    WHERE bucket = 'held' AND p.n IS NULL""")


@query("attribution_holdings", """
    WITH e AS (SELECT def_id, min(date) AS lo, max(date) AS hi, arg_min(value, date) AS v0, arg_max(value, date) AS v1 FROM bk_full GROUP BY 1),
    a AS (SELECT p.def_id, asset_id, coalesce(sum(v) FILTER (date = lo), 0) AS a0, coalesce(sum(v) FILTER (date = hi), 0) AS a1, v0, v1
          FROM bk_pos p JOIN e USING (def_id) GROUP BY p.def_id, asset_id, v0, v1)
    SELECT def_id, asset_id, r6(a1 - a0) AS contribution, r8(a0 / v0) AS start_weight, r8(a1 / v1) AS end_weight FROM a""")
def _(m):
    out = P.holdings_attribution(custom(m), ["def_id"])
    return out.select("def_id", "asset_id", rnd("contribution").alias("contribution"), rnd("start_weight", 8).alias("start_weight"),
                      rnd("end_weight", 8).alias("end_weight"))


RISK_SQL = """
    WITH x AS (SELECT {k}, date, round(coalesce(value / lag(value) OVER w - 1, 0), 12) AS x, row_number() OVER w AS n, date - lag(date) OVER w AS gap
               FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY date)),
    s AS (SELECT * EXCLUDE (x), CASE WHEN abs(x) < 1e-9 THEN 0 ELSE x END AS r FROM x),
    f AS (SELECT {k}, CASE WHEN median(gap) <= 10 THEN 52 WHEN median(gap) <= 45 THEN 12 WHEN median(gap) <= 120 THEN 4 ELSE 1 END::DOUBLE AS ppy
          FROM s GROUP BY {k}),
    c AS (SELECT *, product(1 + r) OVER (PARTITION BY {k} ORDER BY date) AS growth FROM s),
    y AS (SELECT *, growth / max(growth) OVER (PARTITION BY {k} ORDER BY date) - 1 AS y FROM c),
    d AS (SELECT * EXCLUDE (y), CASE WHEN abs(y) < 1e-9 THEN 0 ELSE y END AS dd FROM y),
    b AS (SELECT * FROM d WHERE n > 1),
    neg AS (SELECT {k}, n - row_number() OVER (PARTITION BY {k} ORDER BY n) AS grp FROM b WHERE dd < 0),
    runs AS (SELECT {k}, max(c) AS longest FROM (SELECT {k}, grp, count(*) AS c FROM neg GROUP BY ALL) GROUP BY {k}),
    tr AS (SELECT {k}, n AS tn FROM b QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY dd, n) = 1),
    pk AS (SELECT {k}, tn, max(growth) AS pk FROM b JOIN tr USING ({k}) WHERE n <= tn GROUP BY {k}, tn),
    rec AS (SELECT {k}, min(date) AS recovery_date FROM b JOIN pk USING ({k}) WHERE n > tn AND growth >= pk GROUP BY {k}),
    a AS (SELECT {k}, ppy, count(*) AS n, product(1 + r) AS g, avg(r) AS mean, stddev_samp(r) AS sd, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS d2,
                 max(r) AS best, min(r) AS worst, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS hit, min(dd) AS mdd
          FROM b JOIN f USING ({k}) GROUP BY {k}, ppy)
    SELECT {k}, ppy AS periods_per_year, r6(g ** (ppy / n) - 1) AS annualized_return, r6(sd * sqrt(ppy)) AS annualized_volatility,
           r6(CASE WHEN sd > 0 THEN mean / sd * sqrt(ppy) END) AS sharpe_ratio, r6(CASE WHEN d2 > 0 THEN mean * ppy / (sqrt(d2 / n) * sqrt(ppy)) END) AS sortino_ratio,
           r6(CASE WHEN mdd < 0 THEN (g ** (ppy / n) - 1) / abs(mdd) END) AS calmar_ratio, r6(sqrt(d2 / n) * sqrt(ppy)) AS downside_deviation,
           r6(best) AS best_period_return, r6(worst) AS worst_period_return, r6(hit) AS positive_period_percentage, r6(mdd) AS maximum_drawdown,
           coalesce(longest, 0) AS maximum_drawdown_duration_periods, recovery_date
    FROM a LEFT JOIN runs USING ({k}) LEFT JOIN rec USING ({k})"""


@query("portfolio_risk_metrics", RISK_SQL.format(k="universe, weighting", t="tr_full"))
def _(m):
    return rounded(P.risk_metrics(total_return(m).series, UW))


@query("product_agg", """
    SELECT universe, weighting, year(date) AS year, r6(product(1 + r) - 1) AS year_return
    FROM (SELECT *, coalesce(value / lag(value) OVER (PARTITION BY universe, weighting ORDER BY date) - 1, 0) AS r FROM tr_full) GROUP BY ALL""")
def _(m):
    return total_return(m).series.groupBy(*UW, F.year("date").cast("bigint").alias("year")).agg(
        rnd(F.product(1 + F.col("period_return")) - 1).alias("year_return"))


# --- category strategy --------------------------------------------------------------------

shared_sql("canon", """
    SELECT asset_id, category, period_end AS date, observed_at, price_per_share AS price FROM observations
    QUALIFY row_number() OVER (PARTITION BY asset_id, period_end ORDER BY observed_at DESC, s1 DESC, s2 DESC, s3 DESC) = 1""")
shared_sql("strategy_defs", """
    SELECT category AS def_id, asset_id, 0.8 * (1 + asset_id % 3) / sum(1 + asset_id % 3) OVER (PARTITION BY category) AS weight FROM assets""")
shared_sql("cs_grid", """
    SELECT DISTINCT def_id, date FROM (SELECT asset_id, date FROM canon UNION ALL
        SELECT asset_id, last_day(CAST(date_trunc('quarter', exit_effective_date) + INTERVAL 2 MONTH AS DATE)) FROM exit_events)
    JOIN strategy_defs USING (asset_id)""")
shared_sql("cs_panel", """
    WITH a AS (SELECT d.*, last_day(CAST(date_trunc('quarter', x.exit_effective_date) + INTERVAL 2 MONTH AS DATE)) AS gone, x.terminal_price AS terminal,
                      g.date, min(g.date) OVER (PARTITION BY d.def_id) AS d0
               FROM strategy_defs d LEFT JOIN (SELECT * FROM exit_events WHERE exit_status <> 'cancelled_exit') x USING (asset_id)
               JOIN cs_grid g USING (def_id)),
    f AS (SELECT a.*, c.price, coalesce(a.date >= gone, FALSE) AS is_out FROM a ASOF JOIN canon c ON c.asset_id = a.asset_id AND a.date >= c.date)
    SELECT def_id, asset_id, date, CASE WHEN is_out THEN coalesce(terminal, 0) ELSE price END AS worth,
           CASE WHEN is_out THEN 'cash' ELSE 'held' END AS bucket, date = d0 OR quarter(date) = 4 AS is_rebalance,
           CASE WHEN NOT is_out THEN weight END AS target FROM f""")
simulation_sql("cs", "cs_panel", "def_id", absolute=True)


def canonical_prices(m: Market) -> DataFrame:
    return canonical_rows(m.observations).select("asset_id", F.col("canonical_period").alias("date"), F.col("price_per_share").alias("price"))


@query("category_strategy", """
    SELECT def_id, date, r6(value) AS portfolio_value, r6(cash_value) AS cash_value, r6(value - cash_value) AS invested_value, active_count,
           r6(value / max(value) OVER (PARTITION BY def_id ORDER BY date) - 1) AS drawdown FROM cs_path""")
def _(m):
    key = 1 + F.col("asset_id") % 3
    raw = m.assets.select(F.col("category").alias("def_id"), "asset_id", key.cast("double").alias("raw"))
    total = raw.groupBy("def_id").agg(F.sum("raw").alias("t"))
    defs = raw.join(total, "def_id").select("def_id", "asset_id", (0.8 * F.col("raw") / F.col("t")).alias("weight"))
    s = P.category_strategy(defs, canonical_prices(m), exits(m), "year").series
    return s.select("def_id", "date", rnd("value").alias("portfolio_value"), rnd("cash_value").alias("cash_value"),
                    rnd("invested_value").alias("invested_value"), "active_count", rnd("drawdown").alias("drawdown"))


# --- sleeves of category indexes ----------------------------------------------------------

shared_sql("sleeves", """
    SELECT weighting AS def_id, family AS asset_id, date, index_level AS price,
           ascii(family) / sum(ascii(family)) OVER (PARTITION BY weighting, date) AS weight
    FROM qidx_series WHERE family <> 'all'""")
shared_sql("sv_panel", """
    SELECT s.def_id, s.asset_id, s.date, s.price AS worth, 'held' AS bucket,
           quarter(s.date) = 4 OR s.date = (SELECT min(date) FROM sleeves) AS is_rebalance, s.weight AS target FROM sleeves s""")
simulation_sql("sv", "sv_panel", "def_id")
shared_sql("sv_ledger", """
    SELECT l.def_id, l.date, l.asset_id, l.wf / p.growth AS before, t.target / s.total AS target, p.value
    FROM sv_leg l JOIN sv_path p USING (def_id, date) JOIN sv_seg s USING (def_id, date)
    JOIN sv_panel t ON t.def_id = l.def_id AND t.date = l.date AND t.asset_id = l.asset_id""")


def sleeves(m: Market) -> DataFrame:
    s = family(m).series.filter("family <> 'all'").select(
        F.col("weighting").alias("def_id"), F.col("family").alias("asset_id"), "date", F.col("index_level").alias("price"))
    names = s.select("def_id", "asset_id").distinct().withColumn("raw", F.ascii("asset_id").cast("double"))
    total = names.groupBy("def_id").agg(F.sum("raw").alias("t"))
    w = names.join(total, "def_id").select("def_id", "asset_id", (F.col("raw") / F.col("t")).alias("weight"))
    # a few rows per category and quarter, read several times below
    return staged(s.join(w, ["def_id", "asset_id"]))


def sleeve_backtest(m: Market) -> P.PortfolioResult:
    return P.component_backtest(sleeves(m), "year")


@query("component_backtest", """
    SELECT def_id, date, r6(value) AS growth_value, r6(coalesce(value / lag(value) OVER (PARTITION BY def_id ORDER BY date) - 1, 0)) AS period_return,
           active_count FROM sv_path""")
def _(m):
    return sleeve_backtest(m).series.select("def_id", "date", rnd("value").alias("growth_value"), rnd("period_return").alias("period_return"),
                                            "active_count")


@query("rebalance_ledger", """
    SELECT def_id, date, asset_id, r8(before) AS pre_rebalance_weight, r8(target) AS target_weight, r8(target - before) AS weight_change,
           r6((target - before) * value) AS trade_value FROM sv_ledger""")
def _(m):
    led = P.rebalance_ledger(sleeve_backtest(m), ["def_id"])
    return led.select("def_id", "date", "asset_id", *[rnd(c, 8).alias(c) for c in ("pre_rebalance_weight", "target_weight", "weight_change")],
                      rnd("trade_value").alias("trade_value"))


@query("turnover", """
    SELECT def_id, date, r8(sum(abs(target - before)) / 2) AS turnover, r6(sum(abs(target - before) * value) / 2) AS traded_value
    FROM sv_ledger GROUP BY ALL""")
def _(m):
    return P.turnover(P.rebalance_ledger(sleeve_backtest(m), ["def_id"]), ["def_id"]).select(
        "def_id", "date", rnd("turnover", 8).alias("turnover"), rnd("traded_value").alias("traded_value"))


shared_sql("sv_pos", """
    SELECT t.def_id, t.date, t.asset_id, t.target / s.total * p.value AS after, p.value, p.growth, p.opening FROM sv_panel t
    JOIN sv_seg s USING (def_id, date) JOIN sv_path p USING (def_id, date) WHERE t.is_rebalance
    UNION ALL SELECT l.def_id, l.date, l.asset_id, l.wf * p.opening, p.value, p.growth, p.opening
    FROM sv_leg l JOIN sv_path p USING (def_id, date) WHERE p.n IS NULL""")


@query("contribution_history", """
    WITH c AS (SELECT x.*, coalesce(l.wf * x.opening, x.after) AS before_trades,
                      lag(x.after) OVER (PARTITION BY x.def_id, x.asset_id ORDER BY x.date) AS prev
               FROM sv_pos x LEFT JOIN sv_leg l USING (def_id, date, asset_id)),
    r AS (SELECT *, coalesce(before_trades - prev, 0) AS raw FROM c),
    t AS (SELECT def_id, date, sum(raw) AS total FROM r GROUP BY ALL),
    p AS (SELECT def_id, date, coalesce(value / lag(value) OVER (PARTITION BY def_id ORDER BY date) - 1, 0) AS ret FROM sv_path),
    s AS (SELECT r.def_id, r.date, r.asset_id, CASE WHEN abs(total) <= 1e-15 THEN 0 ELSE raw * ret / total END AS pc
          FROM r JOIN t USING (def_id, date) JOIN p USING (def_id, date))
    SELECT def_id, date, asset_id, r8(pc) AS period_contribution, r8(sum(pc) OVER (PARTITION BY def_id, asset_id ORDER BY date)) AS cumulative_contribution
    FROM s""")
def _(m):
    res = sleeve_backtest(m)
    return P.contribution_history(res.positions, res.series, ["def_id"]).select(
        "def_id", "date", "asset_id", rnd("period_contribution", 8).alias("period_contribution"),
        rnd("cumulative_contribution", 8).alias("cumulative_contribution"))


@query("inverse_vol_weights", """
    WITH r AS (SELECT def_id, asset_id, price / lag(price) OVER (PARTITION BY def_id, asset_id ORDER BY date) - 1 AS ret FROM sleeves),
    v AS (SELECT def_id, asset_id, stddev_samp(ret) AS vol FROM r GROUP BY ALL)
    SELECT def_id, asset_id, r8(1 / vol / sum(1 / vol) OVER (PARTITION BY def_id)) AS weight FROM v""")
def _(m):
    return P.inverse_volatility(sleeves(m)).select("def_id", "asset_id", rnd("weight", 8).alias("weight"))


@query("sleeve_series_clean", """
    SELECT family AS component_id, weighting, date, r6(index_level) AS index_level FROM qidx_series
    WHERE constituent_count > 0 AND index_level > 0 AND date <= DATE '2000-12-31'""")
def _(m):
    s = family(m).series.filter("constituent_count > 0 AND index_level > 0 AND date <= DATE '2000-12-31'")
    return s.select(F.col("family").alias("component_id"), "weighting", "date", rnd("index_level").alias("index_level"))


@query("remove_redistribute", """
    WITH s AS (SELECT *, sum(CASE WHEN asset_id % 7 = 0 THEN weight ELSE 0 END) OVER w AS o, sum(CASE WHEN asset_id % 7 <> 0 THEN weight ELSE 0 END) OVER w AS i,
                      count(*) FILTER (asset_id % 7 <> 0) OVER w AS k FROM baskets WINDOW w AS (PARTITION BY def_id))
    SELECT 'pro_rata' AS policy, def_id, asset_id, r8(weight + o * weight / i) AS weight FROM s WHERE asset_id % 7 <> 0
    UNION ALL SELECT 'equal', def_id, asset_id, r8(weight + o / k) FROM s WHERE asset_id % 7 <> 0
    UNION ALL SELECT 'unallocated', def_id, asset_id, r8(weight) FROM s WHERE asset_id % 7 <> 0""")
def _(m):
    b = baskets(m).select("def_id", "asset_id", "weight")
    parts = [P.remove_and_redistribute(b, F.col("asset_id") % 7 == 0, p).withColumn("policy", F.lit(p)) for p in ("pro_rata", "equal", "unallocated")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("policy", "def_id", "asset_id", rnd("weight", 8).alias("weight"))


# --- look-through -------------------------------------------------------------------------

shared_sql("lt_constituents", """
    SELECT category AS component_id, date, asset_id, 0.95 * cap / sum(cap) OVER (PARTITION BY category, date) AS internal_weight, cap AS market_cap
    FROM q_quotes WHERE cap > 0
    UNION ALL SELECT 'asset:' || asset_id, min(date), asset_id, 1.0, max(cap) FROM q_quotes WHERE category = 'PROMO' GROUP BY asset_id""")
shared_sql("lt_portfolio", """
    WITH c AS (SELECT 'mixed' AS def_id, category AS component_id, 3.0 AS raw, FALSE AS is_direct FROM (SELECT DISTINCT category FROM assets)
               UNION ALL SELECT 'mixed', 'asset:' || asset_id, 1.0 / (1 + asset_id % 5), TRUE FROM assets WHERE category = 'PROMO')
    SELECT def_id, component_id, is_direct, raw / sum(raw) OVER () AS weight FROM c""")
shared_sql("lt_detail", """
    SELECT p.def_id, p.component_id, p.weight, p.is_direct, c.date, c.asset_id, c.internal_weight, p.weight * c.internal_weight AS effective_weight
    FROM lt_portfolio p JOIN lt_constituents c USING (component_id)
    WHERE c.date = (SELECT max(date) FROM lt_constituents k WHERE k.component_id = c.component_id AND k.date <= DATE '1996-02-15')""")


def sleeve_constituents(m: Market) -> DataFrame:
    q = quarterly(m)
    priced = q.filter("cap > 0")
    totals = priced.groupBy("category", "date").agg(F.sum("cap").alias("t"))
    inner = priced.join(totals, ["category", "date"]).select(
        F.col("category").alias("component_id"), "date", "asset_id", (0.95 * F.col("cap") / F.col("t")).alias("internal_weight"),
        F.col("cap").alias("market_cap"))
    direct = q.filter("category = 'PROMO'").groupBy("asset_id").agg(F.min("date").alias("date"), F.max("cap").alias("market_cap")).select(
        F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("component_id"), "date", "asset_id",
        F.lit(1.0).alias("internal_weight"), "market_cap")
    return inner.unionByName(direct)


def mixed_portfolio(m: Market) -> DataFrame:
    a = m.assets
    parts = a.select("category").distinct().select(F.col("category").alias("component_id"), F.lit(3.0).alias("raw"), F.lit(False).alias("is_direct"))
    direct = a.filter("category = 'PROMO'").select(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("component_id"),
                                                   (1.0 / (1 + F.col("asset_id") % 5)).alias("raw"), F.lit(True).alias("is_direct"))
    both = parts.unionByName(direct)
    return both.join(both.agg(F.sum("raw").alias("t"))).select(
        F.lit("mixed").alias("def_id"), "component_id", "is_direct", (F.col("raw") / F.col("t")).alias("weight"),
        F.when(F.col("is_direct"), 1).otherwise(0).alias("position"))


def through(m: Market) -> DataFrame:
    return P.look_through(mixed_portfolio(m), sleeve_constituents(m), "1996-02-15")


@query("look_through", "SELECT def_id, component_id, date, asset_id, r8(effective_weight) AS effective_weight FROM lt_detail")
def _(m):
    return through(m).select("def_id", "component_id", "date", "asset_id", rnd("effective_weight", 8).alias("effective_weight"))


@query("asof_constituent_snapshot", "SELECT component_id, date, count(*) AS n, r8(sum(internal_weight)) AS internal_weight FROM lt_detail GROUP BY ALL")
def _(m):
    return through(m).groupBy("component_id", "date").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("internal_weight"), 8).alias("internal_weight"))


OVERLAP_SQL = """
    SELECT def_id, asset_id, r8(coalesce(sum(effective_weight) FILTER (is_direct), 0)) AS direct_weight,
           r8(coalesce(sum(effective_weight) FILTER (NOT is_direct), 0)) AS indirect_weight, r8(sum(effective_weight)) AS total_weight,
           count(DISTINCT component_id) AS source_count, count(DISTINCT component_id) > 1 AS overlap"""


@query("overlap_report", OVERLAP_SQL + """,
           string_agg(component_id, ', ' ORDER BY is_direct, component_id) AS source_components FROM lt_detail GROUP BY def_id, asset_id""")
def _(m):
    return P.overlap_report(through(m)).select(
        "def_id", "asset_id", *[rnd(c, 8).alias(c) for c in ("direct_weight", "indirect_weight", "total_weight")], "source_components",
        "source_count", "overlap")


@query("overlap_join", OVERLAP_SQL + " FROM lt_detail GROUP BY def_id, asset_id HAVING count(DISTINCT component_id) > 1")
def _(m):
    return P.overlap_report(through(m)).filter("overlap").select(
        "def_id", "asset_id", *[rnd(c, 8).alias(c) for c in ("direct_weight", "indirect_weight", "total_weight")], "source_count", "overlap")


@query("look_through_reconciliation", """
    WITH d AS (SELECT component_id, sum(effective_weight) AS eff, sum(internal_weight) AS i FROM lt_detail GROUP BY 1)
    SELECT def_id, r8(sum(coalesce(eff, 0))) AS look_through_weight, r8(sum(CASE WHEN i IS NOT NULL THEN weight * (1 - i) ELSE 0 END)) AS internal_residual,
           r8(sum(CASE WHEN i IS NULL THEN weight ELSE 0 END)) AS unresolved_weight,
           abs(sum(CASE WHEN i IS NULL THEN weight ELSE coalesce(eff, 0) + weight * (1 - i) END) - 1) <= 1e-9 AS reconciled
    FROM lt_portfolio LEFT JOIN d USING (component_id) GROUP BY def_id""")
def _(m):
    p = mixed_portfolio(m)
    out = P.look_through_reconciliation(p, P.look_through(p, sleeve_constituents(m), "1996-02-15"))
    return out.select("def_id", *[rnd(c, 8).alias(c) for c in ("look_through_weight", "internal_residual", "unresolved_weight")], "reconciled")


@query("expand_component", """
    WITH c AS (SELECT component_id, asset_id, internal_weight, market_cap FROM lt_constituents k WHERE date = (
        SELECT max(date) FROM lt_constituents k2 WHERE k2.component_id = k.component_id AND k2.date <= DATE '1996-02-15'))
    SELECT m.method, def_id, p.component_id, c.asset_id, r8(p.weight * CASE m.method WHEN 'preserve' THEN internal_weight / sum(internal_weight) OVER w
           WHEN 'equal' THEN 1.0 / count(*) OVER w ELSE CASE WHEN min(market_cap) OVER w > 0 THEN market_cap / sum(market_cap) OVER w
           ELSE 1.0 / count(*) OVER w END END) AS weight
    FROM lt_portfolio p JOIN c USING (component_id), (VALUES ('preserve'), ('equal'), ('market_cap')) m(method)
    WINDOW w AS (PARTITION BY m.method, p.component_id)""")
def _(m):
    p = mixed_portfolio(m).select("def_id", "component_id", "weight")
    snap = through(m).select("component_id", "asset_id", "internal_weight", F.coalesce("market_cap", F.lit(0.0)).alias("market_cap"))
    parts = [P.expand_component(p, snap, x).withColumn("method", F.lit(x)) for x in ("preserve", "equal", "market_cap")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("method", "def_id", "component_id", "asset_id", rnd("weight", 8).alias("weight"))


@query("dated_constituents", """
    SELECT component_id, date, asset_id, r8(internal_weight) AS internal_weight FROM lt_constituents
    WHERE internal_weight > 0 AND date <= DATE '1999-12-31'""")
def _(m):
    c = sleeve_constituents(m).filter("internal_weight > 0 AND date <= DATE '1999-12-31'")
    return S.keep_last(c.select("component_id", "date", "asset_id", "internal_weight"), ["component_id", "date", "asset_id"],
                       ["internal_weight"]).withColumn("internal_weight", rnd("internal_weight", 8))


@query("resolve_components", """
    SELECT 'index' AS component_type, 'index:' || family || ':' || weighting AS component_id, date, date AS available_at, r6(index_level) AS level FROM qidx_series
    UNION ALL SELECT 'individual_asset', 'asset:' || asset_id, date, observed_at, r6(price) FROM canon
    UNION ALL SELECT 'category_strategy', 'strategy:' || def_id, date, date, r6(value) FROM cs_path""")
def _(m):
    idx = family(m).series.select(F.lit("index").alias("component_type"), F.concat_ws(":", F.lit("index"), "family", "weighting").alias("component_id"),
                                  "date", F.col("date").alias("available_at"), rnd("index_level").alias("level"))
    direct = canonical_rows(m.observations).select(
        F.lit("individual_asset").alias("component_type"), F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("component_id"),
        F.col("canonical_period").alias("date"), "available_at", rnd("price_per_share").alias("level"))
    key = 1 + F.col("asset_id") % 3
    raw = m.assets.select(F.col("category").alias("def_id"), "asset_id", key.cast("double").alias("raw"))
    defs = raw.join(raw.groupBy("def_id").agg(F.sum("raw").alias("t")), "def_id").select(
        "def_id", "asset_id", (0.8 * F.col("raw") / F.col("t")).alias("weight"))
    s = P.category_strategy(defs, canonical_prices(m), exits(m), "year").series.select(
        F.lit("category_strategy").alias("component_type"), F.concat(F.lit("strategy:"), "def_id").alias("component_id"), "date",
        F.col("date").alias("available_at"), rnd("value").alias("level"))
    return idx.unionByName(direct).unionByName(s)


# --- rule backtests -----------------------------------------------------------------------

shared_sql("rule_rows", """
    WITH c AS (SELECT def_id, asset_id, weight, date, price FROM composite_rows),
    d AS (SELECT def_id, date, row_number() OVER w AS row, year(date) * 4 + quarter(date) - lag(year(date) * 4 + quarter(date)) OVER w AS gap
          FROM (SELECT DISTINCT def_id, date FROM c) WINDOW w AS (PARTITION BY def_id ORDER BY date)),
    r AS (SELECT c.*, d.row, coalesce(gap, 0) AS elapsed, price / lag(price) OVER (PARTITION BY c.def_id, asset_id ORDER BY c.date) - 1 AS ret,
                 first(price) OVER (PARTITION BY c.def_id, asset_id ORDER BY c.date) AS p0, count(*) OVER (PARTITION BY c.def_id, c.date) AS members
          FROM c JOIN d USING (def_id, date))
    SELECT *, CASE WHEN elapsed = 1 AND ret > 0.03 THEN 0.5 WHEN elapsed = 1 AND ret < -0.04 THEN 1.0 ELSE 0 END AS cut FROM r""")


def trio_components(m: Market) -> DataFrame:
    return quarterly(m).select("asset_id", "date", "price").join(trios(m), "asset_id")


def rules(proceeds: str = "cash", rebalance: str = "none") -> R.Rules:
    return R.Rules(gain=0.03, gain_cut=0.5, loss=0.04, loss_cut=1.0, proceeds=proceeds, rebalance=rebalance)


def rule_columns(df: DataFrame) -> DataFrame:
    return df.select("def_id", "date", "elapsed", "events", *[rnd(c).alias(c) for c in ("growth_value", "cash_value", "turnover", "period_return", "drawdown")])


RULE_TAIL = """
    SELECT def_id, date, CAST(elapsed AS INT) AS elapsed, events, r6(v) AS growth_value, r6(cash) AS cash_value, r6(turnover) AS turnover,
           r6(coalesce(v / lag(v) OVER w - 1, 0)) AS period_return, r6(v / max(v) OVER w - 1) AS drawdown FROM f
    WINDOW w AS (PARTITION BY def_id ORDER BY date)"""


@query("quarterly_rule_backtest", """
    WITH k AS (SELECT *, coalesce(product(1 - cut) OVER (PARTITION BY def_id, asset_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS keep
               FROM rule_rows),
    b AS (SELECT *, 100 * weight * price / p0 * keep AS before FROM k),
    d AS (SELECT def_id, date, elapsed, sum(before) AS held, sum(before * cut) AS sold, count(*) FILTER (cut > 0) AS events FROM b GROUP BY ALL),
    c AS (SELECT *, coalesce(sum(sold) OVER (PARTITION BY def_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS banked FROM d),
    f AS (SELECT *, held + banked AS v, banked + sold AS cash, sold / (held + banked) AS turnover FROM c)""" + RULE_TAIL)
def _(m):
    return rule_columns(R.backtest(trio_components(m), rules()))


def _rebalanced_sql(share: str, target: str) -> str:
    return f"""
    WITH w AS (SELECT *, CASE WHEN row = 1 THEN weight ELSE {target} END AS w FROM rule_rows),
    s AS (SELECT *, w * (1 - cut) AS kept, CASE WHEN cut > 0 THEN 0 ELSE {share} END AS share FROM w),
    a AS (SELECT *, kept + CASE WHEN sum(share) OVER p > 0 THEN sum(w * cut) OVER p * share / sum(share) OVER p ELSE 0 END AS after
          FROM s WINDOW p AS (PARTITION BY def_id, date)),
    l AS (SELECT *, lag(after) OVER (PARTITION BY def_id, asset_id ORDER BY date) AS before FROM a),
    d AS (SELECT def_id, date, elapsed, sum(before * (1 + ret)) AS g0, greatest(0, 1 - sum(after)) AS cw, count(*) FILTER (cut > 0) AS events FROM l GROUP BY ALL),
    e AS (SELECT *, coalesce(g0 + lag(cw) OVER q, 1) AS g, lag(cw) OVER q AS pcw FROM d WINDOW q AS (PARTITION BY def_id ORDER BY date)),
    mv AS (SELECT l.def_id, l.date, sum(abs(after - coalesce(before * (1 + ret) / g, after))) AS moved FROM l JOIN e USING (def_id, date) GROUP BY ALL),
    v AS (SELECT e.*, 100 * product(g) OVER (PARTITION BY def_id ORDER BY date) AS v, moved FROM e JOIN mv USING (def_id, date)),
    f AS (SELECT *, CASE WHEN cw > 1e-12 THEN cw ELSE 0 END * v AS cash, (moved + abs(cw - coalesce(pcw / g, cw))) / 2 AS turnover FROM v)""" + RULE_TAIL


@query("quarterly_rule_backtest_rebalanced", _rebalanced_sql("kept", "1.0 / members"))
def _(m):
    return rule_columns(R.backtest(trio_components(m), rules("remaining", "equal_weight")))


@query("proceeds_allocation", _rebalanced_sql("weight", "weight"))
def _(m):
    return rule_columns(R.backtest(trio_components(m), rules("target", "original_weights")))


@query("quarterly_rule_backtest_coupled")
def _(m):
    return rule_columns(R.backtest(trio_components(m), rules("remaining", "none")))


# --- whole-share replication --------------------------------------------------------------

shared_sql("tlatest", """
    SELECT b.def_id, q.asset_id, b.weight AS target, arg_max(q.price, q.date) AS price FROM q_quotes q JOIN baskets b USING (asset_id)
    JOIN assets a USING (asset_id) WHERE a.status = 'trading' GROUP BY ALL""")
shared_sql("tprices", "SELECT def_id, asset_id, price, target / sum(target) OVER (PARTITION BY def_id) AS target FROM tlatest")


def trading_prices(m: Market) -> DataFrame:
    latest = quarterly(m).groupBy("asset_id").agg(F.max_by("price", "date").alias("price"))
    live = m.assets.filter("status = 'trading'").select("asset_id")
    b = baskets(m).select("def_id", "asset_id", "weight").join(live, "asset_id").join(latest, "asset_id")
    return N.with_targets(b)


@query("one_share_capital", "SELECT def_id, r4(sum(price)) AS capital, count(*) AS n FROM tprices GROUP BY def_id")
def _(m):
    return trading_prices(m).groupBy("def_id").agg(rnd(F.sum("price"), 4).alias("capital"), F.count(F.lit(1)).alias("n"))


@query("integer_anchor_allocation", """
    WITH a AS (SELECT *, max(price) OVER w / max(target) OVER w * target AS dollars FROM tprices WINDOW w AS (PARTITION BY def_id)),
    c AS (SELECT def_id, asset_id, price, target, dollars, unnest([greatest(1, floor(dollars / price)), greatest(1, round_even(dollars / price, 0)),
                 greatest(1, ceil(dollars / price))]) AS q, unnest([1, 2, 3]) AS o FROM a),
    p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY def_id, asset_id ORDER BY abs(q * price - dollars), o) = 1)
    SELECT def_id, asset_id, CAST(q AS BIGINT) AS quantity, r4(dollars) AS target_dollars, r4(q * price) AS invested FROM p""")
def _(m):
    return N.anchor_allocation(trading_prices(m)).select("def_id", "asset_id", "quantity", rnd("target_dollars", 4).alias("target_dollars"),
                                                         rnd(F.col("quantity") * F.col("price"), 4).alias("invested"))


FRONTIER_SQL = """
    WITH c AS (SELECT def_id, sum(price) AS one FROM tprices GROUP BY 1),
    b AS (SELECT def_id, one, k, one * k AS budget FROM c, (VALUES (0.5), (1.0), (2.0), (5.0), (10.0), (20.0)) v(k)),
    q AS (SELECT b.def_id, b.k, b.budget, p.price, p.target, CASE WHEN b.k >= 1 THEN greatest(1, floor(b.budget * p.target / p.price))
                 ELSE floor(b.budget * p.target / p.price) END AS q FROM b JOIN tprices p USING (def_id))"""


@query("tracking_frontier", FRONTIER_SQL + """
    SELECT def_id, k::DOUBLE AS multiple, r4(budget) AS budget, r4(sum(price * q)) AS invested, sum(price * q) <= budget * (1 + 1e-12) AS feasible,
           r8(sqrt(avg((price * q / budget - target) ** 2))) AS rmse, r8(sum(abs(price * q / budget - target))) AS absolute,
           r8(max(abs(price * q / budget - target))) AS maximum, r8(greatest(budget - sum(price * q), 0) / budget) AS cash_weight
    FROM q GROUP BY def_id, k, budget""")
def _(m):
    out = N.tracking_frontier(trading_prices(m), [0.5, 1.0, 2.0, 5.0, 10.0, 20.0])
    return out.select("def_id", "multiple", rnd("budget", 4).alias("budget"), rnd("invested", 4).alias("invested"), "feasible",
                      *[rnd(c, 8).alias(c) for c in ("rmse", "absolute", "maximum", "cash_weight")])


@query("minimum_capital_search")
def _(m):
    out = N.minimum_capital(trading_prices(m), 0.002)
    return out.select("def_id", "feasible", "anchor_no", rnd("invested", 4).alias("invested"), rnd("maximum", 8).alias("maximum"), rnd("rmse", 8).alias("rmse"))


@query("prices_asof_inception", """
    WITH h AS (SELECT b.def_id, q.* FROM q_quotes q JOIN baskets b USING (asset_id)),
    e AS (SELECT def_id, greatest(DATE '1996-06-30', max(f)) AS eff FROM (SELECT def_id, asset_id, min(date) AS f FROM h GROUP BY ALL) GROUP BY 1)
    SELECT h.def_id, h.asset_id, eff AS effective_start_date, max(date) AS price_date, r6(arg_max(price, date)) AS price,
           CAST(eff - max(date) AS INT) AS staleness_days, eff - max(date) > 120 AS is_stale
    FROM h JOIN e ON h.def_id = e.def_id AND h.date <= eff GROUP BY h.def_id, h.asset_id, eff""")
def _(m):
    h = quarterly(m).join(baskets(m).select("def_id", "asset_id"), "asset_id")
    return N.prices_asof(h, "1996-06-30").withColumn("price", rnd("price"))


shared_sql("bh_alloc", """
    WITH h AS (SELECT b.def_id, b.weight, q.asset_id, q.date, q.price FROM q_quotes q JOIN baskets b USING (asset_id)),
    e AS (SELECT def_id, max(f) AS eff FROM (SELECT def_id, asset_id, min(date) AS f FROM h GROUP BY ALL) GROUP BY 1),
    p AS (SELECT h.def_id, h.asset_id, eff, arg_max(h.price, h.date) AS price0, any_value(h.weight) AS target FROM h JOIN e ON e.def_id = h.def_id AND h.date <= eff
          GROUP BY h.def_id, h.asset_id, eff)
    SELECT *, 1000000.0 AS budget, floor(1000000.0 * target / price0) AS q, 1000000.0 * target / price0 AS fq FROM p""")
shared_sql("bh_path", """
    WITH g AS (SELECT DISTINCT b.def_id, q.date FROM q_quotes q JOIN baskets b USING (asset_id)),
    x AS (SELECT a.*, g.date FROM bh_alloc a JOIN g ON g.def_id = a.def_id AND g.date >= a.eff),
    v AS (SELECT x.*, q.price FROM x ASOF JOIN q_quotes q ON q.asset_id = x.asset_id AND x.date >= q.date),
    c AS (SELECT def_id, 1000000.0 - sum(q * price0) AS cash FROM bh_alloc GROUP BY 1)
    SELECT v.def_id, v.date, sum(q * price) + any_value(cash) AS pv, sum(fq * price) AS bv, any_value(cash) AS cash FROM v JOIN c USING (def_id) GROUP BY ALL""")


@query("buy_and_hold", """
    SELECT def_id, date, r4(pv) AS portfolio_value, r4(bv) AS benchmark_value, r4(cash) AS cash, r4(pv - 1000000.0) AS portfolio_pnl,
           r4(pv - bv) AS replication_difference, r6(pv / max(pv) OVER (PARTITION BY def_id ORDER BY date) - 1) AS drawdown FROM bh_path""")
def _(m):
    h = quarterly(m).join(baskets(m).select("def_id", "asset_id", "weight"), "asset_id")
    out = N.buy_and_hold(h, 1_000_000.0)
    return out.select("def_id", "date", *[rnd(c, 4).alias(c) for c in ("portfolio_value", "benchmark_value", "cash", "portfolio_pnl",
                                                                      "replication_difference")], rnd("drawdown").alias("drawdown"))


@query("replication_summary", """
    WITH r AS (SELECT *, pv / lag(pv) OVER w - bv / lag(bv) OVER w AS diff, date - lag(date) OVER w AS gap, pv / max(pv) OVER w - 1 AS dd
               FROM bh_path WINDOW w AS (PARTITION BY def_id ORDER BY date))
    SELECT def_id, r4(arg_max(pv, date)) AS latest_value, r6(arg_max(pv, date) / 1000000.0 - 1) AS total_return,
           r6(arg_max(bv, date) / 1000000.0 - 1) AS benchmark_return, r6(stddev_samp(diff) * sqrt(CASE WHEN median(gap) <= 10 THEN 52
           WHEN median(gap) <= 45 THEN 12 WHEN median(gap) <= 120 THEN 4 ELSE 1 END)) AS tracking_error, r6(min(dd)) AS maximum_drawdown
    FROM r GROUP BY def_id""")
def _(m):
    h = quarterly(m).join(baskets(m).select("def_id", "asset_id", "weight"), "asset_id")
    out = N.replication_summary(N.buy_and_hold(h, 1_000_000.0), 1_000_000.0)
    return out.withColumns({c: rnd(c, 4 if c == "latest_value" else 6) for c in
                            ("latest_value", "total_return", "benchmark_return", "tracking_error", "maximum_drawdown")})


# --- canonical history --------------------------------------------------------------------

@query("series_contract_adapter", "SELECT asset_id, date, r6(price) AS index_level, observed_at AS available_at FROM canon")
def _(m):
    return canonical_rows(m.observations).select("asset_id", F.col("canonical_period").alias("date"), rnd("price_per_share").alias("index_level"),
                                                 "available_at")


shared_sql("coh", "SELECT c.*, t.def_id, count(*) OVER (PARTITION BY t.def_id, c.date) AS n FROM canon c JOIN trios t USING (asset_id)")
shared_sql("cohm", "SELECT def_id, count(*) AS members FROM trios GROUP BY 1")


@query("eligibility_timeline", """
    WITH p AS (SELECT DISTINCT def_id, date, n FROM coh)
    SELECT p.def_id, t.asset_id, p.date AS canonical_period, c.asset_id IS NOT NULL AS has_observation,
           c.asset_id IS NOT NULL AND p.n = members AS eligible,
           CASE WHEN c.asset_id IS NULL THEN 'missing_observation_no_fill' WHEN p.n <> members THEN 'excluded_by_intersection' ELSE 'observed' END AS reason
    FROM p JOIN trios t USING (def_id) JOIN cohm USING (def_id) LEFT JOIN coh c ON c.def_id = p.def_id AND c.date = p.date AND c.asset_id = t.asset_id""")
def _(m):
    from tessera.operators.canonical import eligibility_timeline

    return eligibility_timeline(canonical_rows(m.observations), trios(m).select("def_id", "asset_id")).select(
        "def_id", "asset_id", "canonical_period", "has_observation", "eligible", "reason")


@query("align_history", """
    SELECT def_id, asset_id, date AS canonical_period, r6(price) AS price FROM coh JOIN cohm USING (def_id) WHERE n = members""")
def _(m):
    from tessera.operators.canonical import align_history

    return align_history(canonical_rows(m.observations), trios(m).select("def_id", "asset_id")).select(
        "def_id", "asset_id", "canonical_period", rnd("price_per_share").alias("price"))


@query("set_intersection_union_dates", """
    SELECT def_id, count(DISTINCT date) AS union_periods, count(DISTINCT date) FILTER (n = members) AS common_periods, min(date) FILTER (n = members) AS first_common
    FROM coh JOIN cohm USING (def_id) GROUP BY def_id""")
def _(m):
    rows = canonical_rows(m.observations).join(trios(m).select("def_id", "asset_id"), "asset_id")
    members = trios(m).groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    per = rows.groupBy("def_id", "canonical_period").agg(F.count(F.lit(1)).alias("n")).join(members, "def_id")
    common = F.col("n") == F.col("members")
    return per.groupBy("def_id").agg(F.count(F.lit(1)).alias("union_periods"), F.count_if(common).alias("common_periods"),
                                     F.min(F.when(common, F.col("canonical_period"))).alias("first_common"))


@query("canonical_history", """
    WITH o AS (SELECT *, observed_at <= DATE '2000-12-31' AS known, row_number() OVER (PARTITION BY asset_id, period_end, observed_at <= DATE '2000-12-31'
               ORDER BY observed_at DESC, s1 DESC, s2 DESC, s3 DESC) AS k FROM observations)
    SELECT asset_id, period_end AS canonical_period, observed_at, s1, s2, s3, r6(price_per_share) AS price, CASE WHEN NOT known THEN 'after_availability_cutoff'
           WHEN k > 1 THEN 'canonical_period_collision' ELSE 'canonical' END AS resolution FROM o""")
def _(m):
    from tessera.operators.canonical import resolve_history

    return resolve_history(m.observations, "2000-12-31").select(
        "asset_id", F.col("period_end").alias("canonical_period"), "observed_at", "s1", "s2", "s3", rnd("price_per_share").alias("price"), "resolution")


@query("phase_zero_diagnostic", """
    WITH s AS (SELECT o.*, t.def_id FROM observations o JOIN trios t USING (asset_id)),
    u AS (SELECT def_id, asset_id, observed_at, max(period_end) AS period_end FROM s GROUP BY ALL),
    c AS (SELECT DISTINCT def_id, asset_id, period_end FROM u)
    SELECT d.def_id, (SELECT count(*) FROM s WHERE s.def_id = d.def_id) AS raw_observation_rows, (SELECT count(*) FROM u WHERE u.def_id = d.def_id) AS unique_observation_rows,
           (SELECT count(*) FROM c WHERE c.def_id = d.def_id) AS unique_canonical_rows,
           (SELECT count(*) FROM (SELECT observed_at FROM u WHERE u.def_id = d.def_id GROUP BY 1 HAVING count(*) = d.members)) AS common_observed_dates,
           (SELECT count(*) FROM (SELECT period_end FROM c WHERE c.def_id = d.def_id GROUP BY 1 HAVING count(*) = d.members)) AS common_periods
    FROM cohm d""")
def _(m):
    from tessera.operators.canonical import phase_zero

    return phase_zero(m.observations, trios(m).select("def_id", "asset_id"))


@query("set_difference", """
    WITH b AS (SELECT asset_id, min(date) AS s FROM canon GROUP BY 1),
    e AS (SELECT asset_id, last_day(unnest(generate_series(date_trunc('quarter', s) + INTERVAL 2 MONTH, DATE '2001-12-31', INTERVAL 3 MONTH))::DATE) AS d FROM b)
    SELECT e.asset_id, e.d AS missing_period FROM e ANTI JOIN canon c ON c.asset_id = e.asset_id AND c.date = e.d""")
def _(m):
    rows = canonical_rows(m.observations)
    spans = rows.groupBy("asset_id").agg(F.min("canonical_period").alias("start")).withColumn("end", F.lit(AS_OF).cast("date"))
    expected = S.calendar_grid(spans, "quarter").select("asset_id", F.col("date").alias("missing_period"))
    return expected.join(rows.select("asset_id", F.col("canonical_period").alias("missing_period")), ["asset_id", "missing_period"], "left_anti")


