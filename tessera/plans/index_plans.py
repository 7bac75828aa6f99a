"""Index construction and attribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import change, rnd
from tessera.operators import indexes as I
from tessera.operators import series as S
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import daily, quarterly
from tessera.sources.market_views import Market


def _chain_sql(rows: str) -> dict[str, str]:
    """Dates numbered per index, then a self-join on the previous number."""
    return {
        "e": rows,
        "k": "SELECT *, dense_rank() OVER (PARTITION BY family, weighting ORDER BY date) AS k FROM {e}",
        "s": """SELECT c.family, c.weighting, c.date, c.asset_id, c.price / p.price - 1 AS ret,
                       CASE c.weighting WHEN 'equal' THEN 1.0 ELSE p.cap END AS mass
                FROM {k} c JOIN {k} p ON c.family = p.family AND c.weighting = p.weighting AND c.asset_id = p.asset_id
                     AND p.k = c.k - 1""",
        "t": "SELECT family, weighting, date, sum(mass) AS mass, sum(mass * ret) / sum(mass) AS r FROM {s} GROUP BY ALL",
        "series": """SELECT d.family, d.weighting, d.date, d.n AS constituent_count, t.r AS period_return, t.mass,
                       100 * product(1 + coalesce(t.r, 0)) OVER (PARTITION BY d.family, d.weighting ORDER BY d.date) AS index_level
                FROM (SELECT family, weighting, date, count(*) AS n FROM {e} GROUP BY ALL) d
                LEFT JOIN {t} t USING (family, weighting, date)""",
        "contrib": """SELECT s.family, s.weighting, s.date, s.asset_id, s.ret AS asset_return, s.mass / x.mass AS weight,
                       s.mass / x.mass * s.ret AS contribution_return,
                       s.mass / x.mass * s.ret * x.index_level / (1 + x.period_return) AS contribution_points
                FROM {s} s JOIN {series} x USING (family, weighting, date)""",
    }


def _share_chain(prefix: str, rows: str) -> None:
    names = {key: f"{prefix}_{key}" for key in _chain_sql("")}
    for key, sql in _chain_sql(rows).items():
        shared_sql(names[key], sql.format(**names))


_share_chain("qidx", """
    SELECT f.family, w.weighting, q.asset_id, q.date, q.price, q.cap FROM q_quotes q,
           LATERAL (SELECT unnest(['all', q.category]) AS family) f, (VALUES ('equal'), ('market_cap')) w(weighting)
    WHERE w.weighting = 'equal' OR q.cap > 0""")
_share_chain("didx", """
    SELECT 'all' AS family, w.weighting, q.asset_id, q.date, q.price, q.cap FROM d_quotes q,
           (VALUES ('equal'), ('market_cap')) w(weighting) WHERE w.weighting = 'equal' OR q.cap > 0""")

# Five baskets over all assets; weights lean on the asset number.
shared_sql("baskets", """
    SELECT 'basket-' || asset_id % 5 AS def_id, asset_id, CAST(1 + asset_id % 3 AS DOUBLE) AS raw_weight,
           (1 + asset_id % 3) / sum(1 + asset_id % 3) OVER (PARTITION BY asset_id % 5) AS weight FROM assets""")
# Small baskets of three neighbouring assets, so that members share dates; every asset is in exactly one.
shared_sql("trios", """
    SELECT def_id, asset_id, raw / sum(raw) OVER (PARTITION BY def_id) AS weight
    FROM (SELECT 'trio-' || CAST(floor(asset_id / 3) AS BIGINT) AS def_id, asset_id, CAST(1 + asset_id % 3 AS DOUBLE) AS raw FROM assets)""")


def normalized_weights(df: DataFrame, key: str, raw: str) -> DataFrame:
    totals = df.groupBy(key).agg(F.sum(raw).alias("_total"))
    return df.join(totals, key).withColumn("weight", F.col(raw) / F.col("_total")).drop("_total")


def baskets(m: Market) -> DataFrame:
    key = F.col("asset_id")
    raw = m.assets.select(F.concat(F.lit("basket-"), (key % 5).cast("string")).alias("def_id"), "asset_id",
                          (1 + key % 3).cast("double").alias("raw_weight"))
    return normalized_weights(raw, "def_id", "raw_weight")


def trios(m: Market) -> DataFrame:
    key = F.col("asset_id")
    raw = m.assets.select(F.concat(F.lit("trio-"), F.floor(key / 3).cast("string")).alias("def_id"), "asset_id",
                          (1 + key % 3).cast("double").alias("raw"))
    return normalized_weights(raw, "def_id", "raw").drop("raw")


def family(m: Market) -> I.IndexResult:
    return I.quarterly_family(quarterly(m))


SERIES_SQL = "SELECT family, weighting, date, r6(index_level) AS index_level, r6(period_return) AS period_return, constituent_count FROM "


def _series(result: I.IndexResult) -> DataFrame:
    return result.series.select("family", "weighting", "date", rnd("index_level").alias("index_level"),
                                rnd("period_return").alias("period_return"), "constituent_count")


@query("index_quarterly_family", SERIES_SQL + "qidx_series")
def _(m):
    return _series(family(m))


@query("index_market_family", SERIES_SQL + "didx_series")
def _(m):
    return _series(I.market_family(daily(m)))


@query("index_chain", """
    SELECT family, weighting, date, asset_id, r6(asset_return) AS asset_return, r8(weight) AS weight,
           r8(contribution_return) AS contribution_return, r6(contribution_points) AS contribution_points FROM qidx_contrib""")
def _(m):
    return family(m).contributions.select(
        "family", "weighting", "date", "asset_id", rnd("asset_return").alias("asset_return"), rnd("weight", 8).alias("weight"),
        rnd("contribution_return", 8).alias("contribution_return"), rnd("contribution_points").alias("contribution_points"))


@query("self_join_prev_date", """
    SELECT c.asset_id, c.date, p.date AS previous_date, r6(c.price / p.price - 1) AS ret
    FROM qidx_k c JOIN qidx_k p ON c.family = p.family AND c.weighting = p.weighting AND c.asset_id = p.asset_id AND p.k = c.k - 1
    WHERE c.family = 'all' AND c.weighting = 'market_cap'""")
def _(m):
    rows = I.index_rows(quarterly(m), by_category=False).filter("weighting = 'market_cap'")
    dates = rows.select("family", "date").distinct().withColumn("previous_date", F.lag("date").over(S.over("family")))
    w = S.over("asset_id")
    steps = rows.withColumn("p", F.lag(F.struct("date", "price")).over(w)).join(dates, ["family", "date"])
    return steps.filter(F.col("p.date") == F.col("previous_date")).select(
        "asset_id", "date", "previous_date", rnd(change("price", "p.price")).alias("ret"))


@query("index_contribution_summary", """
    SELECT weighting, asset_id, a.name, a.ticker, a.category, r6(sum(contribution_points)) AS contribution_points,
           r6(sum(contribution_return)) AS contribution_return
    FROM qidx_contrib JOIN assets a USING (asset_id) WHERE family = 'all' GROUP BY ALL""")
def _(m):
    total = family(m).contributions.filter("family = 'all'").groupBy("weighting", "asset_id").agg(
        rnd(F.sum("contribution_points")).alias("contribution_points"), rnd(F.sum("contribution_return")).alias("contribution_return"))
    return total.join(m.assets.select("asset_id", "name", "ticker", "category"), "asset_id", "left")


shared_sql("att", """
    WITH e AS (SELECT family, weighting, min(date) AS lo, max(date) AS hi, arg_min(index_level, date) AS v0,
                      arg_max(index_level, date) AS v1 FROM qidx_series
               WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY ALL)
    SELECT c.family, c.weighting, asset_id, v1 - v0 AS total_change, sum(contribution_points) AS contribution,
           product(1 + asset_return) - 1 AS asset_return, avg(weight) AS average_weight, arg_min(weight, date) AS start_weight,
           arg_max(weight, date) AS end_weight
    FROM qidx_contrib c JOIN e ON c.family = e.family AND c.weighting = e.weighting AND date > lo AND date <= hi
    GROUP BY c.family, c.weighting, asset_id, v0, v1""")


def window_attribution(m: Market) -> DataFrame:
    return I.attribution(family(m), ["family", "weighting"], "1997-01-01", "2000-12-31")


@query("attribution_index", """
    SELECT family, weighting, asset_id, r6(contribution) AS contribution, r6(asset_return) AS asset_return,
           r8(average_weight) AS average_weight, r8(start_weight) AS start_weight, r8(end_weight) AS end_weight,
           r6(total_change) AS total_change,
           r6(contribution / total_change) AS contribution_share,
           r6(greatest(contribution, 0) / sum(greatest(contribution, 0)) OVER w) AS gross_positive_share,
           r6(greatest(-contribution, 0) / sum(greatest(-contribution, 0)) OVER w) AS gross_negative_share,
           r6(abs(contribution) / sum(abs(contribution)) OVER w) AS absolute_contribution_share,
           r6(total_change - sum(contribution) OVER w) AS residual
    FROM att WINDOW w AS (PARTITION BY family, weighting)""")
def _(m):
    out = window_attribution(m)
    digits = {"average_weight": 8, "start_weight": 8, "end_weight": 8}
    cols = ["contribution", "asset_return", "average_weight", "start_weight", "end_weight", "total_change", "contribution_share",
            "gross_positive_share", "gross_negative_share", "absolute_contribution_share", "residual"]
    return out.select("family", "weighting", "asset_id", *[rnd(c, digits.get(c, 6)).alias(c) for c in cols])


@query("concentration_metrics", """
    WITH s AS (SELECT family, weighting, asset_id, 'positive' AS side, contribution AS v FROM att WHERE contribution > 0
               UNION ALL SELECT family, weighting, asset_id, 'negative', -contribution FROM att WHERE contribution < 0
               UNION ALL SELECT family, weighting, asset_id, 'absolute', abs(contribution) FROM att),
    k AS (SELECT *, row_number() OVER (PARTITION BY family, weighting, side ORDER BY v DESC, asset_id) AS k FROM s)
    SELECT family, weighting, side, r6(sum(v) FILTER (k <= 1) / sum(v)) AS top_1, r6(sum(v) FILTER (k <= 3) / sum(v)) AS top_3,
           r6(sum(v) FILTER (k <= 5) / sum(v)) AS top_5 FROM k GROUP BY ALL""")
def _(m):
    out = I.concentration(window_attribution(m), ["family", "weighting"])
    return out.select("family", "weighting", "side", *[rnd(f"top_{n}").alias(f"top_{n}") for n in (1, 3, 5)])


@query("breadth_metrics", """
    SELECT family, weighting, count(*) FILTER (contribution > 1e-6) AS positive_count,
           count(*) FILTER (contribution < -1e-6) AS negative_count, count(*) FILTER (abs(contribution) <= 1e-6) AS flat_count,
           count(*) AS total_count, r6(count(*) FILTER (contribution > 1e-6) / count(*)) AS percent_positive
    FROM att GROUP BY ALL""")
def _(m):
    return I.breadth(window_attribution(m), ["family", "weighting"]).withColumn("percent_positive", rnd("percent_positive"))


INDEX_METRICS_SQL = """
    WITH r AS (SELECT family, weighting, date, index_level AS v, index_level / lag(index_level) OVER w - 1 AS r,
                      index_level / max(index_level) OVER w - 1 AS dd FROM qidx_series
               WINDOW w AS (PARTITION BY family, weighting ORDER BY date)),
    a AS (SELECT family, weighting, count(*) AS n, arg_min(v, date) AS v0, arg_max(v, date) AS v1,
                 (max(date) - min(date)) / 365.25 AS years, min(dd) AS mdd, arg_max(dd, date) AS cdd, max(r) AS best, min(r) AS worst,
                 avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dsd, count(*) FILTER (r < 0) AS dn
          FROM r GROUP BY ALL)
    SELECT family, weighting, n AS observation_count, r6(v1 / v0 - 1) AS total_return,
           r6(CASE WHEN years >= 1 THEN (v1 / v0) ** (1 / years) - 1 END) AS cagr, r6(sd * 2) AS annualized_volatility,
           r6(mean * 4 / (sd * 2)) AS sharpe_ratio, r6(CASE WHEN dn >= 2 THEN mean * 4 / (dsd * 2) END) AS sortino_ratio,
           r6(mdd) AS maximum_drawdown, r6(cdd) AS current_drawdown, r6(best) AS best_period, r6(worst) AS worst_period,
           CASE WHEN sd * 2 < .15 THEN 'Low' WHEN sd * 2 < .30 THEN 'Medium' ELSE 'High' END AS risk_band FROM a"""


@query("index_metrics", INDEX_METRICS_SQL)
def _(m):
    out = I.index_metrics(family(m).series, ["family", "weighting"])
    return out.select(*[rnd(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("growth_of_index", """
    WITH g AS (SELECT family, weighting, date, index_level / first(index_level) OVER w * 1000 AS growth_value FROM qidx_series
               WINDOW w AS (PARTITION BY family, weighting ORDER BY date))
    SELECT family, weighting, date, r6(growth_value) AS growth_value,
           r6(coalesce(growth_value / lag(growth_value) OVER (PARTITION BY family, weighting ORDER BY date) - 1, 0)) AS period_return
    FROM g""")
def _(m):
    return I.rebased(family(m).series, ["family", "weighting"], 1000.0).select(
        "family", "weighting", "date", rnd("growth_value").alias("growth_value"), rnd("period_return").alias("period_return"))


shared_sql("composite_rows", """
    WITH h AS (SELECT t.def_id, q.asset_id, q.date, q.price, t.weight FROM q_quotes q JOIN trios t USING (asset_id)),
    m AS (SELECT def_id, count(*) AS members FROM trios GROUP BY 1),
    c AS (SELECT def_id, date FROM h JOIN m USING (def_id) GROUP BY def_id, date, members HAVING count(*) = members)
    SELECT h.*, first(price) OVER (PARTITION BY def_id, asset_id ORDER BY date) AS price0 FROM h JOIN c USING (def_id, date)""")
shared_sql("composite", """
    SELECT def_id, date, 100 * sum(weight * price / price0) AS index_level, count(*) AS constituent_count
    FROM composite_rows GROUP BY ALL""")


@query("custom_composite", """
    SELECT def_id, date, r6(index_level) AS index_level, constituent_count,
           r6(index_level / lag(index_level) OVER (PARTITION BY def_id ORDER BY date) - 1) AS period_return FROM composite""")
def _(m):
    s = I.custom_composite(quarterly(m), trios(m)).series
    return s.select("def_id", "date", rnd("index_level").alias("index_level"), "constituent_count",
                    rnd("period_return").alias("period_return"))


@query("custom_composite_contributions", """
    WITH e AS (SELECT def_id, asset_id, weight, arg_max(price, date) / arg_min(price, date) - 1 AS r
               FROM composite_rows GROUP BY ALL)
    SELECT def_id, asset_id, r6(weight) AS weight, r6(r) AS asset_return, r6(100 * weight * r) AS contribution_points
    FROM e""")
def _(m):
    c = I.custom_composite(quarterly(m), trios(m)).contributions
    return c.select("def_id", "asset_id", rnd("weight").alias("weight"), rnd("asset_return").alias("asset_return"),
                    rnd("contribution_points").alias("contribution_points"))


@query("inner_shared_dates", "SELECT def_id, date FROM composite")
def _(m):
    return I.custom_composite(quarterly(m), trios(m)).series.select("def_id", "date")


@query("normalize_weights", """
    SELECT def_id, asset_id, r8(weight) AS weight FROM baskets""")
def _(m):
    return baskets(m).select("def_id", "asset_id", rnd("weight", 8).alias("weight"))


@query("equal_weights", """
    SELECT def_id, asset_id, r8(1.0 / count(*) OVER (PARTITION BY def_id)) AS weight FROM baskets""")
def _(m):
    b = baskets(m).select("def_id", "asset_id")
    n = b.groupBy("def_id").agg(F.count(F.lit(1)).alias("n"))
    return b.join(n, "def_id").select("def_id", "asset_id", rnd(1 / F.col("n"), 8).alias("weight"))


@query("union_all_by_name", """
    SELECT 'quarterly' AS source, family, weighting, date, r6(index_level) AS index_level, constituent_count FROM qidx_series
    UNION ALL SELECT 'daily', family, weighting, date, r6(index_level), constituent_count FROM didx_series
    UNION ALL SELECT 'composite', def_id, NULL, date, r6(index_level), constituent_count FROM composite""")
def _(m):
    parts = [
        family(m).series.withColumn("source", F.lit("quarterly")),
        I.market_family(daily(m)).series.withColumn("source", F.lit("daily")),
        I.custom_composite(quarterly(m), trios(m)).series.withColumnRenamed("def_id", "family").withColumn("source", F.lit("composite")),
    ]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("source", "family", "weighting", "date", rnd("index_level").alias("index_level"), "constituent_count")


@query("index_engine_reconciliation", """
    SELECT q.date, r6(q.index_level) AS chained_level, r6(d.index_level) AS daily_level,
           r6(q.index_level / d.index_level - 1) AS difference, abs(q.index_level / d.index_level - 1) <= 0.05 AS agrees
    FROM qidx_series q JOIN (SELECT weighting, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS date,
                                    arg_max(index_level, date) AS index_level FROM didx_series GROUP BY ALL) d
    USING (weighting, date) WHERE q.family = 'all' AND weighting = 'equal'""")
def _(m):
    chained = family(m).series.filter("family = 'all' AND weighting = 'equal'").select("date", F.col("index_level").alias("c"))
    d = I.market_family(daily(m)).series.filter("weighting = 'equal'").select("date", F.col("index_level").alias("price"))
    closing = S.period_last(d.withColumn("k", F.lit(1)), ["k"], "quarter").select(F.col("period").alias("date"), "price")
    gap = change("c", "price")
    return chained.join(closing, "date").select(
        "date", rnd("c").alias("chained_level"), rnd("price").alias("daily_level"), rnd(gap).alias("difference"),
        (F.abs(gap) <= 0.05).alias("agrees"))
