"""Benchmark comparison and correlation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import rnd
from tessera.operators import benchmark as B
from tessera.operators import correlation as K
from tessera.operators import indexes as I
from tessera.operators import series as S
from tessera.plans.index_plans import family
from tessera.plans.market_plans import rounded
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import daily, quarterly
from tessera.sources.market_views import Market

shared_sql("subj", "SELECT date, index_level AS value FROM didx_series WHERE weighting = 'equal'")
shared_sql("al_previous", """
    WITH j AS (SELECT s.date, t.ticker, s.value AS subject_value FROM subj s CROSS JOIN (SELECT DISTINCT ticker FROM benchmarks) t)
    SELECT j.*, b.adjusted_close AS benchmark_value FROM j ASOF JOIN benchmarks b ON b.ticker = j.ticker AND j.date >= b.date
    QUALIFY count(*) OVER (PARTITION BY j.date) = (SELECT count(DISTINCT ticker) FROM benchmarks)""")
shared_sql("al_exact", """
    SELECT s.date, b.ticker, s.value AS subject_value, b.adjusted_close AS benchmark_value FROM subj s JOIN benchmarks b USING (date)
    QUALIFY count(*) OVER (PARTITION BY s.date) = (SELECT count(DISTINCT ticker) FROM benchmarks)""")
for _name, _end in (("month_end", "last_day(date)"), ("quarter_end", "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))")):
    shared_sql(f"al_{_name}", f"""
    SELECT s.p AS date, b.ticker, s.v AS subject_value, b.v AS benchmark_value
    FROM (SELECT {_end} AS p, arg_max(value, date) AS v FROM subj GROUP BY 1) s JOIN (SELECT ticker, {_end} AS p, arg_max(adjusted_close, date) AS v
          FROM benchmarks GROUP BY ALL) b USING (p)
    QUALIFY count(*) OVER (PARTITION BY s.p) = (SELECT count(DISTINCT ticker) FROM benchmarks)""")


def subject(m: Market) -> DataFrame:
    return I.market_family(daily(m)).series.filter("weighting = 'equal'").select("date", F.col("index_level").alias("value"))


def aligned(m: Market, method: str = "quarter_end") -> DataFrame:
    return B.align(subject(m), m.benchmarks, method)


@query("align_series", " UNION ALL ".join(
    f"SELECT '{x}' AS method, date, ticker, r6(subject_value) AS subject_value, r6(benchmark_value) AS benchmark_value FROM al_{x}"
    for x in ("exact", "previous", "month_end", "quarter_end")))
def _(m):
    # one row per date, aligned four times
    s = subject(m)
    parts = [B.align(s, m.benchmarks, x).withColumn("method", F.lit(x)) for x in ("exact", "previous", "month_end", "quarter_end")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select("method", "date", "ticker", rnd("subject_value").alias("subject_value"), rnd("benchmark_value").alias("benchmark_value"))


@query("earliest_observation", """
    SELECT min(observed_at) AS earliest FROM observations WHERE price_per_share > 0 AND NOT regexp_matches(lower('manual:' || event_type), 'placeholder|synthetic|demo|test')""")
def _(m):
    return B.earliest_observation(m.observations, F.concat(F.lit("manual:"), "event_type"))


@query("select_benchmark", """
    SELECT date, ticker, r6(adjusted_close) AS raw_value FROM benchmarks WHERE ticker = '1-URGENT' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def _(m):
    b = m.benchmarks.filter((F.upper("ticker") == "1-URGENT") & F.col("date").between("1996-01-01", "1999-12-31"))
    return b.select("date", "ticker", rnd("adjusted_close").alias("raw_value"))


@query("normalize_to_100", """
    SELECT ticker, date, r6(adjusted_close / first(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) * 100) AS level FROM benchmarks""")
def _(m):
    b = m.benchmarks
    return b.select("ticker", "date", rnd(B.normalized(b, ["ticker"], "adjusted_close")).alias("level"))


@query("benchmark_merge", """
    WITH s AS (SELECT upper(ticker) AS ticker, date, adjusted_close, 0 AS seq FROM benchmarks WHERE date <= DATE '2000-06-30'
               UNION ALL SELECT upper(ticker), date, adjusted_close * 1.01, 1 FROM benchmarks WHERE date > DATE '2000-06-23')
    SELECT ticker, date, r6(adjusted_close) AS adjusted_close FROM s QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1""")
def _(m):
    b = m.benchmarks
    fresh = b.filter("date > DATE '2000-06-23'").withColumn("adjusted_close", F.col("adjusted_close") * 1.01)
    return B.merge_history(b.filter("date <= DATE '2000-06-30'"), fresh).select("ticker", "date", rnd("adjusted_close").alias("adjusted_close"))


@query("benchmark_chart_json", """
    SELECT ticker, date, r6(adjusted_close) AS value FROM benchmarks""")
def _(m):
    from tessera.sources.documents import chart_payloads, parse_chart

    return parse_chart(chart_payloads(m.benchmarks)).select("ticker", "date", rnd("value").alias("value"))


SERIES_METRICS = """
    WITH x AS (SELECT *, value / lag(value) OVER w - 1 AS x, date - lag(date) OVER w AS gap, value / max(value) OVER w - 1 AS y FROM all_series WINDOW w AS (PARTITION BY subject_id ORDER BY date)),
    r AS (SELECT *, CASE WHEN abs(x) < 1e-9 THEN 0 ELSE x END AS r, CASE WHEN abs(y) < 1e-9 THEN 0 ELSE y END AS dd FROM x),
    a AS (SELECT subject_id, count(*) AS n, min(date) AS d0, max(date) AS d1, arg_max(value, date) / arg_min(value, date) - 1 AS total, avg(r) AS mean, stddev_samp(r) AS sd,
                 sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(r) AS d2, min(dd) AS mdd, max(r) AS best, min(r) AS worst,
                 avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0 END) AS hits, CASE WHEN median(gap) <= 10 THEN 52 WHEN median(gap) <= 45 THEN 12 WHEN median(gap) <= 120 THEN 4 ELSE 1 END AS ppy FROM r GROUP BY 1)
    SELECT subject_id, n AS observations, ppy::DOUBLE AS periods_per_year, r6(total) AS total_return, r6((1 + total) ** (365.25 / (d1 - d0)) - 1) AS annualized_return, r6(sd * sqrt(ppy)) AS annualized_volatility,
           r6(CASE WHEN sd > 0 THEN mean / sd * sqrt(ppy) END) AS sharpe_ratio, r6(CASE WHEN d2 > 0 THEN mean * ppy / (sqrt(d2) * sqrt(ppy)) END) AS sortino_ratio, r6(mdd) AS maximum_drawdown,
           r6(CASE WHEN mdd < 0 THEN ((1 + total) ** (365.25 / (d1 - d0)) - 1) / abs(mdd) END) AS calmar_ratio, r6(best) AS best_period, r6(worst) AS worst_period, r6(hits) AS positive_period_percentage FROM a"""
shared_sql("all_series", """
    SELECT 'index:' || family || ':' || weighting AS subject_id, date, index_level AS value FROM qidx_series
    UNION ALL SELECT 'benchmark:' || ticker, date, adjusted_close FROM benchmarks""")


def all_series(m: Market) -> DataFrame:
    idx = family(m).series.select(F.concat_ws(":", F.lit("index"), "family", "weighting").alias("subject_id"), "date", F.col("index_level").alias("value"))
    return idx.unionByName(m.benchmarks.select(F.concat(F.lit("benchmark:"), "ticker").alias("subject_id"), "date", F.col("adjusted_close").alias("value")))


@query("series_metrics", SERIES_METRICS)
def _(m):
    return rounded(B.series_metrics(all_series(m), ["subject_id"]).drop("start", "end"))


REL = """
    WITH r AS (SELECT *, subject_value / lag(subject_value) OVER w - 1 AS sr, benchmark_value / lag(benchmark_value) OVER w - 1 AS br, date - lag(date) OVER w AS gap
               FROM al_quarter_end WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    a AS (SELECT ticker, count(*) AS n, stddev_samp(sr - br) AS sd, avg(sr - br) AS mean, covar_samp(sr, br) AS cov, var_samp(br) AS var, corr(sr, br) AS corr, avg(sr) AS ms, avg(br) AS mb,
                 avg(sr) FILTER (br > 0) / avg(br) FILTER (br > 0) AS up, avg(sr) FILTER (br < 0) / avg(br) FILTER (br < 0) AS down,
                 arg_max(subject_value, date) / arg_min(subject_value, date) AS gs, arg_max(benchmark_value, date) / arg_min(benchmark_value, date) AS gb,
                 (max(date) - min(date)) / 365.25 AS years, CASE WHEN median(gap) <= 10 THEN 52 WHEN median(gap) <= 45 THEN 12 WHEN median(gap) <= 120 THEN 4 ELSE 1 END AS ppy FROM r GROUP BY 1)"""


@query("relative_metrics", REL + """
    SELECT ticker, r6(gs - gb) AS excess_total_return, r6(gs ** (1 / years) - gb ** (1 / years)) AS annualized_excess_return, r6(sd * sqrt(ppy)) AS tracking_error,
           r6(mean * ppy / (sd * sqrt(ppy))) AS information_ratio, r6(cov / var) AS beta, r6((ms - cov / var * mb) * ppy) AS alpha, r6(corr) AS correlation,
           r6(up) AS upside_capture, r6(down) AS downside_capture FROM a""")
def _(m):
    return rounded(B.relative_metrics(aligned(m)))


@query("cov_corr_beta", REL + " SELECT ticker, r8(cov) AS covariance, r8(var) AS variance, r6(cov / var) AS beta FROM a")
def _(m):
    r = B.paired_returns(aligned(m))
    return r.groupBy("ticker").agg(rnd(F.covar_samp("sr", "br"), 8).alias("covariance"), rnd(F.var_samp("br"), 8).alias("variance"),
                                   rnd(F.try_divide(F.covar_samp("sr", "br"), F.var_samp("br"))).alias("beta"))


@query("comparison_dataset", """
    WITH r AS (SELECT *, subject_value / first(subject_value) OVER w * 100 AS sn, benchmark_value / first(benchmark_value) OVER w * 100 AS bn,
                      subject_value / lag(subject_value) OVER w - 1 AS sr, benchmark_value / lag(benchmark_value) OVER w - 1 AS br FROM al_month_end WINDOW w AS (PARTITION BY ticker ORDER BY date))
    SELECT ticker, date, r6(sn) AS subject_normalized, r6(bn) AS benchmark_normalized, r6(sr) AS subject_return, r6(br) AS benchmark_return, r6(sr - br) AS excess_return FROM r""")
def _(m):
    return rounded(B.comparison_dataset(aligned(m, "month_end")).drop("subject_value", "benchmark_value"))


@query("rolling_excess_sum", """
    WITH r AS (SELECT ticker, date, subject_value / lag(subject_value) OVER w - benchmark_value / lag(benchmark_value) OVER w AS ex FROM al_month_end WINDOW w AS (PARTITION BY ticker ORDER BY date))
    SELECT ticker, date, r6(sum(ex) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS rolling_excess FROM r""")
def _(m):
    c = B.comparison_dataset(aligned(m, "month_end"))
    return c.select("ticker", "date", rnd(F.sum("excess_return").over(S.over("ticker").rowsBetween(-3, 0))).alias("rolling_excess"))


@query("year_returns", """
    WITH r AS (SELECT subject_id, date, value / lag(value) OVER (PARTITION BY subject_id ORDER BY date) - 1 AS r FROM all_series)
    SELECT subject_id, year(date) AS year, r6(product(1 + r) - 1) AS year_return FROM r WHERE r IS NOT NULL GROUP BY ALL""")
def _(m):
    r = S.with_returns(all_series(m), "subject_id", "value").filter("ret IS NOT NULL")
    return r.groupBy("subject_id", F.year("date").cast("bigint").alias("year")).agg(rnd(F.product(1 + F.col("ret")) - 1).alias("year_return"))


# --- correlation --------------------------------------------------------------------------

shared_sql("panel", """
    SELECT brand || '/' || a.category AS subject_id, date, round(avg(ret), 10) AS ret FROM q_returns JOIN assets a USING (asset_id) WHERE ret IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'benchmark:' || ticker, p, round(v / lag(v) OVER (PARTITION BY ticker ORDER BY p) - 1, 10) FROM (
        SELECT ticker, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS p, arg_max(adjusted_close, date) AS v FROM benchmarks GROUP BY ALL)""")
shared_sql("pairs_raw", """
    SELECT a.subject_id AS a, b.subject_id AS b, a.date, a.ret AS x, b.ret AS y FROM panel a JOIN panel b ON a.date = b.date AND a.subject_id < b.subject_id
    WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL""")
shared_sql("pairs", """
    WITH names AS (SELECT DISTINCT subject_id AS s FROM panel WHERE ret IS NOT NULL),
    g AS (SELECT a, b, count(*) AS n, min(date) AS d0, max(date) AS d1, CASE WHEN count(*) >= 6 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS c FROM pairs_raw GROUP BY ALL)
    SELECT p.s AS a, q.s AS b, coalesce(n, 0) AS overlap, d0 AS overlap_start, d1 AS overlap_end, c AS correlation FROM names p JOIN names q ON p.s < q.s LEFT JOIN g ON g.a = p.s AND g.b = q.s""")


def panel(m: Market) -> DataFrame:
    r = S.with_returns(quarterly(m), "asset_id").filter("ret IS NOT NULL").select("asset_id", "date", "ret")
    groups = r.join(m.assets.select("asset_id", "brand", "category"), "asset_id").groupBy(
        F.concat_ws("/", "brand", "category").alias("subject_id"), "date").agg(F.round(F.avg("ret"), 10).alias("ret"))
    b = S.period_last(m.benchmarks, ["ticker"], "quarter", "adjusted_close").withColumnRenamed("period", "date")
    marks = S.with_returns(b, "ticker", "adjusted_close").select(F.concat(F.lit("benchmark:"), "ticker").alias("subject_id"), "date",
                                                                F.round("ret", 10).alias("ret"))
    return groups.unionByName(marks)


@query("correlation_pairs", "SELECT a, b, overlap, overlap_start, overlap_end, r6(correlation) AS correlation FROM pairs")
def _(m):
    return K.correlation_pairs(panel(m)).select("a", "b", "overlap", "overlap_start", "overlap_end", rnd("correlation").alias("correlation"))


@query("correlation_pairs_spearman", """
    WITH r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS x,
                      rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS y FROM pairs_raw)
    SELECT a, b, count(*) AS overlap, r6(CASE WHEN count(*) >= 6 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END) AS correlation FROM r GROUP BY ALL""")
def _(m):
    return K.correlation_pairs(panel(m), "spearman").filter("overlap > 0").select("a", "b", "overlap", rnd("correlation").alias("correlation"))


@query("correlation_distance", """
    SELECT a, b, r6(sqrt(0.5 * (1 - greatest(-1, least(1, correlation))))) AS distance_sqrt, r6(1 - greatest(-1, least(1, correlation))) AS distance_one_minus
    FROM pairs WHERE correlation IS NOT NULL""")
def _(m):
    p = K.correlation_pairs(panel(m)).filter("correlation IS NOT NULL")
    return p.select("a", "b", rnd(K.distance("correlation")).alias("distance_sqrt"), rnd(K.distance("correlation", "one_minus")).alias("distance_one_minus"))


@query("pairwise_table", """
    WITH t AS (SELECT subject_id, CASE WHEN starts_with(subject_id, 'benchmark:') THEN 'External benchmark' ELSE 'Brand index' END AS kind,
                      CASE WHEN starts_with(subject_id, 'benchmark:') THEN 'public' ELSE split_part(subject_id, '/', 2) END AS category FROM (SELECT DISTINCT subject_id FROM panel))
    SELECT p.a, p.b, x.kind AS type_a, y.kind AS type_b, x.category AS category_a, y.category AS category_b, r6(correlation) AS correlation, overlap
    FROM pairs p JOIN t x ON x.subject_id = p.a JOIN t y ON y.subject_id = p.b""")
def _(m):
    p = panel(m)
    mark = F.startswith("subject_id", F.lit("benchmark:"))
    t = p.select("subject_id").distinct().select("subject_id", F.when(mark, "External benchmark").otherwise("Brand index").alias("kind"),
                                                 F.when(mark, "public").otherwise(F.split_part("subject_id", F.lit("/"), F.lit(2))).alias("category"))
    left = t.select(F.col("subject_id").alias("a"), F.col("kind").alias("type_a"), F.col("category").alias("category_a"))
    right = t.select(F.col("subject_id").alias("b"), F.col("kind").alias("type_b"), F.col("category").alias("category_b"))
    return K.correlation_pairs(p).join(left, "a").join(right, "b").select(
        "a", "b", "type_a", "type_b", "category_a", "category_b", rnd("correlation").alias("correlation"), "overlap")


@query("correlation_clusters", """
    WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM pairs WHERE sqrt(0.5 * (1 - greatest(-1, least(1, correlation)))) <= 0.32 AND correlation IS NOT NULL
        UNION ALL SELECT b, a FROM pairs WHERE sqrt(0.5 * (1 - greatest(-1, least(1, correlation)))) <= 0.32 AND correlation IS NOT NULL),
    reach AS (SELECT DISTINCT subject_id AS s, subject_id AS v FROM panel UNION SELECT r.s, e.v FROM reach r JOIN e ON e.u = r.v)
    SELECT s AS subject_id, min(v) AS cluster_id FROM reach GROUP BY s""")
def _(m):
    p = panel(m)
    pairs = K.correlation_pairs(p).withColumn("distance", K.distance("correlation"))
    return K.clusters(pairs, p.select("subject_id").distinct(), 0.32)


@query("pair_self_join", """
    SELECT a.family || ':' || a.weighting AS a, b.family || ':' || b.weighting AS b, count(*) AS periods, r6(corr(a.period_return, b.period_return)) AS correlation
    FROM qidx_series a JOIN qidx_series b ON a.date = b.date AND a.family || ':' || a.weighting < b.family || ':' || b.weighting
    WHERE a.period_return IS NOT NULL AND b.period_return IS NOT NULL GROUP BY ALL""")
def _(m):
    s = family(m).series.filter("period_return IS NOT NULL").select(F.concat_ws(":", "family", "weighting").alias("subject_id"), "date", F.col("period_return").alias("ret"))
    return K.correlation_pairs(s, minimum_overlap=2).select("a", "b", F.col("overlap").alias("periods"), rnd("correlation").alias("correlation"))


@query("matrix_export", """
    WITH s AS (SELECT date, family, r6(index_level) AS v FROM qidx_series WHERE weighting = 'equal')
    SELECT date, max(v) FILTER (family = 'all') AS "all", max(v) FILTER (family = 'ECONOMY') AS economy, max(v) FILTER (family = 'SMALL') AS small FROM s GROUP BY date""")
def _(m):
    s = family(m).series.filter("weighting = 'equal'")
    wide = s.groupBy("date").pivot("family", ["all", "ECONOMY", "SMALL"]).agg(rnd(F.max("index_level")))
    return wide.withColumnsRenamed({"ECONOMY": "economy", "SMALL": "small"})
