"""Story detection, scoring and selection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import rnd
from tessera.operators import indexes as I
from tessera.operators import stories as T
from tessera.plans.crosssection_plans import archive
from tessera.plans.market_plans import exits
from tessera.plans.registry import query, shared_sql
from tessera.plans.valuation_plans import valued
from tessera.session import staged
from tessera.sources.market_views import Market

BENCH = "1-URGENT"

shared_sql("st_p", """
    SELECT period_end AS period, CAST(date_trunc('quarter', period_end) AS DATE) AS start, max(observed_at) AS "end", count(DISTINCT asset_id) AS assets FROM observations
    WHERE observed_at <= period_end GROUP BY period_end HAVING count(DISTINCT asset_id) >= 2""")
shared_sql("st_m", """
    WITH d AS (SELECT asset_id, category, observed_at AS date, price_per_share AS price FROM observations WHERE price_per_share > 0
               QUALIFY row_number() OVER (PARTITION BY asset_id, observed_at ORDER BY s1 DESC, s2 DESC, s3 DESC) = 1)
    SELECT *, max(price) OVER w AS peak, count(*) OVER w AS seen FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY date)""")
shared_sql("st_b", """
    WITH g AS (SELECT a.asset_id, p.period, p."end" AS date FROM (SELECT DISTINCT asset_id FROM st_m) a CROSS JOIN st_p p)
    SELECT g.asset_id, g.period, g.date, m.category, m.price, m.peak, m.seen, CAST(g.date - m.date AS INT) AS age FROM g ASOF JOIN st_m m ON m.asset_id = g.asset_id AND g.date >= m.date""")
shared_sql("st_cur", "SELECT * FROM st_b WHERE age <= 186")
shared_sql("st_r", """
    WITH g AS (SELECT a.asset_id, p.period, p.start - 1 AS date FROM (SELECT DISTINCT asset_id FROM st_m) a CROSS JOIN st_p p),
    a AS (SELECT g.asset_id, g.period, m.price AS p0 FROM g ASOF JOIN st_m m ON m.asset_id = g.asset_id AND g.date >= m.date WHERE g.date - m.date <= 186)
    SELECT b.*, round(b.price / a.p0 - 1, 9) AS ret FROM st_cur b JOIN a USING (asset_id, period)""")
shared_sql("st_bench", "SELECT date, adjusted_close FROM benchmarks WHERE ticker = '1-URGENT'")


def bench(m: Market) -> DataFrame:
    return m.benchmarks.filter(F.col("ticker") == BENCH).select("date", "adjusted_close")


def periods(m: Market) -> DataFrame:
    return T.periods(m.observations)


def marks(m: Market) -> DataFrame:
    return T.marks(m.observations)


def period_returns(m: Market) -> DataFrame:
    return T.period_returns(marks(m), periods(m))


def current(m: Market) -> DataFrame:
    return T.at_periods(marks(m), periods(m), F.col("end"), ["price", "category", "peak", "seen"]).withColumn("age", F.datediff("date", "effective_date"))


def shown(leads: DataFrame, *metrics: str) -> DataFrame:
    return leads.select("period", "family", "kind", "subject_id", *[rnd(F.col("metrics")[x]).alias(x) for x in metrics], rnd("quality").alias("quality"))


@query("discover_quarters", 'SELECT period, start, "end", assets FROM st_p')
def _(m):
    return periods(m).select("period", "start", "end", "assets")


MOVERS_SQL = """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY ret, asset_id) AS lo, row_number() OVER (PARTITION BY period ORDER BY ret DESC, asset_id) AS hi,
               (rank() OVER (PARTITION BY period ORDER BY ret) + (count(*) OVER (PARTITION BY period, ret) - 1) / 2) / count(*) OVER (PARTITION BY period) AS pct FROM st_r),
    n AS (SELECT asset_id, count(*) AS n FROM observations GROUP BY 1)"""


def movers(m: Market) -> DataFrame:
    totals = m.observations.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return T.extreme_movers(period_returns(m), totals)


@query("story_extreme_movers", MOVERS_SQL + """
    SELECT period, 'extreme_movers' AS family, CASE WHEN ret >= 0 THEN 'gained' ELSE 'lost' END AS kind, 'asset:' || asset_id AS subject_id, r6(ret) AS quarter_return, r6(pct) AS percentile,
           r6(least(1, .35 + .1 * least(n, 6))) AS quality FROM k JOIN n USING (asset_id) WHERE lo <= 5 OR hi <= 5""")
def _(m):
    return shown(movers(m), "quarter_return", "percentile")


@query("story_score", MOVERS_SQL + """,
    s AS (SELECT period, asset_id, CASE WHEN ret >= 0 THEN 'gained' ELSE 'lost' END AS kind, least(1, .35 + .1 * least(n, 6)) AS q, abs(pct - .5) * 2 AS ext, least(1, abs(ret) / .5) AS mag
          FROM k JOIN n USING (asset_id) WHERE lo <= 5 OR hi <= 5)
    SELECT period, 'asset:' || asset_id AS subject_id, substr(sha1(period || '|extreme_movers|' || kind || '|asset:' || asset_id), 1, 12) AS story_id,
           r4(round(100 * (.12 * ext + .10 * mag + .05 * ext + .06 * .9 + .10 * q) * (.65 + .35 * q) + 1e-9, 2)) AS content_score FROM s""")
def _(m):
    return T.with_score(movers(m)).select("period", "subject_id", "story_id", rnd("content_score", 4).alias("content_score"))


@query("story_category", """
    WITH c AS (SELECT period, category, round(avg(ret), 9) AS mean, count(*) AS n FROM st_r GROUP BY ALL HAVING count(*) >= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY mean, category) AS lo, row_number() OVER (PARTITION BY period ORDER BY mean DESC, category) AS hi FROM c)
    SELECT period, 'category' AS family, 'category_return' AS kind, 'category:' || category AS subject_id, r6(mean) AS mean_return, r6(n) AS observations, r6(least(1, .45 + n / 20)) AS quality
    FROM k WHERE lo <= 2 OR hi <= 2""")
def _(m):
    return shown(T.category_moves(period_returns(m)), "mean_return", "observations")


@query("story_breadth", """
    SELECT period, 'dispersion_breadth' AS family, 'market_breadth' AS kind, 'market' AS subject_id, r6(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)) AS percent_positive, r6(avg(ret)) AS mean_return,
           r6(median(ret)) AS median_return, r6(stddev_samp(ret)) AS dispersion, r6(least(1, .6 + count(*) / 100)) AS quality FROM st_r GROUP BY period HAVING count(*) >= 4""")
def _(m):
    return shown(T.breadth(period_returns(m)), "percent_positive", "mean_return", "median_return", "dispersion")


@query("story_contrast", """
    SELECT period, 'cross_asset_contrast' AS family, 'category_pair' AS kind, 'asset:' || arg_min(asset_id, (-ret, asset_id)) AS subject_id, r6(max(ret) - min(ret)) AS return_spread, r6(.65) AS quality
    FROM st_r GROUP BY period, category HAVING count(*) >= 2 AND max(ret) - min(ret) >= .20""")
def _(m):
    return shown(T.contrast(period_returns(m)), "return_spread")


@query("story_drawdown", """
    SELECT period, 'drawdown_recovery' AS family, CASE WHEN price / peak - 1 < 0 THEN 'deep_drawdown' ELSE 'new_high' END AS kind, 'asset:' || asset_id AS subject_id, r6(price / peak - 1) AS drawdown,
           r6(peak) AS peak_price, r6(least(1, .45 + seen / 20)) AS quality FROM st_cur WHERE seen >= 3 AND (price / peak - 1 <= -.25 OR price >= peak)""")
def _(m):
    return shown(T.drawdowns(current(m)), "drawdown", "peak_price")


@query("story_benchmark_gap", """
    WITH b AS (SELECT p.period, (SELECT arg_max(adjusted_close, date) FROM st_bench s WHERE s.date < p.start) AS b0, (SELECT arg_max(adjusted_close, date) FROM st_bench s WHERE s.date <= p."end") AS b1 FROM st_p p),
    g AS (SELECT r.period, asset_id, b1 / b0 - 1 AS br, round(ret - (b1 / b0 - 1), 9) AS gap FROM st_r r JOIN b USING (period) WHERE b0 IS NOT NULL)
    SELECT period, 'benchmark_divergence' AS family, 'benchmark_gap' AS kind, 'asset:' || asset_id AS subject_id, r6(gap) AS relative_spread, r6(br) AS benchmark_return, r6(.72) AS quality FROM g
    QUALIFY row_number() OVER (PARTITION BY period ORDER BY abs(gap) DESC, asset_id) <= 4""")
def _(m):
    return shown(T.benchmark_gaps(period_returns(m), bench(m), periods(m)), "relative_spread", "benchmark_return")


@query("story_stale", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY age DESC, asset_id) AS k FROM st_cur)
    SELECT period, 'liquidity_staleness' AS family, 'stale_mark' AS kind, 'asset:' || asset_id AS subject_id, r6(age) AS stale_age_days, r6(greatest(.3, 1 - age / (186 * 1.5))) AS quality FROM k WHERE k <= 4 AND age >= 60""")
def _(m):
    return shown(T.stale_marks(current(m)), "stale_age_days")


shared_sql("st_exits", """
    SELECT p.period, e.asset_id, e.exit_effective_date, e.offering_date, e.terminal_price / e.offering_price_usd - 1 AS r FROM exit_events e
    JOIN st_p p ON e.exit_effective_date BETWEEN p.start AND p."end" WHERE e.is_confirmed AND e.terminal_price IS NOT NULL""")


@query("story_exit", """
    SELECT period, 'exit_buyout' AS family, 'realized_exit' AS kind, 'asset:' || asset_id AS subject_id, r6(r) AS realized_return, r6(.9) AS quality FROM st_exits""")
def _(m):
    return shown(T.exit_stories(T.exits_in_period(exits(m), periods(m))), "realized_return")


@query("story_exit_vs_benchmark", """
    WITH b AS (SELECT e.*, (SELECT arg_min(adjusted_close, date) FROM st_bench s WHERE s.date BETWEEN e.offering_date AND e.exit_effective_date) AS b0,
               (SELECT arg_max(adjusted_close, date) FROM st_bench s WHERE s.date BETWEEN e.offering_date AND e.exit_effective_date) AS b1 FROM st_exits e)
    SELECT period, 'exit_benchmark' AS family, 'holding_period' AS kind, 'asset:' || asset_id AS subject_id, r6(r) AS realized_return, r6(b1 / b0 - 1) AS benchmark_return, r6(r - (b1 / b0 - 1)) AS excess_return,
           r6(.9) AS quality FROM b WHERE b0 IS NOT NULL""")
def _(m):
    return shown(T.exit_benchmark(T.exits_in_period(exits(m), periods(m)), bench(m)), "realized_return", "benchmark_return", "excess_return")


shared_sql("late_observations", """
    SELECT * REPLACE (CASE WHEN (asset_id + month(observed_at)) % 9 = 0 THEN last_day(CAST(date_trunc('quarter', period_end) - INTERVAL 1 MONTH AS DATE)) ELSE period_end END AS period_end)
    FROM observations WHERE NOT (category = 'SMALL' AND period_end BETWEEN DATE '1996-06-30' AND DATE '1997-01-31' OR category = 'PROMO' AND period_end = DATE '1998-06-30')""")


def late_observations(m: Market) -> DataFrame:
    """Observations of which some arrive a quarter late and some categories lack quarters, short and long."""
    late = (F.col("asset_id") + F.month("observed_at")) % 9 == 0
    before = F.date_sub(F.trunc("period_end", "quarter"), 1)
    gap = ((F.col("category") == "SMALL") & F.col("period_end").between("1996-06-30", "1997-01-31")) | ((F.col("category") == "PROMO") & (F.col("period_end") == "1998-06-30"))
    return m.observations.filter(~gap).withColumn("period_end", F.when(late, before).otherwise(F.col("period_end")))


@query("story_corr_regime", """
    WITH v AS (SELECT o.category, p.period, p."end" AS e, o.period_end AS date, avg(o.price_per_share) AS v FROM late_observations o
               JOIN st_p p ON o.observed_at <= p."end" AND o.period_end <= p."end" GROUP BY ALL),
    b AS (SELECT category, period, e, min(date) AS f FROM v GROUP BY ALL),
    g AS (SELECT category, period, d AS date FROM (SELECT *, unnest(generate_series(f, e, INTERVAL 1 DAY))::DATE AS d FROM b) WHERE last_day(d) = d AND month(d) % 3 = 0),
    x AS (SELECT g.*, CASE WHEN g.date - v.date <= 186 THEN v.v END AS v FROM g ASOF JOIN v ON v.category = g.category AND v.period = g.period AND g.date >= v.date),
    xr AS (SELECT *, v / lag(v) OVER (PARTITION BY category, period ORDER BY date) - 1 AS x FROM x),
    q AS (SELECT g.date, CASE WHEN g.date - s.date <= 186 THEN s.adjusted_close END AS v FROM (SELECT DISTINCT date FROM g) g ASOF JOIN st_bench s ON g.date >= s.date),
    yr AS (SELECT date, v / lag(v) OVER (ORDER BY date) - 1 AS y FROM q),
    r AS (SELECT category, period, x, y, row_number() OVER (PARTITION BY category, period ORDER BY date DESC) AS n FROM xr JOIN yr USING (date) WHERE x IS NOT NULL AND y IS NOT NULL),
    w AS (SELECT category, period, corr(x, y) FILTER (n <= 8) AS recent, corr(x, y) FILTER (n BETWEEN 9 AND 16) AS prior, count(*) AS n FROM r GROUP BY ALL)
    SELECT period, 'correlation_regime' AS family, 'possible_regime_shift' AS kind, 'category:' || category AS subject_id, r6(prior) AS prior_correlation, r6(recent) AS recent_correlation, r6(.8) AS quality
    FROM w WHERE n >= 16 AND abs(recent - prior) >= .5""")
def _(m):
    return shown(T.correlation_regimes(late_observations(m), bench(m), periods(m)), "prior_correlation", "recent_correlation")


@query("story_vol_regime", """
    WITH r AS (SELECT asset_id, date, price / lag(price) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS ret FROM st_m),
    n AS (SELECT *, row_number() OVER w AS n, stddev_samp(ret) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s0 FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
    s AS (SELECT *, CASE WHEN n >= 4 THEN round(s0, 9) END AS sd FROM n),
    o AS (SELECT *, lag(sd, 4) OVER (PARTITION BY asset_id ORDER BY date) AS old FROM s),
    h AS (SELECT a.asset_id, a.date, avg(CASE WHEN b.sd <= a.sd THEN 1.0 ELSE 0 END) AS pct FROM o a JOIN o b ON a.asset_id = b.asset_id AND b.date <= a.date AND b.sd IS NOT NULL WHERE a.sd IS NOT NULL GROUP BY ALL),
    g AS (SELECT a.asset_id, p.period, p."end" AS d FROM (SELECT DISTINCT asset_id FROM o) a CROSS JOIN st_p p),
    l AS (SELECT g.period, o.* FROM g ASOF JOIN o ON o.asset_id = g.asset_id AND g.d >= o.date)
    SELECT period, 'volatility_regime' AS family, CASE WHEN sd / old > 1 THEN 'expansion' ELSE 'compression' END AS kind, 'asset:' || l.asset_id AS subject_id, r6(sd) AS recent_volatility,
           r6(sd / old) AS volatility_ratio, r6(pct) AS historical_percentile, r6(.90) AS quality FROM l JOIN h ON h.asset_id = l.asset_id AND h.date = l.date
    WHERE n >= 8 AND old > 0 AND (sd / old >= 1.75 OR sd / old <= .55 OR pct >= .95)""")
def _(m):
    return shown(T.volatility_regimes(marks(m), periods(m)), "recent_volatility", "volatility_ratio", "historical_percentile")


@query("story_streak", """
    WITH q AS (SELECT asset_id, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS q, arg_max(price, date) AS v FROM st_m GROUP BY ALL),
    r AS (SELECT asset_id, q, CAST(sign(v / lag(v) OVER (PARTITION BY asset_id ORDER BY q) - 1) AS INT) AS s FROM q),
    n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY q) AS n FROM r WHERE s IS NOT NULL),
    k AS (SELECT a.asset_id, a.q, a.s, a.n, a.n - coalesce(max(b.n), 0) AS streak FROM n a LEFT JOIN n b ON b.asset_id = a.asset_id AND b.n < a.n AND b.s <> a.s GROUP BY a.asset_id, a.q, a.s, a.n),
    g AS (SELECT a.asset_id, p.period FROM (SELECT DISTINCT asset_id FROM k) a CROSS JOIN st_p p),
    l AS (SELECT g.period, k.* FROM g ASOF JOIN k ON k.asset_id = g.asset_id AND g.period >= k.q)
    SELECT period, 'streak' AS family, CASE WHEN s > 0 THEN 'positive_streak' ELSE 'negative_streak' END AS kind, 'asset:' || asset_id AS subject_id, r6(streak) AS streak_length, r6(least(.95, .5 + n / 30)) AS quality
    FROM l WHERE streak >= 3 AND s <> 0""")
def _(m):
    return shown(T.streaks(marks(m), periods(m)), "streak_length")


@query("story_rank_jump", """
    WITH a AS (SELECT subject_id, date, rank, CASE WHEN n = 1 THEN 1 ELSE (n - rank) / (n - 1) END AS pct FROM lb_archive WHERE metric = 'latest_quarter_return' AND eligible),
    j AS (SELECT c.subject_id, c.date, c.rank, p.rank AS prev, c.pct - p.pct AS delta FROM a c JOIN a p ON p.subject_id = c.subject_id AND p.date = last_day(CAST(c.date - INTERVAL 3 MONTH AS DATE)))
    SELECT s.period, 'rank_history' AS family, 'rank_jump' AS kind, subject_id, r6(prev) AS previous_rank, r6(rank) AS current_rank, r6(delta) AS change, r6(.85) AS quality
    FROM j JOIN st_p s ON j.date = CASE WHEN s."end" = s.period THEN s.period ELSE s.start - 1 END WHERE abs(delta) >= .35""")
def _(m):
    return shown(T.rank_jumps(archive(m, "latest_quarter_return"), periods(m)), "previous_rank", "current_rank", "change")


def valuations(m: Market) -> DataFrame:
    return valued(m).filter("base_value_usd IS NOT NULL").select("asset_id", "base_value_usd", "confidence_score", F.col("last_sale_date").alias("effective"))


@query("story_fair_value", """
    WITH v AS (SELECT v.*, (SELECT max(sale_date) FROM research r WHERE r.asset_id = v.asset_id) AS eff, greatest(0, least(1, CASE WHEN n > 0 THEN .75 ELSE 0 END - CASE WHEN n = 1 THEN .35 ELSE 0 END
           - CASE WHEN unv > .5 THEN .15 ELSE 0 END - CASE WHEN disp > .75 THEN .2 ELSE 0 END - CASE WHEN NOT cond THEN .1 ELSE 0 END - CASE WHEN NOT hist THEN .1 ELSE 0 END)) AS conf FROM valued v WHERE n >= 2),
    j AS (SELECT c.period, c.asset_id, c.price * a.share_count AS market, base, base / (c.price * a.share_count) - 1 AS gap, conf FROM st_cur c JOIN v ON v.asset_id = c.asset_id AND v.eff <= c.date JOIN assets a ON a.asset_id = c.asset_id)
    SELECT period, 'fair_value' AS family, 'valuation_gap' AS kind, 'asset:' || asset_id AS subject_id, r2(market) AS market_value, r6(gap) AS base_gap_percent, r6(coalesce(nullif(conf, 0), .4)) AS quality FROM j WHERE abs(gap) >= .2""")
def _(m):
    out = T.fair_value_gaps(current(m), valuations(m), m.assets.select("asset_id", "share_count"))
    return out.select("period", "family", "kind", "subject_id", rnd(F.col("metrics")["market_value"], 2).alias("market_value"), rnd(F.col("metrics")["base_gap_percent"]).alias("base_gap_percent"),
                      rnd("quality").alias("quality"))


def story_index(m: Market) -> I.IndexResult:
    shares = m.assets.select("asset_id", "share_count")
    q = marks(m).join(shares, "asset_id").select("asset_id", "category", "date", "price", (F.col("price") * F.col("share_count")).alias("cap"))
    return I.index_chain(I.index_rows(q), ["family", "weighting"])


shared_sql("st_ie", """
    SELECT f.family, m.asset_id, m.date, m.price, m.price * a.share_count AS cap, dense_rank() OVER (PARTITION BY f.family ORDER BY m.date) AS k
    FROM st_m m JOIN assets a USING (asset_id), LATERAL (SELECT unnest(['all', m.category]) AS family) f""")
shared_sql("st_is", """
    SELECT c.family, c.date, c.asset_id, c.price / p.price - 1 AS ret, p.cap FROM st_ie c JOIN st_ie p ON p.family = c.family AND p.asset_id = c.asset_id AND p.k = c.k - 1""")
shared_sql("st_day", """
    WITH d AS (SELECT DISTINCT family, date FROM st_ie), r AS (SELECT family, date, avg(ret) AS er, sum(ret * cap) / sum(cap) AS mr FROM st_is GROUP BY ALL),
    g AS (SELECT f.family, p.period, p."end" AS e FROM (SELECT DISTINCT family FROM d) f CROSS JOIN st_p p),
    l AS (SELECT g.family, g.period, d.date FROM g ASOF JOIN d ON d.family = g.family AND g.e >= d.date)
    SELECT l.*, coalesce(er, 0) AS er, coalesce(mr, 0) AS mr FROM l LEFT JOIN r USING (family, date)""")


@query("story_index_weighting", """
    SELECT period, 'index_weighting' AS family, 'equal_vs_market_cap' AS kind, 'index:' || d.family AS subject_id, r6(mr) AS market_cap_return, r6(er) AS equal_weight_return, r6(mr - er) AS spread, r6(.8) AS quality
    FROM st_day d WHERE abs(mr - er) >= .08 OR er * mr < 0""")
def _(m):
    return shown(T.index_weighting(T.latest_index_day(story_index(m).series, periods(m))), "market_cap_return", "equal_weight_return", "spread")


@query("story_index_attribution", """
    WITH c AS (SELECT d.period, s.family, s.asset_id, round(s.ret * s.cap, 6) AS v FROM st_is s JOIN st_day d ON d.family = s.family AND d.date = s.date),
    k AS (SELECT *, row_number() OVER (PARTITION BY period, family ORDER BY v DESC, asset_id) AS k FROM c),
    g AS (SELECT period, family, count(*) AS n, sum(v) FILTER (k <= 3 AND v > 0) / sum(v) FILTER (v > 0) AS share FROM k GROUP BY ALL)
    SELECT period, 'index_attribution' AS family, 'winner_concentration' AS kind, 'index:' || g.family AS subject_id, r6(share) AS top_3_positive_share, r6(n) AS constituent_count, r6(.85) AS quality FROM g WHERE n >= 3 AND share >= .65""")
def _(m):
    res = story_index(m)
    return shown(T.index_attribution(T.latest_index_day(res.series, periods(m)), res.contributions), "top_3_positive_share", "constituent_count")


def detectors(m: Market) -> list[DataFrame]:
    """Leads of every detector family."""
    p, mk = staged(periods(m)), staged(marks(m))
    r = staged(T.period_returns(mk, p))
    cur = staged(T.at_periods(mk, p, F.col("end"), ["price", "category", "peak", "seen"]).withColumn("age", F.datediff("date", "effective_date")))
    totals = m.observations.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_obs"))
    res = story_index(m)
    days = staged(T.latest_index_day(res.series, p))
    return [T.extreme_movers(r, totals), T.category_moves(r), T.breadth(r), T.contrast(r), T.drawdowns(cur), T.benchmark_gaps(r, bench(m), p), T.stale_marks(cur),
             T.exit_stories(T.exits_in_period(exits(m), p)), T.correlation_regimes(m.observations, bench(m), p), T.volatility_regimes(mk, p), T.streaks(mk, p),
             T.exit_benchmark(T.exits_in_period(exits(m), p), bench(m)), T.rank_jumps(archive(m, "latest_quarter_return"), p), T.fair_value_gaps(cur, valuations(m), m.assets.select("asset_id", "share_count")),
             T.index_weighting(days), T.index_attribution(days, res.contributions)]

@query("story_slate")
def _(m):
    # all detectors run once, in one job; their leads are kept without facts
    leads = T.with_score(reduce(DataFrame.unionByName, detectors(m)))
    return T.slate(staged(leads.select("period", "family", "kind", "subject_id", "quality", "story_id", "content_score")))


def return_leads(m: Market) -> DataFrame:
    """Every return of a period as a lead, in seven families and few subjects, so that all caps bind."""
    k = F.col("asset_id")
    token = F.concat(F.date_format("period", "yyyyMM"), F.lit("-"), F.lpad(k.cast("string"), 8, "0"))
    return period_returns(m).select(
        "period", F.concat(F.lit("f"), k % 7).alias("family"), F.concat(F.lit("k"), F.floor(k / 7) % 5).alias("kind"), F.concat(F.lit("s"), F.floor(k / 3) % 40).alias("subject_id"),
        F.when(k % 11 == 0, 0.2).otherwise(0.5).alias("quality"), token.alias("story_id"), F.round(F.abs("ret") * 100, 1).alias("content_score"))


@query("slate_of_returns", """
    WITH RECURSIVE l AS (
      SELECT period, 'f' || asset_id % 7 AS family, 'k' || (asset_id // 7) % 5 AS kind, 's' || (asset_id // 3) % 40 AS subject_id, strftime(period, '%Y%m') || '-' || lpad(CAST(asset_id AS VARCHAR), 8, '0') AS story_id,
             round(abs(ret) * 100, 1) AS content_score FROM st_r WHERE asset_id % 11 <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY content_score DESC, story_id) AS i FROM l),
    w(period, i, picks, subject_id, kind, what, angle_of) AS (
      SELECT DISTINCT period, CAST(0 AS BIGINT), CAST([] AS STRUCT(subject_id VARCHAR, family VARCHAR, story_id VARCHAR, i BIGINT)[]), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM o
      UNION ALL
      SELECT o.period, o.i,
        CASE WHEN len(list_filter(picks, lambda x: x.subject_id = o.subject_id)) < 2 AND len(list_filter(picks, lambda x: x.family = o.family)) < 5 AND len(list_filter(picks, lambda x: x.subject_id = o.subject_id AND x.family = o.family)) = 0
             THEN list_append(picks, {'subject_id': o.subject_id, 'family': o.family, 'story_id': o.story_id, 'i': o.i}) ELSE picks END,
        o.subject_id, o.kind,
        CASE WHEN len(list_filter(picks, lambda x: x.subject_id = o.subject_id AND x.family = o.family)) > 0 THEN 'again'
             WHEN len(list_filter(picks, lambda x: x.subject_id = o.subject_id)) >= 2 OR len(list_filter(picks, lambda x: x.family = o.family)) >= 5 THEN 'kept out' ELSE 'taken' END,
        (list_filter(picks, lambda x: x.subject_id = o.subject_id)[1]).story_id
      FROM w JOIN o ON o.period = w.period AND o.i = w.i + 1),
    t AS (SELECT o.*, row_number() OVER (PARTITION BY o.period ORDER BY o.i) AS nth, count(*) OVER (PARTITION BY o.period) AS n, row_number() OVER (PARTITION BY o.period, o.family ORDER BY o.i) AS f
          FROM o JOIN w ON w.period = o.period AND w.i = o.i WHERE w.what = 'taken'),
    p AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY CASE WHEN n > 20 AND f > 1 THEN 1 ELSE 0 END, nth) AS position FROM t),
    k AS (SELECT period, angle_of, kind, min(i) AS i FROM w WHERE what = 'kept out' AND angle_of IS NOT NULL GROUP BY ALL),
    a AS (SELECT period, angle_of, string_agg(kind, ',' ORDER BY i) AS angles FROM k GROUP BY ALL)
    SELECT p.period, p.story_id, p.family, p.kind, p.subject_id, r6(content_score) AS content_score, position, coalesce(angles, '') AS secondary_angles
    FROM p LEFT JOIN a ON a.period = p.period AND a.angle_of = p.story_id WHERE position <= 20""")
def _(m):
    out = T.slate(staged(return_leads(m)))
    return out.select("period", "story_id", "family", "kind", "subject_id", rnd("content_score").alias("content_score"), F.col("position").cast("bigint").alias("position"), F.array_join("secondary_angles", ",").alias("secondary_angles"))


@query("story_schema", """
    SELECT period, count(*) AS leads, r6(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)) AS share_up FROM st_r GROUP BY period""")
def _(m):
    # a lead is one nested row: ids, facts, metrics and scores; here the market-level facts of a period
    r = period_returns(m)
    fact = F.struct(F.lit("share_up").alias("metric"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("value"))
    doc = r.groupBy("period").agg(F.struct(F.array(fact).alias("facts"), F.count(F.lit(1)).alias("leads")).alias("lead"))
    return doc.select("period", F.col("lead.leads").alias("leads"), rnd(F.col("lead.facts")[0]["value"]).alias("share_up"))
