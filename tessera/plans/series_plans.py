"""Time-series queries: de-duplication, calendars, as-of alignment and ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.columns import change, quarter_ordinal, ratio, rnd
from tessera.functions import columns as C
from tessera.operators import series as S
from tessera.plans.registry import query, shared_sql
from tessera.sources.market_views import SOURCE_ORDER, Market

AS_OF = "2001-12-31"

shared_sql("q_quotes", """
    SELECT asset_id, category, period_end AS date, price_per_share AS price, market_cap AS cap, event_type, observed_at
    FROM observations WHERE price_per_share > 0
    QUALIFY row_number() OVER (PARTITION BY asset_id, period_end
        ORDER BY CASE event_type WHEN 'offering_price' THEN 0 WHEN 'distribution' THEN 2 ELSE 1 END DESC,
                 observed_at DESC, s1 DESC, s2 DESC, s3 DESC) = 1""")
shared_sql("d_quotes", """
    SELECT asset_id, category, observed_at AS date, price_per_share AS price, market_cap AS cap, event_type, bid, ask, volume
    FROM observations
    WHERE price_per_share > 0 AND event_type IN ('executed_trade', 'daily_close', 'chart_observation')
    QUALIFY row_number() OVER (PARTITION BY asset_id, observed_at ORDER BY s1 DESC, s2 DESC, s3 DESC) = 1""")
shared_sql("q_returns", """
    SELECT *, lag(price) OVER w AS previous, price / lag(price) OVER w - 1 AS ret FROM q_quotes
    WINDOW w AS (PARTITION BY asset_id ORDER BY date)""")


def quarterly(m: Market) -> DataFrame:
    return S.quarterly_quotes(m.observations, SOURCE_ORDER)


def daily(m: Market) -> DataFrame:
    return S.daily_quotes(m.observations, SOURCE_ORDER)


def returns(m: Market) -> DataFrame:
    return S.with_returns(quarterly(m), "asset_id")


@query("event_priority_dedupe", """
    SELECT asset_id, date, r6(price) AS price, r2(cap) AS cap, event_type, observed_at FROM q_quotes""")
def _(m):
    return quarterly(m).select("asset_id", "date", rnd("price").alias("price"), rnd("cap", 2).alias("cap"), "event_type",
                               "observed_at")


@query("dedupe_keep_last", """
    SELECT asset_id, date, r6(price) AS price, r8(bid) AS bid, r8(ask) AS ask, volume, event_type FROM d_quotes""")
def _(m):
    return daily(m).select("asset_id", "date", rnd("price").alias("price"), rnd("bid", 8).alias("bid"),
                           rnd("ask", 8).alias("ask"), "volume", "event_type")


@query("latest_per_key", """
    SELECT asset_id, max(date) AS date, r6(arg_max(price, date)) AS price, arg_max(event_type, date) AS event_type
    FROM d_quotes GROUP BY asset_id""")
def _(m):
    return daily(m).groupBy("asset_id").agg(
        F.max("date").alias("date"), rnd(F.max_by("price", "date")).alias("price"),
        F.max_by("event_type", "date").alias("event_type"))


@query("latest_quote_date", """
    SELECT asset_id, strftime(max(observed_at), '%Y-%m-%d') AS last_quote_observed_at FROM observations GROUP BY asset_id""")
def _(m):
    return m.observations.groupBy("asset_id").agg(
        F.date_format(F.max("observed_at"), "yyyy-MM-dd").alias("last_quote_observed_at"))


@query("latest_date_slice", """
    SELECT asset_id, date, r6(price) AS price FROM q_quotes WHERE date = (SELECT max(date) FROM q_quotes)""")
def _(m):
    q = quarterly(m)
    newest = m.observations.agg(F.max("period_end").alias("date"))
    return q.join(newest, "date", "left_semi").select("asset_id", "date", rnd("price").alias("price"))


GAPS = """
    WITH g AS (SELECT asset_id, date, date - lag(date) OVER (PARTITION BY asset_id ORDER BY date) AS gap FROM d_quotes),
    s AS (SELECT asset_id, count(*) AS n, max(gap) AS max_gap, median(gap) AS median_gap, avg(gap) AS mean_gap,
                 stddev_pop(gap) AS std_gap, stddev_samp(gap) AS std_gap_samp, min(date) AS first_date, max(date) AS last_date
          FROM g GROUP BY asset_id)"""


@query("gap_stats", GAPS + """
    SELECT asset_id, n, CAST(max_gap AS INT) AS max_gap, r6(median_gap) AS median_gap, first_date, last_date FROM s""")
def _(m):
    return S.gap_stats(daily(m), ["asset_id"]).select("asset_id", "n", "max_gap", rnd("median_gap").alias("median_gap"),
                                                      "first_date", "last_date")


@query("infer_frequency", GAPS + """
    SELECT asset_id, CASE WHEN n < 2 THEN 1.0::DOUBLE WHEN median_gap <= 10 THEN 52 WHEN median_gap <= 45 THEN 12
                          WHEN median_gap <= 120 THEN 4 ELSE 1 END AS periods_per_year FROM s""")
def _(m):
    return S.gap_stats(daily(m), ["asset_id"]).select(
        "asset_id", S.periods_per_year("n", "median_gap").alias("periods_per_year"))


@query("infer_frequency_cv", GAPS + """
    SELECT asset_id, r6(CASE WHEN n < 2 OR last_date <= first_date THEN NULL
           WHEN std_gap / mean_gap <= 0.25 THEN CASE WHEN median_gap <= 10 THEN 52.0 WHEN median_gap <= 45 THEN 12
                WHEN median_gap <= 120 THEN 4 ELSE 1 END
           ELSE (n - 1) / ((last_date - first_date) / 365.25) END) AS periods,
           coalesce(std_gap / mean_gap <= 0.25, FALSE) AS is_regular FROM s""")
def _(m):
    return S.periods_per_year_regular(S.gap_stats(daily(m), ["asset_id"])).select(
        "asset_id", rnd("periods").alias("periods"), "is_regular")


@query("infer_frequency_label", GAPS + """
    SELECT asset_id, r6(median_gap) AS median_gap, r6(365.25 / median_gap) AS factor,
           CASE WHEN n < 2 THEN 'Insufficient' ELSE
             CASE WHEN median_gap <= 2 THEN 'Daily' WHEN median_gap <= 10 THEN 'Weekly' WHEN median_gap <= 45 THEN 'Monthly'
                  WHEN median_gap <= 135 THEN 'Quarterly' WHEN median_gap <= 270 THEN 'Semiannual'
                  ELSE 'Annual / sparse' END
             || CASE WHEN std_gap_samp / median_gap > 0.35 THEN ' (irregular)' ELSE '' END END AS frequency FROM s""")
def _(m):
    return S.gap_stats(daily(m), ["asset_id"]).select(
        "asset_id", rnd("median_gap").alias("median_gap"), rnd(ratio(F.lit(365.25), "median_gap")).alias("factor"),
        F.when(F.col("n") < 2, "Insufficient").otherwise(S.frequency_label("median_gap", "std_gap_samp")).alias("frequency"))


@query("period_resample_last", """
    SELECT asset_id, last_day(date) AS period, r6(arg_max(price, date)) AS price, max(date) AS last_date
    FROM d_quotes GROUP BY asset_id, last_day(date)""")
def _(m):
    return S.period_last(daily(m), ["asset_id"], "month").withColumn("price", rnd("price"))


@query("calendar_grid", """
    WITH b AS (SELECT asset_id, min(observed_at) AS s, max(observed_at) AS e FROM observations GROUP BY asset_id),
    d AS (SELECT asset_id, s, e, unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS date FROM b),
    k AS (SELECT *, 'week' AS frequency FROM d WHERE isodow(date) = 5
          UNION ALL SELECT *, 'month' FROM d WHERE last_day(date) = date
          UNION ALL SELECT *, 'quarter' FROM d WHERE last_day(date) = date AND month(date) % 3 = 0
          UNION ALL SELECT *, 'year' FROM d WHERE last_day(date) = date AND month(date) = 12)
    SELECT asset_id, frequency, count(*) AS periods, min(date) AS first_period, max(date) AS last_period
    FROM k GROUP BY asset_id, frequency""")
def _(m):
    bounds = m.observations.groupBy("asset_id").agg(F.min("observed_at").alias("start"), F.max("observed_at").alias("end"))
    # one pass over the bounds: a union of four would read them, and all observations behind them, once per frequency
    kinds = F.array(*[F.struct(F.lit(f).alias("frequency"), S.period_array(F.col("start"), F.col("end"), f).alias("p")) for f in S.STEP])
    grid = bounds.select("asset_id", F.inline(kinds)).filter(F.size("p") > 0)
    return grid.select("asset_id", "frequency", F.size("p").cast("bigint").alias("periods"),
                       F.array_min("p").alias("first_period"), F.array_max("p").alias("last_period"))


@query("latest_completed_quarter", """
    SELECT observed_at, CASE WHEN period_end <= observed_at THEN period_end
           ELSE CAST(date_trunc('quarter', observed_at) AS DATE) - 1 END AS quarter, count(*) AS n
    FROM observations GROUP BY ALL""")
def _(m):
    return m.observations.groupBy("observed_at", C.last_completed_quarter(F.col("observed_at")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"))


@query("rebalance_dates", """
    WITH g AS (SELECT DISTINCT date FROM d_quotes), b AS (SELECT min(date) AS s, max(date) AS e FROM g),
    k AS (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS p FROM b),
    sched AS (SELECT p FROM k WHERE last_day(p) = p AND month(p) % 3 = 0)
    SELECT min(g.date) AS date FROM sched JOIN g ON g.date >= p GROUP BY p UNION SELECT s FROM b""")
def _(m):
    return S.rebalance_dates(daily(m).select("date").distinct(), "quarter")


@query("asof_backward", """
    WITH b AS (SELECT asset_id, min(date) AS s FROM d_quotes GROUP BY asset_id),
    g AS (SELECT asset_id, last_day(unnest(generate_series(date_trunc('month', s), DATE '2001-12-31', INTERVAL 1 MONTH))::DATE)
                 AS date FROM b),
    a AS (SELECT g.asset_id, g.date, q.date AS eff, q.price FROM g ASOF LEFT JOIN d_quotes q
          ON g.asset_id = q.asset_id AND g.date >= q.date)
    SELECT asset_id, date, CASE WHEN date - eff <= 60 THEN eff END AS effective_date,
           r6(CASE WHEN date - eff <= 60 THEN price END) AS price FROM a""")
def _(m):
    d = daily(m).select("asset_id", "date", "price")
    grid = S.calendar_grid(d.groupBy("asset_id").agg(F.min("date").alias("start")).withColumn(
        "end", F.lit(AS_OF).cast("date")), "month")
    return S.asof_backward(d, grid, ["asset_id"], ["price"], 60).withColumn("price", rnd("price"))


@query("asof_exact", """
    SELECT q.asset_id, q.date, r6(d.price) AS price FROM q_quotes q
    LEFT JOIN d_quotes d ON d.asset_id = q.asset_id AND d.date = q.date""")
def _(m):
    return S.asof_exact(daily(m).select("asset_id", "date", "price"), quarterly(m).select("asset_id", "date"),
                        ["asset_id"]).withColumn("price", rnd("price"))


@query("asof_previous_at_subject_dates", """
    WITH g AS (SELECT DISTINCT date FROM d_quotes), t AS (SELECT DISTINCT ticker FROM benchmarks),
    k AS (SELECT ticker, date FROM t CROSS JOIN g)
    SELECT k.ticker, k.date, b.date AS effective_date, r6(b.adjusted_close) AS adjusted_close
    FROM k ASOF LEFT JOIN benchmarks b ON k.ticker = b.ticker AND k.date >= b.date""")
def _(m):
    # every ticker is sampled at every subject date: the ticker list rides along as one array per date
    tickers = m.table("orders").agg(F.collect_set("o_orderpriority").alias("t"))
    dates = daily(m).select("date").distinct()
    grid = dates.join(tickers).select("date", F.explode("t").alias("ticker"))
    return S.asof_backward(m.benchmarks, grid, ["ticker"], ["adjusted_close"]).withColumn(
        "adjusted_close", rnd("adjusted_close"))


@query("asof_lookback_return", """
    WITH l AS (SELECT asset_id, max(date) AS latest, arg_max(price, date) AS price FROM d_quotes GROUP BY asset_id)
    SELECT l.asset_id, latest,
           r6(l.price / max_by(d.price, d.date) FILTER (d.date <= CAST(latest - INTERVAL 3 MONTH AS DATE)) - 1) AS return_1q,
           r6(l.price / max_by(d.price, d.date) FILTER (d.date <= CAST(latest - INTERVAL 12 MONTH AS DATE)) - 1) AS return_1y,
           r6(l.price / max_by(d.price, d.date) FILTER (d.date <= latest - 30) - 1) AS return_30d
    FROM l JOIN d_quotes d USING (asset_id) GROUP BY l.asset_id, latest, l.price""")
def _(m):
    d = daily(m).withColumn("latest", F.max("date").over(Window.partitionBy("asset_id")))

    def back(cutoff):
        return F.max_by("price", F.when(F.col("date") <= cutoff, F.col("date")))

    now = F.max_by("price", "date")
    return d.groupBy("asset_id", "latest").agg(
        rnd(change(now, back(F.add_months("latest", -3)))).alias("return_1q"),
        rnd(change(now, back(F.add_months("latest", -12)))).alias("return_1y"),
        rnd(change(now, back(F.date_sub("latest", 30)))).alias("return_30d"))


@query("exact_period_change", """
    WITH q AS (SELECT asset_id, date, price, year(date) * 4 + quarter(date) AS k FROM q_quotes)
    SELECT a.asset_id, a.date, r6(a.price / b.price - 1) AS qoq, r6(a.price / c.price - 1) AS yoy
    FROM q a LEFT JOIN q b ON b.asset_id = a.asset_id AND b.k = a.k - 1
    LEFT JOIN q c ON c.asset_id = a.asset_id AND c.k = a.k - 4""")
def _(m):
    return exact_changes(quarterly(m), "asset_id").select("asset_id", "date", rnd("qoq").alias("qoq"), rnd("yoy").alias("yoy"))


def exact_changes(df: DataFrame, key: str, value: str = "price") -> DataFrame:
    """Quarter and year changes only when that calendar quarter was observed."""
    w = Window.partitionBy(key).orderBy("_k")

    def base(quarters):
        # a range frame over the quarter number finds the exact period or nothing
        return F.first(value).over(w.rangeBetween(-quarters, -quarters))

    q = df.withColumn("_k", quarter_ordinal("date"))
    return q.withColumn("qoq", change(value, base(1))).withColumn("yoy", change(value, base(4))).drop("_k")


@query("consecutive_quarter_filter", """
    WITH q AS (SELECT asset_id, date, ret, year(date) * 4 + quarter(date)
                 - lag(year(date) * 4 + quarter(date)) OVER (PARTITION BY asset_id ORDER BY date) AS step FROM q_returns)
    SELECT asset_id, count(*) AS returns, r6(avg(ret)) AS mean_return, r6(stddev_samp(ret)) AS std_return,
           r6(min(ret)) AS worst, r6(max(ret)) AS best FROM q WHERE step = 1 GROUP BY asset_id""")
def _(m):
    w = S.over("asset_id")
    q = returns(m).withColumn("step", quarter_ordinal("date") - F.lag(quarter_ordinal("date")).over(w))
    return q.filter("step = 1").groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("returns"), rnd(F.avg("ret")).alias("mean_return"),
        rnd(F.stddev_samp("ret")).alias("std_return"), rnd(F.min("ret")).alias("worst"), rnd(F.max("ret")).alias("best"))


@query("lag_return", """
    SELECT asset_id, date, r6(ret) AS simple_return, r6(ln(price / previous)) AS log_return FROM q_returns""")
def _(m):
    return returns(m).select("asset_id", "date", rnd("ret").alias("simple_return"),
                             rnd(F.ln(ratio("price", "previous"))).alias("log_return"))


@query("shift_prior_value", """
    SELECT category, date, r2(cap) AS cap, r2(coalesce(lag(cap) OVER (PARTITION BY category ORDER BY date), 0)) AS prior_cap
    FROM (SELECT category, date, sum(cap) AS cap FROM q_quotes GROUP BY ALL)""")
def _(m):
    caps = quarterly(m).groupBy("category", "date").agg(F.sum("cap").alias("cap"))
    return caps.select("category", "date", rnd("cap", 2).alias("cap"),
                       rnd(F.coalesce(F.lag("cap").over(S.over("category")), F.lit(0.0)), 2).alias("prior_cap"))


@query("first_row_flag", """
    SELECT asset_id, date, row_number() OVER (PARTITION BY asset_id ORDER BY date) = 1 AS is_first FROM q_quotes""")
def _(m):
    return quarterly(m).select("asset_id", "date", (F.row_number().over(S.over("asset_id")) == 1).alias("is_first"))


@query("cum_product_level", """
    SELECT asset_id, date, r6(100 * product(1 + coalesce(ret, 0)) OVER (PARTITION BY asset_id ORDER BY date)) AS level
    FROM q_returns""")
def _(m):
    return returns(m).select("asset_id", "date", rnd(S.compounded("ret", S.running("asset_id"))).alias("level"))


@query("cum_sum", """
    SELECT asset_id, date, r6(sum(coalesce(ret, 0)) OVER (PARTITION BY asset_id ORDER BY date)) AS cumulative FROM q_returns""")
def _(m):
    return returns(m).select("asset_id", "date", rnd(
        F.sum(F.coalesce("ret", F.lit(0.0))).over(S.running("asset_id"))).alias("cumulative"))


@query("drawdown", """
    SELECT asset_id, date, r6(max(price) OVER w) AS peak, r6(price / max(price) OVER w - 1) AS drawdown
    FROM q_quotes WINDOW w AS (PARTITION BY asset_id ORDER BY date)""")
def _(m):
    return S.with_drawdown(quarterly(m), "asset_id").select("asset_id", "date", rnd("peak").alias("peak"),
                                                            rnd("drawdown").alias("drawdown"))


def drawdown_episodes(df: DataFrame, key: str, value: str = "price") -> DataFrame:
    """Deepest drawdown, longest run below the peak, and the first date that regains the peak."""
    w, upto = S.over(key), S.running(key)
    dd = S.with_drawdown(df, key, value)
    runs = dd.withColumn("island", F.count_if(F.col("drawdown") >= 0).over(upto))
    marked = runs.withColumn("run", F.count_if(F.col("drawdown") < 0).over(
        Window.partitionBy(key, "island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_n", F.row_number().over(w))
    worst = F.min(F.struct("drawdown", "_n", F.col("date").alias("trough"), "peak")).over(Window.partitionBy(key))
    located = marked.withColumn("_worst", worst)
    return located.groupBy(key).agg(
        F.min("drawdown").alias("max_drawdown"), F.max("run").alias("longest_run"), F.max("_worst.trough").alias("trough_date"),
        F.min(F.when((F.col("date") > F.col("_worst.trough")) & (F.col(value) >= F.col("_worst.peak")), F.col("date")))
        .alias("recovery_date"))


@query("drawdown_duration_recovery", """
    WITH d AS (SELECT asset_id, date, price, max(price) OVER w AS peak, price / max(price) OVER w - 1 AS dd,
                      row_number() OVER w AS n FROM q_quotes WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
    neg AS (SELECT asset_id, n - row_number() OVER (PARTITION BY asset_id ORDER BY n) AS grp FROM d WHERE dd < 0),
    runs AS (SELECT asset_id, max(c) AS longest FROM (SELECT asset_id, grp, count(*) AS c FROM neg GROUP BY ALL) GROUP BY 1),
    t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY dd, n) = 1)
    SELECT t.asset_id, r6(t.dd) AS max_drawdown, coalesce(longest, 0) AS longest_run, t.date AS trough_date,
           min(d.date) AS recovery_date
    FROM t LEFT JOIN runs USING (asset_id) LEFT JOIN d ON d.asset_id = t.asset_id AND d.date > t.date AND d.price >= t.peak
    GROUP BY ALL""")
def _(m):
    return drawdown_episodes(quarterly(m), "asset_id").withColumn("max_drawdown", rnd("max_drawdown"))


def trailing_streak(df: DataFrame, key: str) -> DataFrame:
    """Length and sign of the run of same-sign returns that ends at the last observation."""
    seen = df.filter(F.col("ret").isNotNull()).withColumn("sign", F.signum("ret").cast("int"))
    last = F.last("sign").over(Window.partitionBy(key).orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    marked = seen.withColumn("last_sign", last)
    broken = F.max(F.when(F.col("sign") != F.col("last_sign"), F.col("date"))).over(Window.partitionBy(key))
    return marked.withColumn("broken", broken).groupBy(key, F.col("last_sign").alias("sign")).agg(
        F.count_if(F.col("broken").isNull() | (F.col("date") > F.col("broken"))).alias("streak"),
        F.max("date").alias("last_date"))


@query("streak_length", """
    WITH r AS (SELECT asset_id, date, CAST(sign(ret) AS INT) AS s,
                      row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k FROM q_returns WHERE ret IS NOT NULL),
    l AS (SELECT asset_id, s AS sign, date AS last_date FROM r WHERE k = 1),
    b AS (SELECT r.asset_id, min(k) AS brk FROM r JOIN l ON l.asset_id = r.asset_id AND r.s <> l.sign GROUP BY 1)
    SELECT l.asset_id, sign, coalesce(brk - 1, (SELECT count(*) FROM r WHERE r.asset_id = l.asset_id)) AS streak, last_date
    FROM l LEFT JOIN b USING (asset_id)""")
def _(m):
    return trailing_streak(returns(m), "asset_id")


@query("rolling_std", """
    WITH r AS (SELECT asset_id, date, ret, count(ret) OVER w AS c, round(stddev_samp(ret) OVER w, 9) AS sd FROM q_returns
               WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    v AS (SELECT * FROM r WHERE c = 4)
    SELECT a.asset_id, a.date, r6(a.sd) AS rolling_std, r6(avg(CASE WHEN b.sd <= a.sd THEN 1.0 ELSE 0.0 END)) AS share_at_or_below
    FROM v a JOIN v b ON a.asset_id = b.asset_id AND b.date <= a.date GROUP BY a.asset_id, a.date, a.sd""")
def _(m):
    return rolling_volatility(returns(m), "asset_id").select(
        "asset_id", "date", rnd("rolling_std").alias("rolling_std"), rnd("share_at_or_below").alias("share_at_or_below"))


def rolling_volatility(df: DataFrame, key: str, width: int = 4) -> DataFrame:
    """Sample deviation of the last `width` returns and how much of its history it exceeds."""
    frame = S.over(key).rowsBetween(-(width - 1), 0)
    full = (df.filter(F.col("ret").isNotNull())
            .withColumn("rolling_std", F.when(F.count("ret").over(frame) == width, F.round(F.stddev_samp("ret").over(frame), 9)))
            .filter(F.col("rolling_std").isNotNull()))
    return S.share_of_history(full, key, "rolling_std", "share_at_or_below")


@query("rank_ordinal", """
    SELECT date, asset_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY date) AS n,
           r6(CASE WHEN count(*) OVER (PARTITION BY date) = 1 THEN 1.0
              ELSE (count(*) OVER (PARTITION BY date) - row_number() OVER w) / (count(*) OVER (PARTITION BY date) - 1) END)
             AS percentile
    FROM q_returns WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY date ORDER BY r8(ret) DESC, asset_id)""")
def _(m):
    r = returns(m).filter("ret IS NOT NULL").select("date", "asset_id", (-rnd("ret", 8)).alias("_down"))
    return S.ordinal_rank(r, ["date"], ["_down", "asset_id"]).select("date", "asset_id", "rank", "n", rnd("percentile").alias("percentile"))


@query("rank_pct_average", """
    WITH r AS (SELECT date, asset_id, r8(ret) AS x FROM q_returns WHERE ret IS NOT NULL)
    SELECT date, asset_id, r6((rank() OVER (PARTITION BY date ORDER BY x)
           + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(*) OVER (PARTITION BY date)) AS pct FROM r""")
def _(m):
    r = returns(m).filter("ret IS NOT NULL").select("date", "asset_id", rnd("ret", 8).alias("x"))
    return S.rank_average(r, ["date"], "x", "pct").select("date", "asset_id", rnd("pct").alias("pct"))


@query("rank_history", """
    WITH c AS (SELECT category, date, avg(ret) AS v, count(*) >= 20 AS eligible FROM q_returns WHERE ret IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY date, eligible ORDER BY v DESC, category) END AS rank FROM c)
    SELECT category, date, eligible, rank, lag(rank) OVER w AS previous_rank, lag(rank) OVER w - rank AS rank_change
    FROM k WINDOW w AS (PARTITION BY category ORDER BY date)""")
def _(m):
    c = returns(m).filter("ret IS NOT NULL").groupBy("category", "date").agg(
        F.avg("ret").alias("v"), (F.count(F.lit(1)) >= 20).alias("eligible"))
    rank = F.when(F.col("eligible"), F.row_number().over(
        Window.partitionBy("date", "eligible").orderBy(F.desc("v"), "category")).cast("bigint"))
    return with_rank_change(c.withColumn("rank", rank), "category").select(
        "category", "date", "eligible", "rank", "previous_rank", "rank_change")


def with_rank_change(df: DataFrame, key: str, order: str = "date") -> DataFrame:
    previous = F.lag("rank").over(S.over(key, order))
    return df.withColumn("previous_rank", previous).withColumn("rank_change", F.col("previous_rank") - F.col("rank"))
