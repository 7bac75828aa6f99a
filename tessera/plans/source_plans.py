"""Scans, views, conforming projections and sinks. Sinks write to the shared checkpoint area and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import falsy_or, first_nonblank, rnd
from tessera.operators import market as M
from tessera.operators import quality as Q
from tessera.operators import stories as T
from tessera.plans.crosssection_plans import scatter
from tessera.plans.index_plans import family
from tessera.plans.market_plans import market_table
from tessera.plans.quality_plans import raw_assets
from tessera.plans.registry import query
from tessera.plans.series_plans import AS_OF, daily
from tessera.plans.story_plans import movers
from tessera.session import staged
from tessera.sources import tables as IO
from tessera.sources.archive import Archive, append_run, read_ledger
from tessera.sources.market_views import Market


@query("scan_csv_typed", """
    SELECT CASE WHEN asset_id % 50 <> 7 THEN asset_id END AS asset_id, asset_id % 50 = 7 AS is_corrupt, name, r6(offering_price_usd) AS price, offering_date FROM assets""")
def _(m):
    folder = IO.work_folder(m.spark, "csv")
    k = F.col("asset_id")
    rows = m.assets.select(F.when(k % 50 == 7, "n/a").otherwise(k.cast("string")).alias("asset_id"), "name", F.col("offering_price_usd").alias("price"), "offering_date")
    IO.write_tables({"assets": rows}, folder, "csv")
    out = IO.read_csv(m.spark, f"{folder}/assets", "asset_id BIGINT, name STRING, price DOUBLE, offering_date DATE")
    return out.select("asset_id", F.col(IO.CORRUPT).isNotNull().alias("is_corrupt"), "name", rnd("price").alias("price"), "offering_date")


@query("scan_parquet", "SELECT p_type AS category, count(*) AS n, min(p_size) AS smallest FROM part GROUP BY 1")
def _(m):
    return m.table("part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("smallest"))


@query("union_sources_keep_last", """
    WITH u AS (SELECT asset_id, observed_at AS date, price_per_share AS price, 0 AS src, s1, s2, s3 FROM observations WHERE event_type = 'chart_observation'
               UNION ALL SELECT asset_id, observed_at, price_per_share, 1, s1, s2, s3 FROM observations WHERE event_type <> 'chart_observation')
    SELECT asset_id, date, r6(price) AS price FROM u QUALIFY row_number() OVER (PARTITION BY asset_id, date ORDER BY src DESC, s1 DESC, s2 DESC, s3 DESC) = 1""")
def _(m):
    o = m.observations.select("asset_id", F.col("observed_at").alias("date"), F.col("price_per_share").alias("price"), "event_type", "s1", "s2", "s3")
    chart = F.col("event_type") == "chart_observation"
    both = IO.union_keep_last([o.filter(chart), o.filter(~chart)], ["asset_id", "date"], ["s1", "s2", "s3"])
    return both.select("asset_id", "date", rnd("price").alias("price"))


@query("load_manual_assets", """
    SELECT CAST(asset_id AS VARCHAR) AS asset_id, upper(ticker) AS ticker, name, category, share_count, r6(offering_price_usd) AS offering_price, r2(share_count * offering_price_usd) AS offering_valuation_usd FROM assets""")
def _(m):
    raw = m.assets.select(F.col("asset_id").cast("string").alias("asset_id"), "ticker", F.col("name").alias("asset_name"), "category", F.col("share_count").cast("string").alias("shares_outstanding"),
                          F.col("offering_price_usd").cast("string").alias("offering_price_per_share"))
    a = IO.conform(raw, {"asset_id": ("string", ["asset_id"]), "ticker": ("string", ["ticker"]), "name": ("string", ["name", "asset_name"]), "category": ("string", ["category"]),
                         "share_count": ("double", ["share_count", "shares_outstanding"]), "offering_price": ("double", ["offering_price_usd", "offering_price_per_share"])})
    return a.select("asset_id", F.upper("ticker").alias("ticker"), "name", "category", "share_count", rnd("offering_price").alias("offering_price"),
                    rnd(F.col("share_count") * F.col("offering_price"), 2).alias("offering_valuation_usd"))


@query("snapshots_to_quotes", """
    SELECT asset_id, observed_at AS date, r6(price_per_share) AS last, r8(bid) AS bid, r8(ask) AS ask, volume, 'snapshot' AS source FROM observations WHERE event_type = 'daily_close'""")
def _(m):
    o = m.observations.filter("event_type = 'daily_close'")
    return o.select("asset_id", F.col("observed_at").alias("date"), rnd("price_per_share").alias("last"), rnd("bid", 8).alias("bid"), rnd("ask", 8).alias("ask"), "volume",
                    F.lit("snapshot").alias("source"))


@query("secondary_price_view", """
    SELECT asset_id, s1, s2, s3, 'manual:' || event_type || ':' || precision_status AS source, r6(price_per_share) AS last FROM observations
    WHERE event_type IN ('executed_trade', 'daily_close', 'chart_observation') AND price_per_share > 0""")
def _(m):
    return IO.secondary_view(m.observations).select("asset_id", "s1", "s2", "s3", "source", rnd("price_per_share").alias("last"))


@query("quarterly_observation_view", """
    SELECT asset_id, s1, s2, s3, period_end, event_type, r6(price_per_share) AS last FROM observations WHERE price_per_share > 0 AND period_end IS NOT NULL""")
def _(m):
    return IO.quarterly_view(m.observations).select("asset_id", "s1", "s2", "s3", "period_end", "event_type", rnd("price_per_share").alias("last"))


@query("canonical_loaders", """
    SELECT a.asset_id, r2(offering_price_usd * share_count) AS offering_cap, count(o.asset_id) AS authored_rows, count(DISTINCT o.period_end) AS quarters
    FROM assets a LEFT JOIN observations o USING (asset_id) GROUP BY ALL""")
def _(m):
    per = m.observations.groupBy("asset_id", "period_end").agg(F.count(F.lit(1)).alias("n")).groupBy("asset_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("quarters"))
    return m.assets.join(per, "asset_id", "left").select(
        "asset_id", rnd(F.col("offering_price_usd") * F.col("share_count"), 2).alias("offering_cap"), F.coalesce("n", F.lit(0)).alias("authored_rows"),
        F.coalesce("quarters", F.lit(0)).alias("quarters"))


@query("conform_columns", """
    SELECT comp_id, category, sale_date AS date, r4(realized_price_usd) AS price_usd, CAST(year AS INT) AS year, CAST(NULL AS VARCHAR) AS lot_url, r4(exactness_score) AS exactness_score FROM comps""")
def _(m):
    c = IO.conform(m.comps, {"comp_id": ("string", ["comp_id"]), "category": ("string", ["category"]), "date": ("date", ["date", "sale_date"]),
                             "price_usd": ("double", ["price_usd", "realized_price_usd"]), "year": ("int", ["year"]), "lot_url": ("string", ["lot_url"]),
                             "exactness_score": ("double", ["exactness_score"])})
    return c.withColumns({"price_usd": rnd("price_usd", 4), "exactness_score": rnd("exactness_score", 4)})


@query("coerce_numeric_date", """
    SELECT asset_id AS seq, r6(CASE WHEN asset_id % 33 = 8 THEN -5 ELSE share_count END) AS shares, CASE WHEN asset_id % 70 <> 9 THEN offering_date END AS offering_date FROM assets""")
def _(m):
    r = raw_assets(m).filter("seq < 1000000000000")
    return r.select("seq", rnd(Q.number("shares_outstanding")).alias("shares"), Q.date("offering_date").alias("offering_date"))


@query("coalesce_first_nonblank", """
    SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN name WHEN asset_id % 3 = 1 THEN ticker ELSE category END AS label FROM assets""")
def _(m):
    k = F.col("asset_id")
    a = m.assets.withColumns({"x": F.when(k % 3 == 0, F.col("name")).otherwise("  "), "y": F.when(k % 3 == 1, F.col("ticker")).otherwise("nan")})
    return a.select("asset_id", first_nonblank("x", "y", "category").alias("label"))


@query("falsy_or", """
    SELECT asset_id, coalesce(nullif(CASE WHEN asset_id % 4 = 0 THEN 0 ELSE share_count END, 0), offering_price_usd) AS value FROM assets""")
def _(m):
    return m.assets.select("asset_id", falsy_or(F.when(F.col("asset_id") % 4 == 0, 0.0).otherwise(F.col("share_count")), "offering_price_usd").alias("value"))


# --- sinks --------------------------------------------------------------------------------

@query("sink_tables", """
    SELECT 'assets' AS table_name, count(*) AS rows FROM assets UNION ALL SELECT 'quotes', count(*) FROM d_quotes
    UNION ALL SELECT 'comps', count(*) FROM comps UNION ALL SELECT 'indexes', count(*) FROM qidx_series""")
def _(m):
    folder = IO.work_folder(m.spark, "tables")
    tables = {"assets": m.assets, "quotes": daily(m), "comps": m.comps, "indexes": family(m).series}
    IO.write_tables(tables, folder)
    counts = [m.spark.read.parquet(f"{folder}/{t}").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(t)) for t in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("sink_archive_checked", """
    SELECT year(date) AS year, count(*) AS rows, r4(sum(CASE WHEN date >= DATE '2001-01-01' THEN adjusted_close * 2 ELSE adjusted_close END)) AS total FROM benchmarks GROUP BY 1""")
def _(m):
    b = m.benchmarks.withColumn("year", F.year("date"))
    archive = Archive(m.spark, IO.work_folder(m.spark, "archive"), b.schema, "year", ["ticker", "date"])
    archive.publish(b)
    # a refresh replaces its own partition only
    archive.publish(b.filter("date >= DATE '2001-01-01'").withColumn("adjusted_close", F.col("adjusted_close") * 2))
    back = archive.read()
    return back.groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("rows"), rnd(F.sum("adjusted_close"), 4).alias("total"))


def context(m: Market) -> DataFrame:
    t = market_table(m).join(M.liquidity_metrics(m.assets, daily(m), AS_OF).select("asset_id", "stale_mark_flag", "turnover"), "asset_id", "left")
    warnings = F.array_compact(F.array(F.when(F.col("stale_mark_flag"), "stale_mark"), F.when(F.abs("premium_discount_to_fair_value") > 0.25, "premium_over_25_percent"),
                                       F.when(F.col("estimated_fair_value_usd").isNull(), "no_fair_value")))
    return t.withColumn("warnings", warnings)


CONTEXT_SQL = """
    WITH n AS (SELECT asset_id, sum(realized_price_usd * exactness_score) / sum(exactness_score) AS nav FROM comps GROUP BY 1), l AS (SELECT asset_id, arg_max(price, date) AS p FROM d_quotes GROUP BY 1),
    w AS (SELECT a.asset_id, list_filter([CASE WHEN stale_mark_flag THEN 'stale_mark' END, CASE WHEN abs(p * share_count / nav - 1) > .25 THEN 'premium_over_25_percent' END,
          CASE WHEN nav IS NULL THEN 'no_fair_value' END], lambda x: x IS NOT NULL) AS w FROM assets a LEFT JOIN n USING (asset_id) LEFT JOIN l USING (asset_id) LEFT JOIN liq USING (asset_id))"""


@query("research_context", CONTEXT_SQL + " SELECT asset_id, unnest(w) AS warning FROM w")
def _(m):
    return context(m).select("asset_id", F.explode("warnings").alias("warning"))


@query("sink_json_context", CONTEXT_SQL + " SELECT asset_id, array_to_string(w, '; ') AS warnings FROM w")
def _(m):
    folder = IO.work_folder(m.spark, "context")
    IO.write_json_lines(context(m).select("asset_id", "ticker", "warnings"), folder)
    back = m.spark.read.schema("asset_id BIGINT, ticker STRING, warnings ARRAY<STRING>").json(folder)
    return back.select("asset_id", F.array_join("warnings", "; ").alias("warnings"))


@query("sink_story_archive", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY ret, asset_id) AS lo, row_number() OVER (PARTITION BY period ORDER BY ret DESC, asset_id) AS hi FROM st_r)
    SELECT period, count(*) AS leads, r6(min(ret)) AS worst, r6(max(ret)) AS best FROM k WHERE lo <= 5 OR hi <= 5 GROUP BY period""")
def _(m):
    folder = IO.work_folder(m.spark, "stories")
    leads = staged(T.with_score(movers(m)))
    flat = leads.select("period", "story_id", "family", "kind", "subject_id", "content_score", F.col("metrics")["quarter_return"].alias("ret"))
    IO.write_tables({"flat": flat}, folder, "csv")
    IO.write_json_lines(leads, f"{folder}/evidence")
    back = m.spark.read.schema("period DATE, metrics MAP<STRING, DOUBLE>").json(f"{folder}/evidence")
    r = F.col("metrics")["quarter_return"]
    return back.groupBy("period").agg(F.count(F.lit(1)).alias("leads"), rnd(F.min(r)).alias("worst"), rnd(F.max(r)).alias("best"))


ENCODED = "CASE WHEN {0} IS NULL THEN 'N;' ELSE length(CAST({0} AS VARCHAR)) || ':' || {0} || ';' END"
CHECKSUM_SQL = "CAST(coalesce(sum(CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)), 0) AS DECIMAL(38,0))"


@query("run_ledger", f"""
    WITH b AS (SELECT *, asset_id AS seq, FALSE AS rep FROM assets UNION ALL SELECT *, asset_id + 1000000000000, asset_id % 50 <> 7 FROM assets WHERE asset_id % 40 = 3),
    r AS (SELECT asset_id % 50 = 7 OR rep OR asset_id % 47 = 5 OR asset_id % 53 = 6 OR asset_id % 41 = 9 OR asset_id % 60 = 5 OR asset_id % 45 = 4 OR asset_id % 33 = 8 OR asset_id % 70 = 9
          OR (status = 'exited' AND asset_id % 40 <> 0) AS bad, asset_id % 40 = 0 OR asset_id % 25 = 6 OR asset_id % 33 = 8 AS warned,
          seq, CASE WHEN asset_id % 50 = 7 THEN '  ' ELSE CAST(asset_id AS VARCHAR) END AS k, CASE WHEN asset_id % 60 = 5 THEN 'Bogus' ELSE status END AS state FROM b),
    one AS (SELECT 'all' AS what, * FROM r UNION ALL SELECT 'even', * FROM r WHERE seq % 2 = 0)
    SELECT what, count(*) AS input_rows, count(*) FILTER (NOT bad) AS accepted_rows, count(*) FILTER (bad) AS rejected_rows, count(*) FILTER (warned) AS warning_rows,
           {CHECKSUM_SQL.format(" || ".join(ENCODED.format(c) for c in ("seq", "k", "state")))} AS input_hash, 'completed_with_rejections' AS status
    FROM one GROUP BY what""")
def _(m):
    """Both imports run twice; the ledger keeps one row of each."""
    folder, raw = IO.work_folder(m.spark, "ledger"), raw_assets(m)
    verdicts = staged(Q.validate_assets(raw, "seq"))
    for what, rows in (("all", F.lit(True)), ("even", F.col("seq") % 2 == 0)) * 2:
        append_run(m.spark, folder, IO.ledger_row(verdicts.filter(rows), raw.filter(rows).select("seq", F.col("asset_id").alias("k"), F.col("status").alias("state")), what))
    return read_ledger(m.spark, folder).select(F.substring_index("run_id", "-", 1).alias("what"), "input_rows", "accepted_rows", "rejected_rows", "warning_rows", "input_hash", "status")


@query("source_fingerprint", f"""
    SELECT {CHECKSUM_SQL.format(" || ".join(ENCODED.format(c) for c in ("asset_id", "name", "category", "size", "color")))} AS checksum, count(*) AS rows
    FROM (SELECT asset_id, name, CASE WHEN asset_id % 5 = 0 THEN NULL WHEN asset_id % 5 = 1 THEN '' ELSE category END AS category, size, color FROM assets)""")
def _(m):
    k = F.col("asset_id")
    return IO.fingerprint(m.assets.select("asset_id", "name", F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("category")).alias("category"), "size", "color"))


@query("scatter_export", "SELECT asset_id, ticker, r6(p1) AS current_price, r6(years) AS history_years FROM scatter")
def _(m):
    folder = IO.work_folder(m.spark, "scatter")
    cols = scatter(m).select("asset_id", "ticker", rnd("current_price").alias("current_price"), rnd("history_years").alias("history_years"))
    IO.write_tables({"scatter": cols}, folder, "csv")
    return IO.read_csv(m.spark, f"{folder}/scatter", "asset_id BIGINT, ticker STRING, current_price DOUBLE, history_years DOUBLE").drop(IO.CORRUPT)
