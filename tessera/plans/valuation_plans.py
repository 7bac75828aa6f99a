"""Comparable-sale matching, NAV, research valuation and option queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import change, differs, falsy_or, first_nonblank, ratio, rnd, rule_names
from tessera.operators import options as O
from tessera.operators import valuation as V
from tessera.plans.index_plans import family
from tessera.plans.market_plans import rounded
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import AS_OF, daily, quarterly
from tessera.sources.documents import parse_research
from tessera.sources.market_views import Market

MODIFIERS = {"ECONOMY": 1.0, "SMALL": 1.02, "PROMO": 0.98, "LARGE": 0.97, "MEDIUM": 0.99, "STANDARD": 0.95}
MODIFIER_SQL = "CASE a.category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MODIFIERS.items()) + " ELSE 1.0 END"

shared_sql("sim_pairs", """
    WITH a AS (SELECT asset_id, lower(brand) AS brand, lower(model) AS model, CAST(size AS VARCHAR) AS size, lower(category) AS material, lower(color) AS color,
                      lower(hardware) AS hardware, year FROM assets),
    c AS (SELECT comp_id, realized_price_usd AS price, sale_date, lower(brand) AS brand, lower(model) AS model, CAST(size AS VARCHAR) AS size, lower(material) AS material,
                 lower(color) AS color, lower(hardware) AS hardware, year FROM comps)
    SELECT asset_id, comp_id, price, sale_date, round(CASE WHEN a.brand = c.brand THEN .25 ELSE 0 END + CASE WHEN a.model = c.model THEN .25 ELSE 0 END
           + CASE WHEN a.size = c.size THEN .15 ELSE 0 END + CASE WHEN a.material = c.material THEN .15 ELSE 0 END + CASE WHEN a.color = c.color THEN .08 ELSE 0 END
           + CASE WHEN a.hardware = c.hardware THEN .07 ELSE 0 END + CASE WHEN abs(a.year - c.year) <= 2 THEN .05 WHEN abs(a.year - c.year) <= 10
             THEN greatest(.01, .05 * (1 - abs(a.year - c.year) / 10.0)) ELSE 0 END, 4)::DOUBLE AS score FROM a CROSS JOIN c""")
shared_sql("sim", """
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, price DESC, comp_id) AS rank FROM sim_pairs WHERE score >= .20 - 1e-9
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, price DESC, comp_id) <= 20""")


def match_inputs(m: Market) -> tuple[DataFrame, DataFrame]:
    return m.assets.withColumn("material", F.col("category")), m.comps


def matches(m: Market) -> DataFrame:
    return V.similarity_join(*match_inputs(m))


@query("similarity_join", "SELECT asset_id, comp_id, rank, r4(score) AS similarity_score, r4(price) AS realized_price_usd, sale_date FROM sim")
def _(m):
    return matches(m).select("asset_id", "comp_id", "rank", rnd("similarity_score", 4).alias("similarity_score"),
                             rnd("realized_price_usd", 4).alias("realized_price_usd"), "sale_date")


@query("topk_per_group", """
    SELECT category, comp_id, r4(realized_price_usd) AS price, row_number() OVER (PARTITION BY category ORDER BY realized_price_usd DESC, comp_id) AS rank FROM comps
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY realized_price_usd DESC, comp_id) <= 20""")
def _(m):
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy(F.desc("realized_price_usd"), "comp_id")
    return m.comps.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 20").select(
        "category", "comp_id", rnd("realized_price_usd", 4).alias("price"), "rank")


@query("nav_recency_weighted", f"""
    WITH l AS (SELECT asset_id, arg_max(cap, date) AS cap FROM q_quotes WHERE cap IS NOT NULL GROUP BY 1),
    c AS (SELECT c.asset_id, sale_date, realized_price_usd * CASE condition WHEN 'excellent' THEN 1.02 ELSE .93 END * {MODIFIER_SQL} AS p,
                 greatest(.20, 1 / (1 + (DATE '2001-12-31' - sale_date) / 365)) * exactness_score * source_confidence AS w FROM comps c JOIN assets a USING (asset_id)),
    g AS (SELECT asset_id, count(*) AS n, sum(p * w) / sum(w) AS nav, stddev_pop(p) AS sd, avg(w) AS mw, max(sale_date) AS newest FROM c GROUP BY 1),
    d AS (SELECT *, CASE WHEN n > 1 THEN sd / nav ELSE .20 END AS disp FROM g)
    SELECT d.asset_id, n AS comp_count, r2(nav) AS estimated_nav_usd, r2(greatest(.01, nav * (1 - greatest(.08, disp)))) AS nav_low_usd, r2(nav * (1 + greatest(.08, disp))) AS nav_high_usd,
           r6(greatest(.05, least(.95, mw * (1 - least(disp, .8) / 2)))) AS nav_confidence, r6((cap - nav) / nav) AS premium_discount_pct,
           r6((nav - cap) / nav) AS discount_to_secondary_nav, DATE '2001-12-31' - newest > 180 AS is_stale FROM d LEFT JOIN l USING (asset_id)""")
def _(m):
    caps = quarterly(m).filter("cap IS NOT NULL").groupBy("asset_id").agg(F.max_by("cap", "date").alias("market_cap"))
    out = V.nav_recency_weighted(m.assets, m.comps, caps, AS_OF, MODIFIERS)
    return rounded(out, ("estimated_nav_usd", "nav_low_usd", "nav_high_usd"))


@query("weighted_mean", """
    SELECT category, r2(sum(realized_price_usd * exactness_score) / sum(exactness_score)) AS weighted_price FROM comps WHERE exactness_score > 0 GROUP BY 1""")
def _(m):
    w = F.when(F.col("exactness_score") > 0, F.col("exactness_score"))
    return m.comps.groupBy("category").agg(rnd(ratio(F.sum(F.col("realized_price_usd") * w), F.sum(w)), 2).alias("weighted_price"))


@query("weighted_quantile", """
    WITH v AS (SELECT category, realized_price_usd AS v, sum(exactness_score) AS w FROM comps GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY category ORDER BY v) / sum(w) OVER (PARTITION BY category) AS s FROM v)
    SELECT category, r4(min(v) FILTER (s >= .25 - 1e-12)) AS q25, r4(min(v) FILTER (s >= .5 - 1e-12)) AS q50, r4(min(v) FILTER (s >= .75 - 1e-12)) AS q75 FROM c GROUP BY 1""")
def _(m):
    return rounded(V.weighted_quantiles(m.comps, ["category"], "realized_price_usd", "exactness_score", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), digits=4)


shared_sql("navs", """
    WITH m AS (SELECT s.*, c.source_confidence AS conf, s.score * c.source_confidence * 1.1 AS w FROM sim s JOIN comps c USING (comp_id)),
    g AS (SELECT asset_id, count(*) AS n, sum(price * w) / sum(w) AS nav, median(price) AS med, quantile_cont(price, .25) AS q1, quantile_cont(price, .75) AS q3, min(price) AS lo, max(price) AS hi,
                 avg(score) AS sim, avg(conf) AS conf FROM m GROUP BY 1),
    mo AS (SELECT asset_id, d, CASE WHEN count(*) FILTER (late) >= 2 AND count(*) FILTER (NOT late) >= 2 THEN median(price) FILTER (late) / median(price) FILTER (NOT late) - 1 END AS mom
           FROM (SELECT m.*, d, sale_date >= DATE '2001-12-31' - d AS late FROM m, (VALUES (90), (180), (365)) v(d)) GROUP BY ALL),
    l AS (SELECT asset_id, arg_max(price, date) AS p, arg_max(bid, date) AS bid, arg_max(ask, date) AS ask FROM d_quotes GROUP BY 1),
    j AS (SELECT a.asset_id, a.ticker, coalesce(n, 0) AS n, nav, med, CASE WHEN n >= 4 THEN q1 ELSE lo END AS low, CASE WHEN n >= 4 THEN q3 ELSE hi END AS high,
                 CASE WHEN n > 0 THEN least(.95, sim * conf * least(1, n / 5)) ELSE 0 END AS nc, l.p * share_count / nav - 1 AS disc, l.p / offering_price_usd - 1 AS prem,
                 greatest(.1, least(.9, .65 - coalesce(nullif(CASE WHEN ask >= bid THEN (ask - bid) / ((ask + bid) / 2) END, 0), .20))) AS ls
          FROM assets a LEFT JOIN g USING (asset_id) LEFT JOIN l USING (asset_id))
    SELECT j.*, CASE WHEN n > 0 THEN greatest(0, least(100, greatest(0, -coalesce(disc, 0)) * 70 + nc * 25 + ls * 5 - greatest(0, coalesce(disc, 0)) * .25 * 30)) ELSE 0 END AS score,
           (SELECT mom FROM mo WHERE mo.asset_id = j.asset_id AND d = 90) AS m90, (SELECT mom FROM mo WHERE mo.asset_id = j.asset_id AND d = 180) AS m180,
           (SELECT mom FROM mo WHERE mo.asset_id = j.asset_id AND d = 365) AS m365 FROM j""")


def nav_inputs(m: Market) -> DataFrame:
    latest = daily(m).groupBy("asset_id").agg(F.max_by(F.struct("price", "bid", "ask"), "date").alias("l"))
    return m.assets.join(latest, "asset_id", "left").select(
        "asset_id", "ticker", (F.col("l.price") * F.col("share_count")).alias("current_market_cap_usd"),
        (F.col("offering_price_usd") * F.col("share_count")).alias("offering_market_cap_usd"), F.col("l.bid").alias("bid"), F.col("l.ask").alias("ask"))


def navs(m: Market) -> DataFrame:
    members, found = V.matched_profiles(*match_inputs(m), carry=("source_confidence", "estimate_low_usd", "estimate_high_usd"))
    return V.nav_similarity_weighted(nav_inputs(m).join(V.merged(members), "asset_id", "left"), found, AS_OF, "profile")


@query("nav_similarity_weighted", """
    SELECT asset_id, n AS comp_count, r2(nav) AS estimated_nav_usd, r4(med) AS median_comp_sale_usd, r4(low) AS nav_low_usd, r4(high) AS nav_high_usd, r8(nc) AS nav_confidence,
           r6(disc) AS discount, r6(prem) AS premium_to_offering, r6(ls) AS liquidity_score, r6(m90) AS momentum_90d, r6(m180) AS momentum_180d, r6(m365) AS momentum_365d,
           r6(score) AS mispricing_score FROM navs""")
def _(m):
    out = navs(m).select("asset_id", "comp_count", "estimated_nav_usd", "median_comp_sale_usd", "nav_low_usd", "nav_high_usd", "nav_confidence", "discount", "premium_to_offering",
                         "liquidity_score", "momentum_90d", "momentum_180d", "momentum_365d", "mispricing_score")
    four = ("median_comp_sale_usd", "nav_low_usd", "nav_high_usd")
    return rounded(out, ("estimated_nav_usd",), exact=(*four, "nav_confidence")).withColumns({c: rnd(c, 4) for c in four}).withColumn("nav_confidence", rnd("nav_confidence", 8))


@query("comp_momentum", """
    WITH c AS (SELECT category, realized_price_usd AS p, sale_date >= DATE '2001-12-31' - 365 AS late FROM comps)
    SELECT category, r6(median(p) FILTER (late) / median(p) FILTER (NOT late) - 1) AS momentum_365d FROM c GROUP BY 1
    HAVING count(*) FILTER (late) >= 2 AND count(*) FILTER (NOT late) >= 2""")
def _(m):
    c = m.comps.withColumn("late", F.col("sale_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365))
    med = V.comp_market_medians(c, ["category", "late"]).join(c.groupBy("category", "late").agg(F.count(F.lit(1)).alias("n")), ["category", "late"])
    wide = med.groupBy("category").agg(*[F.max(F.when(F.col("late") == x, F.col(y))).alias(z) for x, y, z in (
        (True, "median_price", "a"), (False, "median_price", "b"), (True, "n", "na"), (False, "n", "nb"))])
    return wide.filter("na >= 2 AND nb >= 2").select("category", rnd(change("a", "b")).alias("momentum_365d"))


@query("report_context", """
    SELECT asset_id, ticker, r6(score) AS mispricing_score, n AS comp_count FROM navs ORDER BY round(score, 6) DESC, asset_id LIMIT 20""")
def _(m):
    top = navs(m).withColumn("mispricing_score", rnd("mispricing_score")).orderBy(F.desc("mispricing_score"), "asset_id").limit(20)
    return top.select("asset_id", "ticker", "mispricing_score", "comp_count")


# --- imports ------------------------------------------------------------------------------

@query("exactness_scores", """
    SELECT comp_id, r4(least(1, .35 + .15 + .20 + .10 + CASE WHEN size % 7 <> 0 THEN .08 ELSE 0 END + .07 + CASE WHEN year % 2 = 0 THEN .03 ELSE 0 END)) AS handbag_exactness,
           r4(least(1, .35 + .12 + .08 + .07 + CASE WHEN size % 7 <> 0 THEN .25 ELSE 0 END)) AS watch_exactness FROM comps""")
def _(m):
    c = m.comps.withColumns({"material": F.when(F.col("size") % 7 != 0, F.col("material")).otherwise(" "), "color": F.when(F.col("year") % 2 == 0, F.col("color")),
                             "reference": F.when(F.col("size") % 7 != 0, F.col("model")).otherwise("nan")})
    return c.select("comp_id", rnd(V.exactness(c.drop("reference"), V.HANDBAG_EXACTNESS), 4).alias("handbag_exactness"),
                    rnd(V.exactness(c, V.WATCH_EXACTNESS), 4).alias("watch_exactness"))


def raw_sales(m: Market) -> DataFrame:
    """Imported rows with gaps: some lack a price or a link."""
    return m.comps.select("comp_id", "brand", "model", F.col("size").cast("string").alias("size"), "material", "color", "condition", "sale_date", "source_confidence",
                          F.when(F.col("size") % 11 != 0, F.col("realized_price_usd")).alias("price_usd"),
                          F.when(F.col("year") != 1996, F.concat(F.lit("https://sales.example/"), "comp_id")).alias("source_url"),
                          F.when(F.col("hardware") == "A", "sold").otherwise("listed").alias("status"))


def _import_sql(cap: str, kind: str) -> str:
    return f"""
    SELECT comp_id, r4(CASE WHEN size % 11 <> 0 THEN realized_price_usd END) AS price, r4(least(source_confidence, {cap})) AS confidence, {kind} AS price_type,
           r4(least(1, .35 + .15 + .20 + .10 + .08 + .07 + .03)) AS exactness, array_to_string(list_filter([CASE WHEN size % 11 = 0 THEN 'missing_price' END,
           CASE WHEN year = 1996 THEN 'missing_source_url' END], lambda x: x IS NOT NULL), '; ') AS rejection_reasons FROM comps"""


def _imported(df: DataFrame) -> DataFrame:
    return df.select("comp_id", rnd("price", 4).alias("price"), rnd("confidence", 4).alias("confidence"), "price_type", rnd("exactness", 4).alias("exactness"), "rejection_reasons")


@query("normalize_auction_results", _import_sql("0.90", "'realized_with_premium'"))
def _(m):
    return _imported(V.normalize_sales(raw_sales(m), "Auction", F.lit(0.90), V.HANDBAG_EXACTNESS, F.lit("realized_with_premium")))


@query("normalize_listings", _import_sql("CASE WHEN hardware = 'A' THEN .75 ELSE .65 END", "CASE WHEN hardware = 'A' THEN 'realized_with_premium' ELSE 'ask' END"))
def _(m):
    sold = F.lower("status").isin("sold", "closed", "sale")
    return _imported(V.normalize_sales(raw_sales(m), "Listing", F.when(sold, 0.75).otherwise(0.65), V.HANDBAG_EXACTNESS,
                                       F.when(sold, "realized_with_premium").otherwise("ask")))


@query("normalize_category_comps", _import_sql("1.0", "'realized_with_premium'"))
def _(m):
    return _imported(V.normalize_sales(raw_sales(m), "user_import", F.lit(1.0), V.HANDBAG_EXACTNESS, F.lit("realized_with_premium")))


@query("normalize_market_index", """
    SELECT brand, sale_date AS date, 'watches' AS category, 'median_sale' AS metric_name, r4(median(realized_price_usd)) AS metric_value, 0.75::DOUBLE AS source_confidence
    FROM comps GROUP BY brand, sale_date""")
def _(m):
    # one value per brand and day: the list behind each median is a day's sales of one brand
    return V.comp_market_medians(m.comps, ["brand", "sale_date"]).select(
        "brand", F.col("sale_date").alias("date"), F.lit("watches").alias("category"), F.lit("median_sale").alias("metric_name"),
        rnd("median_price", 4).alias("metric_value"), F.lit(0.75).alias("source_confidence"))


@query("union_category_imports", """
    SELECT 'Auction' AS source, count(*) AS rows, count(*) FILTER (size % 11 = 0 OR year = 1996) AS rejected FROM comps WHERE hardware = 'A'
    UNION ALL SELECT 'Listing', count(*), count(*) FILTER (size % 11 = 0 OR year = 1996) FROM comps WHERE hardware = 'N'
    UNION ALL SELECT 'user_import', count(*), count(*) FILTER (size % 11 = 0 OR year = 1996) FROM comps WHERE hardware = 'R'""")
def _(m):
    raw = raw_sales(m).join(m.comps.select("comp_id", "hardware"), "comp_id")
    kinds = (("Auction", "A"), ("Listing", "N"), ("user_import", "R"))
    parts = [V.normalize_sales(raw.filter(F.col("hardware") == h), s, F.lit(0.9), V.HANDBAG_EXACTNESS, F.lit("realized")) for s, h in kinds]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rejection_reasons") != "").alias("rejected"))


@query("comp_field_fallbacks", """
    SELECT comp_id, r4(CASE WHEN size % 3 = 0 THEN realized_price_usd ELSE estimate_low_usd END) AS price,
           CASE WHEN size % 3 = 0 THEN 'watches' WHEN size % 3 = 1 THEN 'handbags' ELSE 'other' END AS category FROM comps""")
def _(m):
    c = m.comps.withColumns({"realized": F.when(F.col("size") % 3 == 0, F.col("realized_price_usd")),
                             "title": F.concat_ws(" ", F.when(F.col("size") % 3 == 0, "Rolex Daytona").when(F.col("size") % 3 == 1, "Hermès Birkin").otherwise("signed jersey"), "brand")})
    return c.select("comp_id", rnd(F.coalesce("realized", "estimate_low_usd"), 4).alias("price"), V.text_category(F.col("title")).alias("category"))


@query("comparable_universe", """
    SELECT comp_id, brand, model, CAST(size AS VARCHAR) AS size, material, color, hardware, CAST(year AS INT) AS year, r4(realized_price_usd) AS realized_price_usd,
           r4(greatest(0, least(1, exactness_score))) AS confidence_score FROM comps""")
def _(m):
    c = m.comps
    return c.select("comp_id", first_nonblank("brand").alias("brand"), first_nonblank("model").alias("model"), F.col("size").cast("string").alias("size"), "material",
                    "color", "hardware", "year", rnd("realized_price_usd", 4).alias("realized_price_usd"), rnd(falsy_or("exactness_score", F.lit(0.5)), 4).alias("confidence_score"))


@query("source_coverage_rollups", """
    SELECT category, condition, hardware, count(*) AS sales, count(CASE WHEN size % 11 <> 0 THEN 1 END) AS priced, r2(avg(realized_price_usd)) AS mean_price FROM comps GROUP BY ALL""")
def _(m):
    return m.comps.groupBy("category", "condition", "hardware").agg(F.count(F.lit(1)).alias("sales"), F.count_if(F.col("size") % 11 != 0).alias("priced"),
                                                                  rnd(F.avg("realized_price_usd"), 2).alias("mean_price"))


@query("model_comparison", """
    WITH w AS (SELECT model, realized_price_usd AS p, sale_date, greatest(.2, 1 / (1 + (DATE '2001-12-31' - sale_date) / 365)) * exactness_score * source_confidence
                      * CASE WHEN size = 35 THEN 1.15 ELSE 1 END AS w FROM comps),
    g AS (SELECT model, count(*) AS n, sum(p * w) / sum(w) AS nav, stddev_pop(p) / (sum(p * w) / sum(w)) AS disp, avg(w) AS mw, max(sale_date) AS newest FROM w GROUP BY 1),
    a AS (SELECT model, count(*) AS assets FROM assets GROUP BY 1)
    SELECT model, assets, n AS comp_count, r2(nav) AS secondary_nav_usd, r2(nav * (1 - greatest(.10, least(CASE WHEN n > 1 THEN disp ELSE .25 END, .60)))) AS nav_low_usd,
           r2(nav * (1 + greatest(.10, least(CASE WHEN n > 1 THEN disp ELSE .25 END, .60)))) AS nav_high_usd, r6(least(.90, greatest(.05, mw * least(1, n / 5)))) AS nav_confidence,
           newest AS newest_comp_date FROM g JOIN a USING (model)""")
def _(m):
    day = F.lit(AS_OF).cast("date")
    w = V.recency_weight(F.datediff(day, "sale_date")) * F.col("exactness_score") * F.col("source_confidence") * F.when(F.col("size") == 35, 1.15).otherwise(1.0)
    p = F.col("realized_price_usd")
    g = m.comps.groupBy("model").agg(F.count(F.lit(1)).alias("comp_count"), (F.sum(p * w) / F.sum(w)).alias("nav"), F.stddev_pop(p).alias("sd"), F.avg(w).alias("mw"),
                                     F.max("sale_date").alias("newest_comp_date"))
    band = F.greatest(F.lit(0.10), F.least(F.when(F.col("comp_count") > 1, F.col("sd") / F.col("nav")).otherwise(0.25), F.lit(0.60)))
    owned = m.assets.groupBy("model").agg(F.count(F.lit(1)).alias("assets"))
    return g.join(owned, "model").select(
        "model", "assets", "comp_count", rnd("nav", 2).alias("secondary_nav_usd"), rnd(F.col("nav") * (1 - band), 2).alias("nav_low_usd"),
        rnd(F.col("nav") * (1 + band), 2).alias("nav_high_usd"),
        rnd(F.least(F.lit(0.90), F.greatest(F.lit(0.05), F.col("mw") * F.least(F.lit(1.0), F.col("comp_count") / 5)))).alias("nav_confidence"), "newest_comp_date")


# --- research documents -------------------------------------------------------------------

def research_documents(m: Market) -> DataFrame:
    """Landed research files, one per asset and sale day, as JSON text."""
    size, year = F.col("size"), F.col("year")
    comp = F.struct(
        F.col("comp_id").alias("comparable_id"), F.concat_ws(" ", "color", "model").alias("title"), F.col("sale_date").cast("string").alias("sale_date"),
        F.when(size % 10 == 0, "unsold").otherwise("sold").alias("sale_status"),
        F.when(year == 1995, "JPY").when(F.col("hardware") == "N", "EUR").when(F.col("hardware") == "R", "GBP").otherwise("USD").alias("currency"),
        F.col("realized_price_usd").alias("reported_price"), F.when((F.col("hardware") == "R") & (year != 1995), 1.3).alias("fx_rate_to_usd"),
        F.struct(F.when(size % 4 == 0, F.col("exactness_score")).alias("identity_similarity"), F.when(size % 4 == 0, F.col("source_confidence")).alias("condition_similarity"))
        .alias("similarity_scores"),
        F.when(size % 4 == 1, F.col("exactness_score") - (year % 3) * 0.3).alias("overall_similarity"),
        F.when(size % 3 != 0, F.col("source_confidence")).alias("evidence_quality"), (F.col("condition") == "excellent").alias("verified"))
    rows = m.comps.groupBy("asset_id", "sale_date").agg(F.collect_list(comp).alias("comparable_sales"))
    return rows.select(F.to_json(F.struct(F.col("asset_id"), F.col("sale_date").cast("string").alias("research_date"), "comparable_sales")).alias("document"))


def research_comps(m: Market) -> DataFrame:
    return parse_research(research_documents(m))


shared_sql("research", """
    WITH c AS (SELECT asset_id, comp_id, sale_date, size, year, condition = 'excellent' AS verified, CASE WHEN size % 10 = 0 THEN 'unsold' ELSE 'sold' END AS status,
           CASE WHEN year = 1995 THEN NULL WHEN hardware = 'N' THEN realized_price_usd * 1.09 WHEN hardware = 'R' THEN realized_price_usd * 1.3 ELSE realized_price_usd END AS usd,
           CASE size % 4 WHEN 0 THEN (exactness_score * .35 + source_confidence * .25) / .60 WHEN 1 THEN exactness_score - (year % 3) * .3 ELSE .5 END AS sim,
           CASE WHEN size % 3 <> 0 THEN source_confidence END AS eq FROM comps)
    SELECT *, status = 'sold' AND usd IS NOT NULL AND sim >= .35 AND (eq IS NULL OR eq >= .30) AS included,
           sim * coalesce(eq, .5) * greatest(.25, 1 - least((DATE '2001-12-31' - sale_date) / 365.25 / 5, 1)) * CASE WHEN verified THEN 1 ELSE .65 END AS w0 FROM c""")


@query("scan_research_json", """
    SELECT asset_id, comp_id AS comparable_id, sale_date, status AS sale_status, verified, r6(eq) AS evidence_quality FROM research""")
def _(m):
    return research_comps(m).select("asset_id", "comparable_id", "sale_date", "sale_status", "verified", rnd("evidence_quality").alias("evidence_quality"))


@query("research_evidence", """
    SELECT comp_id AS comparable_id, r4(usd) AS usd_price, r6(sim) AS similarity, included, r8(CASE WHEN included THEN w0 ELSE 0 END) AS weight,
           array_to_string(list_filter([CASE WHEN status <> 'sold' THEN 'not_sold' END, CASE WHEN usd IS NULL THEN 'missing_usd_normalized_price' END,
           CASE WHEN sim < .35 THEN 'low_similarity' END, CASE WHEN eq < .30 THEN 'low_evidence_quality' END], lambda x: x IS NOT NULL), '|') AS reasons FROM research""")
def _(m):
    e = V.research_evidence(research_comps(m), AS_OF)
    return e.select("comparable_id", rnd("usd_price", 4).alias("usd_price"), rnd("similarity").alias("similarity"), "included", rnd("weight", 8).alias("weight"),
                    F.array_join("reasons", "|").alias("reasons"))


def valuation_factors(m: Market) -> DataFrame:
    seen = quarterly(m).select("asset_id").distinct().withColumn("_h", F.lit(True))
    return m.assets.select("asset_id", (F.col("asset_id") % 4 != 0).alias("has_condition")).join(seen, "asset_id", "left").select(
        "asset_id", "has_condition", F.coalesce("_h", F.lit(False)).alias("has_history"))


shared_sql("valued", """
    WITH v AS (SELECT asset_id, usd AS v, sum(w0) AS w FROM research WHERE included AND w0 > 0 GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY asset_id ORDER BY v) / sum(w) OVER (PARTITION BY asset_id) AS s FROM v),
    q AS (SELECT asset_id, min(v) FILTER (s >= .25 - 1e-12) AS cons, min(v) FILTER (s >= .5 - 1e-12) AS base, min(v) FILTER (s >= .75 - 1e-12) AS opt FROM c GROUP BY 1),
    g AS (SELECT asset_id, count(*) AS raw, count(*) FILTER (included) AS n, avg(CASE WHEN verified THEN 0.0 ELSE 1 END) AS unv, sum(usd * w0) FILTER (included) / sum(w0) FILTER (included) AS wm,
                 max(usd) FILTER (included) AS hi, min(usd) FILTER (included) AS lo FROM research GROUP BY 1)
    SELECT g.*, cons, base, opt, (hi - lo) / base AS disp, g.asset_id % 4 <> 0 AS cond, g.asset_id IN (SELECT asset_id FROM q_quotes) AS hist FROM g LEFT JOIN q USING (asset_id)""")


def valued(m: Market) -> DataFrame:
    return V.research_valuation(V.research_evidence(research_comps(m), AS_OF), valuation_factors(m))


@query("research_valuation", """
    SELECT asset_id, raw AS raw_count, n AS eligible_count, CASE WHEN n < 2 THEN 'insufficient_evidence' WHEN NOT cond THEN 'completed_with_limitations' ELSE 'completed' END AS valuation_status,
           r4(CASE WHEN n >= 2 THEN cons END) AS conservative_value_usd, r4(CASE WHEN n >= 2 THEN base END) AS base_value_usd, r4(CASE WHEN n >= 2 THEN opt END) AS optimistic_value_usd,
           r4(wm) AS weighted_comparable_value_usd, r6(disp) AS dispersion_pct, r6(greatest(0, least(1, CASE WHEN n > 0 THEN .75 ELSE 0 END - CASE WHEN n = 1 THEN .35 ELSE 0 END
           - CASE WHEN unv > .5 THEN .15 ELSE 0 END - CASE WHEN disp > .75 THEN .2 ELSE 0 END - CASE WHEN NOT cond THEN .1 ELSE 0 END - CASE WHEN NOT hist THEN .1 ELSE 0 END))) AS confidence_score FROM valued""")
def _(m):
    four = ("conservative_value_usd", "base_value_usd", "optimistic_value_usd", "weighted_comparable_value_usd")
    return rounded(valued(m).drop("last_sale_date"), exact=four).withColumns({c: rnd(c, 4) for c in four})


@query("dated_valuations", """
    SELECT asset_id, max(sale_date) AS effective_date, 'valuation_date' AS date_source FROM research GROUP BY 1
    HAVING count(*) FILTER (included) >= 2 AND asset_id % 5 <> 0
    UNION ALL SELECT asset_id, max(sale_date) + 30, 'manifest_file_timestamp' FROM research GROUP BY 1 HAVING count(*) FILTER (included) >= 2 AND asset_id % 5 = 0""")
def _(m):
    e = V.research_evidence(research_comps(m), AS_OF)
    files = e.groupBy("asset_id").agg(F.max("sale_date").alias("last"), F.count_if("included").alias("n")).filter(F.col("n") >= V.MIN_COMPS)
    dated = files.withColumns({"valuation_date": F.when(F.col("asset_id") % 5 != 0, F.col("last")), "manifest_date": F.date_add("last", 30)})
    return dated.select("asset_id", F.coalesce("valuation_date", "manifest_date").alias("effective_date"),
                        F.when(F.col("valuation_date").isNotNull(), "valuation_date").otherwise("manifest_file_timestamp").alias("date_source"))


@query("asset_financial_context", """
    WITH q AS (SELECT asset_id, max(date) AS last_trade_date, arg_max(price, date) AS p, count(*) AS n FROM q_quotes GROUP BY 1)
    SELECT a.asset_id, a.ticker, r6(q.p) AS latest_share_price_usd, last_trade_date, coalesce(n, 0) AS quarters, r2(offering_price_usd * share_count) AS initial_offering_value_usd,
           CASE WHEN n IS NULL THEN 'missing_historical_price_data' ELSE '' END AS warnings FROM assets a LEFT JOIN q USING (asset_id)""")
def _(m):
    # one array entry per quarter: bounded by the calendar
    hist = quarterly(m).groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("date", "price", "cap"))).alias("quarterly_price_history"))
    j = m.assets.join(hist, "asset_id", "left")
    last = F.try_element_at("quarterly_price_history", F.lit(-1))
    warn = rule_names({"missing_share_count": F.col("share_count").isNull(), "missing_launch_date": F.col("offering_date").isNull(),
                       "missing_historical_price_data": F.col("quarterly_price_history").isNull()})
    return j.select("asset_id", "ticker", rnd(last["price"]).alias("latest_share_price_usd"), last["date"].alias("last_trade_date"),
                    F.when(F.col("quarterly_price_history").isNull(), 0).otherwise(F.size("quarterly_price_history")).cast("bigint").alias("quarters"),
                    rnd(F.col("offering_price_usd") * F.col("share_count"), 2).alias("initial_offering_value_usd"), F.array_join(warn, "; ").alias("warnings"))


@query("factor_merge", """
    WITH m AS (SELECT asset_id, category AS c_category, CASE WHEN asset_id % 6 = 0 THEN lower(category) WHEN asset_id % 6 = 1 THEN 'other' ELSE category END AS m_category,
                      CAST(size AS VARCHAR) AS c_size, CASE WHEN asset_id % 9 = 0 THEN CAST(size + 1 AS VARCHAR) END AS m_size FROM assets),
    u AS (SELECT asset_id, 'category' AS field, c_category AS canonical, m_category AS manual FROM m UNION ALL SELECT asset_id, 'size', c_size, m_size FROM m)
    SELECT *, CASE WHEN manual IS NULL THEN 'canonical_only' WHEN lower(manual) <> lower(canonical) THEN 'canonical_value_retained' ELSE 'agreed' END AS resolution FROM u""")
def _(m):
    k = F.col("asset_id")
    canonical = m.assets.select("asset_id", "category", F.col("size").cast("string").alias("size")).unpivot("asset_id", ["category", "size"], "field", "canonical")
    manual = m.assets.select("asset_id", F.when(k % 6 == 0, F.lower("category")).when(k % 6 == 1, "other").otherwise(F.col("category")).alias("category"),
                             F.when(k % 9 == 0, (F.col("size") + 1).cast("string")).alias("size")).unpivot("asset_id", ["category", "size"], "field", "manual")
    j = canonical.join(manual, ["asset_id", "field"])
    return j.withColumn("resolution", F.when(F.col("manual").isNull(), "canonical_only").when(
        differs(F.lower(F.trim("manual")), F.lower(F.trim("canonical"))), "canonical_value_retained").otherwise("agreed"))


@query("identity_alignment", """
    SELECT asset_id, CASE WHEN asset_id % 8 = 0 THEN '#X' || asset_id ELSE ticker END AS document_id, CASE WHEN asset_id % 8 = 0 THEN 'identity_conflict' ELSE 'aligned' END AS state FROM assets""")
def _(m):
    doc = F.when(F.col("asset_id") % 8 == 0, F.concat(F.lit("#X"), F.col("asset_id").cast("string"))).otherwise(F.col("ticker"))
    d = m.assets.select("asset_id", doc.alias("document_id"))
    j = d.join(m.assets.select("asset_id", "ticker"), "asset_id")
    return j.select("asset_id", "document_id", F.when(F.upper("document_id") == F.upper("ticker"), "aligned").otherwise("identity_conflict").alias("state"))


@query("workflow_inventory", """
    WITH r AS (SELECT asset_id, count(*) AS n FROM research GROUP BY 1)
    SELECT a.asset_id, CASE WHEN n IS NOT NULL AND a.asset_id % 7 = 0 THEN 'report_ready' WHEN n IS NOT NULL AND a.asset_id % 3 = 0 THEN 'valuation_ready' WHEN n IS NOT NULL THEN 'research_ready'
           WHEN a.asset_id % 2 = 0 THEN 'factors_ready' ELSE 'intake_missing' END AS status FROM assets a LEFT JOIN r USING (asset_id)""")
def _(m):
    k = F.col("asset_id")
    researched = research_comps(m).select("asset_id").distinct().select("asset_id", F.lit("research").alias("kind"))
    listing = researched.union(researched.select("asset_id", F.lit("factors"))).union(
        researched.filter(k % 3 == 0).select("asset_id", F.lit("valuation"))).union(researched.filter(k % 7 == 0).select("asset_id", F.lit("report"))).union(
        m.assets.filter(k % 2 == 0).select("asset_id", F.lit("factors")))
    have = listing.groupBy("asset_id").agg(*[F.max(F.col("kind") == x).alias(x) for x in ("factors", "research", "valuation", "report")])
    j = m.assets.select("asset_id").join(have, "asset_id", "left")
    state = (F.when(F.col("report"), "report_ready").when(F.col("valuation"), "valuation_ready").when(F.col("factors") & F.col("research"), "research_ready")
             .when(F.col("factors"), "factors_ready").otherwise("intake_missing"))
    return j.select("asset_id", state.alias("status"))


# --- options ------------------------------------------------------------------------------

shared_sql("ul_series", """
    SELECT 'asset:' || asset_id AS subject_id, date, price AS value FROM q_quotes
    UNION ALL SELECT 'index:' || family || ':' || weighting, date, index_level FROM qidx_series""")
shared_sql("ul", """
    SELECT subject_id, count(*) AS prices, arg_max(value, date) AS spot, max(date) AS latest FROM ul_series GROUP BY 1""")
shared_sql("hv", """
    WITH r AS (SELECT *, ln(value / lag(value) OVER w) AS r, date - lag(date) OVER w AS gap FROM ul_series WINDOW w AS (PARTITION BY subject_id ORDER BY date)),
    a AS (SELECT subject_id, count(*) AS n, count(r) AS k, stddev_samp(r) AS sd, median(gap) AS mg, stddev_samp(gap) AS gs FROM r GROUP BY 1)
    SELECT *, 365.25 / mg AS factor, CASE WHEN k >= 3 THEN sd * sqrt(365.25 / mg) END AS vol FROM a""")


def option_series(m: Market) -> DataFrame:
    a = quarterly(m).select(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("subject_id"), "date", F.col("price").alias("value"))
    i = family(m).series.select(F.concat_ws(":", F.lit("index"), "family", "weighting").alias("subject_id"), "date", F.col("index_level").alias("value"))
    return a.unionByName(i)


def priced_underlyings(m: Market) -> DataFrame:
    s = option_series(m)
    vol = O.historical_volatility(s).filter("annualized_volatility > 0").select("subject_id", F.col("annualized_volatility").alias("volatility"))
    return O.underlyings(s).filter("eligible").select("subject_id", "spot", "latest", "prices").join(vol, "subject_id")


@query("historical_volatility", """
    SELECT subject_id, n AS observations, k AS returns, r6(sd) AS periodic_volatility, r6(factor) AS annualization_factor, r6(vol) AS annualized_volatility,
           CASE WHEN k < 3 THEN 'too_few_returns' WHEN k < 8 THEN 'unstable_estimate' END AS warning FROM hv""")
def _(m):
    return rounded(O.historical_volatility(option_series(m)).select("subject_id", "observations", "returns", "periodic_volatility", "annualization_factor",
                                                                    "annualized_volatility", "warning"))


@query("discover_underlyings", "SELECT subject_id, prices, r6(spot) AS spot, latest FROM ul WHERE prices >= 4")
def _(m):
    return O.underlyings(option_series(m)).filter("eligible").select("subject_id", "prices", rnd("spot").alias("spot"), "latest")


@query("underlying_availability", """
    SELECT 'asset:' || a.asset_id AS subject_id, coalesce(prices, 0) AS prices, CASE WHEN prices IS NULL THEN 'missing canonical price series' WHEN prices < 16
           THEN 'fewer than 16 valid observations' ELSE 'eligible' END AS reason FROM assets a LEFT JOIN ul ON ul.subject_id = 'asset:' || a.asset_id""")
def _(m):
    u = O.underlyings(option_series(m), 16)
    a = m.assets.select(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("subject_id"))
    j = a.join(u, "subject_id", "left")
    return j.select("subject_id", F.coalesce("prices", F.lit(0)).alias("prices"), F.when(F.col("prices").isNull(), "missing canonical price series").otherwise(
        F.coalesce("reason", F.lit("eligible"))).alias("reason"))


MONEYNESS, DAYS, RATE, YIELD = [0.8, 1.0, 1.25], [90, 365], 0.04, 0.01
# an independent normal integral: the alternating-free series around zero, saturated in the far tails
CDF_SQL = """CASE WHEN {x} > 7 THEN 1.0 WHEN {x} < -7 THEN 0.0 ELSE 0.5 + exp(-({x}) * ({x}) / 2) / 2.5066282746310002
    * list_sum(list_transform(range(0, 120), lambda k: sign({x}) * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END"""
shared_sql("og", f"""
    WITH g AS (SELECT u.subject_id, u.spot, hv.vol AS v, mo.k0 AS moneyness, da.days, spot * mo.k0 AS strike, da.days / 365.0 AS t FROM ul u JOIN hv USING (subject_id),
               (VALUES {", ".join(f"({x}::DOUBLE)" for x in MONEYNESS)}) mo(k0), (VALUES {", ".join(f"({x})" for x in DAYS)}) da(days) WHERE u.prices >= 4 AND hv.vol > 0),
    d AS (SELECT *, (ln(spot / strike) + ({RATE} - {YIELD} + .5 * v * v) * t) / (v * sqrt(t)) AS d1 FROM g),
    e AS (SELECT *, d1 - v * sqrt(t) AS d2, spot * exp(-{YIELD} * t) AS ds, strike * exp(-{RATE} * t) AS dk, exp(-d1 * d1 / 2) / 2.5066282746310002 AS dens FROM d)
    SELECT *, {CDF_SQL.format(x="d1")} AS n1, {CDF_SQL.format(x="d2")} AS n2 FROM e""")


@query("option_grid", f"""
    WITH o AS (SELECT *, 'call' AS option_type, ds * n1 - dk * n2 AS price, exp(-{YIELD} * t) * n1 AS delta, (-ds * dens * v / (2 * sqrt(t)) - {RATE} * dk * n2 + {YIELD} * ds * n1) / 365 AS theta,
                      strike * t * exp(-{RATE} * t) * n2 / 100 AS rho FROM og
               UNION ALL SELECT *, 'put', dk * (1 - n2) - ds * (1 - n1), exp(-{YIELD} * t) * (n1 - 1), (-ds * dens * v / (2 * sqrt(t)) + {RATE} * dk * (1 - n2) - {YIELD} * ds * (1 - n1)) / 365,
                      -strike * t * exp(-{RATE} * t) * (1 - n2) / 100 FROM og)
    SELECT subject_id, moneyness, days, option_type, r6(price) AS price, r6(delta) AS delta, r8(exp(-{YIELD} * t) * dens / (spot * v * sqrt(t))) AS gamma, r6(ds * dens * sqrt(t) / 100) AS vega,
           r6(theta) AS theta, r6(rho) AS rho FROM o""")
def _(m):
    g = O.option_grid(priced_underlyings(m), MONEYNESS, DAYS, RATE, YIELD)
    return g.select("subject_id", "moneyness", "days", "option_type", *[rnd(c).alias(c) for c in ("price", "delta")], rnd("gamma", 8).alias("gamma"),
                    *[rnd(c).alias(c) for c in ("vega", "theta", "rho")])


@query("itm_probability", """
    SELECT subject_id, moneyness, days, r6(n2) AS call_itm, r6(1 - n2) AS put_itm FROM og""")
def _(m):
    g = O.option_grid(priced_underlyings(m), MONEYNESS, DAYS, RATE, YIELD)
    return g.groupBy("subject_id", "moneyness", "days").agg(
        rnd(F.max(F.when(F.col("option_type") == "call", F.col("itm_probability")))).alias("call_itm"),
        rnd(F.max(F.when(F.col("option_type") == "put", F.col("itm_probability")))).alias("put_itm"))


@query("strategy_payoff_grid", """
    WITH b AS (SELECT subject_id, spot, spot * 1.1 AS k, spot * .08 AS p FROM ul WHERE prices >= 4),
    s AS (SELECT b.*, unnest(['long_call', 'long_put', 'covered_call', 'protective_put']) AS strategy FROM b)
    SELECT subject_id, strategy, r6(CASE strategy WHEN 'long_call' THEN k + p WHEN 'long_put' THEN k - p WHEN 'covered_call' THEN spot - p ELSE spot + p END) AS breakeven,
           r4(10 * CASE strategy WHEN 'long_put' THEN greatest(k - p, 0) WHEN 'covered_call' THEN k - spot + p END) AS maximum_profit,
           r4(10 * CASE strategy WHEN 'covered_call' THEN greatest(spot - p, 0) WHEN 'protective_put' THEN greatest(spot + p - k, 0) ELSE p END) AS maximum_loss,
           r4(10 * CASE strategy WHEN 'long_call' THEN greatest(spot * 1.5 - k, 0) - p WHEN 'long_put' THEN greatest(k - spot * 1.5, 0) - p
              WHEN 'covered_call' THEN spot * 1.5 - spot + p - greatest(spot * 1.5 - k, 0) ELSE spot * 1.5 - spot - p + greatest(k - spot * 1.5, 0) END) AS profit_150 FROM s""")
def _(m):
    u = O.underlyings(option_series(m)).filter("eligible").withColumns({"strike": F.col("spot") * 1.1, "premium": F.col("spot") * 0.08})
    return O.strategy_grid(u).select("subject_id", "strategy", rnd("breakeven").alias("breakeven"), *[rnd(c, 4).alias(c) for c in ("maximum_profit", "maximum_loss", "profit_150")])


@query("contract_capacity", """
    SELECT asset_id, CAST(floor(share_count / 10) AS BIGINT) AS maximum_contracts, r6(100 * 10 * 5 / share_count) AS utilization_pct,
           CAST(greatest(floor(share_count / 10) - 5, 0) AS BIGINT) AS remaining_contracts FROM assets""")
def _(m):
    cap = O.contract_capacity(F.col("share_count"), 10.0, 5)
    return m.assets.select("asset_id", cap["maximum_contracts"].cast("bigint").alias("maximum_contracts"), rnd(cap["utilization_pct"]).alias("utilization_pct"),
                           cap["remaining_contracts"].cast("bigint").alias("remaining_contracts"))


shared_sql("uscore", """
    SELECT u.*, hv.vol, hv.gs / hv.mg > .35 AS irregular, DATE '2001-12-31' - latest AS age, least(prices / 20, 1) AS depth FROM ul u JOIN hv USING (subject_id) WHERE prices >= 4""")
LIQ_SQL = "greatest(0, least(100, round_even((depth * 30 + greatest(0, 1 - age / 365) * 30 + CASE WHEN irregular THEN 5 ELSE 15 END + 20)::DOUBLE, 0)))::DOUBLE"
CONF_SQL = "greatest(0, least(100, round_even((depth * 25 + greatest(0, 20 - age / 18.25) + CASE WHEN irregular THEN 5 ELSE 15 END + 15 + 15 + 10)::DOUBLE, 0)))::DOUBLE"


def scored_underlyings(m: Market) -> DataFrame:
    s = option_series(m)
    v = O.historical_volatility(s).select("subject_id", "annualized_volatility", (ratio("gap_sd", "median_gap") > 0.35).alias("irregular"))
    u = O.underlyings(s).filter("eligible").join(v, "subject_id")
    age = F.datediff(F.lit(AS_OF).cast("date"), "latest")
    n, yes, irregular = F.col("prices"), F.lit(True), F.coalesce("irregular", F.lit(False))
    return u.withColumns({"liquidity": O.liquidity_score(n, age, irregular, yes, yes, yes).cast("double"),
                          "confidence": O.confidence_score(n, age, irregular, yes, F.lit(0.0), F.lit(False), yes).cast("double")})


@query("liquidity_score_underlying", f"SELECT subject_id, {LIQ_SQL} AS liquidity FROM uscore")
def _(m):
    return scored_underlyings(m).select("subject_id", "liquidity")


@query("model_confidence", f"SELECT subject_id, {CONF_SQL} AS confidence FROM uscore")
def _(m):
    return scored_underlyings(m).select("subject_id", "confidence")


@query("hypothetical_spread", f"""
    WITH s AS (SELECT *, {LIQ_SQL} AS l, {CONF_SQL} AS c, spot * .1 AS mid FROM uscore),
    p AS (SELECT *, least(greatest(.04 + .20 * (1 - l / 100) + .16 * (1 - c / 100) + 1 * .015 + abs(ln(0.9)) * .04 + least(vol, 3) * .02 + 1 * .01 + CASE WHEN age > 120 THEN .06 ELSE 0 END, .02), .80) AS pct FROM s),
    b AS (SELECT *, greatest(spot * .02, mid - greatest(mid, .01) * pct / 2, 0) AS bid FROM p)
    SELECT subject_id, r6(bid) AS bid, r6(greatest(mid + greatest(mid, .01) * pct / 2, bid)) AS ask FROM b""")
def _(m):
    u = scored_underlyings(m).withColumn("mid", F.col("spot") * 0.1)
    stale = F.datediff(F.lit(AS_OF).cast("date"), "latest") > 120
    sp = O.hypothetical_spread(F.col("mid"), F.col("spot") * 0.02, F.col("liquidity"), F.col("confidence"), F.lit(1.0), F.lit(0.9), F.col("annualized_volatility"), 10.0,
                               stale, F.lit(False))
    return u.select("subject_id", rnd(sp["bid"]).alias("bid"), rnd(sp["ask"]).alias("ask"))


@query("lifecycle_option_inputs", """
    SELECT asset_id, exit_date, offering_date + 365 AS expiry, r6((exit_date - offering_date) / 365.0) AS years_to_exit FROM assets""")
def _(m):
    return m.assets.select("asset_id", "exit_date", F.date_add("offering_date", 365).alias("expiry"),
                           rnd(F.datediff("exit_date", "offering_date") / 365.0).alias("years_to_exit"))


@query("bootstrap_profit_probability")
def _(m):
    s = option_series(m)
    base = O.underlyings(s).filter("eligible").select("subject_id", "spot", (F.col("spot") * 1.02).alias("strike"), (F.col("spot") * 0.01).alias("premium"))
    return rounded(O.bootstrap_profit(s, base, 1.0, 5_000, 42, O.STRATEGIES))

