"""Title, filing, capture and identifier queries. The texts are rendered by Spark from the given tables, so what a parser
must find is known from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.columns import falsy_or, rnd
from tessera.operators import series as S
from tessera.operators import linking as L
from tessera.operators import market as M
from tessera.operators import text as T
from tessera.plans.registry import query, shared_sql
from tessera.plans.series_plans import daily, quarterly
from tessera.sources.market_views import Market

COLORS = ["Gold", "Noir", "Bleu Nuit", "Rouge", "Étoupe"]
PICK_MATERIALS = ["Togo", "Epsom", "Porosus Crocodile", "Ostrich", "Clemence", "Swift"]
PICK_MODELS = ["Birkin", "Kelly", "Constance", "Daytona"]
PICK_HARDWARE = ["Gold Hardware", "Palladium Hardware", "Permabrass Hardware"]


def pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options)).cast("int") + 1)


def sql_pick(options: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{o}'" for o in options) + f"])[({index}) % {len(options)} + 1]"


def titles(m: Market) -> DataFrame:
    k = F.col("asset_id")
    brand = F.when(k % 4 == 0, "Hermès ").otherwise("")
    return m.assets.select("asset_id", F.concat(
        F.when(k % 7 == 0, "Vintage ").otherwise(""), brand, pick(COLORS, k), F.lit(" "), pick(PICK_MATERIALS, k), F.lit(" "), pick(PICK_MODELS, k), F.lit(" "),
        (20 + F.col("size") % 20).cast("string"), F.lit(" "), pick(PICK_HARDWARE, k), F.lit(", "), F.col("year").cast("string")).alias("title"))


shared_sql("title_truth", f"""
    SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'Hermes' ELSE '' END AS brand, replace({sql_pick(COLORS, 'asset_id')}, 'É', 'E') AS color, {sql_pick(PICK_MATERIALS, 'asset_id')} AS material,
           {sql_pick(PICK_MODELS, 'asset_id')} AS model, CAST(20 + size % 20 AS VARCHAR) AS size, {sql_pick(PICK_HARDWARE, 'asset_id')} AS hardware, year FROM assets""")


@query("parse_titles", "SELECT asset_id, brand, color, material, model, size, hardware, CAST(year AS INT) AS year FROM title_truth")
def _(m):
    return T.with_title_fields(titles(m), "title").select("asset_id", "brand", "model", "size", "material", "hardware", "year", "color")


@query("infer_category", """
    SELECT asset_id, CASE WHEN brand = 'Hermes' OR model IN ('Birkin', 'Kelly') THEN 'handbags' WHEN model = 'Daytona' THEN 'watches' ELSE 'other' END AS category,
           CASE WHEN brand = 'Hermes' OR model IN ('Birkin', 'Kelly') THEN 'hermes_' || lower(model) WHEN model = 'Daytona' THEN 'watches' ELSE 'other' END AS subcategory FROM title_truth""")
def _(m):
    category = T.infer_category("title")
    return titles(m).select("asset_id", category.alias("category"), T.infer_subcategory("title", category, T.title_fields("title")).alias("subcategory"))


@query("parse_model_features", """
    SELECT asset_id, CASE WHEN model = 'Birkin' THEN 'Birkin' ELSE '' END AS model, CASE WHEN model = 'Birkin' THEN size ELSE '' END AS size, material, CAST(year AS INT) AS year,
           material IN ('Porosus Crocodile', 'Ostrich') AS is_exotic FROM title_truth""")
def _(m):
    return titles(m).select("asset_id", *[v.alias(k) for k, v in T.model_features("title").items()])


# --- filings ------------------------------------------------------------------------------

def filings(m: Market) -> DataFrame:
    """One filing text per asset, sold ones with a sale sentence; two forms are not offering forms."""
    k = F.col("asset_id").cast("string")
    sold = F.when(F.col("asset_id") % 20 == 0, F.concat(F.lit("<p>The asset was sold for $"), F.format_string("%.2f", F.col("offering_price_usd") * 100),
                                                       F.lit(" and the offer was accepted on 6/30/2000.</p>"))).otherwise("")
    body = F.concat(F.lit("<html><p>Series  #T"), k, F.lit("</p> <p>The offering price is <b>$"), F.format_string("%.2f", "offering_price_usd"), F.lit("</b> for "),
                    F.format_number(F.col("share_count"), 0), F.lit(" interests; the acquisition cost was $"), F.format_string("%.2f", F.col("offering_price_usd") * 90),
                    F.lit(" with offering expenses of $500.</p>"), sold, F.lit("</html>"))
    return m.assets.select(F.lit("0001").alias("cik"), F.concat(F.lit("A-"), k).alias("accession"), pick(["1-A", "1-K", "8-K", "1-U", "253G2"], F.col("asset_id")).alias("form"),
                           F.col("offering_date").alias("filing_date"), body.alias("text"), "asset_id")


shared_sql("filing_truth", """
    SELECT asset_id, '0001' AS cik, 'A-' || asset_id AS accession, (['1-A', '1-K', '8-K', '1-U', '253G2'])[asset_id % 5 + 1] AS form, 'Series #T' || asset_id AS series_name, offering_price_usd AS offering_price,
           CAST(share_count AS BIGINT) AS shares, offering_price_usd * 90 AS acquisition_cost, 500.0::DOUBLE AS offering_expenses, CASE WHEN asset_id % 20 = 0 THEN offering_price_usd * 100 END AS sale_price,
           CASE WHEN asset_id % 20 = 0 THEN DATE '2000-06-30' END AS sale_date, offering_date AS filing_date FROM assets""")


@query("parse_filings", """
    SELECT accession, series_name, cik || '-' || accession || '-' || series_name AS series_id, r2(offering_price) AS offering_price, shares, r2(acquisition_cost) AS acquisition_cost,
           r2(offering_expenses) AS offering_expenses, r2(sale_price) AS sale_price, sale_date, CASE WHEN sale_price IS NOT NULL THEN 'exit' END AS status FROM filing_truth""")
def _(m):
    p = T.parse_filings(filings(m))
    return p.select("accession", "series_name", "series_id", *[rnd(c, 2).alias(c) for c in ("offering_price", "acquisition_cost", "offering_expenses", "sale_price")], "shares", "sale_date", "status")


@query("filing_dedupe", """
    SELECT 'S' || asset_id % 50 AS series_id, max(asset_id) AS asset_id, arg_max(accession, asset_id) AS accession FROM filing_truth WHERE form IN ('1-A', '1-K', '1-U', '253G2') GROUP BY 1""")
def _(m):
    f = filings(m).filter(F.col("form").isin("1-A", "1-K", "1-U", "253G2"))
    series = f.select(F.concat(F.lit("S"), (F.col("asset_id") % 50).cast("string")).alias("series_id"), "asset_id", "accession")
    return S.keep_last(series, ["series_id"], ["asset_id"])


def filing_tables(m: Market) -> DataFrame:
    """Offering tables: one HTML filing per brand and size, a row per asset."""
    k = F.col("asset_id").cast("string")
    state = F.when(F.col("asset_id") % 20 == 0, F.concat(F.lit("Sold for $"), F.format_string("%.2f", F.col("offering_price_usd") * 100), F.lit(" on 12/14/2000"))).when(
        F.col("asset_id") % 3 == 0, "Closed").otherwise("")
    cells = [F.concat(F.lit("#T"), k), F.lit("q"), F.lit("r"), F.col("name"), state, F.lit(""), F.lit(""), F.concat(F.lit("$"), F.format_string("%.2f", "offering_price_usd")),
             F.format_number("share_count", 0), F.lit("x"), F.lit("$500")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>\n"))
    # the listing repeats each row; a filing holds the assets of one brand and size only
    rows = m.assets.groupBy("brand", "size").agg(F.array_join(F.sort_array(F.collect_list(F.concat(row, row))), "").alias("body"))
    return rows.select(F.lit("0001").alias("cik"), F.concat_ws("/", "brand", F.col("size").cast("string")).alias("accession"), F.lit("2001-01-31").cast("date").alias("filing_date"),
                       F.concat(F.lit("<table><tr><th>#HEAD</th></tr>"), "body", F.lit("</table>")).alias("text"))


@query("filing_table_rows", """
    SELECT brand || '/' || size AS accession, 'T' || asset_id AS ticker, name AS asset_name, r2(offering_price_usd) AS offering_price, CAST(share_count AS BIGINT) AS shares,
           CASE WHEN asset_id % 20 = 0 THEN 'exit' WHEN asset_id % 3 = 0 THEN 'closed' END AS status, r2(CASE WHEN asset_id % 20 = 0 THEN offering_price_usd * 100 END) AS sale_price,
           CASE WHEN asset_id % 20 = 0 THEN DATE '2000-12-14' END AS sale_date FROM assets""")
def _(m):
    return T.filing_table_rows(filing_tables(m)).select("accession", "ticker", "asset_name", rnd("offering_price", 2).alias("offering_price"), "shares", "status",
                                                        rnd("sale_price", 2).alias("sale_price"), "sale_date")


# --- captures -----------------------------------------------------------------------------

def auction_captures(m: Market) -> DataFrame:
    """Captured result pages, one per day and brand: a numbered lot has a title, an estimate and often a price."""
    c = m.comps.join(titles(m), "asset_id")
    sold = F.when(F.col("hardware") != "R", F.concat(F.lit("\nLOT SOLD: "), F.format_number(rnd("realized_price_usd", 0), 0), F.lit(" USD"))).otherwise("")
    lot = F.concat(F.lit(". Hermès\n"), F.col("title"), F.lit("\nEstimate:  "), F.format_number(rnd("estimate_low_usd", 0), 0), F.lit(" - "), F.format_number(rnd("estimate_high_usd", 0), 0),
                   F.lit(" USD"), sold, F.lit("\nhttps://lots.example/"), F.col("comp_id"), F.lit("\n\n"))
    day = c.groupBy("sale_date", "brand").agg(F.sort_array(F.collect_list(F.struct("comp_id", lot.alias("lot")))).alias("lots"))
    text = F.array_join(F.transform("lots", lambda x, i: F.concat((i + 1).cast("string"), x["lot"])), "")
    return day.select(F.concat_ws("/", F.col("sale_date").cast("string"), "brand").alias("capture_id"), F.concat(F.lit("Results\n\n"), text).alias("text"))


shared_sql("lot_truth", """
    SELECT sale_date || '/' || c.brand AS capture_id, CAST(row_number() OVER (PARTITION BY sale_date, c.brand ORDER BY comp_id) AS VARCHAR) AS lot_id, comp_id, c.hardware <> 'R' AS sold,
           r0(realized_price_usd) AS price, r0(estimate_low_usd) AS lo, r0(estimate_high_usd) AS hi, t.model, t.material, t.size, t.color, t.hardware, t.year
    FROM comps c JOIN title_truth t USING (asset_id)""")


@query("auction_capture", """
    SELECT capture_id, lot_id, 'Hermes' AS brand, model, material, size, hardware, CAST(year AS INT) AS year, r2(lo) AS estimate_low, r2(hi) AS estimate_high, r2(price) AS realized_price, 'USD' AS currency,
           'https://lots.example/' || comp_id AS source_url, r4(.98) AS confidence FROM lot_truth WHERE sold""")
def _(m):
    p = T.parse_lots(auction_captures(m))
    return p.select("capture_id", "lot_id", "brand", "model", "material", "size", "hardware", "year", *[rnd(c, 2).alias(c) for c in ("estimate_low", "estimate_high", "realized_price")],
                    "currency", "source_url", rnd("confidence", 4).alias("confidence"))


@query("capture_stats", """
    SELECT capture_id, count(*) AS lot_headers, count(*) AS brand_matching_lots, count(*) FILTER (sold) AS sold_price_lots, count(*) FILTER (sold) AS brand_matching_sold_price_lots
    FROM lot_truth GROUP BY 1""")
def _(m):
    return T.capture_stats(auction_captures(m))


def portfolio_captures(m: Market) -> DataFrame:
    k = F.col("asset_id").cast("string")
    cap = F.col("offering_price_usd") * F.col("share_count")
    text = F.concat(F.lit("Portfolio\n#T"), k, F.lit("\n"), F.col("name"), F.lit("\n$"), F.format_number("offering_price_usd", 2), F.lit("\n$"),
                    F.format_string("%.3f", cap / 1000), F.lit("K\nMarket Cap\n#BROKEN\nno price\n"))
    return m.assets.select(k.alias("capture_id"), text.alias("text"))


@query("portfolio_capture", """
    SELECT 'T' || asset_id AS ticker, name, r2(offering_price_usd) AS price, r2(offering_price_usd * share_count) AS market_cap, CAST(share_count AS BIGINT) AS shares FROM assets""")
def _(m):
    return T.portfolio_rows(portfolio_captures(m)).select("ticker", "name", rnd("price", 2).alias("price"), rnd("market_cap", 2).alias("market_cap"), "shares")


@query("ocr_text_fields", """
    SELECT asset_id, s1, s2, s3, CASE s2 % 3 WHEN 2 THEN CASE WHEN day(observed_at) > 12 OR day(observed_at) = month(observed_at) THEN observed_at END ELSE observed_at END AS observation_date,
           r2(price_per_share) AS price, r2(round(volume)) * 1000 AS market_cap FROM observations""")
def _(m):
    d = F.col("observed_at")
    shown = F.when(F.col("s2") % 3 == 0, F.date_format(d, "MMMM d, yyyy")).when(F.col("s2") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "M/d/yyyy"))
    text = F.concat(F.lit("Price $"), F.format_string("%.2f", rnd("price_per_share", 2)), F.lit(" on "), shown, F.lit(" cap $"), F.col("volume").cast("int").cast("string"), F.lit("K"))
    f = T.reading_fields("text")
    o = m.observations.select("asset_id", "s1", "s2", "s3", text.alias("text"))
    return o.select("asset_id", "s1", "s2", "s3", f["observation_date"].alias("observation_date"), rnd(f["price"], 2).alias("price"), rnd(f["market_cap"], 2).alias("market_cap"))


# --- identifiers --------------------------------------------------------------------------

@query("resolve_identifier", """
    WITH q AS (SELECT asset_id AS qid, CASE asset_id % 5 WHEN 0 THEN lower(ticker) WHEN 1 THEN upper(name) WHEN 2 THEN ' ' || asset_id || ' ' WHEN 3 THEN 'nick' || asset_id ELSE 'unknown ' || asset_id END AS ident,
                      CASE asset_id % 4 WHEN 0 THEN lower(category) WHEN 1 THEN 'elsewhere' END AS expected FROM assets),
    a AS (SELECT lower(ticker) AS key, asset_id FROM assets UNION SELECT lower(name), asset_id FROM assets UNION SELECT CAST(asset_id AS VARCHAR), asset_id FROM assets),
    k AS (SELECT qid, lower(trim(ident)) AS key FROM q UNION SELECT qid, '#t' || substr(ident, 5) FROM q WHERE ident LIKE 'nick%' AND qid % 10 = 3),
    n AS (SELECT qid, count(DISTINCT a.asset_id) AS n, min(a.asset_id) AS hit FROM k JOIN a USING (key) GROUP BY qid),
    r AS (SELECT q.*, trim(ident) AS i, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN hit END AS hit FROM q LEFT JOIN n USING (qid)),
    j AS (SELECT r.*, s.category, r.n = 1 AND expected IS NOT NULL AND lower(s.category) <> expected AS off, r.hit IN (SELECT asset_id FROM q_quotes WHERE date > DATE '1999-06-30') AS priced FROM r LEFT JOIN assets s ON s.asset_id = r.hit)
    SELECT qid, n AS matches, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN off THEN 'category_mismatch' ELSE 'matched' END AS status, hit AS asset_id,
           array_to_string(list_filter([CASE WHEN n = 0 THEN 'unknown_asset_id:' || i END, CASE WHEN n > 1 THEN 'ambiguous_asset_match:' || i END,
             CASE WHEN off THEN 'category_mismatch: factors=' || expected || ' registry=' || category END, CASE WHEN n = 1 AND NOT coalesce(priced, FALSE) THEN 'missing_historical_price_data' END], lambda x: x IS NOT NULL), ';') AS warnings
    FROM j""")
def _(m):
    k = F.col("asset_id")
    a, id_text = m.assets, F.col("asset_id").cast("string")
    ident = F.when(k % 5 == 0, F.lower("ticker")).when(k % 5 == 1, F.upper("name")).when(k % 5 == 2, F.concat(F.lit(" "), id_text, F.lit(" "))).when(
        k % 5 == 3, F.concat(F.lit("nick"), id_text)).otherwise(F.concat(F.lit("unknown "), id_text))
    asked = a.select(k.alias("qid"), ident.alias("ident"), F.when(k % 4 == 0, F.lower("category")).when(k % 4 == 1, F.lit("elsewhere")).alias("expected_category"))
    aliases = a.filter(k % 10 == 3).select(F.concat(F.lit("nick"), id_text).alias("alias"), F.col("ticker").alias("target"))
    out = L.resolve_identifiers(asked, a, quarterly(m).filter("date > '1999-06-30'"), aliases)
    return out.select("qid", "matches", "status", "asset_id", F.concat_ws(";", "warnings").alias("warnings"))


@query("ticker_fallback_link", """
    SELECT asset_id AS truth, asset_id, CASE WHEN asset_id % 3 <> 0 THEN 'asset_id' ELSE 'series_name' END AS linked_by FROM exits""")
def _(m):
    k = F.col("asset_id")
    e = m.exits.select(F.when(k % 3 != 0, k).alias("asset_id"), "series_name", k.alias("truth"), (k % 3 != 0).alias("own"))
    return M.linked_exits(e, m.assets).select("truth", "asset_id", F.when(F.col("own"), "asset_id").otherwise("series_name").alias("linked_by"))


@query("filing_link", """
    WITH f AS (SELECT asset_id AS n, CASE asset_id % 3 WHEN 0 THEN 'T' || asset_id WHEN 1 THEN CASE WHEN asset_id % 6 = 1 THEN 'T' || asset_id ELSE 'ALIAS' || asset_id END END AS ticker,
                      lower(CASE asset_id % 3 WHEN 0 THEN 'Series #T' || asset_id WHEN 1 THEN 'Series #Alias' || asset_id ELSE 'Series ' || asset_id END || ' ' || CASE WHEN asset_id % 3 = 2 THEN name || 's' ELSE '' END) AS text FROM assets),
    t AS (SELECT a.asset_id, max(f.n) AS hit FROM assets a JOIN f ON f.ticker = ltrim(a.ticker, '#') GROUP BY 1),
    w AS (SELECT DISTINCT name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: len(x) >= 4) AS tokens FROM assets),
    s AS (SELECT w.name, f.n, len(list_filter(tokens, lambda x: contains(f.text, x))) AS score FROM w CROSS JOIN f),
    b AS (SELECT name, arg_min(n, (-score, n)) AS hit FROM s WHERE score >= 2 GROUP BY name)
    SELECT a.asset_id, coalesce(t.hit, b.hit) AS filing_id, CASE WHEN t.hit IS NOT NULL THEN 'ticker' WHEN b.hit IS NOT NULL THEN 'name' END AS linked_by FROM assets a LEFT JOIN t USING (asset_id) LEFT JOIN b USING (name)""")
def _(m):
    k, id_text = F.col("asset_id"), F.col("asset_id").cast("string")
    series = F.when(k % 3 == 0, F.concat(F.lit("Series #T"), id_text)).when(k % 3 == 1, F.concat(F.lit("Series #Alias"), id_text)).otherwise(F.concat(F.lit("Series "), id_text))
    rows = m.assets.select(k.alias("filing_id"), series.alias("series_name"), F.when(k % 3 == 2, F.concat("name", F.lit("s"))).otherwise("").alias("asset_name"))
    aliases = m.assets.filter(k % 6 == 1).select(F.concat(F.lit("Alias"), id_text).alias("alias"), F.concat(F.lit("t"), id_text).alias("target"))
    return L.link_filings(m.assets, rows, aliases)


@query("asset_universe_build", """
    WITH l AS (SELECT asset_id, arg_max(price, date) AS p, arg_max_null(cap, date) AS cap FROM d_quotes GROUP BY 1),
    j AS (SELECT a.*, l.p, l.cap, x.sale_date, CASE WHEN asset_id % 5 = 0 THEN 0 ELSE share_count END AS own_shares, f.shares AS filed_shares, f.offering_price AS filed_price
          FROM assets a LEFT JOIN l USING (asset_id) LEFT JOIN filing_truth f USING (asset_id) LEFT JOIN (SELECT asset_id, min(sale_date) AS sale_date FROM exits WHERE status <> 'cancelled_exit' GROUP BY 1) x USING (asset_id))
    SELECT asset_id, ticker, coalesce(nullif(filed_shares, 0)::DOUBLE, own_shares) AS share_count, r2(filed_price * coalesce(nullif(filed_shares, 0), own_shares)) AS offering_market_cap_usd,
           r2(cap) AS current_market_cap_usd, r6(p) AS last_trade_price, CASE WHEN sale_date IS NOT NULL THEN 'exited' WHEN status IN ('active', 'live', 'trading') THEN 'trading' ELSE status END AS status, sale_date AS exit_date
    FROM j""")
def _(m):
    q = daily(m).groupBy("asset_id").agg(F.max_by("price", "date").alias("p"), F.max_by("cap", "date").alias("cap"))
    filed = T.parse_filings(filings(m)).select(F.regexp_extract("accession", r"A-(\d+)", 1).cast("bigint").alias("asset_id"), F.col("shares").alias("filed_shares"),
                                               F.col("offering_price").alias("filed_price"))
    gone = m.exits.filter("status <> 'cancelled_exit'").groupBy("asset_id").agg(F.min("sale_date").alias("exit_date"))
    own = F.when(F.col("asset_id") % 5 == 0, 0.0).otherwise(F.col("share_count"))
    j = m.assets.drop("exit_date").join(q, "asset_id", "left").join(filed, "asset_id", "left").join(gone, "asset_id", "left")
    shares = falsy_or(F.col("filed_shares").cast("double"), own)
    price = falsy_or("filed_price", "offering_price_usd")
    status = F.lower("status")
    return j.select("asset_id", "ticker", shares.alias("share_count"), rnd(F.when((price != 0) & (shares != 0), price * shares), 2).alias("offering_market_cap_usd"),
                    rnd("cap", 2).alias("current_market_cap_usd"), rnd("p").alias("last_trade_price"),
                    F.when(F.col("exit_date").isNotNull(), "exited").when(status.isin("active", "live", "trading"), "trading").otherwise(status).alias("status"), "exit_date")


@query("filing_context_assets", """
    WITH c AS (SELECT *, 'T' || asset_id % 300 AS ticker, 1 + CASE WHEN shares >= 100 THEN 1 ELSE 0 END + CASE WHEN offering_price < 10000 THEN 1 ELSE 0 END + CASE WHEN sale_price IS NOT NULL THEN 1 ELSE 0 END AS quality FROM filing_truth),
    k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.ticker = '#' || c.ticker AND a.category = 'ECONOMY') QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY quality DESC, asset_id DESC) = 1)
    SELECT ticker, series_name, quality, r2(offering_price * shares) AS offering_market_cap_usd FROM k""")
def _(m):
    f = T.parse_filings(filings(m)).withColumn("asset_id", F.regexp_extract("accession", r"A-(\d+)", 1).cast("bigint"))
    f = f.withColumns({"ticker": F.concat(F.lit("T"), (F.col("asset_id") % 300).cast("string")),
                       "quality": 1 + F.when(F.coalesce("shares", F.lit(0)) >= 100, 1).otherwise(0) + F.when(F.coalesce("offering_price", F.lit(0.0)) < 10000, 1).otherwise(0)
                       + F.when(F.col("status") == "exit", 1).otherwise(0)})
    owned = m.assets.filter("category = 'ECONOMY'").select(F.expr("substring(ticker, 2)").alias("ticker"))
    rest = f.join(owned, "ticker", "left_anti").select("ticker", "series_name", "quality", "asset_id", (F.col("offering_price") * F.col("shares")).alias("cap"))
    return S.keep_last(rest, ["ticker"], ["quality", "asset_id"]).select("ticker", "series_name", "quality", rnd("cap", 2).alias("offering_market_cap_usd"))


@query("distinct_headlines", """
    WITH h AS (SELECT trim(split_part(text, '.', 1)) AS headline, max(conv_id) AS newest, max(length(text)) AS score, count(*) AS copies FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT headline, newest, CAST(score AS INT) AS score, copies FROM h WHERE headline <> '' ORDER BY newest DESC, score DESC, headline LIMIT 40""")
def _(m):
    c = m.table("conversations").filter("role = 'user'").withColumn("headline", F.trim(F.split_part("text", F.lit("."), F.lit(1))))
    h = c.filter("headline <> ''").groupBy("headline").agg(F.max("conv_id").alias("newest"), F.max(F.length("text")).alias("score"), F.count(F.lit(1)).alias("copies"))
    return h.orderBy(F.desc("newest"), F.desc("score"), "headline").limit(40)
