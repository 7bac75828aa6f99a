"""Linking free identifiers and filing rows to assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import fold_text

# Shortest name token that counts, tokens that name no asset, least overlap that links, and gram length of the index.
TOKEN_LENGTH, STOP_TOKENS, LEAST_OVERLAP = 4, ("rally", "series", "skeleton", "fossil"), 2


def resolve_identifiers(asked: DataFrame, registry: DataFrame, prices: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The asset that each asked identifier names, by id, ticker or name in any case, or through an alias.

    asked: qid, ident, expected_category. registry: asset_id, ticker, name, category. prices: asset_id. aliases: alias, target.
    Returns qid, matches, status (unknown, ambiguous, category_mismatch, matched), asset_id, ticker, name, category, warnings. A name that
    very many assets carry is one counted row before anybody asks for it.
    """
    ident = F.trim(F.col("ident").cast("string"))
    wanted = asked.select("qid", ident.alias("ident"), "expected_category")
    keys = wanted.select("qid", "ident", F.lower("ident").alias("key"))
    if aliases is not None:
        keys = keys.union(wanted.join(aliases, wanted["ident"] == aliases["alias"]).select("qid", "ident", F.lower("target").alias("key"))).distinct()
    k = F.col("asset_id").cast("string")
    names = registry.select("asset_id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower(k), F.lower("ticker"), F.lower("name"))))).alias("key"))
    known = names.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("low"), F.max("asset_id").alias("high"))
    # an identifier has one or two keys; when both hit the same asset it is one match
    hits = keys.join(known, "key").groupBy("qid").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    n = F.when((F.col("low") == F.col("high")) & (F.col("most") == 1), 1).otherwise(F.col("total"))
    hits = hits.select("qid", n.cast("long").alias("matches"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("asset_id"))
    priced = prices.select("asset_id").distinct().withColumn("_priced", F.lit(True))
    j = wanted.join(hits, "qid", "left").join(registry.select("asset_id", "ticker", "name", "category"), "asset_id", "left").join(priced, "asset_id", "left")
    n = F.coalesce("matches", F.lit(0).cast("long"))
    differs = (n == 1) & F.col("expected_category").isNotNull() & (F.lower(F.coalesce("category", F.lit(""))) != F.lower("expected_category"))
    status = F.when(n == 0, "unknown").when(n > 1, "ambiguous").when(differs, "category_mismatch").otherwise("matched")
    warnings = F.array_compact(F.array(
        F.when(n == 0, F.concat(F.lit("unknown_asset_id:"), "ident")), F.when(n > 1, F.concat(F.lit("ambiguous_asset_match:"), "ident")),
        F.when(differs, F.concat(F.lit("category_mismatch: factors="), "expected_category", F.lit(" registry="), F.coalesce("category", F.lit("")))),
        F.when((n == 1) & F.col("_priced").isNull(), F.lit("missing_historical_price_data"))))
    one = lambda c: F.when(n == 1, F.col(c)).alias(c)
    return j.select("qid", n.alias("matches"), status.alias("status"), *[one(c) for c in ("asset_id", "ticker", "name", "category")], warnings.alias("warnings"))


def series_ticker(series: Column) -> Column:
    """The ticker behind '#', else the whole name, upper case."""
    marked = F.upper(F.regexp_extract(series, r"#([A-Za-z0-9]+)\b", 1))
    return F.when(marked != "", marked).otherwise(F.upper(fold_text(series)))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(fold_text(name), "[^a-z0-9]+"), lambda t: (F.char_length(t) >= TOKEN_LENGTH) & ~t.isin(*STOP_TOKENS))


def _grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) - (TOKEN_LENGTH - 1)), lambda i: F.substring(word, i, F.lit(TOKEN_LENGTH))))


def _token_postings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, filing_id) wherever an asset token stands inside a word of a filing. Dictionaries of distinct tokens and words meet on a
    gram, so no text is scanned per asset."""
    distinct = tokens.select("token").distinct().withColumn("gram", F.substring("token", F.lit(1), F.lit(TOKEN_LENGTH)))
    dictionary = words.select("word").distinct().withColumn("gram", F.explode(_grams(F.col("word"))))
    inside = distinct.join(dictionary, "gram").filter(F.contains("word", "token")).select("token", "word")
    return words.join(inside, "word").select("token", "filing_id").distinct()


def link_filings(assets: DataFrame, filings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The filing row of every asset: asset_id, filing_id, linked_by (ticker, name, or null where none is).

    assets: asset_id, ticker, name. filings: filing_id (their order), series_name, asset_name. aliases: alias, target (tickers).
    The last filing with the asset's ticker wins; without one, the first of those that hold the most name tokens, two at least.

    Names are matched once per distinct token list. A filing that holds two tokens of a name holds one that is not the name's most common,
    so lists are looked up by all their tokens but that one (unless the name repeats it); the overlap is then counted for the candidates
    only. A token that a third of all names share is thus not looked up unless a name has nothing rarer.
    """
    ticker = F.trim(F.replace(F.upper("ticker"), F.lit("#"), F.lit("")))
    rows = filings.select("filing_id", "series_name", "asset_name", series_ticker(F.col("series_name")).alias("_ticker"))
    if aliases is not None:
        rows = rows.join(aliases.select(F.upper("alias").alias("_ticker"), F.upper("target").alias("_target")), "_ticker", "left").withColumn("_ticker", F.coalesce("_target", "_ticker"))
    by_ticker = rows.groupBy("_ticker").agg(F.max("filing_id").alias("by_ticker"))
    linked = assets.select("asset_id", ticker.alias("_ticker"), name_tokens(F.col("name")).alias("_tokens")).join(by_ticker, "_ticker", "left")

    profiles = linked.filter("by_ticker IS NULL AND size(_tokens) > 0").select(F.array_sort("_tokens").alias("_list")).distinct()
    tokens = profiles.select("_list", F.explode("_list").alias("token")).groupBy("_list", "token").agg(F.count(F.lit(1)).alias("times"))
    text = F.concat_ws(" ", fold_text("series_name"), fold_text("asset_name"))
    words = rows.select("filing_id", F.explode(F.array_distinct(F.split(text, "[^a-z0-9]+"))).alias("word")).filter(F.char_length("word") >= TOKEN_LENGTH)
    postings = _token_postings(tokens, words)
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    ranked = tokens.join(common, "token").withColumn("_place", F.row_number().over(Window.partitionBy("_list").orderBy(F.desc("held"), "token")))
    probes = ranked.filter((F.col("_place") > 1) | (F.col("times") >= LEAST_OVERLAP))
    candidates = probes.join(postings, "token").select("_list", "filing_id").distinct()
    overlap = candidates.join(ranked.select("_list", "token", "times"), "_list").join(postings, ["token", "filing_id"]).groupBy("_list", "filing_id").agg(F.sum("times").alias("overlap"))
    best = overlap.filter(F.col("overlap") >= LEAST_OVERLAP).groupBy("_list").agg(F.min_by("filing_id", F.struct(-F.col("overlap"), F.col("filing_id"))).alias("by_name"))
    found = linked.withColumn("_list", F.when(F.col("by_ticker").isNull(), F.array_sort("_tokens"))).join(best, "_list", "left")
    return found.select("asset_id", F.coalesce("by_ticker", "by_name").alias("filing_id"),
                        F.when(F.col("by_ticker").isNotNull(), "ticker").when(F.col("by_name").isNotNull(), "name").alias("linked_by"))
