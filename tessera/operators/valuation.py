"""Comparable-sale matching and valuation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import blank_to_null, change, clip, falsy_or, first_nonblank, fold_text, ratio, rule_names
from tessera.operators.quantiles import exact_quantiles
from tessera.session import drop_stored, staged, store

# Weights of matching attributes, year bonus by distance, and the score that counts as a match.
MATCH_WEIGHTS = {"brand": 0.25, "model": 0.25, "size": 0.15, "material": 0.15, "color": 0.08, "hardware": 0.07}
NEAR_YEARS, FAR_YEARS, YEAR_BONUS = 2, 10, 0.05
MIN_SCORE, TOP_COMPS = 0.20, 20
CONDITION_FACTORS = {"mint": 1.05, "excellent": 1.02, "very_good": 0.98, "good": 0.93, "fair": 0.85}
# Research valuation settings.
FX_RATES = {"USD": 1.0, "HKD": 0.128, "CHF": 1.12, "GBP": 1.27, "EUR": 1.09}
UNVERIFIED_WEIGHT, MAX_YEARS, RECENCY_FLOOR = 0.65, 5.0, 0.25
MIN_SIMILARITY, MIN_EVIDENCE, MIN_COMPS = 0.35, 0.30, 2
CONFIDENCE_BASE, EXTREME_DISPERSION = 0.75, 0.75
CONFIDENCE_PENALTIES = {"one_comparable": 0.35, "most_unverified": 0.15, "extreme_dispersion": 0.2, "missing_condition": 0.1,
                        "missing_history": 0.1}
COMPONENT_WEIGHTS = {"identity_similarity": 0.35, "condition_similarity": 0.25, "provenance_similarity": 0.20, "presentation_similarity": 0.20}


def year_bonus(gap: Column) -> Column:
    far = F.greatest(F.lit(0.01), YEAR_BONUS * (1 - gap / FAR_YEARS))
    return F.when(gap <= NEAR_YEARS, YEAR_BONUS).when(gap <= FAR_YEARS, far).otherwise(0.0)


def _patterns() -> list[tuple[str, ...]]:
    """Attribute subsets that can reach the match score with the best year bonus."""
    fields = list(MATCH_WEIGHTS)
    subsets = [c for n in range(1, len(fields) + 1) for c in combinations(fields, n)]
    return [s for s in subsets if sum(MATCH_WEIGHTS[f] for f in s) + YEAR_BONUS >= MIN_SCORE - 1e-9]


FIELD_BIT = {f: 1 << i for i, f in enumerate(MATCH_WEIGHTS)}
ATTRIBUTES = [f"_{f}" for f in MATCH_WEIGHTS]
# the hash comes first only to make sorting cheap; mask and values keep the key exact
KEY = ["hash", "mask", "values"]
#: Attribute sets matched together, heaviest first; what is left is the last round.
ROUND_SETS = (3, 8, 16)


def _weight(fields: tuple[str, ...]) -> float:
    return sum(MATCH_WEIGHTS[f] for f in fields)


def lattice_rounds() -> list[list[tuple[str, ...]]]:
    """The attribute sets in falling order of weight, cut into rounds. A set always comes after the sets that contain it."""
    sets, out = sorted(_patterns(), key=lambda s: (-round(_weight(s), 9), s)), []
    for n in ROUND_SETS:
        out.append(sets[:n])
        sets = sets[n:]
    return [r for r in [*out, sets] if r]


def with_keys(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """One row per attribute set of which a row has every attribute, with the lookup key (hash, mask, values)."""
    keys = []
    for fields in sets:
        present = reduce(Column.__and__, [F.col(f"_{f}").isNotNull() for f in fields])
        keys.append(F.when(present, F.struct(F.lit(sum(FIELD_BIT[f] for f in fields)).alias("mask"), F.concat_ws("|", *[F.concat(F.char_length(f"_{f}"), F.lit(":"), F.col(f"_{f}")) for f in fields]).alias("values"))))
    flat = df.select("*", F.explode(F.array_compact(F.array(*keys))).alias("_key")).select(*df.columns, "_key.mask", "_key.values")
    return flat.withColumn("hash", F.xxhash64("mask", "values"))


def normal_attribute(df: DataFrame, field: str) -> Column:
    """An attribute as compared: folded text, a whole number without its ".0", blank as missing."""
    value = F.col(field)
    if df.schema[field].dataType.typeName() in ("double", "float"):
        value = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return blank_to_null(F.regexp_replace(fold_text(value.cast("string")), r"^(\d+)\.0$", "$1"))


def merged(df: DataFrame) -> DataFrame:
    """The other side of a join that is shuffled whatever its estimated size: compressed tables and exploded keys look smaller than they are,
    and a broadcast would pass through the driver."""
    return df.hint("merge")


def _lists(sales: DataFrame, wanted: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """The best sales of every wanted (key, asset year) as one row with their list: by year bonus, price and id, at most TOP_COMPS each.

    Only keys somebody asks for go on. The first, heaviest sets are asked by every profile, and all sales go to their keys; later few profiles are
    open, and the distinct attributes of sales find out which are asked for, so that sales are not copied once per set. Of a key, at most TOP_COMPS
    sales per sale year can be in any list, which is decided before the rows meet, so a hot key costs a short list per year.
    """
    price = F.col("realized_price_usd").desc()
    asked = merged(wanted.select(KEY).distinct())
    if len(sets) <= ROUND_SETS[0]:
        keyed = with_keys(sales, sets).join(asked, KEY, "left_semi")
    else:
        kinds = with_keys(sales.select(ATTRIBUTES).distinct(), sets).join(asked, KEY, "left_semi")
        keyed = sales.select(F.struct(ATTRIBUTES).alias("_kind"), "comp_year", "_sales").join(
            merged(kinds.select(F.struct(ATTRIBUTES).alias("_kind"), *KEY)), "_kind").select("_kind.*", "comp_year", "_sales", *KEY)
    keyed = keyed.select(*KEY, *ATTRIBUTES, "comp_year", F.explode("_sales").alias("_sale")).select(*KEY, *ATTRIBUTES, "comp_year", "_sale.*")
    year = F.row_number().over(Window.partitionBy(*KEY, "comp_year").orderBy(price, "comp_id"))
    keyed = keyed.withColumn("_k", year).filter(F.col("_k") <= TOP_COMPS).drop("_k")
    bonus = F.coalesce(year_bonus(F.abs(F.col("year") - F.col("comp_year"))), F.lit(0.0))
    best = F.row_number().over(Window.partitionBy(*KEY, "year").orderBy(bonus.desc(), price, "comp_id"))
    met = keyed.join(merged(wanted), KEY).withColumn("_k", best).filter(F.col("_k") <= TOP_COMPS).drop("_k")
    met = met.withColumnsRenamed({x: f"c{x}" for x in ATTRIBUTES})
    return met.groupBy(*KEY, "year").agg(F.collect_list(F.struct(*[c for c in met.columns if c not in (*KEY, "year")])).alias("_list"))


def _scored(hits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score, matched set and nearness of years of pairs that meet in the list of exactly the attributes they share, so each pair once."""
    same = {f: F.coalesce(F.col(f"_{f}") == F.col(f"c_{f}"), F.lit(False)) for f in MATCH_WEIGHTS}
    matched = sum((F.when(same[f], FIELD_BIT[f]).otherwise(0) for f in MATCH_WEIGHTS), F.lit(0))
    score = sum((F.when(same[f], w).otherwise(0.0) for f, w in MATCH_WEIGHTS.items()), F.lit(0.0))
    gap = F.abs(F.col("year") - F.col("comp_year"))
    near = F.when(gap <= NEAR_YEARS, "year").when(gap <= FAR_YEARS, "year_near")
    return hits.filter(matched == F.col("mask")).select(
        "profile", "comp_id", F.round(F.least(F.lit(1.0), score + F.coalesce(year_bonus(gap), F.lit(0.0))), 4).alias("similarity_score"),
        "mask", near.alias("near"), "realized_price_usd", "sale_date", *carry).filter(F.col("similarity_score") >= MIN_SCORE)


def similarity_join(assets: DataFrame, comps: DataFrame) -> DataFrame:
    """The best comparable sales of each asset by weighted attribute match, see `matched_profiles`."""
    members, found = matched_profiles(assets, comps)
    fields = F.concat_ws(", ", *[F.when(F.col("mask").bitwiseAND(bit) != 0, f) for f, bit in FIELD_BIT.items()], "near")
    return members.join(merged(found), "profile").select("asset_id", "comp_id", "similarity_score", fields.alias("matched_fields"), "realized_price_usd", "sale_date", "rank")


def matched_profiles(assets: DataFrame, comps: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The profile of each asset, and the best comparable sales of each profile: a rank join over the lattice of attribute sets. `carry` names
    columns of the sales that come along.

    Assets that agree in all attributes and the year are one profile and matched once; of sales that agree so, only the best by price and
    id can matter. The attribute sets are visited in falling order of weight, in rounds. In a round the sales that share a set's
    values with an open profile form short sorted lists. A sale missing from the list of the set it shares with a profile is beaten by
    a full list of sales that match at least as well, so lists suffice. A profile closes when its TOP_COMPS-th score is above what any
    set still to come can reach with the best year bonus; only open profiles ask in later rounds, and only keys that are asked
    for are looked up. The result is exact, and no pair is built that cannot be among a profile's best of its round.

    Rounds end in written tables: the next round's size follows from what is still open. A missing or zero year gives no bonus.
    """
    a = assets.select("asset_id", F.nullif(F.col("year"), F.lit(0)).alias("year"), *[normal_attribute(assets, f).alias(f"_{f}") for f in MATCH_WEIGHTS])
    a = a.withColumn("_same", F.struct(*ATTRIBUTES, "year"))
    profiles = a.groupBy("_same").agg(F.min("asset_id").alias("profile")).select("profile", "_same", "_same.*")
    profiles = staged(profiles)

    sales = comps.filter("realized_price_usd IS NOT NULL").select(
        "comp_id", "realized_price_usd", "sale_date", F.nullif(F.col("year"), F.lit(0)).alias("comp_year"), *carry, *[normal_attribute(comps, f).alias(f"_{f}") for f in MATCH_WEIGHTS])
    alike = Window.partitionBy(*ATTRIBUTES, "comp_year").orderBy(F.desc("realized_price_usd"), "comp_id")
    sale = F.struct("comp_id", "realized_price_usd", "sale_date", *carry)
    # sales alike are one row with their list, so that attributes and keys are not repeated with each
    sales = sales.withColumn("_k", F.row_number().over(alike)).filter(F.col("_k") <= TOP_COMPS).groupBy(*ATTRIBUTES, "comp_year").agg(F.collect_list(sale).alias("_sales"))
    sold = store(sales)
    sales = assets.sparkSession.read.schema(sales.schema).parquet(sold)

    order = Window.partitionBy("profile").orderBy(F.desc("similarity_score"), F.desc("realized_price_usd"), "comp_id")
    open_, found, rounds = profiles.drop("_same"), None, lattice_rounds()
    spark, last = assets.sparkSession, None
    for number, sets in enumerate(rounds):
        asked = with_keys(open_, sets)
        lists = _lists(sales, asked.select(*KEY, "year").distinct(), sets).withColumnRenamed("year", "_year")
        # lists of the first sets are long: one set at a time is shuffled, and only its hits are stored
        masks = [sum(FIELD_BIT[f] for f in fields) for fields in sets]
        stored = []
        for group in ([[m] for m in masks] if number == 0 else [masks]):
            some = lists.filter(F.col("mask").isin(group)).withColumnsRenamed({k: f"c{k}" for k in KEY})
            met = asked.filter(F.col("mask").isin(group)).join(merged(some), reduce(Column.__and__, [F.col(k) == F.col(f"c{k}") for k in KEY]) & F.col("year").eqNullSafe(F.col("_year")))
            met = met.select("profile", "year", *ATTRIBUTES, "mask", F.explode("_list").alias("_sale")).select("profile", "year", *ATTRIBUTES, "mask", "_sale.*")
            hits = _scored(met, carry)
            stored.append(store(hits))
        hits = spark.read.schema(hits.schema).parquet(*stored)
        ranked = (hits if found is None else hits.unionByName(found.drop("rank"))).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= TOP_COMPS)
        path = store(ranked)
        found = spark.read.schema(ranked.schema).parquet(path)
        drop_stored(spark, *stored, *([last] if last else []))
        last = path
        if number + 1 < len(rounds):
            reachable = max(map(_weight, rounds[number + 1])) + YEAR_BONUS
            closed = found.filter((F.col("rank") == TOP_COMPS) & (F.col("similarity_score") > reachable + 1e-9)).select("profile")
            open_ = staged(open_.join(merged(closed), "profile", "left_anti"))
            if open_.isEmpty():
                break
    drop_stored(spark, sold)
    members = a.select("asset_id", "_same").join(merged(profiles.select("profile", "_same")), "_same").select("asset_id", "profile")
    return members, found


def recency_weight(age_days: Column) -> Column:
    return F.greatest(F.lit(0.20), 1 / (1 + F.greatest(age_days, F.lit(0)) / 365))


def condition_factor(condition: Column | str) -> Column:
    key = F.regexp_replace(F.lower(F.col(condition) if isinstance(condition, str) else condition), " ", "_")
    out = F.lit(1.0)
    for name, factor in CONDITION_FACTORS.items():
        out = F.when(key == name, factor).otherwise(out)
    return out


def nav_recency_weighted(assets: DataFrame, comps: DataFrame, caps: DataFrame, as_of: str, modifiers: dict[str, float] | None = None) -> DataFrame:
    """NAV of each asset from its own sales, weighted by recency, exactness and source confidence."""
    modifier = F.lit(1.0)
    for name, factor in (modifiers or {}).items():
        modifier = F.when(F.col("category") == name, factor).otherwise(modifier)
    day = F.lit(as_of).cast("date")
    rows = comps.select("asset_id", "sale_date", (F.col("realized_price_usd") * condition_factor("condition") * modifier).alias("p"),
                        (recency_weight(F.datediff(day, "sale_date")) * F.col("exactness_score") * F.col("source_confidence")).alias("w"))
    a = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("comp_count"), (F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("estimated_nav_usd"),
        F.stddev_pop("p").alias("sd"), F.avg("w").alias("mean_w"), F.max("sale_date").alias("newest"))
    nav, cap = F.col("estimated_nav_usd"), F.col("market_cap")
    dispersion = F.when(F.col("comp_count") > 1, F.col("sd") / nav).otherwise(0.20)
    band = F.greatest(F.lit(0.08), dispersion)
    return a.join(assets.select("asset_id"), "asset_id", "left_semi").join(caps, "asset_id", "left").select(
        "asset_id", "comp_count", "estimated_nav_usd", F.greatest(F.lit(0.01), nav * (1 - band)).alias("nav_low_usd"), (nav * (1 + band)).alias("nav_high_usd"),
        clip(F.col("mean_w") * (1 - F.least(dispersion, F.lit(0.8)) / 2), 0.05, 0.95).alias("nav_confidence"), ratio(cap - nav, nav).alias("premium_discount_pct"),
        ratio(nav - cap, nav).alias("discount_to_secondary_nav"), (F.datediff(day, "newest") > 180).alias("is_stale"))


def momentum(as_of: str, days: int) -> Column:
    """Median sale price after a cutoff over the median before it, as an aggregate; at most a short list of sales per group."""
    price, late = F.col("realized_price_usd"), F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    after, before = (F.percentile(F.when(side, price), F.lit(0.5)) for side in (late, ~late))
    return F.when((F.count_if(late) >= 2) & (F.count_if(~late) >= 2), change(after, F.nullif(before, F.lit(0.0))))


def nav_similarity_weighted(assets: DataFrame, matches: DataFrame, as_of: str, key: str = "asset_id") -> DataFrame:
    """NAV from the matched sales with quartile band, confidence, momentum and mispricing score.

    `assets` carries current_market_cap_usd, offering_market_cap_usd, bid and ask. `matches` carries the sales' source_confidence and estimates, for
    each asset, or for each value of another `key` of the assets: those that match alike are then valued once, in one pass.
    """
    m = matches.withColumn("conf", F.coalesce("source_confidence", F.lit(0.5)))
    mid = (F.col("estimate_low_usd") + F.col("estimate_high_usd")) / 2
    w = F.col("similarity_score") * F.col("conf") * F.when(mid.isNotNull(), 1.1).otherwise(1.0)
    price = F.col("realized_price_usd")
    q = {k: F.percentile(price, F.lit(v)) for k, v in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    a = m.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), ratio(F.sum(price * w), F.sum(w)).alias("weighted"), q["median"].alias("median_comp_sale_usd"),
        F.avg(price).alias("mean_comp_sale_usd"), q["q1"].alias("q1"), q["q3"].alias("q3"), F.min(price).alias("lo"), F.max(price).alias("hi"),
        F.avg("similarity_score").alias("sim"), F.avg("conf").alias("conf"), *[momentum(as_of, days).alias(f"momentum_{days}d") for days in (90, 180, 365)])
    d = assets.join(merged(a), key, "left")
    n = F.coalesce("n", F.lit(0))
    nav = falsy_or("weighted", "median_comp_sale_usd", "mean_comp_sale_usd")
    conf = F.when(n > 0, F.least(F.lit(0.95), F.col("sim") * F.col("conf") * F.least(F.lit(1.0), n / 5))).otherwise(0.0)
    discount = change("current_market_cap_usd", F.nullif(nav, F.lit(0.0)))
    spread = F.when(F.col("ask") >= F.col("bid"), ratio(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2))
    liquidity = F.greatest(F.lit(0.1), F.least(F.lit(0.9), 0.65 - falsy_or(spread, F.lit(0.20))))
    d = d.withColumns({"comp_count": n, "estimated_nav_usd": nav, "nav_confidence": conf, "discount": discount, "liquidity_score": liquidity,
                       "nav_low_usd": F.when(n >= 4, F.col("q1")).otherwise(F.col("lo")), "nav_high_usd": F.when(n >= 4, F.col("q3")).otherwise(F.col("hi")),
                       "premium_to_offering": change("current_market_cap_usd", "offering_market_cap_usd")})
    gap = F.coalesce("discount", F.lit(0.0))
    cheap, dear = F.greatest(F.lit(0.0), -gap), F.greatest(F.lit(0.0), gap) * 0.25
    raw = cheap * 70 + F.col("nav_confidence") * 25 + F.col("liquidity_score") * 5 - dear * 30
    return d.withColumn("mispricing_score", F.when((n > 0) & (F.col("estimated_nav_usd") != 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).otherwise(0.0))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Left-inverse weighted quantiles: the first value whose cumulative weight share reaches q. Equal values collapse first."""
    flat = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    total = flat.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = flat.withColumn("_c", F.sum("_w").over(order)).join(total, keys)
    # the tolerance keeps a share of exactly q on the left side whatever order the weights were added in
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("_c") / F.col("_t") >= q - 1e-12, F.col("_v"))).alias(name) for name, q in qs.items()])


# --- research documents -------------------------------------------------------------------

def research_evidence(comps: DataFrame, valuation_date: str) -> DataFrame:
    """Each researched sale with USD price, similarity, exclusion reasons and weight."""
    day = F.lit(valuation_date).cast("date")
    rate = F.create_map(*[x for k, v in FX_RATES.items() for x in (F.lit(k), F.lit(v))])[F.upper("currency")]
    usd = F.coalesce("price_usd", F.col("reported_price") * F.col("fx_rate_to_usd"), F.col("reported_price") * rate)
    source = (F.when(F.col("price_usd").isNotNull(), "research_price_usd").when(F.col("reported_price").isNull(), None)
              .when(F.col("fx_rate_to_usd").isNotNull(), "research_supplied_fx_rate").when(F.upper("currency") == "USD", "reported_usd_price")
              .when(rate.isNotNull(), "configured_fx_rate"))
    parts = {k: F.col(f"similarity_scores.{k}") for k in COMPONENT_WEIGHTS}
    known = sum((F.when(c.isNotNull(), COMPONENT_WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    blended = sum((F.coalesce(c, F.lit(0.0)) * COMPONENT_WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    similarity = F.coalesce("overall_similarity", ratio(blended, F.nullif(known, F.lit(0.0))), F.lit(0.5))
    c = comps.withColumns({"usd_price": usd, "conversion_source": source, "similarity": similarity})
    years = F.coalesce(F.greatest(F.lit(0.0), F.datediff(day, "sale_date") / 365.25), F.lit(0.0))
    recency = F.greatest(F.lit(RECENCY_FLOOR), 1 - F.least(years / MAX_YEARS, F.lit(1.0)))
    reasons = rule_names({
        "not_sold": F.coalesce(F.col("sale_status") != "sold", F.lit(True)), "missing_usd_normalized_price": F.col("usd_price").isNull(),
        "future_sale_date": F.col("sale_date") > day, "low_similarity": F.col("similarity") < MIN_SIMILARITY,
        "low_evidence_quality": F.col("evidence_quality") < MIN_EVIDENCE,
        "analyst_marked_ineligible": F.coalesce(~F.col("eligible_for_official_valuation"), F.lit(False))})
    weight = F.col("similarity") * F.coalesce("evidence_quality", F.lit(0.5)) * recency * F.when(F.col("verified"), 1.0).otherwise(UNVERIFIED_WEIGHT)
    return c.withColumns({"reasons": reasons}).withColumns({"included": F.size("reasons") == 0, "weight": F.when(F.size("reasons") == 0, weight).otherwise(0.0)})


def research_valuation(evidence: DataFrame, factors: DataFrame) -> DataFrame:
    """Weighted quartile values, dispersion, confidence and status of each researched asset.

    `factors` carries asset_id, has_condition and has_history.
    """
    # evidence may be dear to make: it is read once, and equal prices of an asset collapse first
    priced = evidence.groupBy("asset_id", F.col("usd_price").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("included").alias("_in"), F.sum(F.when(F.col("verified"), 0).otherwise(1)).alias("_unv"),
        F.sum(F.when(F.col("included") & (F.col("weight") > 0), F.col("weight")).otherwise(0.0)).alias("_w"), F.max("sale_date").alias("_last"))
    asset = Window.partitionBy("asset_id")
    share = ratio(F.sum("_w").over(asset.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), F.nullif(F.sum("_w").over(asset), F.lit(0.0)))
    counts = F.col("_w") > 0
    a = priced.withColumn("_s", share).groupBy("asset_id").agg(
        F.sum("_n").alias("raw_count"), F.sum("_in").alias("eligible_count"), (F.sum("_unv") / F.sum("_n")).alias("unverified"),
        ratio(F.sum(F.col("_v") * F.col("_w")), F.nullif(F.sum("_w"), F.lit(0.0))).alias("weighted_value"),
        F.max(F.when(F.col("_in") > 0, F.col("_v"))).alias("hi"), F.min(F.when(F.col("_in") > 0, F.col("_v"))).alias("lo"), F.max("_last").alias("last_sale_date"),
        # the tolerance keeps a share of exactly q on the left side whatever order the weights were added in
        *[F.min(F.when(counts & (F.col("_s") >= q - 1e-12), F.col("_v"))).alias(name) for name, q in {"conservative": 0.25, "base": 0.5, "optimistic": 0.75}.items()])
    j = a.join(factors, "asset_id", "left")
    n = F.col("eligible_count")
    dispersion = ratio(F.col("hi") - F.col("lo"), F.nullif("base", F.lit(0.0)))
    wide = F.coalesce(dispersion > EXTREME_DISPERSION, F.lit(False))
    condition, past = F.coalesce("has_condition", F.lit(False)), F.coalesce("has_history", F.lit(False))
    penalties = {"one_comparable": n == 1, "most_unverified": F.col("unverified") > 0.5, "extreme_dispersion": wide,
                 "missing_condition": ~condition, "missing_history": ~past}
    lost = sum((F.when(cond, CONFIDENCE_PENALTIES[k]).otherwise(0.0) for k, cond in penalties.items()), F.lit(0.0))
    official = n >= MIN_COMPS
    status = F.when(~official, "insufficient_evidence").when(~condition, "completed_with_limitations").otherwise("completed")
    return j.select(
        "asset_id", "raw_count", "eligible_count", status.alias("valuation_status"), *[F.when(official, F.col(c)).alias(f"{c}_value_usd") for c in
                                                                                    ("conservative", "base", "optimistic")],
        F.col("weighted_value").alias("weighted_comparable_value_usd"), dispersion.alias("dispersion_pct"),
        clip(F.when(n > 0, CONFIDENCE_BASE).otherwise(0.0) - lost).alias("confidence_score"), "last_sale_date")


# --- normalisation of imported sales ------------------------------------------------------

HANDBAG_EXACTNESS = {"brand": 0.15, "model": 0.20, "size": 0.10, "material": 0.08, "condition": 0.07, "color": 0.03, "provenance": 0.02}
WATCH_EXACTNESS = {"brand": 0.12, "reference": 0.25, "year": 0.08, "configuration": 0.08, "condition": 0.07, "box_papers": 0.03, "venue_quality": 0.02}


def exactness(df: DataFrame, weights: dict[str, float]) -> Column:
    """0.35 plus the weight of every attribute that is filled in."""
    present = [F.when(blank_to_null(F.col(f).cast("string")).isNotNull(), w).otherwise(0.0) for f, w in weights.items() if f in df.columns]
    return clip(sum(present, F.lit(0.35)))


def source_confidence(df: DataFrame) -> Column:
    url, venue, source = (first_nonblank(c) if c in df.columns else F.lit(None).cast("string") for c in ("source_url", "venue_quality", "source"))
    given = F.col("source_confidence") if "source_confidence" in df.columns else F.lit(None).cast("double")
    return F.coalesce(clip(given), F.when(url.isNotNull() & F.lower(venue).isin("high", "auction", "verified"), 0.85)
                      .when(url.isNotNull() | source.isNotNull(), 0.70).otherwise(0.45))


def text_category(text: Column) -> Column:
    t = F.lower(text)
    return (F.when(t.rlike("rolex|patek|audemars|daytona|watch"), "watches")
            .when(t.rlike("hermes|hermès|birkin|kelly|chanel|handbag|bag"), "handbags").otherwise("other"))


def normalize_sales(raw: DataFrame, source: str, cap: Column, weights: dict[str, float], price_type: Column) -> DataFrame:
    """A source's rows as common comparable sales; rows without price, date or link are marked for quarantine."""
    price = F.coalesce(*[F.col(c) for c in ("realized_price_usd", "price_usd", "sale_price", "list_price_usd", "ask_price_usd") if c in raw.columns])
    date = F.coalesce(*[F.col(c) for c in ("date", "sale_date", "listing_date") if c in raw.columns])
    link = first_nonblank(*[c for c in ("source_url", "lot_url", "listing_url") if c in raw.columns])
    missing = rule_names({"missing_price": price.isNull(), "missing_date": date.isNull(), "missing_source_url": link.isNull()})
    return raw.withColumns({
        "source": F.lit(source), "source_url": link, "sale_on": date, "price": price, "exactness": exactness(raw, weights),
        "confidence": F.least(source_confidence(raw), cap), "price_type": price_type, "rejection_reasons": F.array_join(missing, "; ")})


def comp_market_medians(comps: DataFrame, keys: list[str]) -> DataFrame:
    return exact_quantiles(comps, keys, "realized_price_usd", {"median_price": 0.5})
