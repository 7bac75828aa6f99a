"""Asset universes, exits, and market-capitalisation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import any_of, blank_to_null, change, falsy_or, first_nonblank, fold_text, ratio, rule_names
from tessera.operators import series as S

# Raw status spellings and their canonical state.
STATUS_GROUPS = {
    "active_tradable": ["trading", "active", "active_tradable", "accepting_orders", "listed", "live"],
    "trading_paused": ["paused", "trading_paused", "halted", "buyout_pending"],
    "exited": ["sold", "redeemed", "liquidated", "exited", "delisted", "buyout"],
    "pending_settlement": ["pending_settlement", "pending_approval"],
    "exit_announced": ["exit_announced", "sale_announced", "exit_pending"],
    "cancelled": ["cancelled", "cancelled_exit"],
    "withdrawn": ["withdrawn"],
    "funded": ["funded", "sold_out"],
    "offering_open": ["offering_open", "accepting_investments"],
    "offering_closed": ["offering_closed"],
    "announced": ["announced"],
}
EXIT_TYPES = ["buyout", "asset_sale", "redemption", "liquidation", "delisting", "issuer_repurchase", "auction_sale",
              "private_sale", "other", "distribution", "unknown"]
EXIT_STATES = ["active", "exit_announced", "pending_approval", "pending_settlement", "settled", "exited", "cancelled_exit", "unknown"]
EXIT_AWARE = ["active_tradable", "trading_paused", "exit_announced", "pending_settlement", "exited"]
SAMPLE_TERMS = ["fixture", "sample", "demo", "mock", "placeholder", "synthetic", "example"]


def canonical_status(raw: Column | str) -> Column:
    key = F.regexp_replace(F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw)), "[ -]", "_")
    out = F.lit(None).cast("string")
    for state, names in STATUS_GROUPS.items():
        out = F.when(key.isin(names), state).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def is_production(columns: list[str], environment: Column | None = None) -> Column:
    """False for fixture and demo rows, found by environment or by a term in any text column."""
    text = F.lower(F.concat_ws(" ", *columns))
    sample = text.rlike("|".join(SAMPLE_TERMS))
    if environment is None:
        return ~sample
    env = F.lower(F.trim(environment))
    return ~sample & (env.isNull() | env.isin("", "nan", "none", "<na>", "production"))


# --- exits --------------------------------------------------------------------------------

# For every field of an exit event the columns that may hold it, best first.
EXIT_DATE_FIELDS = {
    "exit_announcement_date": ["exit_announcement_date", "announcement_date", "sale_date"],
    "last_trading_date": ["last_trading_date", "sale_date"],
    "exit_valuation_date": ["exit_valuation_date", "valuation_date", "sale_date"],
    "exit_effective_date": ["exit_effective_date", "effective_date", "sale_date"],
    "settlement_date": ["settlement_date", "sale_date"],
}
EXIT_NUMBER_FIELDS = {
    "exit_price_per_share": ["exit_price_per_share", "terminal_price", "payout_per_share"],
    "exit_total_value": ["exit_total_value", "exit_value_total", "sale_price", "terminal_value"],
    "shares_at_exit": ["shares_at_exit", "share_count", "shares"],
    "last_observed_price_before_exit": ["last_observed_price_before_exit"],
}
EXIT_TEXT_FIELDS = {
    "exit_type": ["exit_type", "type"], "exit_status": ["exit_status", "status"], "is_confirmed": ["is_confirmed"],
    "payout_source": ["payout_source", "source_url", "source_reference"], "source_reference": ["source_reference", "source_url"],
    "notes": ["notes"], "data_quality_flag": ["data_quality_flag"],
}
EXIT_STEPS = ["announced", "trading_ended", "pending_settlement", "settled"]


def exit_dates(exits: DataFrame) -> dict[str, Column]:
    """The authored dates of raw exit rows; a missing one is the sale date."""
    return {name: _first_of(exits, sources, "date") for name, sources in EXIT_DATE_FIELDS.items()}


def _first_of(df: DataFrame, names: list[str], kind: str) -> Column:
    found = [blank_to_null(F.col(n).cast("string")).try_cast(kind) if df.schema[n].dataType.typeName() == "string" else F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def linked_exits(exits: DataFrame, assets: DataFrame) -> DataFrame:
    """Exit rows with the asset their series name stands for where they name none."""
    if "asset_id" not in exits.columns:
        exits = exits.withColumn("asset_id", F.lit(None).cast(assets.schema["asset_id"].dataType))
    own = F.col("asset_id")
    if exits.schema["asset_id"].dataType.typeName() == "string":
        own = F.when(~F.lower(F.trim(own)).isin("", "nan", "none", "<na>"), own)
    if "series_name" not in exits.columns:
        return exits.withColumn("asset_id", own)
    tickers = assets.groupBy(F.trim(F.replace(F.upper("ticker"), F.lit("#"), F.lit(""))).alias("_ticker")).agg(F.min("asset_id").alias("_linked"))
    series = F.trim(F.replace(F.regexp_replace(F.upper("series_name"), "SERIES", ""), F.lit("#"), F.lit("")))
    rows = exits.withColumn("_series", F.when(own.isNull(), series)).join(tickers, F.col("_series") == F.col("_ticker"), "left")
    return rows.withColumn("asset_id", F.coalesce(own, "_linked")).drop("_series", "_ticker", "_linked")


def normalize_exits(exits: DataFrame, assets: DataFrame, prices: DataFrame) -> DataFrame:
    """Canonical exit events, several per asset where several are known, with all authored dates, the terminal price hierarchy, and
    premium, return and quality columns.

    Terminal price: confirmed per-share payout, else confirmed total over shares, else the last traded price on or
    before the last trading date. `standing_exits` chooses the event that counts for an asset.
    """
    rows = linked_exits(exits, assets)
    text = {name: _first_of(rows, sources, "string") for name, sources in EXIT_TEXT_FIELDS.items()}
    kind = F.lower(F.coalesce(text["exit_type"], F.lit("other")))
    kind = F.when(kind == "buyout_offer", "buyout").when(kind == "sale", "asset_sale").otherwise(kind)
    state = F.lower(F.coalesce(text["exit_status"], F.lit("settled")))
    numbers = {name: _first_of(rows, sources, "double") for name, sources in EXIT_NUMBER_FIELDS.items()}
    e = rows.select(
        "asset_id", F.when(kind.isin(EXIT_TYPES), kind).otherwise("other").alias("exit_type"), F.when(state.isin(EXIT_STATES), state).otherwise("unknown").alias("exit_status"),
        *[c.alias(name) for name, c in exit_dates(rows).items()], *[c.alias(f"_{name}" if name in ("shares_at_exit", "last_observed_price_before_exit") else name) for name, c in numbers.items()],
        F.lower(F.coalesce(text["is_confirmed"], F.lit("true"))).isin("true", "1", "yes", "y").alias("_said"),
        *[F.coalesce(text[name], F.lit("")).alias(name) for name in ("payout_source", "source_reference", "notes", "data_quality_flag")])
    e = e.withColumn("_cutoff", F.coalesce("last_trading_date", "exit_effective_date"))
    cutoffs = e.filter("asset_id IS NOT NULL AND _cutoff IS NOT NULL").select("asset_id", F.col("_cutoff").alias("date")).distinct()
    traded = S.asof_backward(prices.filter("price > 0"), cutoffs, ["asset_id"], ["price"]).select("asset_id", F.col("date").alias("_cutoff"), F.col("price").alias("_traded"))
    master = assets.select("asset_id", "ticker", "category", F.col("share_count").alias("_shares"), "offering_price_usd", "offering_date")
    joined = e.join(master, "asset_id", "left").join(traded, ["asset_id", "_cutoff"], "left")
    joined = joined.withColumn("shares_at_exit", F.coalesce("_shares_at_exit", "_shares")).withColumn("last_observed_price_before_exit", F.coalesce("_last_observed_price_before_exit", "_traded"))
    confirmed = F.col("_said") & (F.col("exit_status") != "cancelled_exit")
    per_share = confirmed & (F.col("exit_price_per_share") > 0)
    from_total = confirmed & (F.col("exit_total_value") > 0) & (F.col("shares_at_exit") > 0)
    from_trade = confirmed & (F.col("last_observed_price_before_exit") > 0)
    terminal = (F.when(per_share, F.col("exit_price_per_share"))
                .when(from_total, ratio("exit_total_value", "shares_at_exit"))
                .when(from_trade, F.col("last_observed_price_before_exit")))
    source = (F.when(per_share, "confirmed_per_share_payout").when(from_total, "confirmed_total_payout_divided_by_shares")
              .when(from_trade, "last_valid_secondary_market_price").otherwise("missing"))
    fallback = F.col("terminal_price_source") == "last_valid_secondary_market_price"
    years = F.datediff("exit_effective_date", "offering_date") / 365.25
    return (
        joined.withColumn("is_confirmed", confirmed).withColumn("terminal_price", terminal)
        .withColumn("terminal_price_source", source)
        .withColumn("terminal_price_quality", F.when(F.col("terminal_price_source") == "missing", "blocking").when(fallback, "fallback").otherwise("confirmed"))
        .withColumn("data_quality_flag", F.when(fallback, F.concat("data_quality_flag", F.lit(";terminal_price_fallback_last_trade"))).otherwise(F.col("data_quality_flag")))
        .withColumn("last_observed_market_cap_before_exit", F.col("last_observed_price_before_exit") * F.col("shares_at_exit"))
        .withColumn("terminal_value", F.col("terminal_price") * F.col("shares_at_exit"))
        .withColumn("terminal_return", change("terminal_price", "last_observed_price_before_exit"))
        .withColumn("exit_premium_vs_last_trade", F.col("terminal_return"))
        .withColumn("exit_return_vs_offering", change("terminal_price", "offering_price_usd"))
        .withColumn("annualized_exit_return", F.when(years > 0, F.pow(1 + F.col("exit_return_vs_offering"), 1 / years) - 1))
        .drop("_cutoff", "_shares", "_shares_at_exit", "_last_observed_price_before_exit", "_traded", "_said")
    )


def standing_exits(events: DataFrame) -> DataFrame:
    """The exit event that counts for each asset: the earliest that was not cancelled, else the earliest. Events of one day go by
    settlement, type and price."""
    day = F.datediff("exit_effective_date", F.lit("1970-01-01").cast("date"))
    live = (F.col("exit_status") != "cancelled_exit").cast("int")
    settled = F.datediff("settlement_date", F.lit("1970-01-01").cast("date"))
    return S.keep_last(events.filter("asset_id IS NOT NULL"), ["asset_id"], [live, -day, -settled, "exit_type", "terminal_price"])


def live_exits(events: DataFrame) -> DataFrame:
    """The exit that removes each asset, if one does."""
    return standing_exits(events.filter("exit_status <> 'cancelled_exit' AND exit_effective_date IS NOT NULL"))


def exit_states(events: DataFrame) -> DataFrame:
    """State intervals of every asset with an exit event: asset_id, state, from_date, to_date (exclusive, null while it lasts).

    Each event covers its steps from announcement to settlement; a cancelled one is announced until the day it would have taken effect.
    Where events overlap the furthest step counts; where none holds the asset trades. One running count per step, so work is linear
    in the events.
    """
    announced, ended, effective, settled = (F.col(c) for c in ("exit_announcement_date", "last_trading_date", "exit_effective_date", "settlement_date"))
    bounds = {"announced": (announced, F.least(ended, effective)), "trading_ended": (F.least(ended, effective), effective), "pending_settlement": (effective, F.greatest(effective, settled)),
              "settled": (F.greatest(effective, settled), F.lit(None).cast("date"))}
    live = F.col("exit_status") != "cancelled_exit"
    steps = []
    for rank, step in enumerate(EXIT_STEPS):
        start, end = bounds[step]
        if step == "announced":
            end = F.when(live, end).otherwise(effective)
        held = start.isNotNull() & (end.isNull() | (start < end)) & (F.lit(True) if step == "announced" else live)
        steps += [F.when(held, F.struct(start.alias("date"), F.lit(rank).alias("rank"), F.lit(1).alias("delta"))),
                  F.when(held & end.isNotNull(), F.struct(end.alias("date"), F.lit(rank).alias("rank"), F.lit(-1).alias("delta")))]
    moves = events.filter("asset_id IS NOT NULL AND exit_effective_date IS NOT NULL").select("asset_id", F.inline(F.array_compact(F.array(*steps))))
    days = moves.groupBy("asset_id", "date").agg(*[F.sum(F.when(F.col("rank") == r, F.col("delta")).otherwise(0)).alias(f"_{r}") for r in range(len(EXIT_STEPS))])
    w, running = S.over("asset_id"), S.over("asset_id").rowsBetween(Window.unboundedPreceding, 0)
    state = F.lit("trading")
    for r, step in enumerate(EXIT_STEPS):
        state = F.when(F.sum(f"_{r}").over(running) > 0, step).otherwise(state)
    changes = days.select("asset_id", "date", state.alias("state")).withColumn("_before", F.lag("state").over(w)).filter("_before IS NULL OR _before <> state")
    return changes.select("asset_id", "state", F.col("date").alias("from_date"), F.lead("date").over(w).alias("to_date"))


# --- market-cap history -------------------------------------------------------------------

def with_offering_prices(quotes: DataFrame, assets: DataFrame) -> DataFrame:
    """Quotes plus one offering-price row per asset; a quote on the offering date wins."""
    quoted = quotes.select("asset_id", "date", "price", (F.col("event_type") != "offering_price").alias("is_direct"),
                           F.lit(1).alias("rank"))
    offered = assets.select("asset_id", F.col("offering_date").alias("date"), F.col("offering_price_usd").alias("price"),
                            F.lit(False).alias("is_direct"), F.lit(0).alias("rank"))
    # placed by asset, so that the steps per asset that follow need no further shuffle
    return S.keep_last(quoted.unionByName(offered).repartition("asset_id"), ["asset_id", "date"], ["rank"]).drop("rank")


def exchange_asset_history(assets: DataFrame, quotes: DataFrame, exits: DataFrame, as_of: str, frequency: str = "quarter",
                           stale_days: int = 120, start: str | None = None) -> DataFrame:
    """Market cap of every asset on a calendar grid from its offering to its exit, without look-ahead.

    Each asset expands its own part of the calendar, so there is no asset x date cross join and no range join.
    """
    master = assets.filter("share_count > 0 AND offering_price_usd > 0 AND offering_date IS NOT NULL").select(
        "asset_id", "ticker", "name", F.coalesce("category", F.lit("unknown")).alias("category"), "share_count", "offering_date",
        "offering_price_usd")
    gone = live_exits(exits).select("asset_id", F.col("exit_effective_date").alias("exit_date"), "terminal_price", "terminal_price_source")
    end = F.lit(as_of).cast("date")
    begin = F.col("offering_date") if start is None else F.greatest("offering_date", F.lit(start).cast("date"))
    spans = master.join(gone, "asset_id", "left").withColumn("_end", F.least(F.coalesce("exit_date", end), end))
    grid = spans.filter(begin <= F.col("_end")).select(
        *[c for c in spans.columns if c != "_end"], F.explode(S.period_array(begin, F.col("_end"), frequency)).alias("date"))
    h = S.asof_backward(with_offering_prices(quotes, master), grid, ["asset_id"], ["price", "is_direct"])
    w = S.over("asset_id")
    upto_end = Window.partitionBy("asset_id")
    age = F.datediff("date", "effective_date")
    cap = F.col("price") * F.col("share_count")
    first = F.row_number().over(w) == 1
    leaving = F.col("exit_date").isNotNull() & (F.col("date") == F.max("date").over(upto_end))
    return (
        h.withColumn("observation_age_days", age)
        .withColumn("is_direct_observation", (age == 0) & F.col("is_direct"))
        .withColumn("price_source", F.when(F.col("is_direct_observation"), "observed_price")
                    .when(age == 0, "offering_price").otherwise("carried_forward"))
        .withColumn("is_stale", age > stale_days)
        .withColumn("full_market_cap", cap)
        .withColumn("previous_price", F.lag("price").over(w))
        .withColumn("asset_return", change("price", "previous_price"))
        .withColumn("new_issuance", F.when(first, cap).otherwise(0.0))
        .withColumn("price_effect", F.when(first, 0.0).otherwise((F.col("price") - F.col("previous_price")) * F.col("share_count")))
        .withColumn("is_exit_effective_date", leaving)
        .withColumn("removed_capital", F.when(leaving, cap).otherwise(0.0))
        .withColumn("market_cap", F.when(leaving, 0.0).otherwise(cap))
        .drop("is_direct")
    )


def exchange_totals(history: DataFrame, keys: list[str] | None = None, exact: dict[str, Column] | None = None) -> DataFrame:
    """Per-date (and per-key) sums of an asset history; one combinable aggregate, with further named aggregates in `exact`."""
    direct, carried = F.col("is_direct_observation"), F.col("price_source") == "carried_forward"
    return history.groupBy(*(keys or []), "date").agg(
        F.sum("market_cap").alias("total_market_cap"), F.count(F.lit(1)).alias("active_asset_count"),
        F.count_if(direct).alias("direct_observation_asset_count"), F.count_if(carried).alias("carried_forward_asset_count"),
        F.count_if(F.col("is_stale")).alias("stale_asset_count"),
        F.percentile("observation_age_days", F.lit(0.5)).alias("median_observation_age_days"),
        F.max("observation_age_days").alias("max_observation_age_days"),
        F.sum(F.when(direct, F.col("market_cap")).otherwise(0.0)).alias("direct_observation_market_cap"),
        F.sum(F.when(carried, F.col("market_cap")).otherwise(0.0)).alias("carried_forward_market_cap"),
        F.sum("new_issuance").alias("new_issuance"), F.sum("price_effect").alias("price_effect"),
        F.sum("removed_capital").alias("removed_capital"), F.avg("asset_return").alias("mean_asset_return"),
        F.count_if(F.col("new_issuance") > 0).alias("assets_added_count"), *[c.alias(name) for name, c in (exact or {}).items()])


def exchange_total_history(history: DataFrame, base: float = 100.0, tolerance: float = 0.01) -> DataFrame:
    """Flow-adjusted market index with reconciliation; the windows run over one row per date. What is reconciled is summed as decimals: sums of
    doubles are off by more than the tolerance in large markets, by the order they are taken in."""
    exact = {c: F.sum(F.col(c).cast("decimal(28,8)")) for c in ("market_cap", "price_effect", "new_issuance", "removed_capital")}
    t = exchange_totals(history, exact={"exact_cap": exact["market_cap"], "exact_change": exact["price_effect"] + exact["new_issuance"] - exact["removed_capital"]})
    t = t.withColumn("_all", F.lit("all"))
    w, upto = S.over("_all"), S.running("_all")
    flow = F.col("new_issuance") - F.col("removed_capital")
    t = (
        t.withColumn("prior_market_cap", F.coalesce(F.lag("total_market_cap").over(w), F.lit(0.0)))
        .withColumn("net_external_flow", flow)
        .withColumn("period_return", F.when(F.col("prior_market_cap") > 0, change(
            F.col("total_market_cap") - flow, "prior_market_cap")).otherwise(0.0))
        .withColumn("return_index", S.compounded("period_return", upto, base))
        .withColumn("equal_weighted_index", S.compounded("mean_asset_return", upto, base))
        .withColumn("cumulative_invested_capital", F.sum("net_external_flow").over(upto))
        .withColumn("cumulative_flow_adjusted_pl", F.col("total_market_cap") - F.col("cumulative_invested_capital"))
        .withColumn("drawdown", change("return_index", F.max("return_index").over(upto)))
        .withColumn("direct_coverage_pct", ratio("direct_observation_market_cap", F.nullif("total_market_cap", F.lit(0.0))))
        .withColumn("carried_forward_coverage_pct", ratio("carried_forward_market_cap", F.nullif("total_market_cap", F.lit(0.0))))
        .withColumn("reconciliation_difference", (F.col("exact_cap") - F.coalesce(F.lag("exact_cap").over(w), F.lit(0)) - F.col("exact_change")).cast("double"))
        .withColumn("reconciles", F.abs("reconciliation_difference") <= tolerance)
    )
    return t.drop("_all", "exact_cap", "exact_change")


def exchange_category_history(history: DataFrame, base: float = 100.0) -> DataFrame:
    c = exchange_totals(history, ["category"])
    total = c.groupBy("date").agg(F.sum("total_market_cap").alias("_total"))
    prior = F.coalesce(F.lag("total_market_cap").over(S.over("category")), F.lit(0.0))
    c = c.join(total, "date").withColumn("category_weight", ratio("total_market_cap", F.nullif("_total", F.lit(0.0))))
    c = c.withColumn("prior_category_market_cap", prior).withColumn("period_return", F.when(prior > 0, change(
        F.col("total_market_cap") - F.col("new_issuance") + F.col("removed_capital"), prior)).otherwise(0.0))
    return c.withColumn("return_index", S.compounded("period_return", S.running("category"), base)).drop("_total")


def exchange_additions(history: DataFrame) -> DataFrame:
    """Assets that joined the exchange on each date, one labelled row each (not one growing string per date)."""
    label = F.concat(F.coalesce("ticker", F.col("asset_id").cast("string")), F.lit(" — "), F.col("name"), F.lit(" ($"),
                     F.format_number(F.round("new_issuance"), 0), F.lit(")"))
    return history.filter("new_issuance > 0").select("date", "asset_id", label.alias("label"))


def performance_summary(total: DataFrame, factor: int) -> DataFrame:
    agg = total.groupBy().agg(
        F.max_by("return_index", "date").alias("last"), F.min_by("return_index", "date").alias("first"),
        F.count("period_return").alias("n"), F.stddev_pop("period_return").alias("sd"), F.min("drawdown").alias("max_drawdown"),
        F.max_by("drawdown", "date").alias("current_drawdown"))
    years = F.greatest(F.col("n") / factor, F.lit(1 / factor))
    many = F.col("n") > 1
    gain = change("last", "first")
    return agg.select(
        gain.alias("since_inception_return"), F.when(many, F.pow(1 + gain, 1 / years) - 1).alias("annualized_return"),
        F.when(many, F.col("sd") * factor**0.5).alias("annualized_volatility"), "max_drawdown", "current_drawdown")


# --- universes ----------------------------------------------------------------------------

def asset_universe(assets: DataFrame, quotes: DataFrame, as_of: str, include_exited: bool = False,
                   require_prices: bool = True, weighting: str = "equal") -> DataFrame:
    """Eligibility of every asset with the reasons that exclude it."""
    cutoff = F.lit(as_of).cast("date")
    history = quotes.filter(F.col("date") <= cutoff).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("history_row_count"), F.min("date").alias("first_observation_date"),
        F.max("date").alias("last_observation_date"), (F.max("cap") > 0).alias("has_market_cap_history"))
    out = (
        assets.join(history, "asset_id", "left")
        .withColumn("canonical_status", canonical_status("status"))
        .withColumn("is_production_asset", is_production(["asset_id", "ticker", "name"]))
        .withColumn("history_row_count", F.coalesce("history_row_count", F.lit(0)))
        .withColumn("has_price_history", F.col("history_row_count") > 0)
        .withColumn("has_market_cap_history", F.coalesce("has_market_cap_history", F.lit(False)))
        .withColumn("entered_by_as_of_date", F.coalesce(F.col("offering_date") <= cutoff, F.lit(False)))
    )
    allowed = F.col("canonical_status").isin(EXIT_AWARE if include_exited else ["active_tradable"])
    rules = {
        "not_production_asset": ~F.col("is_production_asset"),
        ("status_not_supported" if include_exited else "status_excluded_active_only"): ~allowed,
        "not_entered_by_as_of_date": ~F.col("entered_by_as_of_date"),
    }
    if require_prices:
        rules["missing_price_history"] = ~F.col("has_price_history")
    if weighting == "market_cap":
        rules["missing_market_cap_history"] = ~F.col("has_market_cap_history")
    reasons = rule_names(rules)
    return (
        out.withColumn("is_universe_eligible", F.size(reasons) == 0)
        .withColumn("exclusion_reason", F.when(F.size(reasons) == 0, "included").otherwise(F.array_join(reasons, "|")))
    )


def current_universe(assets: DataFrame, history: DataFrame, as_of: str, max_age: int = 120) -> DataFrame:
    """The newest slice of the exchange history joined to the master, with tradable and represented flags."""
    upto = history.filter(F.col("date") <= F.lit(as_of).cast("date"))
    newest = upto.agg(F.max("date").alias("date"))
    latest = upto.join(newest, "date", "left_semi").drop("ticker", "name", "category", "share_count", "offering_date",
                                                         "offering_price_usd", "exit_date")
    out = latest.join(assets, "asset_id").withColumn("canonical_status", canonical_status("status"))
    out = out.withColumn("canonical_market_cap", F.col("price") * F.col("share_count")).withColumn(
        "is_production_asset", is_production(["asset_id", "ticker", "name"]))
    tradable = (F.col("is_production_asset") & (F.col("canonical_status") == "active_tradable")
                & (F.col("observation_age_days") <= max_age) & (F.col("price_source") != "offering_price")
                & F.col("price").isNotNull() & F.col("share_count").isNotNull())
    return out.withColumn("is_current_tradable", F.coalesce(tradable, F.lit(False))).withColumn(
        "is_represented_asset", F.col("is_production_asset") & F.col("canonical_status").isin(
            "active_tradable", "trading_paused", "pending_settlement"))


def current_summary(universe: DataFrame) -> DataFrame:
    return universe.groupBy().agg(
        F.max("date").alias("as_of_date"), F.count(F.lit(1)).alias("unique_asset_count"),
        F.count_if("is_current_tradable").alias("tradable_asset_count"),
        F.sum("canonical_market_cap").alias("tradable_market_cap"), F.countDistinct("category").alias("category_count"),
        F.count_if("is_direct_observation").alias("direct_price_count"),
        F.count_if(F.col("price_source") == "carried_forward").alias("carried_forward_count"),
        F.count_if("is_stale").alias("stale_value_count"),
        F.count_if(F.col("canonical_market_cap").isNull()).alias("missing_value_count"))


def asset_master(assets: DataFrame, quotes: DataFrame, as_of: str) -> DataFrame:
    """Normalised master with quality status, derived offering price and return at exit."""
    seen = quotes.groupBy("asset_id").agg(F.max("date").alias("last_quote_observed_at"))
    shares, valuation = F.col("share_count"), F.col("offering_valuation_usd")
    out = assets.join(seen, "asset_id", "left").withColumn("ticker", F.upper(first_nonblank("ticker")))
    out = out.withColumn("offering_price", F.when((shares != 0) & (valuation != 0), ratio(valuation, shares)))
    out = out.withColumn("exit_value_usd", falsy_or(F.col("exit_price_per_share") * shares, F.lit(None).cast("double")))
    out = out.withColumn("total_return_at_exit", F.when(
        (shares != 0) & (F.col("offering_price") != 0) & (F.col("exit_value_usd") != 0),
        ratio(ratio("exit_value_usd", shares), "offering_price") - 1))
    age = F.datediff(F.lit(as_of).cast("date"), "last_quote_observed_at")
    severe = {
        "missing_ticker": F.col("ticker").isNull(), "missing_category": first_nonblank("category").isNull(),
        "missing_share_count": shares.isNull(), "missing_offering_price": F.col("offering_price").isNull(),
    }
    mild = {"missing_quote_snapshot": F.col("last_quote_observed_at").isNull(), "stale_quote_snapshot": age > 30}
    warnings = rule_names({**severe, **mild})
    return out.withColumn("data_quality_status", F.when(F.size(warnings) == 0, "usable")
                          .when(any_of(*severe.values()), "incomplete").otherwise("limited")).withColumn(
        "data_quality_warnings", F.array_join(warnings, "; "))


def asset_returns(quotes: DataFrame) -> DataFrame:
    """One-quarter, one-year and full-history return of each asset from its latest price, one aggregate after the latest date."""
    latest = quotes.groupBy("asset_id").agg(F.max("date").alias("latest"))
    d = quotes.join(latest, "asset_id")

    def back(months: int) -> Column:
        return F.max_by("price", F.when(F.col("date") <= F.add_months("latest", -months), F.col("date")))

    now, start = F.max_by("price", "date"), F.min_by("price", "date")
    return d.groupBy("asset_id").agg(
        change(now, back(3)).alias("return_1q"), change(now, back(12)).alias("return_1y"),
        F.when(F.count(F.lit(1)) >= 2, change(now, start)).alias("return_full_history"))


def liquidity_metrics(assets: DataFrame, quotes: DataFrame, as_of: str, stale_days: int = 14) -> DataFrame:
    w, upto = S.over("asset_id"), S.running("asset_id")
    rows = quotes.withColumn("ret", change("price", F.lag("price").over(w))).withColumn(
        "dd", change("price", F.max("price").over(upto)))
    agg = rows.groupBy("asset_id").agg(
        F.max_by(F.struct("bid", "ask", "price", "cap"), "date").alias("l"), F.sum("volume").alias("volume"),
        F.coalesce(F.max(F.when(F.col("volume") > 0, F.col("date"))), F.min("date")).alias("last_trade"),
        F.count_if(F.col("volume") == 0).alias("days_with_zero_trades"),
        F.coalesce(F.stddev_pop("ret") * 252**0.5, F.lit(0.0)).alias("realized_volatility"), F.min("dd").alias("max_drawdown"))
    mid = (F.col("l.bid") + F.col("l.ask")) / 2
    idle = F.datediff(F.lit(as_of).cast("date"), "last_trade")
    return agg.join(assets.select("asset_id", "share_count", "offering_price_usd"), "asset_id").select(
        "asset_id", ratio(F.col("l.ask") - F.col("l.bid"), F.nullif(mid, F.lit(0.0))).alias("bid_ask_spread_pct"),
        ratio("volume", "share_count").alias("turnover"), idle.alias("days_since_last_trade"), "days_with_zero_trades",
        "realized_volatility", "max_drawdown", change("l.price", "offering_price_usd").alias("return_since_offering"),
        (idle > stale_days).alias("stale_mark_flag"))


def contains_text(columns: list[str], needle: str) -> Column:
    return any_of(*[fold_text(c).contains(needle.strip().lower()) for c in columns])
