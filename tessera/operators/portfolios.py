"""Portfolio simulation without a date loop.

Between rebalances the units of a portfolio are fixed, so its value is the value right after the last rebalance times
the weighted average of the price ratios since then. Each (portfolio, date) factor is one combinable aggregate, and
the level is a running product over the few rebalances of a portfolio.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change, quarter_end, ratio, without_noise
from tessera.operators import series as S
from tessera.operators.market import live_exits, with_offering_prices
from tessera.session import staged


@dataclass(frozen=True)
class PortfolioResult:
    """`series` is the value path; `positions` lists what is held after each date's trades."""

    series: DataFrame
    positions: DataFrame


def price_panel(members: DataFrame, prices: DataFrame, grid: DataFrame, exits: DataFrame | None = None,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per member and grid date from its first price on, with the price a held unit is worth.

    `grid` has one row per date with its rebalance flag and may differ per portfolio (`keys`). Prices off the grid are
    dropped before filling forward. After an exit a unit is worth its terminal price (0 when unknown), as pending money until settlement and as cash afterwards.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    marked = F.when(F.col("is_rebalance"), F.struct(F.col("_at").alias("at"), "date"))
    days = grid.select(*keys, "date", "is_rebalance", F.row_number().over(w).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    days = days.withColumn("_mark", F.last(marked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if exits is not None:
        gone = live_exits(exits).select("asset_id", F.col("exit_effective_date").alias("gone"), "settlement_date",
                                        F.coalesce("terminal_price", F.lit(0.0)).alias("terminal"),
                                        (F.col("exit_status") == "pending_settlement").alias("waits"))
        held = members.join(gone, "asset_id", "left")
    else:
        held = members.withColumns({"gone": F.lit(None).cast("date"), "settlement_date": F.lit(None).cast("date"),
                                    "terminal": F.lit(None).cast("double"), "waits": F.lit(False)})
    # A price holds from its place in the calendar to that of the next one, so rows are shuffled by asset, and their windows run, before
    # they become days. A day's mark, the rebalance before it, lies in its own span or is the one before the span, `_m`.
    priced = prices.filter("price IS NOT NULL").select("asset_id", "date", "price").join(held, "asset_id").join(
        days.select(*keys, "date", "_at", "_n", F.col("_mark.at").alias("_m")), [*keys, "date"]).drop("date")
    own = Window.partitionBy(*keys, "asset_id")
    earlier = F.max_by("price", "_at").over(own.orderBy("_m").rangeBetween(Window.unboundedPreceding, -1))
    spans = priced.withColumn("_next", F.coalesce(F.lead("_at").over(own.orderBy("_at")), F.col("_n") + 1)).withColumn("_earlier", earlier).filter("_next > _at")
    kept = [c for c in spans.columns if c not in ("_n", "_m", "_next")]
    filled = spans.select(*kept, F.explode(F.sequence(F.col("_at").cast("long"), F.col("_next").cast("long") - 1)).alias("_day")).join(
        days.withColumnRenamed("_at", "_day").drop("_n"), [*keys, "_day"])
    filled = filled.withColumn("mark_price", F.when(F.col("_mark.at") >= F.col("_at"), F.col("price")).otherwise(F.col("_earlier")))
    filled = filled.withColumn("mark_date", F.when(F.col("mark_price").isNotNull(), F.col("_mark.date"))).drop("_at", "_day", "_earlier", "_mark")
    return with_worth(filled)


def with_worth(rows: DataFrame) -> DataFrame:
    """What a unit is worth on a date, and whether it is held, pending money or cash."""
    out = F.coalesce(F.col("date") >= F.col("gone"), F.lit(False))
    pending = out & F.coalesce(F.col("waits") & (F.col("date") < F.col("settlement_date")), F.lit(False))
    return rows.withColumn("is_out", out).withColumn("worth", F.when(out, F.col("terminal")).otherwise(F.col("price"))).withColumn(
        "bucket", F.when(pending, "pending").when(out, "cash").otherwise("held"))


def segment_sums(panel: DataFrame, keys: list[str], targets: dict[str, Column]) -> DataFrame:
    """Raw sums per portfolio and date for every weighting, in one pass over the panel and one combinable aggregate.

    The panel carries keys, asset_id, date, worth, bucket and is_rebalance. A target is the raw weight of an asset that
    may be bought on that date, NULL otherwise; sums stay unnormalised, so they add up across portfolios.
    """
    rows = with_holdings(panel, keys, targets)
    sums = []
    for name in targets:
        held = F.col(f"_held.{name}")
        grown = F.when(held > 0, held * F.col("worth") / F.col("_held.p"))
        bought = F.when(F.col("is_rebalance"), F.col(f"_t_{name}"))
        sums.append(F.struct(
            F.lit(name).alias("weighting"), F.sum(bought).alias("target_sum"), F.count_if(bought > 0).alias("bought"), F.sum(grown).alias("grown"),
            F.sum(F.when(F.col("bucket") == "cash", grown)).alias("cash"), F.sum(F.when(F.col("bucket") == "pending", grown)).alias("pending"),
            F.count_if((held > 0) & (F.col("bucket") == "held")).alias("active")))
    flat = rows.groupBy(*keys, "date").agg(F.max("is_rebalance").alias("is_rebalance"), F.array(*sums).alias("_s"))
    return flat.select(*keys, "date", "is_rebalance", F.inline("_s"))


def with_holdings(panel: DataFrame, keys: list[str], targets: dict[str, Column]) -> DataFrame:
    """Each row with the price and raw weights at the last rebalance before it. A panel that carries this date and its price (`mark_date`,
    `mark_price`) is read as it was then; any other one takes them from its earlier rows."""
    raw = {f"_t_{n}": c for n, c in targets.items()}
    weights = [F.coalesce(f"_t_{n}", F.lit(0.0)).alias(n) for n in targets]
    if "mark_date" in panel.columns:
        swap = {"date": "_date", "price": "_price", "mark_date": "date", "mark_price": "price"}
        then = with_worth(panel.withColumnsRenamed(swap)).withColumns(raw)
        held = then.withColumn("_held", F.when(F.col("date").isNotNull(), F.struct(F.col("worth").alias("p"), *weights)))
        now = held.drop("date", "price", *raw).withColumnsRenamed({"_date": "date", "_price": "price"})
        return with_worth(now).withColumns(raw)
    rows = panel.withColumns(raw)
    mark = F.when(F.col("is_rebalance"), F.struct(F.col("worth").alias("p"), *weights))
    before = S.over([*keys, "asset_id"]).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_held", F.last(mark, ignorenulls=True).over(before))


def value_path(sums: DataFrame, keys: list[str], base: float = 100.0, absolute_weights: bool = False) -> DataFrame:
    """Value of each portfolio from its segment sums; the windows run over one row per portfolio and date.

    A rebalance with nothing to buy means that everything held has been paid out, so the value stays as it is.
    """
    prior = S.over(keys).rowsBetween(Window.unboundedPreceding, -1)
    bought = F.coalesce("target_sum", F.lit(0.0))
    rest = F.greatest(F.lit(0.0), 1 - bought) if absolute_weights else F.when(bought > 0, 0.0).otherwise(1.0)
    scale = F.lit(1.0) if absolute_weights else F.when(bought > 0, bought).otherwise(1.0)
    rebalance = F.coalesce("is_rebalance", F.lit(False))
    mark = F.when(rebalance, F.struct(rest.alias("rest"), scale.alias("scale")))
    d = sums.withColumn("_now", mark).withColumn("_seg", F.coalesce(
        F.last("_now", ignorenulls=True).over(prior), F.struct(F.lit(1.0).alias("rest"), F.lit(1.0).alias("scale"))))

    def share(c: str) -> Column:
        return F.coalesce(F.col(c) / F.col("_seg.scale"), F.lit(0.0))

    d = d.withColumn("growth", share("grown") + F.col("_seg.rest"))
    opening = F.coalesce(F.product(F.when(rebalance, F.col("growth")).otherwise(1.0)).over(prior), F.lit(1.0)) * base
    d = d.withColumn("opening", opening).withColumn("value", F.col("opening") * F.col("growth"))
    cash = F.when(rebalance, F.col("value") * F.col("_now.rest")).otherwise(F.col("opening") * (share("cash") + F.col("_seg.rest")))
    return (
        d.withColumn("cash_value", cash)
        .withColumn("pending_value", F.when(rebalance, 0.0).otherwise(F.col("opening") * share("pending")))
        .withColumn("invested_value", F.col("value") - F.col("cash_value") - F.col("pending_value"))
        .withColumn("active_count", F.when(rebalance, F.coalesce("bought", F.lit(0))).otherwise(F.coalesce("active", F.lit(0))))
        .withColumn("period_return", F.coalesce(change("value", F.lag("value").over(S.over(keys))), F.lit(0.0)))
        .withColumn("cumulative_return", F.col("value") / base - 1)
        .withColumn("drawdown", change("value", F.max("value").over(S.running(keys))))
        .withColumn("scale", F.when(rebalance, F.col("_now.scale")).otherwise(F.col("_seg.scale")))
        .withColumn("prior_scale", F.col("_seg.scale")).withColumn("rebalance_flag", rebalance)
        .drop("_now", "_seg", "grown", "cash", "pending", "active", "bought", "is_rebalance", "target_sum")
    )


def held_positions(panel: DataFrame, keys: list[str], target: Column, path: DataFrame) -> DataFrame:
    """Value, units and weight of every position after each date's trades, and its weight just before them."""
    return positions_on(with_holdings(panel, keys, {"w": target}), keys, path)


def positions_on(held: DataFrame, keys: list[str], path: DataFrame) -> DataFrame:
    """Positions from rows with holdings (one target, `w`) and the value path of their portfolios."""
    rows = held.join(path.select(*keys, "date", "value", "opening", "growth", "scale", "prior_scale"), [*keys, "date"])
    old = F.when(F.col("_held.w") > 0, F.col("_held.w") * F.col("worth") / F.col("_held.p") / F.col("prior_scale"))
    now = F.when(F.col("is_rebalance"), F.col("_t_w") / F.col("scale") * F.col("value")).when(
        F.col("bucket") == "held", old * F.col("opening"))
    return (
        rows.withColumn("position_value", now).filter("position_value > 0")
        .withColumn("portfolio_weight", ratio("position_value", "value")).withColumn("units_held", ratio("position_value", "worth"))
        .withColumn("weight_before", ratio(F.coalesce(old, F.lit(0.0)), "growth"))
        .select(*keys, "date", "asset_id", F.col("worth").alias("price"), "units_held", "position_value", "portfolio_weight",
                "weight_before", F.col("is_rebalance").alias("rebalanced"))
    )


def grid_dates(known: DataFrame, frequency: str) -> DataFrame:
    """Distinct simulation dates: period ends between the first and last known date, or every known date."""
    if frequency == "native":
        return known.select("date").distinct()
    bounds = known.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    ends = F.array_distinct(F.concat(S.period_array(F.col("start"), F.col("end"), frequency), F.array("start", "end")))
    return bounds.select(F.explode(ends).alias("date"))


def known_dates(assets: DataFrame, observed: DataFrame, exits: DataFrame) -> DataFrame:
    """Every date the inputs know: offerings, observations, and of all exit events the announcement, the last trading, the effective and
    the settlement date."""
    named = [c for c in ("exit_announcement_date", "last_trading_date", "exit_effective_date", "settlement_date") if c in exits.columns]
    events = exits.select(F.explode(F.array(*named)).alias("date"))
    return assets.select(F.col("offering_date").alias("date")).union(observed.select("date")).union(events).filter("date IS NOT NULL")


@dataclass(frozen=True)
class TotalReturn:
    """Market and category portfolios: lazy parts that share one price panel."""

    panel: DataFrame
    targets: dict[str, Column]
    series: DataFrame

    def positions(self, last_only: bool = False) -> DataFrame:
        """What is held after each date's trades, in one pass over the panel: it meets the stored value path, which has a row per
        portfolio and date, without being shuffled again, and becomes a row per portfolio only then."""
        series = self.series
        if last_only:
            newest = series.agg(F.max("date").alias("_last"))
            series = series.join(newest).filter(F.col("date") == F.col("_last")).drop("_last")
        rows = with_holdings(self.panel, ["category"], self.targets)
        sides = F.array(*[F.struct(F.lit(n).alias("weighting"), F.col(f"_t_{n}").alias("_t_w"), F.struct(F.col("_held.p"), F.col(f"_held.{n}").alias("w")).alias("_held"))
                          for n in self.targets])
        kept = ["asset_id", "date", "worth", "bucket", "is_rebalance"]
        wide = rows.select("category", *kept, F.explode(sides).alias("_s")).select("category", *kept, "_s.weighting", "_s._t_w", "_s._held")
        # an asset without a category is in the whole market only
        wide = wide.withColumn("universe", F.explode(F.array(F.lit("all"), F.col("category")))).filter("universe IS NOT NULL")
        return positions_on(wide, ["universe", "weighting"], series)


def total_return_index(assets: DataFrame, quotes: DataFrame, exits: DataFrame, grid: DataFrame, rebalance: str = "quarter",
                       base: float = 100.0) -> TotalReturn:
    """Exit-aware equal- and cap-weighted portfolios of the whole market and of every category.

    The panel is read once: raw sums per category and date add up to the whole market.
    """
    master = assets.filter("share_count > 0 AND offering_price_usd > 0 AND offering_date IS NOT NULL")
    prices = with_offering_prices(quotes, master)
    marks = S.rebalance_dates(grid, rebalance).withColumn("is_rebalance", F.lit(True))
    days = staged(grid.join(marks, "date", "left").withColumn("is_rebalance", F.coalesce("is_rebalance", F.lit(False))))
    panel = price_panel(master.select("asset_id", "category", "share_count", "offering_date"), prices, days, exits)
    buyable = ~F.col("is_out") & (F.col("offering_date") <= F.col("date")) & F.col("price").isNotNull()
    targets = {"equal_weight": F.when(buyable, 1.0), "market_cap_weight": F.when(buyable, F.col("price") * F.col("share_count"))}
    by_category = segment_sums(panel, ["category"], targets)
    added = [F.sum(c).alias(c) for c in ("target_sum", "bought", "grown", "cash", "pending", "active")]
    rolled = staged(by_category.withColumn("universe", F.explode(F.array(F.lit("all"), F.col("category")))).groupBy(
        "universe", "weighting", "date").agg(*added))
    calendar = days.agg(F.collect_list(F.struct("date", "is_rebalance")).alias("_d"))
    whole = rolled.select("universe", "weighting").distinct().join(calendar).select("universe", "weighting", F.inline("_d"))
    full = whole.join(rolled, ["universe", "weighting", "date"], "left")
    return TotalReturn(panel, targets, staged(value_path(full, ["universe", "weighting"], base)))


def basket_portfolio(definitions: DataFrame, assets: DataFrame, quotes: DataFrame, exits: DataFrame, rebalance: str,
                     base: float = 100.0) -> PortfolioResult:
    """Baskets `(def_id, asset_id, weight)` on all dates their members have; weights are renormalised over the members
    that can be bought."""
    members = definitions.join(assets.select("asset_id", "offering_date", "offering_price_usd"), "asset_id")
    prices = with_offering_prices(quotes, assets)
    events = exits.select("asset_id", F.explode(F.array("exit_effective_date", "settlement_date")).alias("date"))
    known = prices.select("asset_id", "date").union(events.filter("date IS NOT NULL"))
    grid = known.join(definitions.select("def_id", "asset_id"), "asset_id").select("def_id", "date").distinct()
    marks = S.rebalance_dates(grid, rebalance, ["def_id"]).withColumn("is_rebalance", F.lit(True))
    days = staged(grid.join(marks, ["def_id", "date"], "left").withColumn("is_rebalance", F.coalesce("is_rebalance", F.lit(False))))
    panel = price_panel(members, prices, days, exits, ("def_id",))
    buyable = ~F.col("is_out") & (F.col("offering_date") <= F.col("date")) & F.col("price").isNotNull()
    return _one_weighting(panel, F.when(buyable, F.col("weight")), base)


def _one_weighting(panel: DataFrame, target: Column, base: float, absolute: bool = False) -> PortfolioResult:
    path = staged(value_path(segment_sums(panel, ["def_id"], {"w": target}).drop("weighting"), ["def_id"], base, absolute))
    return PortfolioResult(path, held_positions(panel, ["def_id"], target, path))


def category_strategy(definitions: DataFrame, canonical: DataFrame, exits: DataFrame, rebalance: str,
                      base: float = 100.0) -> PortfolioResult:
    """Quarter-aligned baskets with absolute weights; what the weights leave over stays in cash.

    `canonical` has one price per asset and quarter end. Exits act at the end of their quarter and pay into cash.
    """
    periods = canonical.select("asset_id", "date").union(
        exits.select("asset_id", quarter_end("exit_effective_date").alias("date")).filter("date IS NOT NULL"))
    grid = periods.join(definitions.select("def_id", "asset_id"), "asset_id").select("def_id", "date").distinct()
    due = {"none": F.lit(False), "quarter": F.lit(True), "year": F.quarter("date") == 4}[rebalance]
    first = F.col("date") == F.min("date").over(Window.partitionBy("def_id"))
    days = staged(grid.withColumn("is_rebalance", first | due))
    at_quarter = exits.withColumn("exit_effective_date", quarter_end("exit_effective_date")).withColumn(
        "settlement_date", F.col("exit_effective_date"))
    panel = price_panel(definitions, canonical, days, at_quarter, ("def_id",))
    return _one_weighting(panel, F.when(~F.col("is_out"), F.col("weight")), base, absolute=True)


def component_backtest(components: DataFrame, rebalance: str, base: float = 100.0) -> PortfolioResult:
    """Sleeves `(def_id, asset_id, weight, date, price)` on the dates all of them share."""
    members = components.select("def_id", "asset_id").distinct().groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    shared = components.groupBy("def_id", "date").agg(F.count(F.lit(1)).alias("n")).join(members, "def_id").filter("n = members")
    marks = S.rebalance_dates(shared, rebalance, ["def_id"]).withColumn("is_rebalance", F.lit(True))
    aligned = components.join(shared.select("def_id", "date"), ["def_id", "date"], "left_semi").join(marks, ["def_id", "date"], "left")
    panel = aligned.withColumn("is_rebalance", F.coalesce("is_rebalance", F.lit(False))).withColumn("worth", F.col("price")).withColumn(
        "bucket", F.lit("held"))
    return _one_weighting(panel, F.col("weight"), base)


def rebalance_ledger(result: PortfolioResult, keys: list[str]) -> DataFrame:
    """Weight before, target weight and traded value of every position at each rebalance after the first."""
    first = result.series.groupBy(*keys).agg(F.min("date").alias("_first"))
    rows = result.positions.filter("rebalanced").join(first, keys).filter("date > _first")
    shift = F.col("portfolio_weight") - F.col("weight_before")
    return rows.select(*keys, "date", "asset_id", F.col("weight_before").alias("pre_rebalance_weight"),
                       F.col("portfolio_weight").alias("target_weight"), shift.alias("weight_change"),
                       (shift * F.col("position_value") / F.col("portfolio_weight")).alias("trade_value"))


def turnover(ledger: DataFrame, keys: list[str]) -> DataFrame:
    return ledger.groupBy(*keys, "date").agg((F.sum(F.abs("weight_change")) / 2).alias("turnover"),
                                             (F.sum(F.abs("trade_value")) / 2).alias("traded_value"))


def contribution_history(positions: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Component contributions scaled to the period return, with running sums.

    The raw contribution is the value change of a position before that date's trades.
    """
    w = S.over([*keys, "asset_id"])
    flat = positions.join(series.select(*keys, "date", "value", "period_return"), [*keys, "date"])
    before_trades = F.col("weight_before") * F.col("value")
    raw = flat.withColumn("raw", F.coalesce(before_trades - F.lag("position_value").over(w), F.lit(0.0)))
    total = raw.groupBy(*keys, "date").agg(F.sum("raw").alias("_total"))
    out = raw.join(total, [*keys, "date"]).withColumn("period_contribution", F.when(F.abs("_total") <= 1e-15, 0.0).otherwise(
        F.col("raw") * F.col("period_return") / F.col("_total")))
    return out.withColumn("cumulative_contribution", F.sum("period_contribution").over(S.running([*keys, "asset_id"])))


def holdings_attribution(result: PortfolioResult, keys: list[str]) -> DataFrame:
    """Change of each position's value over the whole path; a position that is not held counts as zero."""
    ends = result.series.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"),
                                            F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"))
    p = result.positions.join(ends, keys)
    start = F.sum(F.when(F.col("date") == F.col("lo"), F.col("position_value")).otherwise(0.0))
    end = F.sum(F.when(F.col("date") == F.col("hi"), F.col("position_value")).otherwise(0.0))
    return p.groupBy(*keys, "asset_id", "v0", "v1").agg(
        (end - start).alias("contribution"), (start / F.first("v0")).alias("start_weight"), (end / F.first("v1")).alias("end_weight"))


def risk_metrics(series: DataFrame, keys: list[str], risk_free: float = 0.0) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, Calmar, hit rate, drawdown depth, duration and recovery per portfolio.

    The first row of each path is the starting value, not a return, and is left out of returns and drawdowns.
    """
    w, upto = S.over(keys), S.running(keys)
    # differences below `NOISE` are rounding of a flat path, not gains or losses
    rows = series.select(*keys, "date", without_noise(F.round("period_return", 12)).alias("period_return")).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("growth", F.product(1 + F.col("period_return")).over(upto))
    rows = rows.withColumn("_gap", F.datediff("date", F.lag("date").over(w))).withColumn(
        "dd", without_noise(change("growth", F.max("growth").over(upto))))
    spacing = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.percentile("_gap", F.lit(0.5)).alias("_m")).select(
        *keys, S.periods_per_year("_c", "_m").alias("periods"))
    body = rows.filter("_n > 1")
    body = body.withColumn("_run", F.count_if(F.col("dd") >= 0).over(upto))
    body = body.withColumn("_len", F.count_if(F.col("dd") < 0).over(
        Window.partitionBy(*keys, "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    trough = F.min(F.struct("dd", "_n")).over(Window.partitionBy(*keys))
    body = body.withColumn("_t", trough)
    peak = F.max(F.when(F.col("_n") <= F.col("_t._n"), F.col("growth"))).over(Window.partitionBy(*keys))
    body = body.withColumn("_peak", peak).join(spacing, keys)
    rf = F.pow(F.lit(1 + risk_free), 1 / F.col("periods")) - 1
    r = F.col("period_return")
    agg = body.groupBy(*keys, "periods").agg(
        F.count(F.lit(1)).alias("n"), F.product(1 + r).alias("g"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.sum(F.when(r < rf, F.pow(r - rf, F.lit(2))).otherwise(0.0)).alias("down2"), F.max(r).alias("best_period_return"),
        F.min(r).alias("worst_period_return"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("positive_period_percentage"),
        F.min("dd").alias("maximum_drawdown"), F.max("_len").alias("maximum_drawdown_duration_periods"),
        F.min(F.when((F.col("_n") > F.col("_t._n")) & (F.col("growth") >= F.col("_peak")), F.col("date"))).alias("recovery_date"))
    annual = F.pow(F.col("g"), F.col("periods") / F.col("n")) - 1
    vol = F.when(F.col("n") > 1, F.col("sd") * F.sqrt("periods")).otherwise(0.0)
    down = F.sqrt(F.col("down2") / F.col("n")) * F.sqrt("periods")
    return agg.select(
        *keys, F.col("periods").alias("periods_per_year"), annual.alias("annualized_return"), vol.alias("annualized_volatility"),
        F.when(F.col("sd") > 0, (F.col("mean") - rf) / F.col("sd") * F.sqrt("periods")).alias("sharpe_ratio"),
        F.when(down > 0, (F.col("mean") - rf) * F.col("periods") / down).alias("sortino_ratio"),
        F.when(F.col("maximum_drawdown") < 0, annual / F.abs("maximum_drawdown")).alias("calmar_ratio"),
        down.alias("downside_deviation"), "best_period_return", "worst_period_return", "positive_period_percentage",
        "maximum_drawdown", "maximum_drawdown_duration_periods", "recovery_date")


# --- weights ------------------------------------------------------------------------------

def inverse_volatility(components: DataFrame, minimum: int = 3) -> DataFrame:
    """Weights proportional to 1 / deviation of returns on the dates all members share."""
    members = components.select("def_id", "asset_id").distinct().groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    shared = components.groupBy("def_id", "date").agg(F.count(F.lit(1)).alias("n")).join(members, "def_id").filter("n = members")
    aligned = components.join(shared.select("def_id", "date"), ["def_id", "date"], "left_semi")
    r = S.with_returns(aligned, ["def_id", "asset_id"])
    vol = r.groupBy("def_id", "asset_id").agg(F.stddev_samp("ret").alias("vol"), F.count("ret").alias("n"))
    total = vol.groupBy("def_id").agg(F.sum(ratio(F.lit(1.0), "vol")).alias("_t"), F.min("vol").alias("_lo"), F.min("n").alias("_n"))
    usable = total.filter((F.col("_lo") > 0) & (F.col("_n") >= minimum))
    return vol.join(usable, "def_id").select("def_id", "asset_id", (ratio(F.lit(1.0), "vol") / F.col("_t")).alias("weight"))


def remove_and_redistribute(weights: DataFrame, removed: Column, policy: str) -> DataFrame:
    """Drop members and hand their weight to the rest pro rata, equally, or to nobody."""
    sums = weights.groupBy("def_id").agg(
        F.sum(F.when(removed, F.col("weight")).otherwise(0.0)).alias("_out"),
        F.sum(F.when(~removed, F.col("weight")).otherwise(0.0)).alias("_in"), F.count_if(~removed).alias("_k"))
    rest = weights.filter(~removed).join(sums, "def_id")
    equal = F.col("_out") / F.col("_k")
    add = {"pro_rata": F.when(F.col("_in") > 0, F.col("_out") * F.col("weight") / F.col("_in")).otherwise(equal),
           "equal": equal, "unallocated": F.lit(0.0)}[policy]
    return rest.withColumn("weight", F.col("weight") + add).drop("_out", "_in", "_k")


def expand_component(portfolio: DataFrame, constituents: DataFrame, method: str = "preserve") -> DataFrame:
    """Replace sleeves `(def_id, component_id, weight)` by their assets, keeping each sleeve's allocation."""
    inner = {"preserve": F.col("internal_weight"), "equal": F.lit(1.0), "market_cap": F.greatest("market_cap", F.lit(0.0))}[method]
    raw = constituents.withColumn("_raw", inner)
    totals = raw.groupBy("component_id").agg(F.sum("_raw").alias("_t"), F.min("_raw").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    share = F.when((F.col("_t") > 0) & (F.col("_lo") > 0), F.col("_raw") / F.col("_t")).otherwise(1 / F.col("_n"))
    return portfolio.join(raw.join(totals, "component_id"), "component_id").select(
        "def_id", "component_id", "asset_id", (F.col("weight") * share).alias("weight"))


# --- look-through -------------------------------------------------------------------------

def look_through(portfolio: DataFrame, constituents: DataFrame, as_of: str) -> DataFrame:
    """Last constituent snapshot on or before a date times the sleeve weight; the whole snapshot, not one per asset."""
    known = constituents.filter(F.col("date") <= F.lit(as_of).cast("date"))
    newest = known.groupBy("component_id").agg(F.max("date").alias("date"))
    snap = known.join(newest, ["component_id", "date"], "left_semi")
    return portfolio.join(snap, "component_id").withColumn("effective_weight", F.col("weight") * F.col("internal_weight"))


def overlap_report(detail: DataFrame) -> DataFrame:
    direct = F.col("is_direct")
    w = F.col("effective_weight")
    # a basket has few sleeves, so the ordered source list per asset is bounded by the number of sleeves
    sources = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct("position", "component_id"))),
                                                        lambda s: s["component_id"])), ", ")
    return detail.groupBy("def_id", "asset_id").agg(
        F.sum(F.when(direct, w).otherwise(0.0)).alias("direct_weight"), F.sum(F.when(~direct, w).otherwise(0.0)).alias("indirect_weight"),
        F.sum(w).alias("total_weight"), sources.alias("source_components"), F.countDistinct("component_id").alias("source_count")
    ).withColumn("overlap", F.col("source_count") > 1)


def look_through_reconciliation(portfolio: DataFrame, detail: DataFrame) -> DataFrame:
    inner = detail.groupBy("def_id", "component_id").agg(F.sum("effective_weight").alias("eff"), F.sum("internal_weight").alias("inner"))
    j = portfolio.join(inner, ["def_id", "component_id"], "left")
    out = j.groupBy("def_id").agg(
        F.sum(F.coalesce("eff", F.lit(0.0))).alias("look_through_weight"),
        F.sum(F.when(F.col("inner").isNotNull(), F.col("weight") * (1 - F.col("inner"))).otherwise(0.0)).alias("internal_residual"),
        F.sum(F.when(F.col("inner").isNull(), F.col("weight")).otherwise(0.0)).alias("unresolved_weight"))
    diff = F.col("look_through_weight") + F.col("internal_residual") + F.col("unresolved_weight") - 1
    return out.withColumn("reconciled", F.abs(diff) <= 1e-9)
