"""Chain-linked price indexes, composites and their attribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change, ratio
from tessera.operators import series as S
from tessera.session import staged


@dataclass(frozen=True)
class IndexResult:
    series: DataFrame
    contributions: DataFrame


def index_rows(quotes: DataFrame, by_category: bool = True) -> DataFrame:
    """Each quote once per index it belongs to, with the quote `before` it in the same index. The quotes before are found while there is
    one row per asset and date, so that only these rows are shuffled and sorted, not the wider ones per index, and stored, since a chain
    reads them for its calendar, its levels and its contributions."""
    kept = quotes.filter("price > 0").select("asset_id", "category", "date", "price", F.when(F.col("cap") > 0, F.col("cap")).alias("cap")).repartition("asset_id")
    own, quote = ["asset_id"], F.struct("date", "price", "cap")

    def before(keys: list[str], ok: Column) -> Column:
        return F.last(F.when(ok, quote), ignorenulls=True).over(S.over(keys).rowsBetween(Window.unboundedPreceding, -1))

    sides = []
    for family, keys in [(F.lit("all"), own), (F.col("category"), [*own, "category"])][:2 if by_category else 1]:
        for weighting, ok in (("equal", F.lit(True)), ("market_cap", F.col("cap").isNotNull())):
            name = f"_b{len(sides)}"
            kept = kept.withColumn(name, before(keys, ok))
            sides.append(F.when(ok & family.isNotNull(), F.struct(family.alias("family"), F.lit(weighting).alias("weighting"), F.col(name).alias("before"))))
    rows = staged(kept).select("asset_id", "date", "price", "cap", F.explode(F.array_compact(F.array(*sides))).alias("_s"))
    return rows.select("_s.family", "_s.weighting", "asset_id", "date", "price", "cap", "_s.before")


def index_chain(rows: DataFrame, keys: list[str], base: float = 100.0) -> IndexResult:
    """Level of each index from the returns of assets seen on its previous and current date.

    A return counts only when the asset was eligible on the date row before in the same index. Weights are equal
    or the previous caps; nothing is filled. `rows` carries keys, `weighting`, asset_id, date, price, cap and the asset's quote before. The
    calendar and the levels, a row per index and date, are stored, so that the rows meet them without being shuffled.
    """
    dates = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("constituent_count"))
    calendar = staged(dates.withColumn("previous_date", F.lag("date").over(S.over(keys))))
    steps = (
        rows.join(calendar.select(*keys, "date", "previous_date"), [*keys, "date"])
        .filter(F.col("before.date") == F.col("previous_date"))
        .withColumn("asset_return", change("price", "before.price"))
        .withColumn("mass", F.when(F.col("weighting") == "equal", 1.0).otherwise(F.col("before.cap")))
    )
    totals = steps.groupBy(*keys, "date").agg(
        F.sum("mass").alias("mass_total"), (F.sum(F.col("mass") * F.col("asset_return")) / F.sum("mass")).alias("period_return"))
    level = S.compounded("period_return", S.running(keys), base)
    series = calendar.join(totals, [*keys, "date"], "left").withColumn("index_level", level)
    opening = F.coalesce(F.lag("index_level").over(S.over(keys)), F.lit(base))
    series = staged(series.withColumn("opening_level", opening))
    contributions = (
        steps.join(series.select(*keys, "date", "mass_total", "opening_level"), [*keys, "date"])
        .withColumn("weight", F.col("mass") / F.col("mass_total"))
        .withColumn("contribution_return", F.col("weight") * F.col("asset_return"))
        .withColumn("contribution_points", F.col("opening_level") * F.col("contribution_return"))
        .select(*keys, "date", "asset_id", "asset_return", "weight", "contribution_return", "contribution_points")
    )
    return IndexResult(
        series.select(*keys, "date", "index_level", "period_return", "constituent_count"), contributions)


def quarterly_family(quotes: DataFrame) -> IndexResult:
    return index_chain(index_rows(quotes), ["family", "weighting"])


def market_family(quotes: DataFrame) -> IndexResult:
    return index_chain(index_rows(quotes, by_category=False), ["family", "weighting"])


def custom_composite(quotes: DataFrame, definitions: DataFrame, base: float = 100.0) -> IndexResult:
    """Constant-weight composites on the dates every member was observed, from the latest inception.

    `definitions` carries def_id, asset_id and weights that sum to one.
    """
    members = definitions.groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    held = quotes.filter("price > 0").join(definitions, "asset_id").select("def_id", "asset_id", "date", "price", "weight")
    start = held.groupBy("def_id", "asset_id").agg(F.min("date").alias("first")).groupBy("def_id").agg(
        F.max("first").alias("inception"), F.count(F.lit(1)).alias("present"))
    common = (
        held.groupBy("def_id", "date").agg(F.count(F.lit(1)).alias("n"))
        .join(members, "def_id").join(start, "def_id")
        .filter("n = members AND present = members AND date >= inception")
        .select("def_id", "date")
    )
    aligned = held.join(common, ["def_id", "date"]).withColumn(
        "price0", F.first("price").over(S.over(["def_id", "asset_id"])))
    levels = aligned.groupBy("def_id", "date").agg(
        (F.sum(F.col("weight") * F.col("price") / F.col("price0")) * base).alias("index_level"),
        F.count(F.lit(1)).alias("constituent_count"))
    series = levels.withColumn("period_return", change("index_level", F.lag("index_level").over(S.over("def_id"))))
    ends = aligned.groupBy("def_id", "asset_id", "weight").agg(
        (F.max_by("price", "date") / F.min_by("price", "date") - 1).alias("asset_return"))
    moved = Window.partitionBy("def_id")
    contributions = ends.withColumn("contribution_points", F.col("weight") * F.col("asset_return") * base).withColumn(
        "share_of_total_move", ratio("contribution_points", F.sum("contribution_points").over(moved)))
    return IndexResult(series, contributions)


def attribution(result: IndexResult, keys: list[str], start: str, end: str) -> DataFrame:
    """Contribution of each asset to the change between the first and last index date inside a window."""
    window = result.series.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    ends = window.groupBy(*keys).agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.min_by("index_level", "date").alias("start_value"),
        F.max_by("index_level", "date").alias("end_value"))
    inside = result.contributions.join(ends, keys).filter("date > lo AND date <= hi")
    per_asset = inside.groupBy(*keys, "asset_id", "start_value", "end_value").agg(
        F.sum("contribution_points").alias("contribution"), (F.product(1 + F.col("asset_return")) - 1).alias("asset_return"),
        F.avg("weight").alias("average_weight"), F.min_by("weight", "date").alias("start_weight"),
        F.max_by("weight", "date").alias("end_weight"))
    return with_shares(per_asset, keys, F.col("end_value") - F.col("start_value"))


def with_shares(df: DataFrame, keys: list[str], total_change) -> DataFrame:
    """Shares of the total, gross positive, gross negative and absolute movement, and the residual.

    Totals come from one combinable aggregate joined back, so an index with very many assets is not one window.
    """
    c = F.col("contribution")
    df = df.withColumn("total_change", total_change)
    totals = df.groupBy(*keys).agg(
        F.sum(F.when(c > 0, c).otherwise(0.0)).alias("_pos"), F.sum(F.when(c < 0, -c).otherwise(0.0)).alias("_neg"),
        F.sum(F.abs(c)).alias("_abs"), F.sum(c).alias("_explained"))
    near_zero = F.abs("total_change") <= 1e-6
    return (
        df.join(totals, keys)
        .withColumn("contribution_share", F.when(~near_zero, c / F.col("total_change")))
        .withColumn("gross_positive_share", ratio(F.greatest(c, F.lit(0.0)), F.nullif("_pos", F.lit(0.0))))
        .withColumn("gross_negative_share", ratio(F.greatest(-c, F.lit(0.0)), F.nullif("_neg", F.lit(0.0))))
        .withColumn("absolute_contribution_share", ratio(F.abs(c), F.nullif("_abs", F.lit(0.0))))
        .withColumn("residual", F.col("total_change") - F.col("_explained"))
        .drop("_pos", "_neg", "_abs", "_explained")
    )


def concentration(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the largest 1, 3 and 5 positive, negative and absolute contributions."""
    c = F.coalesce("contribution", F.lit(0.0))
    sides = df.select(*keys, "asset_id", F.explode(F.array(
        F.struct(F.lit("positive").alias("side"), F.when(c > 0, c).alias("v")),
        F.struct(F.lit("negative").alias("side"), F.when(c < 0, -c).alias("v")),
        F.struct(F.lit("absolute").alias("side"), F.abs(c).alias("v")))).alias("e")).select(*keys, "asset_id", "e.side", "e.v")
    sides = sides.filter("v IS NOT NULL")
    total = sides.groupBy(*keys, "side").agg(F.sum("v").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys, "side").orderBy(F.desc("v"), "asset_id"))
    top = sides.withColumn("_k", rank).filter("_k <= 5").groupBy(*keys, "side").agg(
        *[F.sum(F.when(F.col("_k") <= n, F.col("v"))).alias(f"sum_{n}") for n in (1, 3, 5)])
    joined = total.join(top, [*keys, "side"])
    return joined.select(*keys, "side", *[ratio(f"sum_{n}", F.nullif("total", F.lit(0.0))).alias(f"top_{n}") for n in (1, 3, 5)])


def breadth(df: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    c = F.coalesce("contribution", F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count_if(c > tolerance).alias("positive_count"), F.count_if(c < -tolerance).alias("negative_count"),
        F.count_if(F.abs(c) <= tolerance).alias("flat_count"), F.count(F.lit(1)).alias("total_count"),
        (F.count_if(c > tolerance) / F.count(F.lit(1))).alias("percent_positive"))


def index_metrics(series: DataFrame, keys: list[str], periods: int = 4) -> DataFrame:
    """Level statistics of each index: return, CAGR from one year on, risk ratios, drawdowns and a risk band."""
    w = S.over(keys)
    rows = series.withColumn("r", change("index_level", F.lag("index_level").over(w))).withColumn(
        "dd", change("index_level", F.max("index_level").over(S.running(keys))))
    down = F.when(F.col("r") < 0, F.col("r"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"), F.count("r").alias("n"), F.min_by("index_level", "date").alias("first"),
        F.max_by("index_level", "date").alias("last"), F.min("date").alias("d0"), F.max("date").alias("d1"),
        F.min("dd").alias("maximum_drawdown"), F.max_by("dd", "date").alias("current_drawdown"),
        F.max("r").alias("best_period"), F.min("r").alias("worst_period"), F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("sd"), F.stddev_samp(down).alias("down_sd"), F.count(down).alias("down_n"))
    years = F.datediff("d1", "d0") / 365.25
    vol = F.when(F.col("n") >= 2, F.col("sd") * periods**0.5)
    return agg.select(
        *keys, "observation_count", change("last", "first").alias("total_return"),
        F.when(years >= 1, F.pow(F.col("last") / F.col("first"), 1 / years) - 1).alias("cagr"),
        vol.alias("annualized_volatility"),
        F.when(vol > 0, F.col("mean") * periods / vol).alias("sharpe_ratio"),
        F.when((F.col("n") >= 2) & (F.col("down_n") >= 2) & (F.col("down_sd") > 0),
               F.col("mean") * periods / (F.col("down_sd") * periods**0.5)).alias("sortino_ratio"),
        "maximum_drawdown", "current_drawdown", "best_period", "worst_period",
        F.when(vol.isNull(), "Unavailable").when(vol < 0.15, "Low").when(vol < 0.30, "Medium").otherwise("High").alias("risk_band"))


def rebased(series: DataFrame, keys: list[str], starting_value: float = 100.0) -> DataFrame:
    """Growth of an amount put into each index on its first date."""
    start = F.first("index_level").over(S.running(keys))
    grown = series.withColumn("growth_value", F.col("index_level") / start * starting_value)
    return grown.withColumn("period_return", F.coalesce(
        change("growth_value", F.lag("growth_value").over(S.over(keys))), F.lit(0.0)))
