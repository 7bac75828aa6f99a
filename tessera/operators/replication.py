"""Whole-share replication of baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change
from tessera.operators import series as S


def with_targets(members: DataFrame) -> DataFrame:
    total = members.groupBy("def_id").agg(F.sum("weight").alias("_t"))
    return members.join(total, "def_id").withColumn("target", F.col("weight") / F.col("_t")).drop("_t")


def anchor_allocation(prices: DataFrame) -> DataFrame:
    """Share counts nearest to the dollar anchor set by the dearest share: best of floor, round and ceiling."""
    top = prices.groupBy("def_id").agg((F.max("price") / F.max("target")).alias("_anchor"))
    rows = prices.join(top, "def_id").withColumn("target_dollars", F.col("_anchor") * F.col("target"))
    raw = F.col("target_dollars") / F.col("price")

    def option(q: Column, order: int) -> Column:
        count = F.greatest(F.lit(1.0), q)
        return F.struct(F.abs(count * F.col("price") - F.col("target_dollars")).alias("miss"), F.lit(order).alias("o"), count.alias("q"))

    best = F.array_min(F.array(option(F.floor(raw).cast("double"), 1), option(F.bround(raw).cast("double"), 2), option(F.ceil(raw).cast("double"), 3)))
    return rows.withColumn("quantity", best["q"].cast("bigint")).drop("_anchor")


def weight_errors(rows: DataFrame, keys: list[str], denominator: str | None = None) -> DataFrame:
    """RMSE, absolute and maximum weight error of share counts `q` against `target`."""
    spent = F.col("price") * F.col("q")
    sums = rows.groupBy(*keys).agg(F.sum(spent).alias("invested"))
    base = F.col(denominator) if denominator else F.col("invested")
    miss = spent / base - F.col("target")
    return rows.join(sums, keys).groupBy(*keys, "invested").agg(
        F.sqrt(F.avg(miss * miss)).alias("rmse"), F.sum(F.abs(miss)).alias("absolute"), F.max(F.abs(miss)).alias("maximum"))


def tracking_frontier(prices: DataFrame, multiples: list[float]) -> DataFrame:
    """Weight errors of the floor allocation at several multiples of the one-share-each capital."""
    one = prices.groupBy("def_id").agg(F.sum("price").alias("_one"))
    rows = prices.join(one, "def_id").withColumn("multiple", F.explode(F.array(*[F.lit(float(k)) for k in multiples])))
    rows = rows.withColumn("budget", F.col("_one") * F.col("multiple"))
    q = F.floor(F.col("budget") * F.col("target") / F.col("price")).cast("double")
    rows = rows.withColumn("q", F.when(F.col("multiple") >= 1, F.greatest(F.lit(1.0), q)).otherwise(q))
    out = weight_errors(rows, ["def_id", "multiple", "budget"], "budget")
    return out.withColumn("feasible", F.col("invested") <= F.col("budget") * (1 + 1e-12)).withColumn(
        "cash_weight", F.greatest(F.lit(0.0), F.col("budget") - F.col("invested")) / F.col("budget"))


def minimum_capital(prices: DataFrame, tolerance: float, metric: str = "maximum", steps: int = 180, spread: float = 100.0) -> DataFrame:
    """Smallest of a geometric ladder of budgets whose rounded allocation meets the tolerance, per basket; a basket that none
    meets stays, with `feasible` false."""
    one = prices.groupBy("def_id").agg(F.sum("price").alias("_one"))
    ladder = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    rows = prices.join(one, "def_id").withColumn("anchor_no", ladder)
    budget = F.round(F.col("_one") * F.pow(F.lit(float(spread)), F.col("anchor_no") / (steps - 1)), 6)
    q = F.greatest(F.lit(1.0), F.bround(budget * F.col("target") / F.col("price")).cast("double"))
    out = weight_errors(rows.withColumn("q", q), ["def_id", "anchor_no"])
    met = F.when(F.col(metric) <= tolerance, F.struct("anchor_no", "invested", "maximum", "rmse"))
    return out.groupBy("def_id").agg(F.min(met).alias("b")).select("def_id", F.col("b").isNotNull().alias("feasible"), "b.*")


def prices_asof(history: DataFrame, requested: str, mode: str = "common", stale_days: int = 120) -> DataFrame:
    """Latest price of each member on or before the start: the requested date, or the first date all members exist."""
    want = F.lit(requested).cast("date")
    if mode == "common":
        firsts = history.groupBy("def_id", "asset_id").agg(F.min("date").alias("f")).groupBy("def_id").agg(F.max("f").alias("f"))
        start = firsts.select("def_id", F.greatest("f", want).alias("effective_start_date"))
    else:
        start = history.select("def_id").distinct().withColumn("effective_start_date", want)
    rows = history.join(start, "def_id").filter("date <= effective_start_date")
    out = rows.groupBy("def_id", "asset_id", "effective_start_date").agg(F.max("date").alias("price_date"), F.max_by("price", "date").alias("price"))
    age = F.datediff("effective_start_date", "price_date")
    return out.withColumn("staleness_days", age).withColumn("is_stale", age > stale_days)


def buy_and_hold(history: DataFrame, budget: float) -> DataFrame:
    """Whole shares bought at the first common date against the fractional portfolio of the same budget.

    `history` carries def_id, asset_id, weight (summing to one), date and price.
    """
    start = prices_asof(history, "1000-01-01")
    weights = history.select("def_id", "asset_id", "weight").distinct()
    alloc = start.join(weights, ["def_id", "asset_id"]).withColumn("fq", budget * F.col("weight") / F.col("price")).withColumn(
        "q", F.floor("fq").cast("double"))
    cash = alloc.groupBy("def_id").agg((F.lit(budget) - F.sum(F.col("q") * F.col("price"))).alias("cash"))
    dates = history.groupBy("def_id").agg(F.collect_set("date").alias("_d"))
    members = alloc.select("def_id", "asset_id", "effective_start_date", "q", "fq").join(dates, "def_id")
    rows = members.withColumn("date", F.explode(F.filter("_d", lambda d: d >= F.col("effective_start_date")))).drop("_d")
    filled = S.asof_backward(history.select("def_id", "asset_id", "date", "price"), rows, ["def_id", "asset_id"], ["price"])
    path = filled.groupBy("def_id", "date").agg(F.sum(F.col("q") * F.col("price")).alias("held"), F.sum(F.col("fq") * F.col("price")).alias("benchmark_value"))
    out = path.join(cash, "def_id").withColumn("portfolio_value", F.col("held") + F.col("cash"))
    return (
        out.withColumn("portfolio_pnl", F.col("portfolio_value") - budget).withColumn("benchmark_pnl", F.col("benchmark_value") - budget)
        .withColumn("replication_difference", F.col("portfolio_value") - F.col("benchmark_value"))
        .withColumn("drawdown", change("portfolio_value", F.max("portfolio_value").over(S.running("def_id"))))
    )


def replication_summary(path: DataFrame, budget: float) -> DataFrame:
    w = Window.partitionBy("def_id").orderBy("date")
    diff = change("portfolio_value", F.lag("portfolio_value").over(w)) - change("benchmark_value", F.lag("benchmark_value").over(w))
    rows = path.withColumn("diff", diff).withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    agg = rows.groupBy("def_id").agg(
        F.max_by("portfolio_value", "date").alias("latest_value"), F.max_by("benchmark_value", "date").alias("_b"), F.stddev_samp("diff").alias("_sd"),
        F.percentile("gap", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_n"), F.min("drawdown").alias("maximum_drawdown"))
    return agg.select("def_id", "latest_value", (F.col("latest_value") / budget - 1).alias("total_return"),
                      (F.col("_b") / budget - 1).alias("benchmark_return"),
                      (F.col("_sd") * F.sqrt(S.periods_per_year("_n", "_m"))).alias("tracking_error"), "maximum_drawdown")
