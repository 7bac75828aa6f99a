"""Option and strategy grids over eligible underlyings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import normal
from tessera.functions.columns import change, clip, ratio
from tessera.operators import series as S

MINIMUM_PRICES = 4


def underlyings(series: DataFrame, minimum: int = MINIMUM_PRICES) -> DataFrame:
    """Every subject with its price count, latest price and the reason when it is not eligible."""
    a = series.groupBy("subject_id").agg(
        F.count_if(F.col("value") > 0).alias("prices"), F.max_by("value", F.when(F.col("value") > 0, F.col("date"))).alias("spot"),
        F.max(F.when(F.col("value") > 0, F.col("date"))).alias("latest"))
    reason = F.when(F.col("prices") == 0, "no positive latest price").when(F.col("prices") < minimum, f"fewer than {minimum} valid observations")
    return a.withColumn("reason", reason).withColumn("eligible", reason.isNull())


def historical_volatility(series: DataFrame, lookback: int | None = None, log_returns: bool = True, minimum: int = 3) -> DataFrame:
    """Deviation of (log) returns over the last `lookback` observations, annualised by observed spacing."""
    rows = series.filter("value > 0")
    if lookback:
        newest = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("date")))
        rows = rows.withColumn("_k", newest).filter(F.col("_k") <= max(lookback, 2)).drop("_k")
    w = S.over("subject_id")
    prev = F.lag("value").over(w)
    rows = rows.withColumns({"r": F.ln(ratio("value", prev)) if log_returns else change("value", prev), "gap": F.datediff("date", F.lag("date").over(w))})
    a = rows.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count("r").alias("returns"), F.stddev_samp("r").alias("periodic_volatility"),
        F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.stddev_samp("gap").alias("gap_sd"))
    factor = ratio(F.lit(365.25), "median_gap")
    warning = F.when(F.col("returns") < minimum, "too_few_returns").when(F.col("returns") < 8, "unstable_estimate")
    return a.withColumns({
        "annualization_factor": factor, "frequency": F.when(F.col("observations") < 2, "Insufficient").otherwise(S.frequency_label("median_gap", "gap_sd")),
        "annualized_volatility": F.when(F.col("returns") >= minimum, F.col("periodic_volatility") * F.sqrt(factor)), "warning": warning})


def option_grid(base: DataFrame, moneyness: list[float], days: list[int], rate: float, yield_rate: float = 0.0) -> DataFrame:
    """European prices and Greeks for every underlying x strike x expiry x type.

    The grid is a fixed number of rows per underlying, exploded in place: no cross join.
    """
    g = base.withColumn("moneyness", F.explode(F.array(*[F.lit(x) for x in moneyness])))
    g = g.withColumn("days", F.explode(F.array(*[F.lit(d) for d in days]))).withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    g = g.withColumns({"strike": F.col("spot") * F.col("moneyness"), "t": F.col("days") / 365.0})
    s, k, t, v = F.col("spot"), F.col("strike"), F.col("t"), F.col("volatility")
    r, q = F.lit(rate), F.lit(yield_rate)
    root = F.sqrt(t)
    d1 = (F.ln(s / k) + (r - q + 0.5 * v * v) * t) / (v * root)
    g = g.withColumns({"d1": d1, "d2": d1 - v * root, "ds": s * F.exp(-q * t), "dk": k * F.exp(-r * t)})
    g = g.withColumns({"n1": normal.cdf(F.col("d1")), "n2": normal.cdf(F.col("d2")), "m1": normal.cdf(-F.col("d1")), "m2": normal.cdf(-F.col("d2")),
                       "density": normal.pdf(F.col("d1"))})
    call = F.col("option_type") == "call"
    ds, dk, dens = F.col("ds"), F.col("dk"), F.col("density")
    intrinsic = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    decay = -ds * dens * v / (2 * root)
    return g.withColumns({
        "intrinsic": intrinsic,
        "price": F.when(call, ds * F.col("n1") - dk * F.col("n2")).otherwise(dk * F.col("m2") - ds * F.col("m1")),
        "delta": F.exp(-q * t) * F.when(call, F.col("n1")).otherwise(F.col("n1") - 1),
        "gamma": F.exp(-q * t) * dens / (s * v * root), "vega": ds * dens * root / 100,
        "theta": F.when(call, decay - r * dk * F.col("n2") + q * ds * F.col("n1")).otherwise(decay + r * dk * F.col("m2") - q * ds * F.col("m1")) / 365,
        "rho": F.when(call, k * t * F.exp(-r * t) * F.col("n2")).otherwise(-k * t * F.exp(-r * t) * F.col("m2")) / 100,
        "itm_probability": F.when(call, F.col("n2")).otherwise(F.col("m2"))})


STRATEGIES = ["long_call", "long_put", "covered_call", "protective_put"]


def strategy_profit(strategy: Column, terminal: Column, spot: Column, strike: Column, premium: Column) -> Column:
    up, down = F.greatest(terminal - strike, F.lit(0.0)), F.greatest(strike - terminal, F.lit(0.0))
    return (F.when(strategy == "long_call", up - premium).when(strategy == "long_put", down - premium)
            .when(strategy == "covered_call", terminal - spot + premium - up).otherwise(terminal - spot - premium + down))


def strategy_grid(base: DataFrame, multiplier: float = 10.0) -> DataFrame:
    """Breakeven, maximum profit and loss, and payoff at five terminal prices for four strategies."""
    g = base.withColumn("strategy", F.explode(F.array(*[F.lit(x) for x in STRATEGIES])))
    s, k, p, name = F.col("spot"), F.col("strike"), F.col("premium"), F.col("strategy")
    breakeven = F.when(name == "long_call", k + p).when(name == "long_put", k - p).when(name == "covered_call", s - p).otherwise(s + p)
    gain = F.when(name == "long_put", F.greatest(k - p, F.lit(0.0))).when(name == "covered_call", k - s + p)
    loss = (F.when(name.isin("long_call", "long_put"), p).when(name == "covered_call", F.greatest(s - p, F.lit(0.0)))
            .otherwise(F.greatest(s + p - k, F.lit(0.0))))
    g = g.withColumns({"breakeven": breakeven, "maximum_profit": gain * multiplier, "maximum_loss": loss * multiplier})
    points = [0.5, 0.8, 1.0, 1.2, 1.5]
    return g.withColumns({f"profit_{int(x * 100)}": strategy_profit(name, s * x, s, k, p) * multiplier for x in points})


def contract_capacity(shares: Column, multiplier: float, contracts: int) -> dict[str, Column]:
    ok = shares > 0
    most = F.floor(shares / multiplier)
    return {"maximum_contracts": F.when(ok, most), "utilization_pct": F.when(ok, 100 * multiplier * contracts / shares),
            "remaining_contracts": F.when(ok, F.greatest(most - contracts, F.lit(0)))}


def liquidity_score(n: Column, age_days: Column, irregular: Column, has_cap: Column, has_shares: Column, trading: Column) -> Column:
    total = (F.least(n / 20, F.lit(1.0)) * 30 + F.greatest(F.lit(0.0), 1 - age_days / 365) * 30 + F.when(irregular, 5).otherwise(15)
             + F.when(has_cap, 10).otherwise(0) + F.when(has_shares, 10).otherwise(0) + F.when(trading, 0).otherwise(-25))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(total)))


def confidence_score(n: Column, stale_days: Column, irregular: Column, has_vol: Column, model_gap: Column, synthetic: Column, capacity: Column) -> Column:
    total = (F.least(n / 20, F.lit(1.0)) * 25 + F.greatest(F.lit(0.0), 20 - stale_days / 18.25) + F.when(irregular, 5).otherwise(15)
             + F.when(has_vol, 15).otherwise(0) + F.greatest(F.lit(0.0), 15 - F.least(F.abs(model_gap), F.lit(1.0)) * 15)
             + F.when(synthetic, 0).when(capacity, 10).otherwise(4))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(total)))


def hypothetical_spread(mid: Column, intrinsic: Column, liquidity: Column, confidence: Column, t: Column, moneyness: Column, volatility: Column,
                        multiplier: float, stale: Column, unhedged: Column) -> dict[str, Column]:
    pct = (0.04 + 0.20 * (1 - liquidity / 100) + 0.16 * (1 - confidence / 100) + F.least(t, F.lit(2.0)) * 0.015
           + F.least(F.abs(F.ln(F.greatest(moneyness, F.lit(1e-9)))), F.lit(1.0)) * 0.04 + F.least(volatility, F.lit(3.0)) * 0.02
           + F.least(F.log10(F.greatest(F.lit(multiplier), F.lit(1.0))), F.lit(3.0)) * 0.01 + F.when(stale, 0.06).otherwise(0.0) + F.when(unhedged, 0.08).otherwise(0.0))
    half = F.greatest(mid, F.lit(0.01)) * clip(pct, 0.02, 0.80) / 2
    bid = F.greatest(intrinsic, mid - half, F.lit(0.0))
    return {"bid": bid, "ask": F.greatest(mid + half, bid)}


MASK, PRIMES = 2**64 - 1, (11400714785074694791, 14029467366897019727, 1609587929392839161, 2870177450012600261)
#: Profits this near zero, as a share of the amounts in them, are left to Spark's own `exp`.
BREAK_EVEN = 1e-9


def _xxhash64(value: np.ndarray | int, start: np.ndarray | int) -> np.ndarray:
    """`xxhash64` of ints after `start`, the hash of the columns before them."""
    one, two, three, five = PRIMES
    h = (np.asarray(start, np.uint64) + np.uint64(five + 4)) ^ (value * np.uint64(one) if isinstance(value, np.ndarray) else np.uint64(value * one & MASK))
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * np.uint64(two) + np.uint64(three)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(two)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(three)
    return h ^ (h >> np.uint64(32))


def _path_totals(start: int, returns: np.ndarray, steps: int, paths: int) -> np.ndarray:
    """The summed returns of each path; the draw of a step is the hash of (seed, subject, path, step) modulo the returns."""
    lead, total, n = _xxhash64(np.arange(1, paths + 1, dtype=np.uint64), start & MASK), np.zeros(paths), len(returns)
    for step in range(1, steps + 1):
        drawn = _xxhash64(step, lead).view(np.int64)
        total += returns[drawn - drawn // n * n]
    return total


def _profits(strategies: Sequence[str], t: np.ndarray, spot: float, strike: float, premium: float) -> np.ndarray:
    up, down = np.maximum(t - strike, 0.0), np.maximum(strike - t, 0.0)
    gain = {"long_call": lambda: up - premium, "long_put": lambda: down - premium, "covered_call": lambda: t - spot + premium - up,
            "protective_put": lambda: t - spot - premium + down}
    return np.stack([gain[x]() for x in strategies])


def bootstrap_profit(series: DataFrame, base: DataFrame, horizon_years: float, paths: int, seed: int, strategies: Sequence[str] = ("long_call",)) -> DataFrame:
    """Share of resampled paths with a positive profit, per subject and strategy.

    Draws are a hash of (seed, subject, path, step), so every retry of a task repeats them, and all strategies see the same
    paths. Each subject carries its own short return list, so drawing needs no join; subjects are dealt to all tasks, and a task draws one
    subject's paths at a time as arrays. A path that ends next to a break-even is decided by Spark's `exp`.
    """
    w = S.over("subject_id")
    r = series.filter("value > 0").withColumns({"r": F.ln(ratio("value", F.lag("value").over(w))), "gap": F.datediff("date", F.lag("date").over(w))})
    lists = r.groupBy("subject_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("date", "r")))), lambda x: x["r"]).alias("rs"),
        F.percentile("gap", F.lit(0.5)).alias("gap")).filter(F.size("rs") >= 8)
    lists = lists.withColumn("steps", F.greatest(F.lit(1), F.round(horizon_years * 365.25 / F.col("gap")).cast("int"))).join(base, "subject_id")
    # small rows with much work each: a fixed number of tasks that adaptive execution neither merges nor finds redundant
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("subject_id", F.xxhash64(F.lit(seed), "subject_id").alias("start"), "rs", "steps", "spot", "strike", "premium").repartition(tasks, "start")
    names = list(strategies)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for subject, start, rs, steps, *amounts in batch.itertuples(index=False):
                total = _path_totals(start, np.asarray(rs, float), steps, paths)
                ends = amounts[0] * np.exp(total)
                profit = _profits(names, ends, *amounts)
                close = (np.abs(profit) <= BREAK_EVEN * (ends + sum(map(abs, amounts)))).any(axis=0)
                near, times = np.unique(total[close], return_counts=True)
                rows.append((subject, *amounts, ((profit > 0) & ~close).sum(axis=1), near, times))
            yield pd.DataFrame(rows, columns=["subject_id", "spot", "strike", "premium", "wins", "near", "times"])

    key = dealt.schema["subject_id"].dataType.simpleString()
    drawn = dealt.mapInPandas(draw, f"subject_id {key}, spot double, strike double, premium double, wins array<bigint>, near array<double>, times array<bigint>")

    def won(i: int, name: str) -> Column:
        def gains(total: Column, n: Column) -> Column:
            return F.when(strategy_profit(F.lit(name), F.col("spot") * F.exp(total), F.col("spot"), F.col("strike"), F.col("premium")) > 0, n).otherwise(F.lit(0).cast("bigint"))

        return F.col("wins")[i] + F.aggregate(F.zip_with("near", "times", gains), F.lit(0).cast("bigint"), lambda a, x: a + x)

    each = F.explode(F.array(*[F.struct(F.lit(x).alias("strategy"), (won(i, x) / paths).alias("probability_of_profit")) for i, x in enumerate(names)]))
    return drawn.select("subject_id", each.alias("each"), F.lit(paths).cast("bigint").alias("paths")).select("subject_id", "each.strategy", "each.probability_of_profit", "paths")
