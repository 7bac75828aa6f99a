"""Comparison of sparse series with benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change, ratio, without_noise
from tessera.operators import series as S

# Source names that do not count as genuine observations.
PLACEHOLDER_TERMS = "placeholder|synthetic|demo|test"


def clean_history(rows: DataFrame) -> DataFrame:
    """Upper-case tickers, positive prices, last row per ticker and date (by `seq`)."""
    ok = rows.withColumn("ticker", F.upper(F.trim("ticker"))).filter("date IS NOT NULL AND ticker <> '' AND adjusted_close > 0")
    return S.keep_last(ok, ["ticker", "date"], ["seq"])


def merge_history(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and refreshed closes; where they overlap the refresh wins."""
    return clean_history(stored.withColumn("seq", F.lit(0)).unionByName(fresh.withColumn("seq", F.lit(1)), allowMissingColumns=True)).drop("seq")


def earliest_observation(observations: DataFrame, source: Column) -> DataFrame:
    genuine = ~F.coalesce(F.lower(source).rlike(PLACEHOLDER_TERMS), F.lit(False))
    return observations.filter(genuine & (F.col("price_per_share") > 0)).agg(F.min("observed_at").alias("earliest"))


def normalized(df: DataFrame, keys: list[str], value: str) -> Column:
    return F.col(value) / F.first(value).over(S.running(keys)) * 100


def align(subject: DataFrame, benchmarks: DataFrame, method: str) -> DataFrame:
    """Benchmarks at the subject's dates: `exact`, `previous`, `month_end` or `quarter_end`.

    Long result `(date, ticker, subject_value, benchmark_value)`; a date stays only when every benchmark has a value.
    """
    names = benchmarks.select("ticker").distinct().agg(F.collect_set("ticker").alias("_t"))
    if method in ("month_end", "quarter_end"):
        period = method.split("_")[0]
        s = S.period_last(subject.withColumn("_k", F.lit(1)), ["_k"], period, "value").select(F.col("period").alias("date"), F.col("value").alias("subject_value"))
        b = S.period_last(benchmarks, ["ticker"], period, "adjusted_close").select("ticker", F.col("period").alias("date"), "adjusted_close")
        joined = s.join(b, "date").select("date", "ticker", "subject_value", F.col("adjusted_close").alias("benchmark_value"))
    else:
        s = subject.select("date", F.col("value").alias("subject_value"))
        if method == "exact":
            joined = s.join(benchmarks.select("ticker", "date", F.col("adjusted_close").alias("benchmark_value")), "date")
        else:
            grid = s.join(names).select("date", "subject_value", F.explode("_t").alias("ticker"))
            joined = S.asof_backward(benchmarks, grid, ["ticker"], ["adjusted_close"]).filter("adjusted_close IS NOT NULL").select(
                "date", "ticker", "subject_value", F.col("adjusted_close").alias("benchmark_value"))
    complete = joined.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).join(names).filter(F.col("_n") == F.size("_t")).select("date")
    return joined.join(complete, "date", "left_semi")


def series_metrics(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Return, risk, drawdown and hit-rate metrics of each series."""
    w = S.over(keys)
    rows = series.withColumns({"r": without_noise(change(value, F.lag(value).over(w))), "gap": F.datediff("date", F.lag("date").over(w)),
                               "dd": without_noise(change(value, F.max(value).over(S.running(keys))))})
    r = F.col("r")
    a = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.count("r").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.min_by(value, "date").alias("v0"), F.max_by(value, "date").alias("v1"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("d2"), F.min("dd").alias("mdd"), F.max(r).alias("best"), F.min(r).alias("worst"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("hits"), F.percentile("gap", F.lit(0.5)).alias("gap"))
    years = F.datediff("end", "start") / 365.25
    ppy = S.periods_per_year("observations", "gap")
    total = change("v1", "v0")
    annual = F.when((years > 0) & (total > -1), F.pow(1 + total, 1 / years) - 1)
    down = F.sqrt(F.col("d2") / F.col("n")) * F.sqrt(ppy)
    many = F.col("observations") >= 2

    def known(c: Column) -> Column:
        return F.when(many, c)

    return a.select(
        *keys, "observations", "start", "end", known(ppy).alias("periods_per_year"), known(total).alias("total_return"), known(annual).alias("annualized_return"),
        known(F.when(F.col("n") > 1, F.col("sd") * F.sqrt(ppy))).alias("annualized_volatility"),
        known(F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(ppy))).alias("sharpe_ratio"),
        known(F.when(down > 0, F.col("mean") * ppy / down)).alias("sortino_ratio"), known(F.col("mdd")).alias("maximum_drawdown"),
        known(F.when(F.col("mdd") < 0, annual / F.abs("mdd"))).alias("calmar_ratio"), known(F.col("best")).alias("best_period"),
        known(F.col("worst")).alias("worst_period"), known(F.col("hits")).alias("positive_period_percentage"))


def paired_returns(aligned: DataFrame) -> DataFrame:
    w = S.over("ticker")
    return aligned.withColumns({"sr": change("subject_value", F.lag("subject_value").over(w)),
                                "br": change("benchmark_value", F.lag("benchmark_value").over(w)),
                                "gap": F.datediff("date", F.lag("date").over(w))})


def relative_metrics(aligned: DataFrame) -> DataFrame:
    """Excess return, tracking error, information ratio, beta, alpha, correlation and capture against each benchmark."""
    rows = paired_returns(aligned)
    sr, br = F.col("sr"), F.col("br")
    both = sr.isNotNull() & br.isNotNull()
    a = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("gap", F.lit(0.5)).alias("gap"), F.stddev_samp(sr - br).alias("sd"), F.avg(sr - br).alias("mean"),
        F.covar_samp(F.when(both, sr), F.when(both, br)).alias("cov"), F.var_samp(br).alias("var"), F.var_samp(sr).alias("svar"), F.avg(sr).alias("ms"), F.avg(br).alias("mb"),
        F.avg(F.when(br > 0, sr)).alias("su"), F.avg(F.when(br > 0, br)).alias("bu"), F.avg(F.when(br < 0, sr)).alias("sdn"),
        F.avg(F.when(br < 0, br)).alias("bdn"), F.min_by("subject_value", "date").alias("s0"), F.max_by("subject_value", "date").alias("s1"),
        F.min_by("benchmark_value", "date").alias("b0"), F.max_by("benchmark_value", "date").alias("b1"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    ppy, years = S.periods_per_year("n", "gap"), F.col("days") / 365.25
    te = F.col("sd") * F.sqrt(ppy)
    beta = ratio("cov", F.nullif("var", F.lit(0.0)))

    def annual(v1: str, v0: str) -> Column:
        return F.when(years > 0, F.pow(F.col(v1) / F.col(v0), 1 / years) - 1)

    return a.filter("n >= 3").select(
        "ticker", (change("s1", "s0") - change("b1", "b0")).alias("excess_total_return"),
        (annual("s1", "s0") - annual("b1", "b0")).alias("annualized_excess_return"), te.alias("tracking_error"),
        F.when(te > 0, F.col("mean") * ppy / te).alias("information_ratio"), beta.alias("beta"),
        ((F.col("ms") - beta * F.col("mb")) * ppy).alias("alpha"),
        ratio("cov", F.nullif(F.sqrt("var") * F.sqrt("svar"), F.lit(0.0))).alias("correlation"),
        ratio("su", F.nullif("bu", F.lit(0.0))).alias("upside_capture"), ratio("sdn", F.nullif("bdn", F.lit(0.0))).alias("downside_capture"))


def comparison_dataset(aligned: DataFrame) -> DataFrame:
    """Raw, rebased, return and excess return of subject and benchmark per date."""
    w = S.over("ticker")
    first = Window.partitionBy("ticker").orderBy("date")
    return aligned.withColumns({
        "subject_normalized": F.col("subject_value") / F.first("subject_value").over(first) * 100,
        "benchmark_normalized": F.col("benchmark_value") / F.first("benchmark_value").over(first) * 100,
        "subject_return": change("subject_value", F.lag("subject_value").over(w)),
        "benchmark_return": change("benchmark_value", F.lag("benchmark_value").over(w))}).withColumn(
        "excess_return", F.col("subject_return") - F.col("benchmark_return"))
