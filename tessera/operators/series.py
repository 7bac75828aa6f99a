"""Time-series operators on long frames `(key, ts, value)`.

Raw observations are first reduced to one row per key and date with a partial (map-side) aggregate. After that
the rows of one key are bounded by the calendar, so the per-key windows below stay small however many raw rows a
single asset has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change, col, period_of, ratio
from tessera.session import staged, store

# Event kinds that count as a market price, and the precedence used inside one period.
PRICE_EVENTS = ["executed_trade", "daily_close", "chart_observation"]
TERMINAL_EVENTS = ["buyout", "asset_sale", "distribution"]
QUARTERLY_EVENTS = [*PRICE_EVENTS, "offering_price", *TERMINAL_EVENTS]


def event_priority(event: Column | str = "event_type") -> Column:
    e = col(event)
    return F.when(e == "offering_price", 0).when(e.isin(TERMINAL_EVENTS), 2).otherwise(1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in `order`. A max over structs combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(packed.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def daily_quotes(observations: DataFrame, order: Sequence[str]) -> DataFrame:
    """Genuine market prices, one per asset and observation date."""
    kept = observations.filter((F.col("price_per_share") > 0) & F.col("event_type").isin(PRICE_EVENTS))
    rows = kept.select("asset_id", "category", F.col("observed_at").alias("date"), F.col("price_per_share").alias("price"),
                       F.col("market_cap").alias("cap"), "event_type", "bid", "ask", "volume",
                       *[F.col(c).alias(f"_{c}") for c in order])
    return keep_last(rows, ["asset_id", "date"], [f"_{c}" for c in order]).drop(*[f"_{c}" for c in order])


def quarterly_quotes(observations: DataFrame, order: Sequence[str]) -> DataFrame:
    """One price per asset and quarter: terminal events over trades over the offering price, then the latest row."""
    kept = observations.filter((F.col("price_per_share") > 0) & F.col("event_type").isin(QUARTERLY_EVENTS))
    rows = kept.select("asset_id", "category", F.col("period_end").alias("date"), F.col("price_per_share").alias("price"),
                       F.col("market_cap").alias("cap"), "event_type", "observed_at", "s1", "s2", "s3")
    return keep_last(rows, ["asset_id", "date"], [event_priority(), *order]).drop("s1", "s2", "s3")


# --- calendars ----------------------------------------------------------------------------

STEP = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def period_array(start: Column, end: Column, frequency: str) -> Column:
    """All period ends inside [start, end] as an array of dates."""
    if frequency == "week":
        raw = F.sequence(period_of(start, "week"), F.date_add(end, 7), F.expr("INTERVAL 7 DAY"))
    else:
        anchor = F.trunc(start, {"month": "month", "quarter": "quarter", "year": "year"}[frequency])
        raw = F.transform(F.sequence(anchor, end, F.expr(STEP[frequency])), lambda d: period_of(d, frequency))
    return F.filter(raw, lambda d: (d >= start) & (d <= end))


def calendar_grid(bounds: DataFrame, frequency: str, start: str = "start", end: str = "end") -> DataFrame:
    """Bounds rows expanded to the period ends they contain."""
    keep = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*keep, F.explode(period_array(F.col(start), F.col(end), frequency)).alias("date"))


def last_scheduled(d: Column | str, frequency: str) -> Column:
    """Latest scheduled period end on or before a date."""
    day = col(d)
    if frequency == "week":
        return F.next_day(F.date_sub(day, 7), "Fri")
    end = period_of(day, frequency)
    return F.when(end == day, day).otherwise(F.date_sub(F.trunc(day, frequency), 1))


def rebalance_dates(grid: DataFrame, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """First grid date on or after each scheduled period end, plus the first grid date."""
    if frequency == "none":
        return grid.groupBy(*keys).agg(F.min("date").alias("date"))
    slots = grid.groupBy(*keys, last_scheduled("date", frequency).alias("_slot")).agg(F.min("date").alias("date"))
    return slots.select(*keys, "date").distinct()


# --- as-of --------------------------------------------------------------------------------

def asof_backward(
    values: DataFrame, grid: DataFrame, keys: Sequence[str], value_cols: Sequence[str], max_age_days: int | None = None
) -> DataFrame:
    """Latest values on or before each grid row of the same key, with the date they come from.

    Both sides carry `keys` and `date`. One union and one running `last` per key: no range join.
    """
    keys = list(keys)
    extra = [c for c in grid.columns if c not in [*keys, "date"]]
    observed = values.select(*keys, "date", F.struct(F.col("date").alias("effective_date"), *value_cols).alias("_obs"),
                             *[F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("_grid"))
    wanted = grid.select(*keys, "date", F.lit(None).cast(observed.schema["_obs"].dataType).alias("_obs"), *extra,
                         F.lit(1).alias("_grid"))
    seen = F.last("_obs", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("date", "_grid").rowsBetween(Window.unboundedPreceding, 0))
    out = observed.unionByName(wanted).withColumn("_seen", seen).filter("_grid = 1")
    fresh = F.lit(True) if max_age_days is None else (
        F.datediff("date", F.col("_seen.effective_date")) <= max_age_days)
    return out.select(*keys, "date", *extra, *[F.when(fresh, F.col("_seen")[c]).alias(c)
                                                for c in ["effective_date", *value_cols]])


def asof_exact(values: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.join(values, [*keys, "date"], "left")


def period_last(values: DataFrame, keys: Sequence[str], frequency: str, value: str = "price") -> DataFrame:
    """Last value of each period, labelled with the period end."""
    return values.groupBy(*keys, period_of("date", frequency).alias("period")).agg(
        F.max_by(value, "date").alias(value), F.max("date").alias("last_date"))


# --- ordered operators --------------------------------------------------------------------

def over(keys: Sequence[str] | str, order: str = "date"):
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def running(keys: Sequence[str] | str, order: str = "date"):
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def with_returns(df: DataFrame, keys: Sequence[str] | str, value: str = "price", order: str = "date") -> DataFrame:
    w = over(keys, order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("ret", change(value, "previous"))


def with_drawdown(df: DataFrame, keys: Sequence[str] | str, value: str = "price", order: str = "date") -> DataFrame:
    return df.withColumn("peak", F.max(value).over(running(keys, order))).withColumn("drawdown", change(value, "peak"))


def compounded(ret: Column | str, window, base: float = 100.0) -> Column:
    return F.lit(base) * F.product(1 + F.coalesce(col(ret), F.lit(0.0))).over(window)


def gap_stats(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Spacing of the observations of each key in days."""
    w = over(keys, date)
    gaps = df.withColumn("gap", F.datediff(date, F.lag(date).over(w)))
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"),
        F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.stddev_samp("gap").alias("std_gap_samp"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def periods_by_spacing(median: Column | str) -> Column:
    m = col(median)
    return F.when(m <= 10, 52.0).when(m <= 45, 12.0).when(m <= 120, 4.0).otherwise(1.0)


def periods_per_year(n: Column | str, median: Column | str) -> Column:
    """Annualisation factor from median spacing; a single observation counts as yearly."""
    return F.when((col(n) < 2) | col(median).isNull(), 1.0).otherwise(periods_by_spacing(median))


def periods_per_year_regular(df: DataFrame) -> DataFrame:
    """Spacing-based factor when spacing is regular, otherwise observed intervals per elapsed year."""
    years = F.datediff("last_date", "first_date") / 365.25
    regular = ratio("std_gap", "mean_gap") <= 0.25
    return df.withColumn("history_years", F.when(F.col("n") > 1, years).otherwise(0.0)).withColumn(
        "periods", F.when((F.col("n") < 2) | (years <= 0), None).when(regular, periods_by_spacing("median_gap"))
        .otherwise((F.col("n") - 1) / years)).withColumn("is_regular", F.coalesce(regular, F.lit(False)))


def frequency_label(median: Column | str, std: Column | str) -> Column:
    """Spacing name, marked when the spread of gaps is large against the median."""
    m = col(median)
    name = (F.when(m <= 2, "Daily").when(m <= 10, "Weekly").when(m <= 45, "Monthly").when(m <= 135, "Quarterly")
            .when(m <= 270, "Semiannual").otherwise("Annual / sparse"))
    return F.when(ratio(std, m) > 0.35, F.concat(name, F.lit(" (irregular)"))).otherwise(name)


def _placed_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column) -> DataFrame:
    """Rows dealt to tasks by range and kept, with `_part` and the summed size of the same group in earlier parts, `_ahead`. Counts and rows
    see the same stored parts."""
    placed = staged(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.sum(size).alias("_size"))
    ahead = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_size").over(Window.partitionBy(*keys))
    offsets = sizes.select(*keys, "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"), total.alias("_total"))
    return placed.join(offsets, [*keys, "_part"])


def _in_order(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str | Column], kept: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The `kept` columns of rows stored in range parts, with `_part` and their place `_at` in its file, and for each group and part the first place,
    the rows of the group in earlier parts, `_ahead`, and in all, `_total`. Groups of one table are not in another; tables are stored one after the
    other, so that the shuffle of one is on disk at a time."""
    by = [*keys, *order]
    paths = [store(t.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept, F.spark_partition_id().alias("_part"))) for t in tables]
    schema = tables[0].select(*kept, F.lit(0).alias("_part")).schema
    placed = tables[0].sparkSession.read.schema(schema).parquet(*paths).select("*", F.col("_metadata.row_index").alias("_at"))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    ahead = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_size").over(Window.partitionBy(*keys))
    return placed, staged(sizes.select(*keys, "_part", "_first", F.coalesce(ahead, F.lit(0)).alias("_ahead"), total.alias("_total")))


def ranked_in_parts(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str | Column], kept: Sequence[str], size: str) -> tuple[DataFrame, DataFrame]:
    """The `kept` columns of the rows of all tables with their ordinal `rank` in their group and its rows, `size`; and a row per group with `size`.

    Rows are shuffled once: the stored parts are sorted, so a row's place in the file of its part is its position, and the first places of the
    groups of a part, at most one row a group and part, are stored so that their size is known. What only decides the order need not be kept.
    """
    placed, offsets = _in_order(tables, keys, order, kept)
    ranked = placed.join(offsets, [*keys, "_part"]).withColumn("rank", F.col("_ahead") + F.col("_at") - F.col("_first") + 1)
    return ranked.withColumnRenamed("_total", size).drop("_part", "_at", "_first", "_ahead"), offsets.groupBy(*keys).agg(F.max("_total").alias(size))


def ordinal_rank_distributed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: str | None = None) -> DataFrame:
    """Ordinal rank of groups too large to sort in one task: the rows of the group in earlier parts plus the position inside its own.
    `size` names a column for the rows of the group."""
    ranked, _ = ranked_in_parts([df], keys, order, df.columns, size or "_total")
    return ranked if size else ranked.drop("_total")


def ordinal_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rank`, group size `n` and the percentile that falls from 1 to 0; a group of one row is at 1."""
    n, rank = F.col("n"), F.col("rank")
    return ordinal_rank_distributed(df, keys, order, "n").withColumn("percentile", F.when(n == 1, 1.0).otherwise(ratio(n - rank, n - 1)))


def rank_average(df: DataFrame, keys: Sequence[str], value: str, out: str, pct: bool = True) -> DataFrame:
    """Average rank of ties, as a share of the group when `pct`; a missing value has no rank and counts for nothing.

    Equal values are one counted row before anything is ordered, and the distinct values of a group are ranked over many tasks.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = _placed_by_range(counted, keys, [value], F.col("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("_ahead") + upto - (F.col("_c") - 1) / 2
    ranks = placed.select(*keys, value, (rank / F.col("_total") if pct else rank).alias(out))
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out)


#: Rows that are compared with each other directly, as neighbours in order; longer histories are merged block by block.
NEAR = 16


def share_of_history(df: DataFrame, key: str, value: str, out: str, order: str = "date") -> DataFrame:
    """For every row the share of the rows of its key up to it whose value is at most its own.

    An ordered merge count: rows are numbered in order and lie in blocks of `NEAR`. Inside its block a row is compared with the rows before
    it; above that, at level k, blocks of 2^k rows are paired, and a row in the right block of a pair counts the rows of the left block that
    are not above it, by one ordered pass over the pair. The blocks a row is right of make up all rows before it, so no history is held, and
    only pairs with a right block are made: a key of at most `NEAR` rows makes none. Rows without a value have no share and count for nothing.
    """
    start = NEAR.bit_length() - 1
    known = Window.partitionBy(key, F.col(value).isNull())
    w = known.orderBy(order)
    numbered = df.withColumns({"_i": (F.row_number().over(w) - 1).cast("long"), "_n": F.count(F.lit(1)).over(known),
                               **{f"_l{j}": F.lag(value, j).over(w) for j in range(1, NEAR)}})
    near = [F.when((F.col("_i") % NEAR >= j) & (F.col(f"_l{j}") <= F.col(value)), 1).otherwise(0) for j in range(1, NEAR)]
    numbered = numbered.withColumn("_near", sum(near, F.lit(1))).drop(*[f"_l{j}" for j in range(1, NEAR)])
    block = lambda k: F.call_function("shiftright", F.col("_i"), k)
    has_right = lambda k: F.call_function("shiftleft", block(k + 1) * 2 + 1, k) < F.col("_n")
    levels = F.filter(F.sequence(F.lit(start), F.greatest(F.lit(start), F.ceil(F.log2("_n")).cast("int"))), has_right)
    far = numbered.filter((F.col("_n") > NEAR) & F.col(value).isNotNull()).select(key, order, F.col(value).alias("_x"), "_i", F.explode(levels).alias("_k"))
    far = far.withColumns({"_right": block(F.col("_k")) % 2, "_pair": block(F.col("_k") + 1)})
    upto = Window.partitionBy(key, "_k", "_pair").orderBy("_x", "_right").rowsBetween(Window.unboundedPreceding, 0)
    below = far.withColumn("_c", F.sum(1 - F.col("_right")).over(upto)).filter("_right = 1").groupBy(key, order).agg(F.sum("_c").alias("_below"))
    share = (F.coalesce("_below", F.lit(0)) + F.col("_near")) / (F.col("_i") + 1)
    return numbered.join(below, [key, order], "left").select(*df.columns, F.when(F.col(value).isNotNull(), share).alias(out))
