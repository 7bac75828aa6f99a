"""Threshold-rule backtests on quarterly component levels.

Signals depend on component returns only, never on the portfolio. With proceeds kept in cash and no rebalancing each
position is its buy-and-hold value times the product of its past cuts. With rebalancing every quarter the weights after
the rules are known in advance, so the path is a running product. Only proceeds handed to other components without
rebalancing couple the components; those are folded over the quarters, strategies side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import change, quarter_ordinal, ratio
from tessera.operators import series as S


@dataclass(frozen=True)
class Rules:
    gain: float | None = 0.15
    gain_cut: float = 0.5
    loss: float | None = 0.20
    loss_cut: float = 1.0
    proceeds: str = "cash"
    rebalance: str = "none"
    start: float = 100.0


def signals(components: DataFrame, rules: Rules) -> DataFrame:
    """Shared quarters of each strategy with returns, the cut each rule asks for, and the gap to the last quarter.

    `components` carries def_id, asset_id, weight, date and price; a gap of more than one quarter gives no signal.
    """
    members = components.select("def_id", "asset_id").distinct().groupBy("def_id").agg(F.count(F.lit(1)).alias("members"))
    shared = components.groupBy("def_id", "date").agg(F.count(F.lit(1)).alias("n")).join(members, "def_id").filter("n = members")
    q = quarter_ordinal("date")
    w = S.over("def_id")
    shared = shared.withColumn("elapsed", F.coalesce(q - F.lag(q).over(w), F.lit(0))).withColumn("row", F.row_number().over(w))
    rows = components.join(shared.select("def_id", "date", "elapsed", "row", "members"), ["def_id", "date"])
    rows = S.with_returns(rows, ["def_id", "asset_id"])
    ret = F.col("ret")
    cut: Column = F.lit(0.0)
    if rules.loss is not None:
        cut = F.when(ret < -rules.loss, rules.loss_cut).otherwise(cut)
    if rules.gain is not None:
        cut = F.when(ret > rules.gain, rules.gain_cut).otherwise(cut)
    active = (F.col("elapsed") == 1) & ret.isNotNull()
    return rows.withColumn("cut", F.when(active, cut).otherwise(0.0)).withColumn("triggered", F.col("cut") > 0)


def cash_path(sig: DataFrame, rules: Rules) -> DataFrame:
    """No rebalancing, proceeds kept as cash."""
    own = Window.partitionBy("def_id", "asset_id").orderBy("date")
    kept = F.coalesce(F.product(1 - F.col("cut")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    first = F.first("price").over(own)
    rows = sig.withColumn("before", rules.start * F.col("weight") * F.col("price") / first * kept).withColumn(
        "sale", F.col("before") * F.col("cut"))
    d = rows.groupBy("def_id", "date", "elapsed").agg(F.sum("before").alias("held"), F.sum("sale").alias("sold"),
                                                      F.count_if("triggered").alias("events"))
    w = S.over("def_id")
    banked = F.coalesce(F.sum("sold").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("growth_value", F.col("held") + banked).withColumn("cash_value", banked + F.col("sold"))
    return _finish(d.withColumn("turnover", ratio("sold", "growth_value")), rules)


def rebalanced_weights(sig: DataFrame, rules: Rules) -> DataFrame:
    """Weights after the quarterly rebalance and the rules, which do not depend on the path."""
    target = 1 / F.col("members") if rules.rebalance == "equal_weight" else F.col("weight")
    base = F.when(F.col("row") == 1, F.col("weight")).otherwise(target)
    rows = sig.withColumn("w", base).withColumn("kept", F.col("w") * (1 - F.col("cut"))).withColumn(
        "share", F.when(~F.col("triggered"), F.col("kept") if rules.proceeds == "remaining" else F.col("weight")).otherwise(0.0))
    sums = rows.groupBy("def_id", "date").agg(F.sum(F.col("w") * F.col("cut")).alias("sold"), F.sum("share").alias("shares"))
    rows = rows.join(sums, ["def_id", "date"])
    handed = F.lit(0.0) if rules.proceeds == "cash" else F.coalesce(ratio(F.col("sold") * F.col("share"), F.nullif("shares", F.lit(0.0))), F.lit(0.0))
    return rows.withColumn("w_after", F.col("kept") + handed)


def rebalanced_path(sig: DataFrame, rules: Rules) -> DataFrame:
    rows = rebalanced_weights(sig, rules)
    own = S.over(["def_id", "asset_id"])
    rows = rows.withColumn("w_before", F.lag("w_after").over(own))
    d = rows.groupBy("def_id", "date", "elapsed").agg(
        F.sum(F.col("w_before") * (1 + F.col("ret"))).alias("g"), F.sum("w_after").alias("invested"), F.count_if("triggered").alias("events"))
    w = S.over("def_id")
    d = d.withColumn("cash_w", F.greatest(F.lit(0.0), 1 - F.col("invested")))
    d = d.withColumn("g", F.coalesce(F.col("g") + F.lag("cash_w").over(w), F.lit(1.0)))
    d = d.withColumn("growth_value", rules.start * F.product("g").over(S.running("def_id"))).withColumn(
        "cash_value", F.when(F.col("cash_w") > 1e-12, F.col("cash_w")).otherwise(0.0) * F.col("growth_value"))
    drift = rows.join(d.select("def_id", "date", "g"), ["def_id", "date"]).groupBy("def_id", "date").agg(
        F.sum(F.abs(F.col("w_after") - F.coalesce(F.col("w_before") * (1 + F.col("ret")) / F.col("g"), F.col("w_after")))).alias("moved"))
    prior_cash = F.coalesce(F.lag("cash_w").over(w) / F.col("g"), F.col("cash_w"))
    d = d.withColumn("_cash_move", F.abs(F.col("cash_w") - prior_cash))
    d = d.join(drift, ["def_id", "date"]).withColumn("turnover", (F.col("moved") + F.col("_cash_move")) / 2)
    return _finish(d, rules)


FOLD_SCHEMA = "def_id string, date date, elapsed int, events bigint, growth_value double, cash_value double, turnover double"


def coupled_path(sig: DataFrame, rules: Rules) -> DataFrame:
    """Proceeds to other components without rebalancing: a fold over the quarters, of many strategies at once.

    A strategy is one row with its prices and cuts as arrays in order of date and component; strategies of equal shape step together.
    """
    start, to_target = rules.start, rules.proceeds == "target"

    def step_all(price: np.ndarray, cut: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        units, cash, out = start * weight / price[:, 0], np.zeros(len(price)), []
        for t in range(price.shape[1]):
            value, cuts = units * price[:, t], cut[:, t]
            total = value.sum(axis=1) + cash
            kept, sold = value * (1 - cuts), (value * cuts).sum(axis=1)
            share = np.where(cuts == 0, weight if to_target else kept, 0.0)
            shares = share.sum(axis=1)
            handed = np.divide(sold, shares, out=np.zeros_like(sold), where=shares > 0)
            after = kept + handed[:, None] * share
            new_cash = cash + np.where(shares > 0, 0.0, sold)
            moved = np.abs(after - value).sum(axis=1) + np.abs(new_cash - cash)
            out.append(((cuts > 0).sum(axis=1), total, new_cash, np.divide(moved / 2, total, out=np.zeros_like(total), where=total != 0)))
            units, cash = after / price[:, t], new_cash
        return [np.stack(column, axis=1).ravel() for column in zip(*out)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.stack([pc.list_value_length(batch["price"]).to_numpy(), batch["members"].to_numpy()], axis=1)
            for size, members in np.unique(shapes, axis=0):
                part = batch.take(pa.array(np.flatnonzero((shapes == (size, members)).all(axis=1))))
                quarters = size // members
                price, cut, weight, elapsed = (part[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, quarters, members) for c in ("price", "cut", "weight", "elapsed"))
                days = part["date"].flatten().take(pa.array(np.arange(0, part.num_rows * size, members)))
                names = part["def_id"].take(pa.array(np.repeat(np.arange(part.num_rows), quarters)))
                events, total, cash, turnover = step_all(price, cut, weight[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [names, days, pa.array(elapsed[:, :, 0].ravel(), pa.int32()), pa.array(events, pa.int64()), pa.array(total), pa.array(cash), pa.array(turnover)],
                    names=[c.split()[0] for c in FOLD_SCHEMA.split(", ")])

    fields = ["date", "asset_id", "price", "cut", "weight", "elapsed"]
    rows = sig.groupBy("def_id", F.col("members").cast("bigint").alias("members")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_r"))
    folded = rows.select(F.col("def_id").cast("string").alias("def_id"), "members", *[F.col(f"_r.{c}").alias(c) for c in fields if c != "asset_id"]).mapInArrow(fold, FOLD_SCHEMA)
    return _finish(folded, rules)


def _finish(d: DataFrame, rules: Rules) -> DataFrame:
    w = S.over("def_id")
    return d.select(
        "def_id", "date", "elapsed", "events", "growth_value", "cash_value", "turnover",
        F.coalesce(change("growth_value", F.lag("growth_value").over(w)), F.lit(0.0)).alias("period_return"),
        (F.col("growth_value") / rules.start - 1).alias("cumulative_return"),
        change("growth_value", F.max("growth_value").over(S.running("def_id"))).alias("drawdown"))


def backtest(components: DataFrame, rules: Rules) -> DataFrame:
    sig = signals(components, rules)
    if rules.rebalance != "none":
        return rebalanced_path(sig, rules)
    return cash_path(sig, rules) if rules.proceeds == "cash" else coupled_path(sig, rules)
