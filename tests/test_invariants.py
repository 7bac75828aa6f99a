"""Brute-force comparisons, skewed inputs and plan shapes."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import options as O
from tessera.operators import portfolios as P
from tessera.operators import stories as T
from tessera.operators import valuation as V
from tessera.operators.quantiles import exact_quantiles


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = np.round(rng.normal(size=30_000), 3)
    rows = pd.concat([pd.DataFrame({"k": "hot", "v": hot}), pd.DataFrame({"k": "tiny", "v": [1.0, 2.0]}), pd.DataFrame({"k": "same", "v": np.full(5000, 7.0)})])
    out = exact_quantiles(spark.createDataFrame(rows), ["k"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1.0}).collect()
    for r in out:
        values = rows.loc[rows["k"] == r["k"], "v"]
        assert [r["q10"], r["q50"], r["q95"], r["q100"]] == pytest.approx(list(values.quantile([0.1, 0.5, 0.95, 1.0])))


@pytest.mark.parametrize("noise", [0.2, 50.0])
def test_exact_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch, noise):
    """Sketches merged in another order, here at every evaluation, or far off, give the same quantiles."""
    sound = F.percentile_approx
    stir = F.udf(lambda b: sorted(x + random.uniform(-noise, noise) for x in b), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda v, b, accuracy: stir(sound(v, b, accuracy)))
    rows = [(f"k{i % 3}", float((i * 7919) % 30_011)) for i in range(60_000)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q50"], r["q95"]) for r in exact_quantiles(d, ["k"], "v", {"q50": 0.5, "q95": 0.95}).collect()}
    frame = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"]
    assert got == {k: (pytest.approx(frame.get_group(k).quantile(0.5)), pytest.approx(frame.get_group(k).quantile(0.95))) for k in ("k0", "k1", "k2")}
    assert exact_quantiles(d, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(float(np.median([v for _, v in rows])))


FIELDS = ["brand", "model", "size", "material", "color", "hardware"]


def brute_force(assets, comps):
    best = {}
    for a in assets:
        scored = []
        for c in comps:
            score = sum(V.MATCH_WEIGHTS[f] for f in FIELDS if a[f] and a[f] == c[f])
            if a["year"] is not None and c["year"] is not None:
                gap = abs(a["year"] - c["year"])
                score += 0.05 if gap <= 2 else max(0.01, 0.05 * (1 - gap / 10)) if gap <= 10 else 0
            score = round(score, 4)
            if score >= 0.20:
                scored.append((-score, -c["realized_price_usd"], c["comp_id"]))
        best[a["asset_id"]] = [x[2] for x in sorted(scored)[: V.TOP_COMPS]]
    return best


def test_similarity_join_equals_brute_force_on_skewed_brands(spark):
    rng = random.Random(7)

    def item(i, kind):
        hot = rng.random() < 0.4
        pick = lambda values: rng.choice(values)
        row = {"brand": "hot" if hot else pick(["x", "y", None]), "model": pick(["m1", "m2", "m3", None]), "size": pick(["25", "30", "35", None]), "material": pick(["t", "e", "o", None]),
               "color": pick(["r", "g", "b", None]), "hardware": pick(["A", "N", None]), "year": pick([1990, 1996, 1997, 1999, 2004, None])}
        return {f"{kind}_id": f"{kind}{i:04d}", **row, **({"realized_price_usd": float(rng.randrange(1, 60)), "sale_date": dt.date(2020, 1, 1)} if kind == "comp" else {})}

    assets, comps = [item(i, "asset") for i in range(60)], [item(i, "comp") for i in range(400)]
    attrs = "brand string, model string, size string, material string, color string, hardware string, year int"
    a = spark.createDataFrame(assets, "asset_id string, " + attrs)
    c = spark.createDataFrame(comps, "comp_id string, " + attrs + ", realized_price_usd double, sale_date date")
    joined = V.similarity_join(a, c)
    got = {}
    for r in joined.orderBy("asset_id", "rank").collect():
        got.setdefault(r["asset_id"], []).append(r["comp_id"])
    want = {k: v for k, v in brute_force(assets, comps).items() if v}
    assert got == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_similarity_join_stops_when_all_lists_are_full(spark, monkeypatch):
    """Assets with 20 full matches close after the first round; no later attribute set is looked up. Sizes meet as 30 and 30.0."""
    asked, sound = [], V._lists
    monkeypatch.setattr(V, "_lists", lambda sales, wanted, sets: asked.append(sets) or sound(sales, wanted, sets))
    attrs = "brand string, model string, size {}, material string, color string, hardware string, year int"
    a = spark.createDataFrame([(f"a{i}", "B|x", "m", "30", "t", "r", "A", 1999) for i in range(3)], "asset_id string, " + attrs.format("string"))
    sales = [(f"c{i:02d}", "b|X ", "M", 30.0, "t", "r", "A", 1999, float(i), dt.date(2020, 1, 1)) for i in range(30)]
    sales += [(f"d{i:02d}", "b", "x|m", 30.0, "t", "r", "A", 1999, 999.0, dt.date(2020, 1, 1)) for i in range(30)]
    c = spark.createDataFrame(sales, "comp_id string, " + attrs.format("double") + ", realized_price_usd double, sale_date date")
    rows = V.similarity_join(a, c).collect()
    assert len(asked) == 1 and len(rows) == 60 and {r["similarity_score"] for r in rows} == {1.0}
    assert {r["comp_id"] for r in rows} == {f"c{i:02d}" for i in range(10, 30)}
    asked.clear()
    assert V.similarity_join(a.withColumn("size", F.lit("31.0")), c).count() == 60 and len(asked) == 2
    assert V.similarity_join(a.where("false"), c).count() == 0 == V.similarity_join(a, c.where("false")).count()


def test_similarity_join_broadcasts_nothing_and_values_equal_profiles_once(spark):
    """Compressed tables and exploded keys look small; what is joined goes through shuffles. Two assets of one profile share its sales."""
    attrs = "brand string, model string, size string, material string, color string, hardware string, year int"
    a = spark.createDataFrame([(f"a{i}", "b", "m", "30", "t", "r", "A", 1999) for i in range(2)], "asset_id string, " + attrs)
    c = spark.createDataFrame([(f"c{i}", "b", "m", "30", "t", "r", "A", 1999, 10.0 * (i + 1), dt.date(2020, 1, 1 + i), 0.5, 1.0, 2.0) for i in range(4)],
                              "comp_id string, " + attrs + ", realized_price_usd double, sale_date date, source_confidence double, estimate_low_usd double, estimate_high_usd double")
    joined = V.similarity_join(a, c)
    joined.count()
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 8
    members, found = V.matched_profiles(a, c, carry=("source_confidence", "estimate_low_usd", "estimate_high_usd"))
    assert found.count() == 4 and members.select("profile").distinct().count() == 1
    market = members.selectExpr("*", "50.0D AS current_market_cap_usd", "40.0D AS offering_market_cap_usd", "1.0D AS bid", "1.0D AS ask")
    rows = V.nav_similarity_weighted(market, found, "2020-01-02", "profile").orderBy("asset_id").collect()
    assert [(r["asset_id"], r["comp_count"], r["estimated_nav_usd"], r["momentum_90d"]) for r in rows] == [("a0", 4, pytest.approx(25.0), None), ("a1", 4, pytest.approx(25.0), None)]


def test_similarity_join_copies_sales_for_the_first_sets_only(spark, monkeypatch, tmp_path):
    """Later sets are looked up by the distinct attributes of sales; of what is stored meanwhile only profiles, open ones and the result stay."""
    keyed, sound = [], V.with_keys
    monkeypatch.setattr(V, "with_keys", lambda df, sets: keyed.append((len(sets), df.columns)) or sound(df, sets))
    paths, store = [], V.store
    monkeypatch.setattr(V, "store", lambda df: paths.append(store(df)) or paths[-1])
    attrs = "brand string, model string, size string, material string, color string, hardware string, year int"
    a = spark.createDataFrame([("a0", "b", "m", "30", "t", "r", "A", 1999), ("a1", "b", None, "31", None, "g", "N", None)], "asset_id string, " + attrs)
    c = spark.createDataFrame([(f"c{i}", "b", "m", "30", "t", "r", "A", 1999, 10.0 * (i + 1), dt.date(2020, 1, 1)) for i in range(4)], "comp_id string, " + attrs + ", realized_price_usd double, sale_date date")
    rows = V.similarity_join(a, c).collect()
    assert sorted((r["asset_id"], r["comp_id"], r["matched_fields"]) for r in rows) == [
        (x, f"c{i}", fields) for x, fields in (("a0", "brand, model, size, material, color, hardware, year"), ("a1", "brand")) for i in range(4)]
    assert all(n <= V.ROUND_SETS[0] or not {"comp_id", "_sales"} & set(columns) for n, columns in keyed) and max(n for n, _ in keyed) > V.ROUND_SETS[0]
    from pathlib import Path
    assert sum(Path(p).exists() for p in paths) == 1


def sequential_total_return(assets, prices, exits, dates, marks, weighting):
    """Unit accounting date by date for one universe."""
    units, cash, pending, path = {}, 100.0, {}, []
    for d in dates:
        for aid, (eff, settle, terminal, waits) in exits.items():
            if aid in units and d >= eff:
                paid = units.pop(aid) * terminal
                if waits and d < settle:
                    pending[aid] = paid
                else:
                    cash += paid
        for aid in [x for x in pending if d >= exits[x][1]]:
            cash += pending.pop(aid)
        known = {a: max((x for x in ps if x[0] <= d), default=None) for a, ps in prices.items()}
        known = {a: x[1] for a, x in known.items() if x}
        total = cash + sum(pending.values()) + sum(u * known[a] for a, u in units.items())
        if d in marks:
            live = [a for a, (offered, _) in assets.items() if offered <= d and a in known and not (a in exits and d >= exits[a][0])]
            if live:
                raw = {a: 1.0 if weighting == "equal_weight" else known[a] * assets[a][1] for a in live}
                units = {a: total * raw[a] / sum(raw.values()) / known[a] for a in live}
                cash, pending = 0.0, {}
        path.append(total)
    return path


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_total_return_equals_sequential_accounting(spark, frame, seed):
    rng = random.Random(seed)
    days = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(18)]
    assets = {f"a{i}": (rng.choice(days[:9]), float(rng.randrange(1, 50))) for i in range(6)}
    prices = {a: sorted((d, round(rng.uniform(5, 50), 2)) for d in rng.sample(days, 9)) for a in assets}
    for a, (offered, _) in assets.items():
        prices[a] = sorted({offered: 20.0, **dict(prices[a])}.items())
    exits = {"a1": (days[10], days[12], 33.0, True), "a2": (days[7], days[7], 0.0, False)}
    marks = {days[i] for i in (0, 3, 6, 9, 12, 15)}
    a = frame([(k, k, k, "c", s, o.isoformat(), 20.0) for k, (o, s) in assets.items()],
              "asset_id string, ticker string, name string, category string, share_count double, offering_date date, offering_price_usd double")
    q = frame([(k, "c", d.isoformat(), p, None, "daily_close") for k, ps in prices.items() for d, p in ps], "asset_id string, category string, date date, price double, cap double, event_type string")
    e = frame([(k, "sale", "pending_settlement" if w else "settled", x.isoformat(), y.isoformat(), t, "s") for k, (x, y, t, w) in exits.items()],
              "asset_id string, exit_type string, exit_status string, exit_effective_date date, settlement_date date, terminal_price double, terminal_price_source string")
    grid = frame([(d.isoformat(),) for d in days], "date date")
    real = P.S.rebalance_dates
    P.S.rebalance_dates = lambda g, f, keys=(): frame([(d.isoformat(),) for d in sorted(marks)], "date date")
    try:
        series = P.total_return_index(a, q, e, grid).series.filter("universe = 'all'").collect()
    finally:
        P.S.rebalance_dates = real
    for weighting in ("equal_weight", "market_cap_weight"):
        got = [r["value"] for r in sorted((r for r in series if r["weighting"] == weighting), key=lambda r: r["date"])]
        assert got == pytest.approx(sequential_total_return(assets, prices, exits, days, marks, weighting))


def greedy(rows):
    rows = sorted((r for r in rows if r["quality"] >= T.MIN_QUALITY), key=lambda r: (-r["content_score"], r["story_id"]))
    picked, subjects, families, prints = [], {}, {}, set()
    for r in rows:
        fp = (r["subject_id"], r["family"])
        if fp in prints or subjects.get(r["subject_id"], 0) >= T.PER_SUBJECT or families.get(r["family"], 0) >= T.PER_FAMILY:
            continue
        picked.append(r)
        prints.add(fp)
        subjects[r["subject_id"]] = subjects.get(r["subject_id"], 0) + 1
        families[r["family"]] = families.get(r["family"], 0) + 1
    if len(picked) <= T.SLATE:
        return [r["story_id"] for r in picked]
    first, seen = [], set()
    for r in picked:
        if r["family"] not in seen:
            seen.add(r["family"])
            first.append(r)
    chosen = {r["story_id"] for r in first}
    return [r["story_id"] for r in (first + [r for r in picked if r["story_id"] not in chosen])[: T.SLATE]]


def test_pruned_slate_equals_full_greedy(spark):
    rng = random.Random(3)
    rows = [{"period": dt.date(2024, 3, 31), "story_id": f"s{i:05d}", "family": f"f{rng.randrange(16)}", "kind": rng.choice("xy"), "subject_id": f"u{rng.randrange(60)}",
             "content_score": float(rng.randrange(1, 400)), "quality": rng.choice([0.2, 0.5, 0.9])} for i in range(3000)]
    out = T.slate(spark.createDataFrame(rows, "period date, story_id string, family string, kind string, subject_id string, content_score double, quality double"))
    assert [r["story_id"] for r in out.orderBy("position").collect()] == greedy(rows)


def test_slate_with_more_families(spark):
    rng = random.Random(4)
    rows = [{"period": dt.date(2024, 3, 31), "story_id": f"s{i:05d}", "family": f"f{rng.randrange(23)}", "kind": "x", "subject_id": f"u{rng.randrange(9)}",
             "content_score": float(rng.randrange(1, 50)), "quality": 0.9} for i in range(900)]
    out = T.slate(spark.createDataFrame(rows, "period date, story_id string, family string, kind string, subject_id string, content_score double, quality double"))
    assert [r["story_id"] for r in out.orderBy("position").collect()] == greedy(rows)


def test_put_call_parity(spark):
    base = spark.createDataFrame([("u", 100.0, 0.3)], "subject_id string, spot double, volatility double")
    rows = O.option_grid(base, [0.8, 1.0, 1.3], [30, 365], 0.04, 0.01).collect()
    for call in (r for r in rows if r["option_type"] == "call"):
        put = next(r for r in rows if r["option_type"] == "put" and r["strike"] == call["strike"] and r["days"] == call["days"])
        assert call["price"] - put["price"] == pytest.approx(call["ds"] - call["dk"], abs=1e-9)
        assert call["delta"] - put["delta"] == pytest.approx(float(np.exp(-0.01 * call["t"])))


def test_bootstrap_repeats(spark):
    rows = [("u", dt.date(2020, 1, 1) + dt.timedelta(days=90 * i), 100.0 * 1.01 ** (i * (-1) ** i)) for i in range(14)]
    s = spark.createDataFrame(rows, "subject_id string, date date, value double")
    base = spark.createDataFrame([("u", 100.0, 101.0, 1.0)], "subject_id string, spot double, strike double, premium double")
    one, two = (O.bootstrap_profit(s, base, 1.0, 300, 5).first()["probability_of_profit"] for _ in range(2))
    assert one == two and 0 < one < 1


def test_bootstrap_strategies_by_brute_force(spark):
    """All registered strategies over the same drawn paths, in blocks of which the last is not full."""
    start, base, paths = dt.date(2020, 1, 1), [("u", 100.0, 101.3, 1.1), ("v", 50.0, 45.0, 2.0)], 610
    values = {s: [100.0 * (1 + 0.02 * k) ** (i % 3) + i for i in range(12)] for k, s in enumerate("uv", 1)}
    rows = [(s, start + dt.timedelta(days=90 * i), v) for s in values for i, v in enumerate(values[s])]
    series = spark.createDataFrame(rows, "subject_id string, date date, value double")
    frame = spark.createDataFrame(base, "subject_id string, spot double, strike double, premium double")
    got = {(r["subject_id"], r["strategy"]): (r["probability_of_profit"], r["paths"]) for r in O.bootstrap_profit(series, frame, 1.0, paths, 5, O.STRATEGIES).collect()}
    steps = spark.createDataFrame([(s, p, i) for s in values for p in range(1, paths + 1) for i in range(1, 5)], "s string, p int, i int")
    draws = {(r["s"], r["p"], r["i"]): r["h"] % 11 for r in steps.withColumn("h", F.xxhash64(F.lit(5), "s", "p", "i")).collect()}
    want = {}
    for s, spot, strike, premium in base:
        returns = np.diff(np.log(values[s]))
        ends = [spot * np.exp(sum(returns[draws[s, p, i]] for i in range(1, 5))) for p in range(1, paths + 1)]
        gains = {"long_call": lambda x: max(x - strike, 0) - premium, "long_put": lambda x: max(strike - x, 0) - premium,
                 "covered_call": lambda x: x - spot + premium - max(x - strike, 0), "protective_put": lambda x: x - spot - premium + max(strike - x, 0)}
        want |= {(s, name): (pytest.approx(np.mean([gain(x) > 0 for x in ends])), paths) for name, gain in gains.items()}
    assert got == want and {s for _, s in got} == set(O.STRATEGIES)


def test_bootstrap_draws_in_all_tasks_and_decides_break_even(spark):
    """Small rows with much work each stay in as many tasks as the session has; paths that end on a break-even go by Spark's own exp."""
    start, subjects, paths = dt.date(2020, 1, 1), [f"s{k}" for k in range(40)], 50
    rows = [(s, start + dt.timedelta(days=365 * i), 100.0 if i % 2 else 110.0) for s in subjects for i in range(10)]
    series = spark.createDataFrame(rows, "subject_id string, date date, value double")
    base = series.select("subject_id").distinct().selectExpr("subject_id", "100D AS spot", "100D * exp(ln(110D / 100D)) AS strike", "0D AS premium")
    out = O.bootstrap_profit(series, base, 1.0, paths, 5, ["long_call", "protective_put"])
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["subject_id"], r["strategy"]): r["probability_of_profit"] for r in out.collect()}
    assert got == {k: v for s in subjects for k, v in (((s, "long_call"), 0.0), ((s, "protective_put"), 1.0))}


def test_distributed_rank_equals_window_rank(spark):
    from pyspark.sql import Window

    from tessera.operators.series import ordinal_rank_distributed

    d = spark.range(5000).select((F.col("id") % 3 == 0).alias("hot"), F.col("id").alias("subject"), (F.col("id") * 7919 % 40).alias("v"))
    want = d.withColumn("rank", F.row_number().over(Window.partitionBy("hot").orderBy("v", "subject")).cast("bigint"))
    got = ordinal_rank_distributed(d, ["hot"], ["v", "subject"])
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == 5000


def test_rank_average(frame):
    from tessera.operators.series import rank_average

    d = frame([("k", v) for v in (1, 2, 2, 4)], "k string, v double")
    out = sorted((r["v"], r["p"]) for r in rank_average(d, ["k"], "v", "p").collect())
    assert out == [(1, 0.25), (2, 0.625), (2, 0.625), (4, 1.0)]


def test_share_of_history_equals_counting(spark):
    """Ties, missing values, several keys, and one key of 100,000 days whose history no row carries."""
    from tessera.operators.series import share_of_history

    rng = random.Random(4)
    rows = [(k, d, rng.choice([None, 0.0, 1.0, 1.0, 2.5, float(rng.randrange(50))])) for k, n in (("a", 37), ("b", 1), ("c", 64), ("d", 100)) for d in range(n)]
    got = {(r["k"], r["d"]): r["s"] for r in share_of_history(spark.createDataFrame(rows, "k string, d int, v double"), "k", "v", "s", "d").collect()}
    for k, d, v in rows:
        past = [x for kk, dd, x in rows if kk == k and dd <= d and x is not None]
        assert got[(k, d)] is None if v is None else abs(got[(k, d)] - sum(x <= v for x in past) / len(past)) < 1e-12
    long = spark.range(100_000).select(F.lit("x").alias("k"), F.col("id").alias("d"), F.pmod(F.xxhash64("id"), F.lit(1_000)).cast("double").alias("v"))
    out = share_of_history(long, "k", "v", "s", "d")
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    values = [r["v"] for r in long.orderBy("d").select("v").collect()]
    last = out.orderBy(F.desc("d")).first()
    assert abs(last["s"] - sum(x <= values[-1] for x in values) / len(values)) < 1e-12


def test_share_of_history_at_block_borders(spark):
    """Short histories are compared with neighbours only; at block borders nothing is counted twice or left out, and only pairs with a right block are made."""
    from tessera.operators.series import share_of_history

    rng = random.Random(5)
    rows = [(n, d, rng.choice([None, float(rng.randrange(9))])) for n in (1, 15, 16, 17, 31, 32, 33, 48, 49, 80) for d in range(n + 5)]
    df = spark.createDataFrame(rows, "k int, d int, v double")
    got = {(r["k"], r["d"]): r["s"] for r in share_of_history(df, "k", "v", "s", "d").collect()}
    for k, d, v in rows:
        past = [x for kk, dd, x in rows if kk == k and dd <= d and x is not None]
        assert got[(k, d)] is None if v is None else abs(got[(k, d)] - sum(x <= v for x in past) / len(past)) < 1e-12
    out = share_of_history(spark.range(16_000).selectExpr("id % 1000 AS k", "id AS d", "CAST(id % 7 AS DOUBLE) AS v"), "k", "v", "s", "d")
    assert out.count() == 16_000
    assert made_rows(out) == 0


def made_rows(df) -> int:
    """Rows that the explode of a plan makes, after running it."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    todo, n = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan], 0
    while todo:
        x = todo.pop()
        if x.nodeName() == "Generate":
            n += x.metrics().apply("numOutputRows").value()
        todo += [x.plan()] if x.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage") else [x.children().apply(i) for i in range(x.children().length())]
    return n


def counted(spark, rows, schema):
    """A table that counts how often its rows are read."""
    reads = spark.sparkContext.accumulator(0)

    def read(row):
        reads.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(read), schema), reads


def test_archive_of_some_dates_equals_the_whole_one(spark, monkeypatch):
    from tessera.operators import crosssection as X

    stored = []
    monkeypatch.setattr(X, "staged", lambda df: stored.append(df.count()) or df)
    rows = [(f"s{i}", "asset", dt.date(2000, 3 * q, 31 if q in (1, 4) else 30), 9 if i % 5 else None, 10 * (i % 3), 4.0, float((i * q) % 11)) for i in range(30) for q in (1, 2, 3, 4)]
    m = spark.createDataFrame(rows, "subject_id string, subject_type string, date date, obs_no int, age int, history_years double, total_return double")
    whole = X.leaderboard_archive(m, ["total_return"]).filter("date = DATE '2000-06-30'")
    some = X.leaderboard_archive(m, ["total_return"], dates=["2000-06-30"])
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.collect())) and some.count() == 30
    assert stored == [120, 30]


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "shuffle_" in n}


def test_stored_tables_leave_no_shuffle_files(spark):
    """The shuffle behind a stored table goes with its writing, not when the driver next collects garbage."""
    from tessera.session import staged

    before = shuffle_files(spark)
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before
    before = shuffle_files(spark)
    stored = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before and stored.count() == 7


def test_archive_ranks_few_metrics_at_a_time_and_stores_no_order(spark, monkeypatch):
    """All metrics, ties and rows without a value: equal to a window, with at most RANKED_TOGETHER metrics in a shuffle."""
    from pyspark.sql import Window

    from tessera.operators import crosssection as X, series as S

    stored, sound = [], S.store
    monkeypatch.setattr(S, "store", lambda df: stored.append((df.columns, df.select("metric").distinct().count())) or sound(df))
    names = list(X.LEADERBOARD_METRICS)
    rows = [(f"s{i:02d}", "asset", dt.date(2000, 3 * q, 31 if q in (1, 4) else 30), 99, 10, *[None if (i + j) % 9 == 0 else float((i * q + j) % 7) for j in range(len(names))])
            for i in range(25) for q in (1, 2)]
    m = spark.createDataFrame(rows, "subject_id string, subject_type string, date date, obs_no int, age int, " + ", ".join(f"{n} double" for n in names))
    got = X.leaderboard_archive(m, carried=())
    assert len(stored) == -(-len(names) // X.RANKED_TOGETHER)
    assert all("_order" not in columns and n <= X.RANKED_TOGETHER for columns, n in stored)
    states = X.archive_states(m)
    low = F.create_map(*[F.lit(x) for n, rule in X.LEADERBOARD_METRICS.items() for x in (n, rule[0])])[F.col("metric")]
    group = Window.partitionBy("date", "metric", "eligible")
    want = states.withColumns({"rank": F.when(F.col("eligible"), F.row_number().over(group.orderBy(F.when(low, F.col("value")).otherwise(-F.col("value")), "subject_id"))).cast("bigint"),
                               "eligible_universe_size": F.count_if("eligible").over(Window.partitionBy("date", "metric"))})
    shown = ["subject_id", "date", "metric", "value", "eligible", "exclusion_reason", "rank", "eligible_universe_size"]
    assert got.count() == len(rows) * len(names) and got.select(shown).exceptAll(want.select(shown)).isEmpty()


def test_a_sound_archive_is_validated_in_one_reading(spark):
    from tessera.operators import crosssection as X

    rows = [(dt.date(2000, 3, 31), f"s{i}", name, i - 1) for i in range(3) for name in ("cagr", "total_return")]
    archive, reads = counted(spark, rows, "date date, subject_id string, metric string, age long")
    assert X.validate_archive(archive).first().asDict() == {"duplicate_states": 0, "future_observations": 2, "rows": 6} and reads.value == len(rows)
    assert X.validate_archive(archive.where("false")).first().asDict() == {"duplicate_states": 0, "future_observations": 0, "rows": 0}
    twice = X.validate_archive(archive.unionAll(archive.filter("subject_id = 's0' AND metric = 'cagr'"))).first()
    assert twice.asDict() == {"duplicate_states": 1, "future_observations": 2, "rows": 7}


def test_evidence_of_a_valuation_is_read_once(spark):
    from tessera.operators.valuation import research_valuation

    rows = [("a", 10.0, 1.0, True, True, "2001-01-02"), ("a", 10.0, 1.0, True, False, "2001-01-03"), ("a", 30.0, 2.0, True, True, "2001-01-01"), ("a", 99.0, 0.0, False, False, "2001-05-01"),
            ("a", None, 0.0, False, True, "2001-04-01"), ("b", 5.0, 0.0, False, False, "2001-02-01")]
    evidence, reads = counted(spark, rows, "asset_id string, usd_price double, weight double, included boolean, verified boolean, sale_date string")
    factors = spark.createDataFrame([("a", True, True)], "asset_id string, has_condition boolean, has_history boolean")
    out = {r["asset_id"]: r for r in research_valuation(evidence, factors).collect()}
    assert reads.value == len(rows)
    a, b = out["a"], out["b"]
    assert (a["raw_count"], a["eligible_count"], a["conservative_value_usd"], a["base_value_usd"], a["optimistic_value_usd"]) == (5, 3, 10, 10, 30)
    assert a["weighted_comparable_value_usd"] == 20 and a["dispersion_pct"] == 2 and a["last_sale_date"] == "2001-05-01"
    assert (b["raw_count"], b["eligible_count"], b["valuation_status"], b["weighted_comparable_value_usd"]) == (1, 0, "insufficient_evidence", None)


def test_price_rows_are_aggregated_once(spark):
    from tessera.operators.quality import validate_prices

    names = ["seq", "asset_id", "period_end", "observed_at", "price_per_share", "market_cap", "event_type", "precision_status", "volume", "source_reference"]
    make = lambda seq, price, cap, event="daily_close": (seq, "1", "2001-03-31", "2001-03-30", price, cap, event, "exact", "1", "x")
    rows = [make(1, "5", None), make(2, "5", None), make(3, "6", None), make(4, "5", "500"), make(5, "6", None), make(6, "6", None, "executed_trade")]
    raw, reads = counted(spark, rows, ", ".join("seq int" if n == "seq" else f"{n} string" for n in names))
    master = spark.createDataFrame([(1, 100.0, None)], "asset_id int, share_count double, exit_date date")
    out = {r["seq"]: r["rejection_reason"] for r in validate_prices(raw, master, "seq").collect()}
    again, other = "duplicate_price_observation", "conflicting_price_observation"
    assert out == {1: "", 2: again, 3: other, 4: other, 5: f"{again}; {other}", 6: ""}
    assert reads.value == 2 * len(rows)


def test_ranks_of_one_large_date_use_many_tasks(spark):
    """A million rows of one date: both ranks agree with numpy and no task orders the whole date."""
    from tessera.operators.series import ordinal_rank_distributed, rank_average

    n = 1_000_000
    d = spark.range(0, n, 1, 8).select(F.lit("day").alias("date"), F.col("id"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5_000)).cast("double")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordinal_rank_distributed(d, ["date"], ["v", "id"], "n")
        assert got.filter(f"n <> {n}").count() == 0 and got.agg(F.countDistinct("rank")).first()[0] == n
        average = rank_average(d, ["date"], "v", "p", pct=False).select("v", "p").distinct().toPandas().sort_values("v")
        counts = d.groupBy("v").count().toPandas().sort_values("v")
        upto = counts["count"].cumsum().to_numpy()
        assert np.allclose(average["p"].to_numpy(), upto - (counts["count"].to_numpy() - 1) / 2)
        from tessera.operators.series import _placed_by_range
        parts = _placed_by_range(d, ["date"], ["v", "id"], F.lit(1)).groupBy("_part").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    gone = rank_average(spark.createDataFrame([("k", None), ("k", 1.0), ("k", 3.0)], "date string, v double"), ["date"], "v", "p")
    assert sorted(((r["v"], r["p"]) for r in gone.collect()), key=repr) == [(1.0, 0.5), (3.0, 1.0), (None, None)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 999, 2_500, 30_000])
def test_quantiles_of_every_size_by_one_rule(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 5.0, float(rng.randrange(9)), 1e9]) for _ in range(n)]
    qs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.95, "g": 1.0}
    row = exact_quantiles(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v", qs).first()
    for name, q in qs.items():
        assert np.isclose(row[name], np.quantile(values, q), rtol=1e-12, atol=1e-9), (n, name)


def test_correlation_windows_use_only_what_had_arrived(frame):
    """A row that arrives two quarters late changes its quarter from then on, not before."""
    rows = [(f"a{i}", "c", f"{y}-{m}", f"{y}-{m}", 10.0 + i) for y in (2000, 2001) for m in ("03-31", "06-30", "09-30", "12-31") for i in range(2)]
    rows.append(("a0", "c", "2000-09-15", "2000-03-31", 41.0))
    o = frame(rows, "asset_id string, category string, observed_at date, period_end date, price_per_share double")
    known = {(str(r["period"]), str(r["date"])): r["price"] for r in T.known_category_prices(o, T.periods(o)).collect()}
    assert known[("2000-03-31", "2000-03-31")] == known[("2000-06-30", "2000-03-31")] == 10.5
    assert known[("2000-09-30", "2000-03-31")] == known[("2001-12-31", "2000-03-31")] == 62 / 3
    assert ("2000-03-31", "2000-06-30") not in known


def test_filing_links_equal_brute_force_with_common_tokens(spark):
    """Every second name holds the same two common tokens; links must equal scanning all filings, and rare tokens alone are looked up where there are any."""
    import re

    from tessera.operators import linking as L

    rng = random.Random(9)
    words = ["gold", "watch", *[f"model{i:03d}" for i in range(60)], "abc", "fossil"]
    name = lambda: " ".join(([] if rng.random() < 0.5 else ["gold", "watch"]) + rng.sample(words, rng.randrange(1, 4)) + rng.choice([[], ["twin", "twin"]]))
    assets = [(i, f"#A{i}", rng.choice([None, name(), name()])) for i in range(150)]
    filings = [(i, rng.choice([f"Series #A{i}", f"Series #B{i}", f"series {i}", None]), rng.choice([None, name(), name() + "s", "twinned golden"])) for i in range(120)]
    aliases = [(f"b{i}", f"a{i}") for i in range(0, 120, 2)]

    def tokens(text):
        return [t for t in re.split(r"[^a-z0-9]+", (text or "").lower()) if len(t) >= 4 and t not in L.STOP_TOKENS]

    def ticker(series):
        found = re.search(r"#([A-Za-z0-9]+)\b", series or "")
        t = found.group(1).upper() if found else (series or "").upper()
        return {a.upper(): b.upper() for a, b in aliases}.get(t, t)

    want = {}
    for i, tick, text in assets:
        hits = [f for f, s, _ in filings if ticker(s) == tick[1:]]
        if hits:
            want[i] = (hits[-1], "ticker")
            continue
        scores = [(-sum(t in f"{(s or '').lower()} {(n or '').lower()}" for t in tokens(text)), f) for f, s, n in filings]
        best = min(scores)
        want[i] = (best[1], "name") if best[0] <= -2 else (None, None)
    got = L.link_filings(spark.createDataFrame(assets, "asset_id long, ticker string, name string"), spark.createDataFrame(filings, "filing_id long, series_name string, asset_name string"),
                         spark.createDataFrame(aliases, "alias string, target string"))
    assert {r["asset_id"]: (r["filing_id"], r["linked_by"]) for r in got.collect()} == want
    assert {v[1] for v in want.values()} == {"ticker", "name", None}


def test_identifiers_resolve_with_mismatch_and_history(spark):
    from tessera.operators import linking as L

    registry = spark.createDataFrame([("a1", "#AA", "Gold Watch", "watches"), ("a2", "#BB", "Gold Watch", "cards"), ("a3", "#CC", "Red Car", "cars")], "asset_id string, ticker string, name string, category string")
    asked = spark.createDataFrame([(1, " #aa ", None), (2, "gold watch", None), (3, "nobody", None), (4, "RED CAR", "watches"), (5, "red", "CARS"), (6, "A3", "cars"), (7, None, None)], "qid int, ident string, expected_category string")
    aliases = spark.createDataFrame([("red", "#CC"), ("A3", "#cc")], "alias string, target string")
    got = {r["qid"]: (r["status"], r["asset_id"], r["warnings"]) for r in L.resolve_identifiers(asked, registry, registry.filter("asset_id = 'a1'"), aliases).collect()}
    assert got[1] == ("matched", "a1", []) and got[2] == ("ambiguous", None, ["ambiguous_asset_match:gold watch"]) and got[3] == ("unknown", None, ["unknown_asset_id:nobody"])
    assert got[4] == ("category_mismatch", "a3", ["category_mismatch: factors=watches registry=cars", "missing_historical_price_data"])
    assert got[5][:2] == got[6][:2] == ("matched", "a3") and got[7][0] == "unknown"


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_blocks_grow_with_the_subjects(spark, method):
    """60 subjects in blocks of 8: every pair once, as pandas has it, over more tasks than a fixed few."""
    from tessera.operators import correlation as K

    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(24, 60)).round(2), columns=[f"s{i:02d}" for i in range(60)], index=pd.date_range("2000-01-01", periods=24))
    data[data.abs() > 1.5] = np.nan
    data["s07"] = 1.0
    rows = [(c, d.date(), float(v)) for c in data for d, v in data[c].items() if not np.isnan(v)]
    pairs = K.correlation_pairs(spark.createDataFrame(rows, "subject_id string, date date, ret double"), method, per_block=8)
    got = {(r["a"], r["b"]): r for r in pairs.collect()}
    want = data.corr(method=method, min_periods=6)
    assert len(got) == 60 * 59 // 2
    for (a, b), r in got.items():
        both = data[[a, b]].dropna()
        assert r["overlap"] == len(both) and (r["overlap_start"], r["overlap_end"]) == (both.index[0].date(), both.index[-1].date())
        assert (r["correlation"] is None) == (bool(np.isnan(want.loc[a, b])) or "s07" in (a, b)) and (r["correlation"] is None or abs(r["correlation"] - want.loc[a, b]) < 1e-9)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan
