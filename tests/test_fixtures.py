"""Hand-computed cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import benchmark as B
from tessera.operators import correlation as K
from tessera.operators import crosssection as X
from tessera.operators import indexes as I
from tessera.operators import market as M
from tessera.operators import portfolios as P
from tessera.operators import quality as Q
from tessera.operators import rules as R
from tessera.operators import series as S
from tessera.operators import text as T

QUOTE = "asset_id string, category string, date date, price double, cap double"


def quotes(frame, rows):
    return frame([(a, "c", d, p, cap) for a, d, p, cap in rows], QUOTE)


def chain(frame, rows, weighting):
    result = I.market_family(quotes(frame, rows))
    series = result.series.filter(F.col("weighting") == weighting).orderBy("date").collect()
    return series, result


def test_equal_weight_chain(frame):
    s, _ = chain(frame, [("a", "2024-01-01", 10, None), ("b", "2024-01-01", 20, None), ("a", "2024-01-02", 11, None), ("b", "2024-01-02", 18, None)], "equal")
    assert s[1]["period_return"] == pytest.approx(0) and s[1]["index_level"] == pytest.approx(100)


def test_cap_weight_chain_uses_prior_caps(frame):
    s, _ = chain(frame, [("a", "2024-01-01", 10, 100), ("b", "2024-01-01", 20, 300), ("a", "2024-01-02", 11, 110), ("b", "2024-01-02", 22, 330)], "market_cap")
    assert s[1]["index_level"] == pytest.approx(110)
    s, _ = chain(frame, [("a", "2024-01-01", 10, 100), ("b", "2024-01-01", 10, 300), ("a", "2024-01-02", 20, 900), ("b", "2024-01-02", 10, 100)], "market_cap")
    assert s[1]["period_return"] == pytest.approx(0.25)


def test_missing_price_and_cap_are_not_filled(frame):
    rows = [("a", "2024-01-01", 10, 100), ("a", "2024-01-02", 11, None), ("b", "2024-01-02", 20, 200)]
    equal, _ = chain(frame, rows, "equal")
    cap, _ = chain(frame, rows, "market_cap")
    assert [r["constituent_count"] for r in equal] == [1, 2] and [r["constituent_count"] for r in cap] == [1, 1]


def test_contributions_reconcile(frame):
    rows = [(a, f"2024-0{q}-01", p * (1 + 0.1 * q * k), 100 * p) for q in range(1, 6) for a, p, k in (("a", 10, 1), ("b", 20, -0.5), ("c", 5, 2))]
    series, result = chain(frame, rows, "market_cap")
    points = result.contributions.filter("weighting = 'market_cap'").agg(F.sum("contribution_points")).first()[0]
    assert points == pytest.approx(series[-1]["index_level"] - 100)


def test_offering_rows_do_not_enter_daily_quotes(frame):
    o = frame([("a", "c", "2024-01-01", "2024-03-31", 10, None, "offering_price", 1, 1, 1), ("a", "c", "2024-01-02", "2024-03-31", 11, None, "distribution", 1, 1, 1)],
              "asset_id string, category string, observed_at date, period_end date, price_per_share double, market_cap double, event_type string, s1 int, s2 int, s3 int")
    o = o.withColumns({"bid": F.lit(1.0), "ask": F.lit(1.0), "volume": F.lit(1.0)})
    assert S.daily_quotes(o, ["s1"]).count() == 0
    assert S.quarterly_quotes(o, ["observed_at", "s1"]).first()["event_type"] == "distribution"


def test_custom_composite(frame):
    rows = [("a", f"2024-0{q}-01", p, None) for q, p in ((1, 10), (2, 12), (3, 9))] + [("b", f"2024-0{q}-01", p, None) for q, p in ((1, 20), (2, 18), (3, 22))]
    even = frame([("x", "a", 0.5), ("x", "b", 0.5), ("y", "a", 0.75), ("y", "b", 0.25)], "def_id string, asset_id string, weight double")
    out = I.custom_composite(quotes(frame, rows), even)
    levels = {(r["def_id"], r["date"].month): r["index_level"] for r in out.series.collect()}
    assert [levels["x", k] for k in (1, 2, 3)] == pytest.approx([100, 105, 100])
    assert [levels["y", k] for k in (2, 3)] == pytest.approx([112.5, 95])
    total = out.contributions.filter("def_id = 'y'").agg(F.sum("contribution_points")).first()[0]
    assert total == pytest.approx(-5)


def test_composite_dates_are_shared_dates(frame):
    rows = [("a", d, 10, None) for d in ("2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31")] + [("b", d, 5, None) for d in ("2024-03-31", "2024-09-30")]
    defs = frame([("x", "a", 0.5), ("x", "b", 0.5)], "def_id string, asset_id string, weight double")
    assert sorted(r["date"].isoformat() for r in I.custom_composite(quotes(frame, rows), defs).series.collect()) == ["2024-03-31", "2024-09-30"]


ASSETS = "asset_id string, ticker string, name string, category string, share_count double, offering_date date, offering_price_usd double"
EXITS = ("asset_id string, exit_type string, exit_status string, exit_effective_date date, settlement_date date, terminal_price double, terminal_price_source string")


def priced(frame, rows):
    return frame([(a, "c", d, p, None, "daily_close") for a, d, p in rows], QUOTE + ", event_type string")


def test_market_cap_history_reconciles(frame):
    assets = frame([("a", "A", "A", "c", 10, "2020-01-31", 10), ("b", "B", "B", "c", 5, "2020-02-15", 20)], ASSETS)
    h = M.exchange_asset_history(assets, priced(frame, [("a", "2020-01-31", 10), ("a", "2020-02-29", 12)]), frame([], EXITS), "2020-02-29", "month")
    rows = M.exchange_total_history(h, tolerance=1e-6).orderBy("date").collect()
    assert rows[0]["total_market_cap"] == 100 and rows[1]["price_effect"] == 20 and rows[1]["new_issuance"] == 100
    assert all(r["reconciles"] for r in rows) and rows[0]["period_return"] == 0


def test_exit_hierarchy(frame):
    assets = frame([(x, x, x, "c", 10, "2020-01-01", 10) for x in "abcd"], ASSETS)
    exits = frame([("a", "sale", "settled", "2021-01-01", None, None, 130), ("b", "sale", "cancelled_exit", "2021-01-01", None, 50, None), ("c", "sale", "settled", "2021-01-01", None, None, None)],
                  "asset_id string, type string, status string, sale_date date, settlement_date date, exit_price_per_share double, exit_total_value double")
    out = {r["asset_id"]: r for r in M.normalize_exits(exits, assets, priced(frame, [("c", "2020-06-01", 22), ("c", "2021-02-01", 99)])).collect()}
    assert out["a"]["terminal_price"] == 13 and out["b"]["terminal_price"] is None and out["c"]["terminal_price"] == 22
    assert out["c"]["terminal_price_quality"] == "fallback"


def test_cancelled_exit_does_not_hide_a_settled_one(frame):
    assets = frame([("a", "a", "a", "c", 10, "2019-01-01", 10)], ASSETS)
    exits = frame([("a", "buyout_offer", "cancelled_exit", "2020-01-01", None, 12, None), ("a", "sale", "settled", "2022-01-01", None, 30, None)],
                  "asset_id string, type string, status string, sale_date date, settlement_date date, exit_price_per_share double, exit_total_value double")
    live = M.live_exits(M.normalize_exits(exits, assets, priced(frame, [("a", "2020-06-01", 22)]))).collect()
    assert [(str(r["exit_effective_date"]), r["terminal_price"]) for r in live] == [("2022-01-01", 30)]


def test_two_exits_of_one_asset(frame):
    """Both events stay; the earlier live one removes the asset; series names link; dates and quality follow the hierarchy."""
    assets = frame([("a", "#AB", "a", "c", 10, "2019-01-01", 10), ("b", "#B", "b", "c", 10, "2019-01-01", 10)], ASSETS)
    exits = frame([
        ("a", None, "sale", "settled", "2021-06-30", None, None, None, 30, None, None), (None, "Series #AB", "Redemption", "settled", "2020-06-30", "2020-05-01", "2020-06-10", "2020-07-15", None, None, "yes"),
        ("a", None, "buyout_offer", "cancelled_exit", "2019-12-31", "2019-11-30", None, None, 99, None, None), ("b", None, "spin", "odd", "2020-01-01", None, None, None, 12, None, "no")],
        "asset_id string, series_name string, type string, status string, sale_date date, announcement_date date, last_trading_date date, settlement_date date, exit_price_per_share double, exit_total_value double, is_confirmed string")
    events = M.normalize_exits(exits, assets, priced(frame, [("a", "2020-06-01", 22), ("a", "2020-06-20", 50)]))
    rows = {(r["asset_id"], str(r["exit_effective_date"])): r for r in events.collect()}
    assert len(rows) == 4
    first, other = rows[("a", "2020-06-30")], rows[("b", "2020-01-01")]
    assert (first["terminal_price"], first["terminal_price_quality"], first["data_quality_flag"], first["exit_type"]) == (22, "fallback", ";terminal_price_fallback_last_trade", "redemption")
    assert [str(first[c]) for c in ("exit_announcement_date", "last_trading_date", "exit_valuation_date", "settlement_date")] == ["2020-05-01", "2020-06-10", "2020-06-30", "2020-07-15"]
    assert first["exit_premium_vs_last_trade"] == 0 and first["last_observed_market_cap_before_exit"] == 220
    assert (other["exit_type"], other["exit_status"], other["is_confirmed"], other["terminal_price"], other["terminal_price_quality"]) == ("other", "unknown", False, None, "blocking")
    live = {r["asset_id"]: str(r["exit_effective_date"]) for r in M.live_exits(events).collect()}
    assert live == {"a": "2020-06-30", "b": "2020-01-01"}
    states = [(r["state"], str(r["from_date"]), str(r["to_date"])) for r in M.exit_states(events).filter("asset_id = 'a'").orderBy("from_date").collect()]
    assert states == [("announced", "2019-11-30", "2019-12-31"), ("trading", "2019-12-31", "2020-05-01"), ("announced", "2020-05-01", "2020-06-10"), ("trading_ended", "2020-06-10", "2020-06-30"),
                      ("pending_settlement", "2020-06-30", "2020-07-15"), ("settled", "2020-07-15", "None")]
    quotes = priced(frame, [("a", "2020-03-31", 20), ("a", "2021-03-31", 25)])
    h = M.exchange_asset_history(assets, quotes, events, "2022-12-31", "month").filter("asset_id = 'a'")
    assert [str(r["date"]) for r in h.filter("is_exit_effective_date").collect()] == ["2020-06-30"] and h.groupBy("date").count().filter("count > 1").count() == 0


def test_size_belongs_to_the_chosen_model(spark):
    row = spark.createDataFrame([("Gold Togo Kelly 25 and Birkin 30 Palladium",)], "title string").select(*[v.alias(k) for k, v in T.title_fields("title").items()]).first()
    assert (row["model"], row["size"], row["color"]) == ("Birkin", "30", "Gold")


def total_return(frame, assets, prices, exits, dates, rebalance="month"):
    grid = frame([(d,) for d in dates], "date date")
    return P.total_return_index(assets, prices, exits, grid, rebalance)


def test_total_return_pays_out_exits(frame):
    assets = frame([("a", "A", "A", "c", 1, "2020-01-01", 50), ("b", "B", "B", "c", 1, "2020-01-01", 50)], ASSETS)
    prices = priced(frame, [("a", "2020-01-01", 50), ("b", "2020-01-01", 50), ("b", "2020-02-01", 50)])
    exits = frame([("a", "asset_sale", "settled", "2020-02-01", "2020-02-01", 100, "x")], EXITS)
    out = total_return(frame, assets, prices, exits, ["2020-01-01", "2020-02-01"], "quarter").series
    last = out.filter("universe = 'all' AND weighting = 'equal_weight'").orderBy(F.desc("date")).first()
    assert last["value"] == pytest.approx(150) and last["cash_value"] == pytest.approx(100)


def test_monthly_rebalance(frame):
    assets = frame([("a", "A", "A", "c", 1, "2020-01-31", 100), ("b", "B", "B", "c", 1, "2020-01-31", 100)], ASSETS)
    prices = priced(frame, [(x, d, p) for x, ps in (("a", (100, 200, 100)), ("b", (100, 100, 100))) for d, p in zip(("2020-01-31", "2020-02-29", "2020-03-31"), ps)])
    out = total_return(frame, assets, prices, frame([], EXITS), ["2020-01-31", "2020-02-29", "2020-03-31"]).series
    last = out.filter("universe = 'all' AND weighting = 'equal_weight'").orderBy(F.desc("date")).first()
    assert last["value"] == pytest.approx(112.5)


COMPONENT = "def_id string, asset_id string, weight double, date date, price double"


def components(frame, a, b):
    days = ["2020-03-31", "2020-06-30", "2020-09-30"]
    return frame([("p", n, 0.5, d, p) for n, ps in (("a", a), ("b", b)) for d, p in zip(days, ps)], COMPONENT)


def test_gain_rule_to_cash(frame):
    rules = R.Rules(gain=0.15, gain_cut=0.5, loss=None)
    rows = R.backtest(components(frame, (100, 120, 120), (100, 100, 100)), rules).orderBy("date").collect()
    assert [r["growth_value"] for r in rows[:2]] == pytest.approx([100, 110]) and rows[1]["cash_value"] == pytest.approx(30)


def test_loss_rule_sells_after_the_quarter(frame):
    rules = R.Rules(gain=None, loss=0.20, loss_cut=1.0)
    rows = R.backtest(components(frame, (100, 75, 150), (100, 100, 100)), rules).orderBy("date").collect()
    assert [r["growth_value"] for r in rows[1:]] == pytest.approx([87.5, 87.5])


def test_original_weight_rebalance(frame):
    rules = R.Rules(gain=None, loss=None, rebalance="original_weights")
    rows = R.backtest(components(frame, (100, 200, 200), (100, 100, 200)), rules).orderBy("date").collect()
    assert rows[-1]["growth_value"] == pytest.approx(225)


def test_coupled_fold_equals_closed_form_when_nothing_triggers(frame):
    c = components(frame, (100, 130, 90), (100, 80, 120))
    free = R.Rules(gain=9.0, loss=0.99, proceeds="remaining")
    coupled = {r["date"]: r["growth_value"] for r in R.backtest(c, free).collect()}
    cash = {r["date"]: r["growth_value"] for r in R.backtest(c, R.Rules(gain=9.0, loss=0.99)).collect()}
    assert coupled == pytest.approx(cash)


@pytest.mark.parametrize("proceeds", ["remaining", "target"])
def test_coupled_fold_of_strategies_of_any_shape_steps_together(frame, proceeds):
    """Strategies of two, three and one components against a plain fold; no strategy is a pandas group of its own."""
    days = ("2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31")
    paths = {"p": {"a": (0.5, 100, 130, 90, 95), "b": (0.5, 100, 70, 80, 120)}, "q": {"a": (0.2, 50, 80, 80, 20), "b": (0.3, 10, 9, 14, 13), "c": (0.5, 7, 7, 7, 9)},
             "r": {"a": (0.6, 20, 30, 10, 10), "b": (0.4, 20, 30, 10, 40)}, "s": {"a": (1.0, 10, 20, 5, 5)}}
    c = frame([(d, a, v[0], day, x) for d, members in paths.items() for a, v in members.items() for day, x in zip(days, v[1:])],
              "def_id string, asset_id string, weight double, date date, price double")
    rules = R.Rules(proceeds=proceeds)
    got = R.backtest(c, rules)
    want = {}
    for d, members in paths.items():
        units, cash, last = {a: rules.start * v[0] / v[1] for a, v in members.items()}, 0.0, None
        for t, day in enumerate(days, 1):
            now = {a: v[t] for a, v in members.items()}
            ret = {a: now[a] / last[a] - 1 if last else 0.0 for a in members}
            cut = {a: rules.gain_cut if r > rules.gain else rules.loss_cut if r < -rules.loss else 0.0 for a, r in ret.items()}
            value = {a: units[a] * now[a] for a in members}
            total, sold = sum(value.values()) + cash, sum(value[a] * cut[a] for a in members)
            share = {a: 0.0 if cut[a] else members[a][0] if proceeds == "target" else value[a] for a in members}
            whole = sum(share.values())
            after = {a: value[a] * (1 - cut[a]) + (sold * share[a] / whole if whole else 0.0) for a in members}
            left = cash + (0.0 if whole else sold)
            moved = sum(abs(after[a] - value[a]) for a in members) + abs(left - cash)
            want[d, dt.date.fromisoformat(day)] = (sum(x > 0 for x in cut.values()), *(pytest.approx(x) for x in (total, left, moved / 2 / total)))
            units, cash, last = {a: after[a] / now[a] for a in members}, left, now
    assert {(r["def_id"], r["date"]): (r["events"], r["growth_value"], r["cash_value"], r["turnover"]) for r in got.collect()} == want
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_asof_staleness(frame):
    v = frame([("s", "2021-04-01", 10), ("s", "2021-06-29", 20)], "k string, date date, value double")
    grid = frame([("s", "2021-03-31"), ("s", "2021-06-30"), ("s", "2021-09-30")], "k string, date date")
    rows = S.asof_backward(v, grid, ["k"], ["value"], 60).orderBy("date").collect()
    assert [r["value"] for r in rows] == [None, 20, None] and rows[1]["effective_date"] == dt.date(2021, 6, 29)


def test_point_in_time_metrics(frame):
    days = ["2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31", "2021-03-31", "2021-06-30"]
    s = frame([("s", "asset", "c", d, v, None, None) for d, v in zip(days, (10, 11, 12, 13, 15, 999))],
              "subject_id string, subject_type string, category string, date date, value double, shares double, offering_price double")
    row = X.point_in_time_metrics(s, "2020-01-01", "2021-06-30").filter("date = DATE '2021-03-31'").first()
    assert row["latest_quarter_return"] == pytest.approx(15 / 13 - 1) and row["trailing_1y_return"] == pytest.approx(0.5)
    assert row["maximum_drawdown"] == 0 and row["best_quarter"] < 1


def test_point_in_time_metrics_move_rows_once(frame):
    """A second category of a subject gives it a second set of quarters, as its rows say; a quarter before its first value is there too."""
    s = frame([("s", "asset", "c", "2020-02-01", 10, 5, 2), ("s", "asset", "d", "2020-04-30", 11, 5, 2), ("s", "asset", "c", "2020-05-31", 12, 5, 2), ("t", "asset", "c", "2020-09-30", 7, None, None)],
              "subject_id string, subject_type string, category string, date date, value double, shares double, offering_price double")
    d = X.point_in_time_metrics(s, "2020-01-01", "2020-09-30")
    assert shuffles(d) == 1
    got = sorted((r["subject_id"], r["category"], str(r["date"]), r["obs_no"], r["current_price"], r["age"]) for r in d.filter("date < DATE '2020-09-30'").collect())
    assert got == [("s", "c", "2020-03-31", 1, 10, 59), ("s", "c", "2020-06-30", 3, 12, 30), ("s", "d", "2020-03-31", 1, 10, 59), ("s", "d", "2020-06-30", 3, 12, 30),
                   ("t", "c", "2020-03-31", None, None, None), ("t", "c", "2020-06-30", None, None, None)]


def test_ranks_break_ties_by_id(frame):
    from tessera.operators.series import ordinal_rank

    d = frame([("s", "b", 1), ("s", "a", 1), ("s", "c", 0)], "k string, id string, v double").withColumn("down", -F.col("v"))
    out = {r["id"]: (r["rank"], r["percentile"]) for r in ordinal_rank(d, ["k"], ["down", "id"]).collect()}
    assert out == {"a": (1, 1.0), "b": (2, 0.5), "c": (3, 0.0)}
    assert ordinal_rank(d.filter("id = 'a'"), ["k"], ["down", "id"]).first()["percentile"] == 1.0


def test_large_markets_reconcile_to_the_cent(frame):
    caps = [4e12 / 3 * (1 + 0.37 * k) for k in range(400)]
    rows = [("2020-01-31", c, c, 0.0) for c in caps] + [("2020-02-29", c * 1.01, 0.0, c * 1.01 - c) for c in caps] + [("2020-03-31", c * 1.01, 0.0, 0.02 if not k else 0.0) for k, c in enumerate(caps)]
    h = frame(rows, "date date, market_cap double, new_issuance double, price_effect double").withColumns({
        "removed_capital": F.lit(0.0), "is_direct_observation": F.lit(True), "price_source": F.lit("direct"), "is_stale": F.lit(False), "observation_age_days": F.lit(1), "asset_return": F.lit(0.0)})
    out = M.exchange_total_history(h).orderBy("date").collect()
    assert [r["reconciles"] for r in out] == [True, True, False] and out[2]["reconciliation_difference"] == pytest.approx(-0.02)


def test_noise_of_sums_is_no_return(frame):
    path = frame([("p", f"2020-{k:02d}-28", 100 * (1 + (2e-11 if k % 2 else 0)), 2e-11 * (-1) ** k) for k in range(1, 9)], "k string, date date, value double, period_return double")
    risk, flat = P.risk_metrics(path, ["k"]).first(), B.series_metrics(path.drop("period_return"), ["k"]).first()
    assert risk["sortino_ratio"] is None and risk["calmar_ratio"] is None and risk["positive_period_percentage"] == 0 and risk["maximum_drawdown_duration_periods"] == 0
    assert flat["sortino_ratio"] is None and flat["calmar_ratio"] is None and flat["positive_period_percentage"] == 0 and flat["maximum_drawdown"] == 0


def shuffles(df):
    return sum(line.lstrip(" +-:*()0123456789").startswith("Exchange") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def archive_metrics(frame, rows):
    ids = "date date, subject_id string, subject_type string, obs_no long, age long"
    d = frame(rows, f"{ids}, total_return double")
    return d.withColumns({n: F.lit(1.0) for n in X.LEADERBOARD_METRICS if n != "total_return"})


def test_archive_states_need_no_shuffle(frame):
    d = archive_metrics(frame, [("2020-03-31", "a", "asset", 9, 3, 0.5), ("2020-03-31", "b", "asset", None, None, None), ("2020-03-31", "c", "asset", 9, 300, 0.1)])
    states = X.archive_states(d)
    assert shuffles(states) == 0 and states.count() == 3 * len(X.LEADERBOARD_METRICS)
    reasons = {r["subject_id"]: r["exclusion_reason"] for r in states.filter("metric = 'total_return'").collect()}
    assert reasons == {"a": "", "b": "not_yet_launched", "c": "stale_latest_observation"}


def test_archive_ranks_move_rows_once(frame):
    d = archive_metrics(frame, [("2020-03-31", s, "asset", 9, 3, v) for s, v in (("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", None))])
    full, bare = X.leaderboard_archive(d, ["total_return"]), X.leaderboard_archive(d, ["total_return"], carried=())
    assert {r["subject_id"]: (r["rank"], r["percentile_rank"], r["eligible"]) for r in bare.collect()} == {"c": (1, 1.0, True), "a": (2, 0.5, True), "b": (3, 0.0, True), "d": (None, None, False)}
    assert set(full.columns) - set(bare.columns) == set(X.CARRIED)
    assert "Window" not in bare._jdf.queryExecution().executedPlan().toString()


def test_validate_archive_counts_repeats(frame):
    rows = [("2020-03-31", "a", "m1", 3), ("2020-03-31", "a", "total_return", 3), ("2020-03-31", "a", "total_return", -1), ("2020-03-31", "b", "cagr", -2), ("2020-03-31", "b", "total_return", 1),
            ("2020-06-30", "a", "total_return", 1), ("2020-06-30", None, "cagr", 1), ("2020-06-30", None, "cagr", 1)]
    found = X.validate_archive(frame(rows, "date date, subject_id string, metric string, age long")).first()
    assert found.asDict() == {"duplicate_states": 2, "future_observations": 2, "rows": 8}
    none = X.validate_archive(frame(rows[4:6], "date date, subject_id string, metric string, age long")).first()
    assert none.asDict() == {"duplicate_states": 0, "future_observations": 0, "rows": 2}


PANEL = {"a": [1, 2, 3, None], "b": [2, 4, 6, 8], "c": [5, 5, 5, 5], "d": [3, 2, 1, 0]}


@pytest.mark.parametrize("method,minimum,pair,expected", [
    ("pearson", 3, ("a", "b"), 1.0), ("pearson", 3, ("a", "c"), None), ("pearson", 4, ("a", "b"), None), ("spearman", 3, ("a", "d"), -1.0)])
def test_correlation_pairs(frame, method, minimum, pair, expected):
    rows = [(s, f"2024-0{i + 1}-01", v) for s, vs in PANEL.items() for i, v in enumerate(vs)]
    out = {(r["a"], r["b"]): r for r in K.correlation_pairs(frame(rows, "subject_id string, date date, ret double"), method, minimum, 2).collect()}
    assert len(out) == 6 and out["a", "b"]["overlap"] == 3
    got = out[pair]["correlation"]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_concentration_and_breadth(frame):
    c = frame([("x", i, v) for i, v in zip("abcd", (4, 3, -2, 0))], "k string, asset_id string, contribution double")
    top = {r["side"]: r["top_1"] for r in I.concentration(c, ["k"]).collect()}
    b = I.breadth(c, ["k"]).first()
    assert top["positive"] == pytest.approx(4 / 7) and top["negative"] == 1
    assert (b["positive_count"], b["negative_count"], b["flat_count"]) == (2, 1, 1)


def test_title_fields(spark):
    d = spark.createDataFrame([("Gold Togo Birkin 25 Gold Hardware, 2021",)], "t string")
    row = d.select(*[v.alias(k) for k, v in T.title_fields("t").items()]).first().asDict()
    assert row == {"brand": "", "model": "Birkin", "size": "25", "material": "Togo", "hardware": "Gold Hardware", "year": 2021, "color": "Gold"}


def test_title_columns_equal_title_fields(spark):
    lines = ["Gold Togo Birkin 25 Gold Hardware, 2021", "Vintage Hermès Étoupe Porosus Crocodile Kelly 32", "A Rare 1998 35 cm Bleu Nuit Box", "Rolex Daytona 40", "", None]
    d = spark.createDataFrame([(x,) for x in lines], "t string")
    names = ["brand", "model", "size", "material", "hardware", "year", "color"]
    want = d.select(*[v.alias(k) for k, v in T.title_fields("t").items()]).select(*names).collect()
    assert T.with_title_fields(d, "t").select(*names).collect() == want


def test_captures_are_cut_into_lots_in_place(spark):
    text = "\nResults 2\n\n\u0085 1. page\n12A.\tHermès \t \n  Gold  Togo Kelly 25\r\n\n 3.5 kg\nLOT SOLD: 1,200 USD\n7. \n8.  Rolex\u2028Daytona\n9. Box"
    d = spark.createDataFrame([("c", text), ("n", None), ("e", ""), ("o", "no lot\n"), ("f", "1. A\nLOT SOLD: 5 EUR\n")], "capture_id string, text string")
    blocks = T.capture_blocks(d)
    assert sorted((r["capture_id"], r["lot_id"], r["label"], r["second"], r["block"]) for r in blocks.collect()) == [
        ("c", "12A", "Hermès", "Gold Togo Kelly 25", "12A. Hermès Gold Togo Kelly 25 3.5 kg LOT SOLD: 1,200 USD 7. 8. Rolex\u2028Daytona"), ("c", "9", "Box", None, "9. Box"),
        ("f", "1", "A", "LOT SOLD: 5 EUR", "1. A LOT SOLD: 5 EUR")]
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_filing_table(spark):
    def row(*cells):
        return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"

    html = "<table>" + row("#BIRKINTAN", "", "", "Tan bag", "Closed", "", "", "$28.00", "1,000", "", "$100") + row(
        "#FAUBOURG2", "", "", "Faubourg", "Sold for $180,000 on 12/14/2024", "", "", "$15", "2,000", "", "") + "</table>"
    d = spark.createDataFrame([("1", "a", dt.date(2025, 1, 1), html)], "cik string, accession string, filing_date date, text string")
    out = {r["ticker"]: r for r in T.filing_table_rows(d).collect()}
    assert len(out) == 2 and out["BIRKINTAN"]["offering_price"] == 28 and out["BIRKINTAN"]["shares"] == 1000
    assert out["FAUBOURG2"]["sale_price"] == 180000 and out["FAUBOURG2"]["sale_date"] == dt.date(2024, 12, 14)


def test_price_import_reasons(frame):
    cols = "seq int, asset_id string, period_end string, observed_at string, price_per_share string, market_cap string, event_type string, precision_status string, volume string, source_reference string"
    good = ("a", "2024-03-31", "2024-03-30", "$1,000", "", "daily_close", "exact", "", "x")
    rows = [(1, *good), (2, *good), (3, *good[:3], "11", *good[4:]), (4, "zz", *good[1:]), (5, "a", "2024-03-30", *good[2:]), (6, "a", "2024-06-30", "soon", *good[3:])]
    master = frame([("a", 10, None)], "asset_id string, share_count double, exit_date date")
    out = {r["seq"]: r["rejection_reason"] for r in Q.validate_prices(frame(rows, cols), master, "seq").collect()}
    assert out[1] == "" and out[2] == "duplicate_price_observation" and out[3] == "conflicting_price_observation"
    assert out[4] == "unknown_asset_id" and out[5] == "period_end_not_calendar_quarter_end" and out[6] == "invalid_observed_at"


def test_alignment_methods(frame):
    s = frame([("2024-01-31", 100), ("2024-02-15", 110)], "date date, value double")
    b = frame([("X", "2024-01-31", 10), ("X", "2024-02-10", 11)], "ticker string, date date, adjusted_close double")
    assert B.align(s, b, "exact").count() == 1
    assert [r["benchmark_value"] for r in B.align(s, b, "previous").orderBy("date").collect()] == [10, 11]


def test_range_rules_of_every_record_type(spark):
    from tessera.operators import range_rules as R

    rows = spark.createDataFrame([(1, "2000-01-01", "a", 2.0, 1.0, "x", None, "s"), (2, None, None, 2.0, 3.0, "5", "-1", "s"), (3, "2000-13-01", "a", None, 1.0, "-4", "0", None)],
                                 "id int, date string, asset_id string, bid double, ask double, last string, volume string, source string")
    got = {(r["id"], r["field"], r["rule"]) for r in R.range_violations(rows, "price_observation", ["id"]).collect()}
    assert got == {(1, "last", "not_number"), (1, "ask", "not_below_bid"), (2, "date", "missing"), (2, "asset_id", "missing"), (2, "volume", "non_negative"),
                   (3, "date", "not_date"), (3, "last", "positive"), (3, "source", "missing")}
    assert len(R.RULES) == 10
    for model, rules in R.RULES.items():  # a row without any field breaks every required one
        empty = {r["field"] for r in R.range_violations(spark.range(1), model, ["id"]).collect()}
        assert empty == {name for name, _, required, _ in rules if required}
    sale = R.conformed(spark.createDataFrame([("c", "usd", None), ("d", None, 3)], "comp_id string, currency string, extra int"), "comparable_sale").orderBy("comp_id").collect()
    assert [r["currency"] for r in sale] == ["USD", "USD"] and sale[1]["extra"] == 3


def test_price_panel_marks(frame):
    # the price of the last rebalance before a day: in the day's own span, before it, or none
    panel = P.price_panel(frame([("a",)], "asset_id string"), frame([("a", f"2024-0{k}-01", p) for k, p in ((2, 10.0), (3, None), (4, 20.0), (6, 30.0))], "asset_id string, date date, price double"),
                          frame([(f"2024-0{k}-01", k in (1, 3, 4, 7)) for k in range(1, 9)], "date date, is_rebalance boolean"))
    rows = P.with_holdings(panel, [], {"w": F.lit(1.0)}).orderBy("date").collect()
    assert [(r["date"].month, r["price"], r["_held"] and r["_held"]["p"]) for r in rows] == [
        (2, 10, None), (3, 10, None), (4, 20, 10), (5, 20, 20), (6, 30, 20), (7, 30, 20), (8, 30, 30)]


def test_index_rows_carry_the_quote_before(frame):
    rows = [("a", "x", "2024-01-01", 10, 100), ("a", "y", "2024-01-02", 11, None), ("a", "x", "2024-01-03", 12, 90), ("a", None, "2024-01-04", 13, 80)]
    out = I.index_rows(frame(rows, QUOTE)).collect()
    seen = {(r["family"], r["weighting"], r["date"].day): r["before"] and r["before"]["price"] for r in out}
    assert seen == {("all", "equal", 1): None, ("all", "equal", 2): 10, ("all", "equal", 3): 11, ("all", "equal", 4): 12,
                    ("all", "market_cap", 1): None, ("all", "market_cap", 3): 10, ("all", "market_cap", 4): 12,
                    ("x", "equal", 1): None, ("x", "equal", 3): 10, ("y", "equal", 2): None, ("x", "market_cap", 1): None, ("x", "market_cap", 3): 10}
