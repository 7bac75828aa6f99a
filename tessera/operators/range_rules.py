"""Field rules of the ten record types as one table, compiled into columns; every broken rule is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Categories, and per record type each ruled field with its kind, whether it must be there, and its range.
CATEGORIES = ["handbags", "watches", "cars", "wine", "cards", "trading cards", "memorabilia", "comics", "books", "fossils", "natural_history", "art", "instruments",
              "precious minerals", "coins", "other"]
RULES = {
    "asset": [
        ("asset_id", "text", True, "nonempty"), ("ticker", "text", True, "nonempty"), ("name", "text", True, "nonempty"), ("category", "text", True, "category"),
        ("offering_date", "date", False, ""), ("offering_price", "number", True, "positive"), ("shares", "integer", True, "positive"), ("market_cap_usd", "number", False, "positive"),
        ("last_price_usd", "number", False, "positive"), ("source_confidence", "number", True, "unit"), ("rarity_score", "number", False, "unit"),
        ("buyout_offer_price_per_share", "number", False, "positive"), ("buyout_offer_total_value", "number", False, "positive"), ("buyout_reference_price", "number", False, "positive"),
        ("buyout_vote_yes_pct", "number", False, "percent"), ("buyout_vote_no_pct", "number", False, "percent"), ("buyout_vote_advisory_pct", "number", False, "percent")],
    "snapshot": [
        ("date", "date", True, ""), ("asset_id", "text", True, ""), ("ticker", "text", True, ""), ("price", "number", True, "positive"), ("bid", "number", False, "positive"),
        ("ask", "number", False, "positive"), ("volume", "number", False, "non_negative"), ("market_cap_usd", "number", False, "positive"), ("source", "text", True, ""),
        ("source_confidence", "number", True, "unit"), ("ask", "number", False, "not_below_bid")],
    "comparable_sale": [
        ("comp_id", "text", True, "nonempty"), ("category", "text", True, "category"), ("subcategory", "text", True, ""), ("source", "text", True, "nonempty"), ("date", "date", True, ""),
        ("price_usd", "number", True, "positive"), ("currency", "text", False, "three_letters"), ("exactness_score", "number", True, "unit"), ("source_confidence", "number", True, "unit"),
        ("year", "integer", False, "non_negative"), ("confidence_score", "number", False, "unit"), ("estimate_low_usd", "number", False, "non_negative"), ("estimate_high_usd", "number", False, "non_negative")],
    "market_index": [
        ("category", "text", True, "category"), ("source", "text", True, "nonempty"), ("date", "date", True, ""), ("brand", "text", True, "nonempty"), ("metric_name", "text", True, "nonempty"),
        ("metric_value", "number", True, ""), ("currency", "text", False, "three_letters"), ("source_confidence", "number", True, "unit")],
    "filing_series": [
        ("series_id", "text", True, "nonempty"), ("cik", "text", True, "nonempty"), ("accession_number", "text", True, "nonempty"), ("filing_type", "text", True, "nonempty"), ("filing_date", "date", True, ""),
        ("filing_url", "text", True, ""), ("offering_price", "number", False, "positive"), ("shares", "integer", False, "positive"), ("acquisition_cost", "number", False, "non_negative"),
        ("offering_expenses", "number", False, "non_negative"), ("source_confidence", "number", False, "unit")],
    "exit_event": [
        ("exit_id", "text", True, "nonempty"), ("sale_price", "number", False, "positive"), ("sale_date", "date", False, ""), ("exit_announcement_date", "date", False, ""), ("last_trading_date", "date", False, ""),
        ("exit_valuation_date", "date", False, ""), ("exit_effective_date", "date", False, ""), ("settlement_date", "date", False, ""), ("exit_price_per_share", "number", False, "positive"),
        ("exit_total_value", "number", False, "positive"), ("shares_at_exit", "number", False, "positive"), ("source_confidence", "number", False, "unit")],
    "category_metadata": [
        ("category", "text", True, "category"), ("display_name", "text", True, ""), ("category_momentum_score", "number", False, "unit"), ("condition_modifier", "number", False, "positive")],
    "price_observation": [
        ("date", "date", True, ""), ("asset_id", "text", True, ""), ("bid", "number", False, "positive"), ("ask", "number", False, "positive"), ("last", "number", True, "positive"),
        ("volume", "number", False, "non_negative"), ("market_cap_usd", "number", False, "positive"), ("source", "text", True, ""), ("ask", "number", False, "not_below_bid")],
    "liquidity": [
        ("asset_id", "text", True, ""), ("turnover", "number", True, "non_negative"), ("days_since_last_trade", "integer", True, "non_negative"), ("days_with_zero_trades", "integer", True, "non_negative"),
        ("realized_volatility", "number", True, "non_negative"), ("max_drawdown", "number", True, "non_positive"), ("stale_mark_flag", "flag", True, "")],
    "nav_estimate": [
        ("asset_id", "text", True, ""), ("estimated_nav_usd", "number", True, "positive"), ("nav_low_usd", "number", True, "positive"), ("nav_high_usd", "number", True, "positive"),
        ("nav_confidence", "number", True, "unit"), ("valuation_notes", "text", True, "")],
}
DEFAULTS = {"rarity_score": "0.5", "volume": "0", "currency": "USD", "category_momentum_score": "0.5", "condition_modifier": "1.0"}
TYPES = {"text": "string", "number": "double", "integer": "bigint", "date": "date", "flag": "boolean"}


def _broken(name: str, kind: str, required: bool, rule: str, df: DataFrame) -> Column:
    """The name of the rule that a field breaks, or null."""
    if name not in df.columns:
        return F.lit("missing" if required else None).cast("string")
    raw = F.col(name)
    value = raw.try_cast(TYPES[kind]) if df.schema[name].dataType.typeName() == "string" and kind != "text" else raw.cast(TYPES[kind])
    out = F.lit(None).cast("string")
    failed = {
        "positive": ~(value > 0), "non_negative": ~(value >= 0), "non_positive": ~(value <= 0), "unit": ~value.between(0, 1), "percent": ~value.between(0, 100),
        "nonempty": F.char_length(value) == 0, "category": ~value.isin(CATEGORIES), "three_letters": F.char_length(value) != 3,
        "not_below_bid": value < (F.col("bid").try_cast("double") if "bid" in df.columns and df.schema["bid"].dataType.typeName() == "string" else F.col("bid").cast("double") if "bid" in df.columns else F.lit(None)),
    }.get(rule)
    if failed is not None:
        out = F.when(F.coalesce(failed, F.lit(False)), rule)
    if rule == "not_below_bid":
        return out
    wrong = F.when(raw.isNotNull() & value.isNull(), f"not_{kind}") if kind != "text" else F.lit(None).cast("string")
    absent = F.when(raw.isNull(), "missing") if required else F.lit(None).cast("string")
    return F.coalesce(absent, wrong, out)


def range_violations(df: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """`keys`, model, field, rule: one row per rule of `model` that a row breaks. Fields may be typed or text; extra columns do not matter."""
    found = [F.struct(F.lit(name).alias("field"), _broken(name, kind, required, rule, df).alias("rule")) for name, kind, required, rule in RULES[model]]
    rows = df.select(*keys, F.explode(F.array(*found)).alias("_v")).filter("_v.rule IS NOT NULL")
    return rows.select(*keys, F.lit(model).alias("model"), "_v.field", "_v.rule")


def conformed(df: DataFrame, model: str) -> DataFrame:
    """The ruled fields of a model with their types: defaults filled, currency in upper case."""
    out = {}
    for name, kind, _, _ in RULES[model]:
        value = F.col(name) if name in df.columns else F.lit(None)
        if name in DEFAULTS and not (model == "asset" and name == "volume"):
            value = F.coalesce(value.cast("string"), F.lit(DEFAULTS[name]))
        value = value.cast("string").try_cast(TYPES[kind])
        out[name] = F.upper(value) if name == "currency" else value
    return df.select(*[c.alias(name) for name, c in out.items()], *[c for c in df.columns if c not in out])
