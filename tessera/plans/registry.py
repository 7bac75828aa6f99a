"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.market_views import MARKET_SQL, Market

Builder = Callable[[Market], DataFrame]

_builders: dict[str, Builder] = {}
_checks: dict[str, str] = {}
_shared: dict[str, str] = dict(MARKET_SQL)


def shared_sql(name: str, sql: str) -> None:
    """Name a sub-select that several check queries refer to."""
    _shared[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(fn: Builder) -> Builder:
        if name in _builders:
            raise ValueError(f"duplicate query {name}")
        _builders[name] = fn
        if sql is not None:
            _checks[name] = sql
        return fn

    return register


def _needed(sql: str, found: dict[str, None]) -> None:
    for name, body in _shared.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            found[name] = None


def _expand_rounding(sql: str) -> str:
    """rN(x) in check SQL stands for report rounding to N digits (see `tessera.functions.columns.rnd`)."""
    while match := re.search(r"\br(\d)\(", sql):
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[match.end() : end - 1]
        sql = f"{sql[:match.start()]}(round(CAST({inner} AS DOUBLE) + 1e-{int(match[1]) + 4}, {match[1]}) + CAST(0 AS DOUBLE)){sql[end:]}"
    return sql


def complete_sql(sql: str) -> str:
    """Prefix the shared sub-selects a check query uses."""
    found: dict[str, None] = {}
    _needed(sql, found)
    body = sql.strip()
    if not found:
        return body
    head = ",\n".join(f"{name} AS ({_shared[name]})" for name in found)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Builder) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Market(spark, sf_dir))

    return {name: bind(fn) for name, fn in _builders.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _expand_rounding(complete_sql(sql)) for name, sql in _checks.items()}
