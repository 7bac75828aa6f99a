from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of plain values with an SQL schema; ISO text becomes a date where the schema says so."""

    def build(rows, schema):
        kinds = [c.strip().split()[1].lower() for c in schema.split(",")]

        def value(v, kind):
            if v is None:
                return None
            return dt.date.fromisoformat(v) if kind == "date" else float(v) if kind == "double" else v

        return spark.createDataFrame([tuple(value(v, k) for v, k in zip(r, kinds)) for r in rows], schema)

    return build
