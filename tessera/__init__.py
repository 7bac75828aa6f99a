"""Tessera: Spark-native analytics for fractionally owned collectible assets."""

from tessera.session import build_session

__all__ = ["build_session"]
