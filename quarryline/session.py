"""Session and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Thresholds and weights that operators take as parameters; the defaults are fixed values."""

    relevance_gate: int = 30
    merge_at: float = 0.80
    review_at: float = 0.62
    block_chunk: int = 256
    refresh_days: int = 14
    pages_most: int = 3
    revalidate_days: int = 90
    weight_source: float = 0.35
    weight_corroboration: float = 0.25
    weight_fields: float = 0.20
    weight_phone: float = 0.20


def session(app: str = "quarryline", **conf: str) -> SparkSession:
    """A session with the settings the library counts on: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
