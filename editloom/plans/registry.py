"""Named queries over the driver's tables, each with SQL that computes the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.sources.fixtures import NUDGE, Source

MODULES = ("positions", "haplotypes", "indels", "summaries", "resampling", "models", "drivers", "opposite", "stored")
_queries: dict[str, Callable[[Source], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function from a Source to a frame, with its oracle."""

    def keep(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"editloom.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["flagship"](Source(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Source(spark, sf_dir))) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
