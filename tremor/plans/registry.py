"""Every registered query of the library with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremor.plans import fields, geometry, meshes, models, posterior, profiles, sources  # noqa: F401  they register their queries
from tremor.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g9_robust_stack"](spark, sf_dir)
