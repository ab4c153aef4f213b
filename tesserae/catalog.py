"""All queries of the package, without those of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import composing, curating, files, imaging, pooling, priors, scoring, selecting, streams  # noqa: F401  they register their queries
from tesserae.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to predictions: pooled, adjusted by the class prior, and chosen by a threshold."""
    return QUERIES["k02_threshold"](spark, sf_dir)
