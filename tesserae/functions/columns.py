"""Column helpers that many operators share; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-12


def norm_species_id(c: Column | str) -> Column:
    """A species id as trimmed text without a trailing .0; blank ids are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", ""), F.lit(""))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def log_floor(c: Column, floor: float = TINY) -> Column:
    return F.log(F.greatest(c, F.lit(floor)))


def safe_weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean of a group; its plain mean where weights add up to nothing."""
    total = F.sum(weight)
    return F.when(total < TINY, F.avg(value)).otherwise(F.sum(value * weight) / total)


def by_image(scores: DataFrame) -> DataFrame:
    """Scores dealt by image once: windows by tile and groups by species need no further exchange."""
    return scores.repartition("image_id")


def softmax(scores: DataFrame, keys: list[str], value: str = "logit", out: str = "prob", temperature: float = 1.0) -> DataFrame:
    """Adds the softmax of value over each group of keys, stable for large values."""
    w = Window.partitionBy(*keys)
    x = F.col(value) / F.lit(float(temperature))
    shifted = scores.withColumn("__e", F.exp(x - F.max(x).over(w)))
    return shifted.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def entropy(c: Column) -> Column:
    """A row's share of the entropy of its distribution."""
    p = clip(c, TINY, 1.0)
    return -p * F.log(p)


def ranked(scores: DataFrame, keys: list[str], value: str = "score", out: str = "rank", tie: str = "species_id") -> DataFrame:
    """Adds the 1-based rank by value, largest first; ties by the smaller id."""
    return scores.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(tie))))
