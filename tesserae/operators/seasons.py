"""Seasonal priors from month histograms (species_id, month, n), by closed kernels of 12 months.

Three variants differ in the months' centres, the origin of days and what is normalised.
Kernels are tables of 365 x 12 or 12 x 12 numbers made by range, so broadcasts are fixed in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of the year at the months' centres, by variant.
CENTRES_PER_MONTH = (15, 46, 75, 106, 136, 167, 197, 228, 259, 289, 320, 350)
CENTRES_SUMMED = (15, 45, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)
DAYS = 365


def _months(spark: SparkSession, centres: tuple[int, ...]) -> DataFrame:
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.element_at(F.lit(list(centres)), F.col("id").cast("int")).alias("centre"))


def _bell(a: Column, b: Column, sigma: float) -> Column:
    d = F.abs(a - b)
    d = F.least(d, DAYS - d)
    return F.exp(-0.5 * F.pow(d / sigma, F.lit(2.0)))


def kernel(spark: SparkSession, first_day: int, centres: tuple[int, ...], sigma: float, per_month: bool) -> DataFrame:
    """(doy, month, k): a circular bell for each month, whose days add up to 1 if per_month."""
    days = spark.range(first_day, first_day + DAYS).select(F.col("id").cast("int").alias("doy"))
    k = days.crossJoin(F.broadcast(_months(spark, centres))).withColumn("k", _bell(F.col("doy"), F.col("centre"), sigma))
    return k.select("doy", "month", (F.col("k") / F.sum("k").over(Window.partitionBy("month")) if per_month else F.col("k")).alias("k"))


def day_pdf(spark: SparkSession, histogram: DataFrame, classes: DataFrame, variant: str = "per_month", sigma: float = 18.0, eps: float = 0.05) -> DataFrame:
    """(species_id, doy, p): each class's distribution over days; without counts uniform.

    per_month: every month's bell adds up to 1, days 1 to 365. summed: the sum of bells is
    normalised over days 0 to 364.
    """
    per_month = variant == "per_month"
    k = kernel(spark, 1 if per_month else 0, CENTRES_PER_MONTH if per_month else CENTRES_SUMMED, sigma, per_month)
    h = histogram.where("n > 0")
    total = h.groupBy("species_id").agg(F.sum("n").alias("total"))
    smooth = h.join(F.broadcast(k), "month").groupBy("species_id", "doy").agg(F.sum(F.col("n") * F.col("k")).alias("s"))
    of = smooth.join(total, "species_id")
    share = F.col("s") / F.col("total") if per_month else F.col("s") / (F.sum("s").over(Window.partitionBy("species_id")) + 1e-12)
    pdf = of.select("species_id", "doy", ((1 - eps) * share + eps / DAYS).alias("p"))
    if not per_month:
        pdf = pdf.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("species_id")))
    first = 1 if per_month else 0
    bare = classes.join(total, "species_id", "left_anti").select("species_id", F.explode(F.sequence(F.lit(first), F.lit(first + DAYS - 1))).alias("doy"), F.lit(1.0 / DAYS).alias("p"))
    return pdf.join(classes, "species_id", "left_semi").unionByName(bare)


def month_efficiency(spark: SparkSession, histogram: DataFrame, classes: DataFrame, sigma: float = 18.0, floor: float = 0.05) -> DataFrame:
    """(species_id, month, efficiency): smoothed months, the best of each class 1; without counts all 1."""
    m = _months(spark, CENTRES_SUMMED)
    k = m.crossJoin(F.broadcast(m.select(F.col("month").alias("to"), F.col("centre").alias("at")))).select("month", "to", _bell(F.col("centre"), F.col("at"), sigma).alias("k"))
    s = histogram.where("n > 0").join(F.broadcast(k), "month").groupBy("species_id", F.col("to").alias("month")).agg(F.sum(F.col("n") * F.col("k")).alias("s"))
    w = Window.partitionBy("species_id")
    p = s.withColumn("p", (1 - floor) * F.col("s") / F.sum("s").over(w) + floor / 12)
    done = p.select("species_id", "month", (F.col("p") / F.max("p").over(w)).alias("efficiency")).join(classes, "species_id", "left_semi")
    bare = classes.join(histogram.where("n > 0"), "species_id", "left_anti").select("species_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), F.lit(1.0).alias("efficiency"))
    return done.unionByName(bare)


def bloom_months(masks: DataFrame, neighbour: float = 0.3) -> DataFrame:
    """(species_id, month, open): bits of a mask, smoothed by 0.3 of each neighbour, 1 at most; no bit means all.

    masks: (species_id, mask), bit 0 for January.
    """
    m = F.when(F.col("mask") == 0, F.lit(4095)).otherwise(F.col("mask")).cast("int")
    bit = lambda i: F.call_function("shiftright", m, F.pmod(i, F.lit(12)).cast("int")).bitwiseAND(F.lit(1)).cast("double")
    t = masks.select("species_id", "mask", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    i = F.col("i")
    return t.select("species_id", (i + 1).alias("month"), F.least(F.lit(1.0), bit(i) + neighbour * bit(i - 1) + neighbour * bit(i + 1)).alias("open"))


def month_penalty(scores: DataFrame, efficiency: DataFrame, month: Column, beta: float) -> DataFrame:
    """logit + beta ln(efficiency + 1e-9) in the image's month."""
    t = scores.withColumn("month", month).join(efficiency, ["species_id", "month"])
    return t.select("image_id", "species_id", (F.col("logit") + beta * F.log(F.col("efficiency") + 1e-9)).alias("score"))
