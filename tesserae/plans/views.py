"""The driver's tables as the relations that the operators work on, and the same in SQL.

Embeddings stand for tile scores: vector v is tile v mod 5 of image v div 5, and its 64
numbers are the logits of species 0 to 63. Genus is species div 4, family species div 16.
Line items stand for a manifest of images: the supplier is the species, the return flag
the source; parts are a taxonomy of their keys; orders give months; events are telemetry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILES_PER_IMAGE, CLASSES = 5, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, tile_id, logits array, label): one row for each tile."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 5").alias("image_id"), (F.col("vec_id") % 5).cast("int").alias("tile_id"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), "label")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, tile_id, species_id, logit) in long form."""
    return tile_arrays(spark, sf_dir).select("image_id", "tile_id", F.posexplode("logits").alias("species_id", "logit"))


def tile_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, tile_id, veg_weight, noise_fraction) by rule."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(F.expr("vec_id div 5").alias("image_id"), (v % 5).cast("int").alias("tile_id"), ((v * 7 % 11) / 10.0).alias("veg_weight"), ((v * 3 % 7) / 6.0).alias("noise_fraction"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, species_id): the labels of an image's tiles, times 6."""
    return tile_arrays(spark, sf_dir).select("image_id", (F.col("label") * 6).alias("species_id")).distinct()


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species_id, genus_id, family_id) of the 64 species, from the length of tiles' logits."""
    n = table(spark, sf_dir, "embeddings").agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("n"))
    species = n.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("species_id"))
    return species.select("species_id", F.expr("species_id div 4").cast("int").alias("genus_id"), F.expr("species_id div 16").cast("int").alias("family_id"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species_id, n): training images of each of the species that have any, from line items; 60 to 63 have none."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 60).cast("int").alias("species_id")).agg(F.count("*").alias("n"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_path, image_name, species_id, source, license, ordinal): one row for each line item."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    return li.select(F.concat(F.lit("img/"), F.col("l_suppkey"), F.lit("/"), name, F.lit(".jpg")).alias("image_path"), name.alias("image_name"), F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ".0").otherwise("")).alias("species_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("license"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


#: The same relations in SQL; prefix a query with `WITH {T}`.
TILE = """tile AS (SELECT vec_id // 5 AS image_id, CAST(vec_id % 5 AS INT) AS tile_id, CAST(unnest(range(64)) AS INT) AS species_id,
 CAST(unnest(embedding) AS DOUBLE) AS logit, label FROM embeddings),
meta AS (SELECT vec_id // 5 AS image_id, CAST(vec_id % 5 AS INT) AS tile_id, (vec_id * 7 % 11) / 10.0 AS veg_weight, (vec_id * 3 % 7) / 6.0 AS noise_fraction FROM embeddings),
top AS (SELECT image_id, tile_id, max(logit) AS m FROM tile GROUP BY ALL),
den AS (SELECT t.image_id, t.tile_id, any_value(m) AS m, sum(exp(logit - m)) AS z FROM tile t JOIN top USING (image_id, tile_id) GROUP BY ALL),
p AS (SELECT t.image_id, t.tile_id, species_id, logit, label, exp(logit - m) / z AS prob FROM tile t JOIN den USING (image_id, tile_id))"""
TRUTH = "truth AS (SELECT DISTINCT vec_id // 5 AS image_id, label * 6 AS species_id FROM embeddings)"
COUNTS = "cnt AS (SELECT CAST(l_partkey % 60 AS INT) AS species_id, count(*) AS n FROM lineitem GROUP BY 1)"
CLASSES_SQL = "cls AS (SELECT DISTINCT species_id FROM tile)"
MANIFEST = """man AS (SELECT 'img/' || l_suppkey || '/' || l_orderkey || '-' || l_linenumber || '.jpg' AS image_path, l_orderkey || '-' || l_linenumber AS image_name,
 l_suppkey || CASE WHEN l_linenumber % 3 = 0 THEN '.0' ELSE '' END AS species_id, l_returnflag AS source, l_linestatus AS license, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
