"""Writers: submissions, scored rows by configuration, fixed-size shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.curation import listed


def submission_rows(predictions: DataFrame, images: DataFrame) -> DataFrame:
    """(quadrat_id, species_ids): ids in order of rank, [] for images without any."""
    ids = predictions.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "species_id"))), lambda x: x["species_id"]).alias("ids"))
    t = images.select("image_id").distinct().join(ids, "image_id", "left")
    return t.select(F.col("image_id").cast("string").alias("quadrat_id"), listed(F.coalesce("ids", F.array().cast(ids.schema["ids"].dataType))).alias("species_ids"))


def write_submission(rows: DataFrame, path: str, append: bool = False) -> None:
    """All fields quoted, with a header."""
    rows.write.mode("append" if append else "overwrite").csv(path, header=True, quoteAll=True)


def write_by_configuration(scored: DataFrame, path: str) -> DataFrame:
    """One folder for each (agg, selection); returns (agg, selection, images, mean_k)."""
    scored.write.mode("overwrite").partitionBy("agg", "selection").parquet(path)
    back = scored.sparkSession.read.parquet(path)
    return back.groupBy("agg", "selection").agg(F.count_distinct("image_id").alias("images"), (F.count("*") / F.count_distinct("image_id")).alias("mean_k"))


def write_columnar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_shards(rows: DataFrame, path: str, size: int = 5_000) -> None:
    """(key, jpg, label) rows in files of `size` rows at most; the label is the first of a comma list."""
    t = rows.select("key", "jpg", F.trim(F.split("species_ids", ",")[0]).alias("label"))
    t.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(path)


def merge_sorted(spark, pattern: str, keys: list[str]) -> DataFrame:
    """The rows of all CSV outputs that a pattern finds, in order."""
    return spark.read.csv(pattern, header=True).orderBy(*keys)


def validation_extract(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Truths and inference list of the first n rows by key."""
    few = df.orderBy(key).limit(n)
    return few.select(F.col(key).alias("image_id"), "species_id"), few.select(F.col(key).alias("image_id"), "image_path")
