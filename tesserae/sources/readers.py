"""Readers. Only a header line, or a small settings file, is ever looked at on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType, StructField, StructType

from tesserae.functions.columns import norm_species_id
from tesserae.functions.ordinals import numbered
from tesserae.operators.curation import ids_in, resolve

#: Other names of a manifest's columns.
MANIFEST_ALIASES = {
    "species_id": ["species_ids", "class_id", "label", "speciesid"],
    "image_path": ["path", "filepath", "file_path"],
    "image_name": ["filename", "file_name", "image"],
    "genus": ["genus_name"],
    "family": ["family_name"],
}


def sniff(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The delimiter of a header line, of comma, semicolon and tab the most frequent, and its names."""
    line = spark.read.text(path).first()[0].lstrip("﻿")
    sep = max(",;\t", key=line.count)
    return sep, [c.strip().strip("\"'").strip() for c in line.split(sep)]


def read_manifest(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """A delimited manifest as text columns under canonical names, with normalised species ids."""
    sep, names = sniff(spark, path)
    schema = StructType([StructField(c, StringType()) for c in names])
    df = resolve(spark.read.schema(schema).csv(path, sep=sep, header=True, multiLine=False, enforceSchema=True), aliases or MANIFEST_ALIASES)
    return df.withColumn("species_id", norm_species_id("species_id")) if "species_id" in df.columns else df


def class_folders(spark: SparkSession, root: str, split: bool = False) -> DataFrame:
    """(image_path, image_name, species_id, and split) of files below root/[split/]species/image; contents stay unread.

    Folders are plain names, or Spark's name=value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    at = lambda i: F.regexp_replace(F.element_at(parts, -i), "^[^=]*=", "")  # noqa: E731  Spark's own folders are name=value
    cols = [F.col("path").alias("image_path"), at(1).alias("image_name"), at(2).alias("species_id"), "length"]
    df = files.select(*cols, *([at(3).alias("split")] if split else []))
    if not split:
        return df
    return df.join(df.where("split = 'train'").select("species_id").distinct(), "species_id", "left_semi")


def with_bytes(rows: DataFrame, roots: list[str], key: str = "image_path", out: str = "jpg") -> DataFrame:
    """rows with the bytes of the file that their path names below the first of roots that has it; rows without a file go.

    Places are chosen from listings; contents are read once, of the chosen files' roots, and join at the end.
    """
    spark = rows.sparkSession
    files = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root) for root in roots]
    inside = lambda root: F.expr(f"substr(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    listed = None
    for i, (root, f) in enumerate(zip(roots, files, strict=True)):
        one = f.select(inside(root).alias("__rel"), F.col("path").alias("__path"), F.lit(i).alias("__root"))
        listed = one if listed is None else listed.unionByName(one)
    chosen = listed.groupBy("__rel").agg(F.min_by("__path", "__root").alias("__path"))
    named = rows.join(chosen, rows[key] == F.col("__rel")).drop("__rel")
    contents = None
    for f in files:
        one = f.select(F.col("path").alias("__p"), F.col("content").alias(out))
        contents = one if contents is None else contents.unionByName(one)
    return named.join(contents, F.col("__path") == F.col("__p")).drop("__path", "__p")


def existing(df: DataFrame, listing: DataFrame, key: str = "image_path", least_bytes: int = 1024) -> DataFrame:
    """Rows whose file is listed and larger than least_bytes."""
    return df.join(listing.where(F.col("length") > least_bytes).select(F.col("image_path").alias(key)), key, "left_semi")


def test_items(df: DataFrame, month: bool = False) -> DataFrame:
    """(image_id, file_name, and month) under any usual column names; months default to July."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(have[n]).cast("string")), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    cols = [pick(["quadrat_id", "plot_id", "observation_id", "image_id", "id"]).alias("image_id"), pick(["file_name", "filename", "image_name", "path"]).alias("file_name")]
    if month:
        day = F.to_date(F.try_to_timestamp(pick(["date", "observed_on"])))
        cols.append(F.coalesce(F.month(day), F.lit(7)).alias("month"))
    return df.select(*cols)


def month_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(species_id, month, n) of month histograms in JSON lines: broken lines and errors go, the last of a species wins."""
    schema = StructType([StructField("species_id", StringType()), StructField("error", StringType()), StructField("total", LongType()), StructField("months", MapType(StringType(), LongType()))])
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.from_json("value", schema).alias("r"))
    good = lines.where("r.species_id is not null and r.error is null")
    last = good.groupBy("r.species_id").agg(F.max_by("r.months", "at").alias("months"))
    return last.select("species_id", F.explode(F.map_entries("months")).alias("m")).select("species_id", F.col("m.key").cast("int").alias("month"), F.col("m.value").alias("n"))


def month_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from columns m_01 to m_12, all of which must be there."""
    months = [f"m_{i:02d}" for i in range(1, 13)]
    _, names = sniff(spark, path)
    if missing := [m for m in ["species_id", *months] if m not in names]:
        raise ValueError(f"columns are missing: {missing}")
    schema = StructType([StructField(c, LongType() if c in months else StringType()) for c in names])
    df = spark.read.schema(schema).csv(path, header=True)
    long = df.unpivot([F.col("species_id")], months, "month", "n")
    return long.select("species_id", F.substring("month", 3, 2).cast("int").alias("month"), "n")


def species_list(spark: SparkSession, path: str) -> DataFrame:
    """(species_id, code): the first whole number of each line, distinct, sorted and numbered from zero."""
    ids = spark.read.text(path).select(F.nullif(F.regexp_extract("value", r"(-?\d+)", 1), F.lit("")).cast("long").alias("species_id")).where("species_id is not null").distinct()
    return numbered(ids, "species_id", out="code").withColumn("code", F.col("code").cast("int"))


def submission(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, rank, species_id) of a written submission, ranks from one in written order."""
    sep, names = sniff(spark, path)
    df = spark.read.schema(StructType([StructField(c, StringType()) for c in names])).csv(path, sep=sep, header=True)
    ids = df.select(F.col(names[0]).alias("image_id"), ids_in(F.col(names[1])).alias("ids"))
    return ids.select("image_id", F.posexplode("ids").alias("p", "species_id")).select("image_id", (F.col("p") + 1).alias("rank"), "species_id")


def thresholds(spark: SparkSession, path: str, classes: DataFrame | None = None) -> DataFrame:
    """(species_id, threshold) of a JSON file in any of four layouts.

    A list, or a list under `thresholds`, is by class code; an object is by code if classes
    (species_id, code) are given and all its keys are codes, else by species id.
    """
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    text = text.select(F.coalesce(F.get_json_object("t", "$.thresholds"), F.col("t")).alias("t"))
    listed = text.where(F.col("t").startswith("[")).select(F.posexplode(F.from_json("t", "array<double>")).alias("k", "threshold")).select(F.col("k").cast("string").alias("k"), "threshold", F.lit(True).alias("coded"))
    keyed = text.where(F.col("t").startswith("{")).select(F.explode(F.from_json("t", MapType(StringType(), DoubleType()))).alias("k", "threshold")).select("k", "threshold", F.lit(False).alias("coded"))
    both = listed.union(keyed)
    if classes is None:
        return both.select(F.col("k").alias("species_id"), "threshold")
    c = classes.select(F.col("species_id").cast("string").alias("sid"), F.col("code").cast("string").alias("code"))
    named = keyed.join(c, keyed.k == c.sid, "left_anti").agg((F.count("*") > 0).alias("by_code"))
    t = both.crossJoin(F.broadcast(named)).withColumn("coded", F.col("coded") | F.col("by_code"))
    by_code = t.where("coded").join(c, t.k == c.code).select(F.col("sid").alias("species_id"), "threshold")
    return by_code.union(t.where("not coded").select(F.col("k").alias("species_id"), "threshold"))


def feature_shards(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Feature rows of all readable Parquet shards; their number must be as expected, if given."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return df


def summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries, one JSON object a file, in order of model and prompt mode."""
    return spark.read.json(pattern, multiLine=True).orderBy("model", "prompt_mode")


def remaining(items: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(key), key, "left_anti")


def alias_columns(df: DataFrame, **names: str) -> list[Column]:
    return [F.col(v).alias(k) for k, v in names.items()]
