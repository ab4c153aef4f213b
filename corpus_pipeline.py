"""From raw documents to token ids: five stages, each an operator of tesserae.llm.

Every stage but the last returns the columns of documents. A row is known by two 64-bit
hashes of all its columns under different seeds, so repeated and null ids do no harm and a
chance collision is out of the question at any size. Rows that a stage drops, and lines and
spans that it takes out, are narrow tables: they are sent to every task where a count shows
that they are small, and joined by a shuffle otherwise. Names that the stages add give way to
columns of docs.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.byte_bpe import round_trip
from tesserae.llm.common import cut, reachable, shared_dir
from tesserae.llm.decontaminate import contamination
from tesserae.llm.near_copies import near_copies
from tesserae.llm.quality import quality, stripped
from tesserae.llm.secret_scan import secret_spans

#: Narrow rows, and the hashes or characters in them, that may be sent to every task.
FEW_ROWS, FEW_HASHES, FEW_CHARS = 500_000, 1 << 20, 8 << 20
#: What stands in place of a secret.
BLANK = "[secret]"


def _name(docs: DataFrame, name: str) -> str:
    """name, or with underlines before it a name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row's columns, and the key's name."""
    own = [F.to_json(f"`{c}`") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    key = _name(docs, "__key")
    return docs.withColumn(key, F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("b"), *own).alias("b"))), key


def _few(df: DataFrame, size: Column | None = None, most: int = 0) -> DataFrame:
    """df, computed once, and sent to every task if a count shows that it is small."""
    df = cut(df)
    rows, sizes = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return F.broadcast(df) if rows <= FEW_ROWS and sizes <= most else df


def _without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs whose key is not among keys, without the key."""
    return docs.join(_few(keys.select(key).distinct()), key, "left_anti").drop(key)


def _changed(docs: DataFrame, text: Column, where: Column) -> DataFrame:
    """docs with another text, and its length, where the condition holds."""
    n = F.when(where, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("text", F.when(where, text).otherwise(F.col("text"))).withColumn("n_chars", n)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and from the others the lines above their host's limit."""
    keyed, key = _keyed(docs)
    removed = _name(docs, "__removed")
    found = cut(quality(keyed, key).select(key, "kept", F.col("removed").alias(removed)).where(~F.col("kept") | (F.size(removed) > 0)).dropDuplicates([key]))
    lines = _few(found.where("kept").select(key, removed), F.size(removed), FEW_HASHES)
    left = keyed.join(_few(found.where("not kept").select(key)), key, "left_anti").join(lines, key, "left")
    return _changed(left, stripped(F.col("text"), F.col(removed)), F.col(removed).isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: five words, similarity 0.8 or more."""
    keyed, key = _keyed(docs)
    own = _name(keyed, "__id")
    found = near_copies(keyed.withColumn(own, F.struct(F.col("doc_id").alias("doc_id"), F.col(key).alias("key"))), key, own)
    found = cut(found.select(key, (F.col(own) == F.col("component_id")).alias("first")))
    left = _without(keyed, key, found.where(~F.col("first")))
    twice = cut(found.where("first").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if not twice.count():
        return left
    keyed, key = _keyed(left)
    once = keyed.join(twice, key, "left_semi").dropDuplicates([key]).drop(key)
    return _without(keyed, key, twice).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    keyed, key = _keyed(docs)
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    return _without(keyed, key, found.where("contaminated"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts BLANK in place of every secret and counts the characters anew."""
    reachable(spark)
    keyed, key = _keyed(docs)
    found = _name(docs, "__spans")
    spans = _few(secret_spans(keyed, key).where("spans <> ''").select(key, F.col("spans").alias(found)).distinct(), F.length(found), FEW_CHARS)

    @F.pandas_udf("string")
    def blanked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if text and found:
                parts, at = [], 0
                for i, j in sorted(tuple(map(int, s.split(":")[1:])) for s in found.split(",")):
                    if i >= at:
                        parts += [text[at:i], BLANK]
                    at = max(at, j)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = keyed.join(spans, key, "left")
    return _changed(joined, blanked("text", found), F.col(found).isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again: lengths and digests."""
    return round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", blank_secrets),
    ("byte BPE", token_ids),
]

#: Components of near copies and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's rows are written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
