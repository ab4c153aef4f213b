"""The operators' queries over whole tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import piece_bpe
from tesserae.llm.byte_bpe import round_trip
from tesserae.llm.chat import rendered, repaired
from tesserae.llm.decontaminate import contamination
from tesserae.llm.html_text import extract
from tesserae.llm.lexical import search
from tesserae.llm.oracles import QUALITY_SQL, SEARCH_SQL, TRIE_SQL, shards_sql
from tesserae.llm.prefix_trie import prefix_trie
from tesserae.llm.quality import quality
from tesserae.llm.secret_scan import secret_spans
from tesserae.llm.sharding import shards
from tesserae.llm.simhash import near_duplicates
from tesserae.llm.token_counts import token_counts
from tesserae.llm.token_files import token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("chars", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated", spans.alias("hit_spans"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(repaired(_table(spark, sf_dir, "conversations")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).drop("removed")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_secrets, op3_decontamination, op4_chat_format, op5_html_text, op6_shards, op7_token_counts, op8_token_files, op9_quality, op10_byte_bpe, op11_lexical_search, op12_prefix_trie, op13_sentencepiece)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_shards": shards_sql(), "op9_quality": QUALITY_SQL, "op11_lexical_search": SEARCH_SQL, "op12_prefix_trie": TRIE_SQL}
