"""Token counts: only lengths leave the Arrow function."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_texts
from tesserae.llm.pieces import SLICE_BYTES, pieces

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    Arrow batches are cut into slices of about equal bytes, and texts at white space.
    Null texts count as empty; repeated rows each get a row; an empty table gives an
    empty result; other columns of docs are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        p = pieces(path)
        return lambda texts: [(n,) for n in p.counts(texts).tolist()]

    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint")
    out = map_texts(docs, make, "n_tokens bigint", id_col, text_col, {"n_bytes": size}, SLICE_BYTES, arrays=True)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
