import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import sharding
from tests.llm.cases import SCHEMA, clashing, documents, rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 7])
def test_permutation(n, seed):
    places = sharding.permute(np.arange(n), n, seed)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.unpermute(places, n, seed) == np.arange(n)).all()


def test_shuffle_mixes():
    places = sharding.permute(np.arange(10_000), 10_000, 1)
    assert abs(np.corrcoef(places, np.arange(10_000))[0, 1]) < 0.05
    assert (places != sharding.permute(np.arange(10_000), 10_000, 2)).mean() > 0.99


@pytest.mark.parametrize("clash", [False, True])
def test_shards(spark, clash):
    docs = documents(spark)
    got = sharding.shards(clashing(docs) if clash else docs, 7).collect()
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    # Row numbers in order of id, checksum, size give shard and slot by computing alone.
    order = sorted(want)
    ranks = sharding.permute(np.arange(len(order)), len(order), 0)
    assert sorted((p // 7, p % 7, *o) for p, o in zip(ranks.tolist(), order, strict=True)) == sorted((r.slot, r.shard, r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got)


def test_reproducible(spark):
    docs = documents(spark)
    key = lambda df: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in df.collect())
    assert key(sharding.shards(docs, 5)) == key(sharding.shards(docs.repartition(2), 5))


def test_empty(spark):
    assert sharding.shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_rows_that_are_alike(spark):
    """They are dealt over tasks and get different places."""
    from tesserae.llm.sharding import numbered

    docs = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same").alias("text")).repartition(4)
    got = sharding.shards(docs)
    assert got.select("shard", "slot").distinct().count() == 4000
    assert [r["count"] for r in got.groupBy("shard").count().collect()] == [100] * 40
    rows, n = numbered(docs.withColumn("tie", F.monotonically_increasing_id()), ["doc_id", "text", "tie"])
    assert n == 4000 and rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500
