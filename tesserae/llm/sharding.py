"""Shards by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, partitions, reachable

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as round function."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64) for k in range(1, ROUNDS + 1)]


def _radix(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Where a reproducible shuffle of n rows puts each row number.

    A number is written as two digits to near-equal bases whose product is n or little
    more; each round adds a keyed hash of one digit to the other. Results of n or more
    are permuted again until they fall below n, so 0 to n - 1 maps onto itself.
    """
    a, b = _radix(n)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x // np.uint64(b), x % np.uint64(b)
            for k, key in enumerate(_keys(seed)):
                if k % 2:
                    right = (right + _mix(left, key) % np.uint64(b)) % np.uint64(b)
                else:
                    left = (left + _mix(right, key) % np.uint64(a)) % np.uint64(a)
            x = left * np.uint64(b) + right
            out[todo] = x
            todo = todo[x >= n]
    return out.astype(np.int64)


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each place of the shuffle."""
    a, b = _radix(n)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x // np.uint64(b), x % np.uint64(b)
            for k, key in reversed(list(enumerate(_keys(seed)))):
                if k % 2:
                    right = (right + np.uint64(b) - _mix(left, key) % np.uint64(b)) % np.uint64(b)
                else:
                    left = (left + np.uint64(a) - _mix(right, key) % np.uint64(a)) % np.uint64(a)
            x = left * np.uint64(b) + right
            out[todo] = x
            todo = todo[x >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a gapless global number `__row` in the given order, and how many there are.

    Rows are dealt by ranges and sorted there; each partition's rows are counted and only
    these counts, one for each partition, pass the driver.
    """
    spark = rows.sparkSession
    reachable(spark)
    spread = rows.repartitionByRange(partitions(spark), *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = cut(spread.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, n = {}, 0
    for p in sorted(counts):
        before[p] = n - (p << 33)
        n += counts[p]
    sent = spark.sparkContext.broadcast(before)

    def run(batches):
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            if len(at):
                shift = sent.value
                first = at >> 33
                row = at + np.array([shift[p] for p in first.tolist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(row)], names=[*b.schema.names[:-1], "__row"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in placed.dtypes[:-1]], "__row bigint"])
    return placed.mapInArrow(run, schema), n


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    Rows are numbered by id, then checksum and size; rows that are alike in all three may
    stand for each other. The place that the permutation gives a number is slot * n_shards
    + shard, so counts differ by one at most and slots have no gaps. Law `rows`; there is
    no grown_shard. size: UTF-8 bytes and 16 more, null texts none; a null id comes first;
    an empty table gives an empty result; other columns of docs are ignored. Texts
    are not shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.monotonically_increasing_id().alias("tie"))
    # Rows that are alike in all else are put in order by where they were read, so that many of them do not meet in one task.
    rows, n = numbered(narrow, ["id", "crc", "size", "tie"])

    def run(batches):
        for b in batches:
            place = permute(b.column(4).to_numpy(zero_copy_only=False), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((place % n_shards).astype(np.int32)), pa.array(place // n_shards)], names=["id", "size", "crc", "shard", "slot"])

    placed = rows.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, size bigint, crc bigint, shard int, slot bigint")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
