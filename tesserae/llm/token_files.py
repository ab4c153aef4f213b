"""Token id files: each document its own zstandard frame under one shared dictionary.

A set of files is a folder with `dictionary` (hash and bytes) and `segments`, both Parquet,
so that Spark's committers write them to any store and a lost executor's work is redone.
A segment row holds about SEGMENT_BYTES of frames side by side in `data`, with the index to
them: documents' ids, where each frame starts, how many ids it has and how many ids stand
before it in the file's range of documents. One document costs one segment read (found by
first_id and last_id) and one small decompression. Segments stand in ascending order of id.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import map_texts, partitions, reachable, shared_dir
from tesserae.llm.pieces import SLICE_BYTES, pieces

VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Bytes of frames in a segment, and segments in a file.
SEGMENT_BYTES, FILE_SEGMENTS = 1 << 20, 32
#: The dictionary is trained on this many documents of the smallest hashes, of at most so many bytes each.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 65_536
LEVEL = 3
#: What stands for a null id in the order of ids, and for the end of an id's rows.
LEAST_ID, GREATEST = -(1 << 63), (1 << 63) - 1


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, path: str) -> bytes:
    """A zstandard dictionary of serialized id arrays from a bounded sample; empty if there is too little."""
    text = F.col(f"`{text_col}`").cast("string")
    few = docs.select(text.alias("t"), F.xxhash64(f"`{id_col}`", text).alias("h")).where(F.octet_length("t").between(1, SAMPLE_BYTES))
    # Hashes alone are put in order; the texts of the least ones are fetched by them.
    least = sorted({r["h"] for r in few.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).collect()})
    rows = sorted(few.where(F.col("h").isin(least)).dropDuplicates(["h"]).collect(), key=lambda r: r["h"]) if least else []
    samples = [x.astype("<u2").tobytes() for x in pieces(path).encode(pa.array([r["t"] for r in rows], pa.string()))] if rows else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _buckets(keys: DataFrame, n: int):
    """A column function of (key, h, row): which of n ranges of keys, about equally full, a row falls in.

    Ranges are found from keys alone, so texts are encoded once and only frames move. A key
    that fills several ranges is parted by h, its text's hash, and rows that are alike in
    both are dealt to the ranges that they fill: these stand in any order.
    """
    ids = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    times = Counter(ids) if n > 1 else {}
    often = [k for k, c in times.items() if c > 1]
    parted = {}
    if often:
        for r in keys.where(F.col("key").isin(often)).groupBy("key").agg(F.percentile_approx("h", [i / (2 * n) for i in range(1, 2 * n)], 10_000).alias("hs")).collect():
            c = times[r["key"]]
            parted[r["key"]] = [r["hs"][min(len(r["hs"]) - 1, round(2 * n * i / (c + 1)) - 1)] for i in range(1, c + 1)]
    bounds = np.array([(k, h) for k in sorted(times) for h in parted.get(k, [GREATEST])], np.int64).reshape(-1, 2)
    sent = keys.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def bucket(key: pd.Series, h: pd.Series, row: pd.Series) -> pd.Series:
        b = sent.value
        low, high = np.searchsorted(b[:, 0], key, "left"), np.searchsorted(b[:, 0], key, "right")
        out = low.astype(np.int32)
        for i in np.flatnonzero((high > low) & (b[np.minimum(low, len(b) - 1), 1] < GREATEST)) if len(b) else ():
            own = b[low[i] : high[i], 1]
            first = int(np.searchsorted(own, h[i], "left"))
            alike = int(np.searchsorted(own, h[i], "right")) - first
            out[i] += first + (hash(int(row[i])) % alike if alike > 1 else 0)
        return pd.Series(out)

    return bucket


def _coder(dictionary: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_token_files(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID) -> None:
    """Writes every text's ids, and end_id after them, to token files in the folder out."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    n = partitions(spark)
    dictionary = train_dictionary(docs, id_col, text_col, path)
    mark = hashlib.sha256(dictionary).hexdigest()
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LEAST_ID))
    mark_of = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    bucket = _buckets(docs.select(key.alias("key"), mark_of.alias("h")), n)
    sent = spark.sparkContext.broadcast(dictionary)

    def make():
        p, coder = pieces(path), zstandard.ZstdCompressor(level=LEVEL, **_coder(sent.value))
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def apply(texts):
            out = []
            for ids in p.encode(texts):
                ids = np.concatenate([ids, end])
                kind = "<u2" if not len(ids) or ids.max() < 65536 else "<u4"
                out.append((len(ids), kind[1:], coder.compress(ids.astype(kind).tobytes())))
            return out

        return apply

    frames = map_texts(docs, make, "n bigint, kind string, frame binary", id_col, text_col, {"bucket": bucket(key, mark_of, F.monotonically_increasing_id()), "h": mark_of}, SLICE_BYTES, arrays=True)
    frames = frames.select("bucket", F.col(id_col).cast("bigint").alias("id"), "n", "kind", "frame", "h")

    def pack(batches):
        held, size, at, seq, of = [], 0, 0, 0, None

        def close():
            nonlocal held, size, seq
            if not held:
                return None
            offsets = np.cumsum([0, *[len(f) for _, _, _, _, f in held]])
            row = {
                "bucket": of, "seq": seq, "first_id": min((i for i, *_ in held if i is not None), default=None), "last_id": max((i for i, *_ in held if i is not None), default=None),
                "ids": [i for i, *_ in held], "starts": [s for _, s, *_ in held], "sizes": [k for _, _, k, _, _ in held], "kinds": [k for _, _, _, k, _ in held],
                "offsets": offsets.tolist(), "data": b"".join(f for *_, f in held), "dictionary": mark,
            }
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for bucket, i, k, kind, frame in zip(*[c.to_pylist() for c in b.columns[:5]], strict=True):
                if bucket != of or (held and size + len(frame) > SEGMENT_BYTES):
                    if (done := close()) is not None:
                        yield done
                if bucket != of:
                    of, at, seq = bucket, 0, 0
                held.append((i, at, k, kind, frame))
                size += len(frame)
                at += k
        if (done := close()) is not None:
            yield done

    arrow = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64())), ("data", pa.binary()), ("dictionary", pa.string())])
    schema = "bucket int, seq int, first_id bigint, last_id bigint, ids array<bigint>, starts array<bigint>, sizes array<bigint>, kinds array<string>, offsets array<bigint>, data binary, dictionary string"
    ordered = frames.repartitionById(n, "bucket").sortWithinPartitions("bucket", "id", "h")
    ordered.mapInArrow(pack, schema).write.option("maxRecordsPerFile", FILE_SEGMENTS).parquet(f"{out}/segments")
    spark.createDataFrame([(mark, bytearray(dictionary))], "hash string, data binary").coalesce(1).write.parquet(f"{out}/dictionary")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["hash"]:
        raise ValueError("the dictionary does not have the hash that is kept with it")
    return row["hash"], data


def read_token_files(spark: SparkSession, folder: str, ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, crc32, token_ids) from the files; ids: only these documents.

    start counts the ids of all documents before. token_ids are little-endian unsigned
    32-bit integers, left out unless with_ids.
    """
    reachable(spark)
    mark, data = _dictionary(spark, folder)
    segments = spark.read.parquet(f"{folder}/segments")
    # One number for each range of documents: at most one for each partition at writing.
    totals = segments.groupBy("bucket").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("bucket").collect()
    base, at = {}, 0
    for r in totals:
        base[r["bucket"]] = at
        at += r["n"]
    if ids is not None:
        near = F.lit(False)
        for i in ids:
            near |= F.col("first_id").isNull() | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        segments = segments.where(near)
    sent, wanted = spark.sparkContext.broadcast(data), None if ids is None else set(ids)
    schema = "id bigint, start bigint, n_tokens bigint, crc32 bigint" + ", token_ids binary" * with_ids
    arrow = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("crc32", pa.int64()), *[("token_ids", pa.binary())] * with_ids])

    def unpack(batches):
        coder = zstandard.ZstdDecompressor(**_coder(sent.value))
        for b in batches:
            for bucket, docs, starts, sizes, kinds, offsets, blob, kept in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kept != mark:
                    raise ValueError("a segment names another dictionary")
                rows = []
                for k, doc in enumerate(docs):
                    if wanted is None or doc in wanted:
                        raw = np.frombuffer(coder.decompress(blob[offsets[k] : offsets[k + 1]]), "<" + kinds[k]).astype("<u4").tobytes()
                        rows.append((doc, base[bucket] + starts[k], sizes[k], zlib.crc32(raw), *[raw] * with_ids))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return segments.select("bucket", "ids", "starts", "sizes", "kinds", "offsets", "data", "dictionary").mapInArrow(unpack, schema)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, out: str | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every row, read back from token files that it writes.

    Null texts hold the end id alone; rows that repeat an id stand side by side, in the order
    of their texts' hashes; rows with a null id stand first of all; an empty table gives empty files and an
    empty result; other columns of docs are ignored. Files go to a new folder in the
    shared one unless out names another.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, out, id_col, text_col, path)
    read = read_token_files(spark, out, with_ids=False)
    return read.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))
