"""Image hashes: a Hamming join by chunk tables, and an append-only snapshot of what has been hashed.

A hash is a string of hexadecimal digits, such as the 64 of a 16 x 16 average hash. Bits that are
equal in all hashes, as those of an enlarged picture are, count as one bit of their number's weight.
Two hashes that differ in at most `bits` bits agree in most of their chunks, so they meet in the
table of a chunk on which they agree; crowded entries of a table are parted by the next chunk
that agrees, until little is left to compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.lineage import cut
from tesserae.operators.pixels import measure

#: Chunks beyond one more than the bits: so many more chunks agree, and so often a crowded entry can be parted.
SLACK = 3
#: Comparisons in an entry of a table; hashes in a block of entries that cannot be parted any more.
CROWDED, BLOCK = 250_000, 500
#: Comparisons that cost as much as an entry in a further table.
ENTRY_COST = 100
SNAPSHOT = "path string, length bigint, sha256 string, ahash string, ok boolean, error string, batch bigint"
#: Files that are read at a time, so that a list of files on the driver is bounded.
FILES = 10_000


def _unpacked(column: pa.Array, digits: int) -> np.ndarray:
    """Rows x bits, of hexadecimal hashes."""
    data = bytes.fromhex("".join(h.ljust(digits, "0")[:digits].ljust(digits + digits % 2, "0") for h in column.to_pylist()))
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(len(column), -1), axis=1)[:, : 4 * digits]


def _groups(hashes: DataFrame, digits: int) -> list[list[int]]:
    """Bits that are equal in all hashes (a) together, those left out that never differ; from counts of bits that are set together."""
    n = 4 * digits

    def run(batches):
        total = np.zeros((n + 1, n), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                x = _unpacked(b.column(0).slice(i, 8192), digits).astype(np.float32)
                total[:n] += (x.T @ x).astype(np.int64)
                total[n, 0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["k", "v"])

    each = hashes.select("a").mapInArrow(run, "k int, v array<bigint>").select("k", F.posexplode("v").alias("j", "v"))
    both = np.zeros((n + 1, n), np.int64)
    for k, j, v in each.groupBy("k", "j").agg(F.sum("v").alias("v")).where("v > 0").collect():
        both[k, j] = v
    found: list[list[int]] = []
    for i in range(n):
        if 0 < both[i, i] < both[n, 0]:
            same = next((g for g in found if both[g[0], i] == both[i, i] == both[g[0], g[0]]), None)
            found.append([i]) if same is None else same.append(i)
    return found


def _chunked(df: DataFrame, name: str, groups: list[list[int]], n: int, digits: int) -> DataFrame:
    """df (a hash) with its words of 64 bits, w, and the values of n chunks, c; a long chunk's value is a sum modulo 2 ** 31 - 1."""
    edges = [k * len(groups) // n for k in range(n + 1)] if n else [0]
    firsts = np.array([g[0] for g in groups], np.int64)
    parts = [firsts[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
    words = -(-4 * digits // 64)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                x = _unpacked(part.column(0), digits)
                packed = np.zeros((len(x), 8 * words), np.uint8)
                packed[:, : -(-4 * digits // 8)] = np.packbits(x, axis=1)
                c = [reduce(lambda v, j: (2 * v + x[:, j]) % (2**31 - 1), p, np.zeros(len(x), np.int64)) for p in parts]
                c = np.stack(c, 1).astype(np.int32) if c else np.zeros((len(x), 0), np.int32)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists(packed.view(np.int64)), lists(c)], names=[name, "w", "c"])

    return df.select(F.col(df.columns[0]).alias(name)).mapInArrow(run, f"{name} string, w array<bigint>, c array<int>")


def near_hashes(left: DataFrame, right: DataFrame, bits: int, digits: int = 64, slack: int = SLACK, crowded: int = CROWDED) -> DataFrame:
    """(a, b, distance): every two different-sided hashes that differ in at most `bits` bits, once.

    left and right have one column each, of hashes; repeats and nulls do not matter. Bits that are equal in all
    hashes are a group; within `bits` bits no more than `most` groups differ. Of most + 1 + slack chunks of groups two such
    hashes agree in slack + 1 or more. They meet at the first chunk that
    agrees, which is among the first most + 1; where a chunk's value is crowded, at the first two, and so on.
    Entries that are crowded in all slack + 1, or cost less to compare than to part, are compared in blocks of BLOCK x BLOCK, each a task's small part.
    """
    if bits + 1 + slack > digits:
        raise ValueError(f"{bits} bits and {slack} chunks more than needed do not fit {digits} digits")
    own = [cut(df.select(F.lower(df.columns[0]).alias("a")).where("a is not null").distinct()) for df in (left, right)]
    groups = _groups(own[0].union(own[1]), digits)
    most = int((np.cumsum(sorted(map(len, groups))) <= bits).sum())
    slack = min(slack, len(groups) - most - 1)
    sides = [_chunked(df, name, groups, most + 1 + slack if slack >= 0 else 0, digits).withColumns({"token": F.lit(""), "last": F.lit(-1)}) for df, name in zip(own, "ab", strict=True)]
    if slack < 0:
        sides = [cut(df) for df in sides]
    near = reduce(lambda x, y: x + y, [F.bit_count(F.col("w")[i].bitwiseXOR(F.col("w2")[i])) for i in range(-(-4 * digits // 64))]).alias("distance")
    found = []

    def further(df: DataFrame, name: str, level: int) -> DataFrame:
        """Entries with one more chunk, which comes after the last one and can be the level-th that agrees."""
        options = F.array(*[F.struct(F.lit(k).alias("last"), F.concat_ws(":", F.lit(k), F.col("c")[k]).alias("v")) for k in range(most + level)])
        more = df.withColumn("o", F.explode(F.filter(options, lambda o: o["last"] > F.col("last"))))
        return more.select(name, "w", "c", F.concat_ws("|", "token", "o.v").alias("token"), "o.last")

    for level in range(min(1, slack + 1), slack + 2):
        sides = [cut(further(df, name, level)) for df, name in zip(sides, "ab", strict=True)] if level else sides
        counts = [df.groupBy("token").agg(F.count("*").alias(f"n{name}")) for df, name in zip(sides, "ab", strict=True)]
        busy = cut(counts[0].join(counts[1], "token").where(f"na * nb > {crowded}").select("token", "na", "nb"))
        agreeing = reduce(lambda x, y: x + y, [F.when((F.col("last") >= k) & (F.col("c")[k] == F.col("c2")[k]), 1).otherwise(0) for k in range(most + level)], F.lit(0)) if level else F.lit(0)
        other = sides[1].withColumnsRenamed({"w": "w2", "c": "c2"}).drop("last").hint("merge")
        both = sides[0].join(busy, "token", "left_anti").join(other, "token").where(agreeing == level)
        found.append(both.select("a", "b", near).where(f"distance <= {bits}"))
        entries, pairs = busy.agg(F.sum(F.col("na") + F.col("nb")), F.sum(F.col("na").cast("double") * F.col("nb"))).first()
        if not entries:
            break
        if level <= slack and pairs > ENTRY_COST * entries * (most + level + 1) / (level + 1):
            sides = [df.join(busy, "token", "left_semi") for df in sides]
            continue
        blocks = lambda name, of: F.pmod(F.xxhash64(F.lit(name), of), F.ceil(F.col(f"n{name}") / BLOCK))
        every = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(f"n{name}") / BLOCK) - 1))
        one = sides[0].join(busy, "token").select("a", "w", "c", "token", "last", blocks("a", "a").alias("x"), every("b").alias("y"))
        two = other.join(busy, "token").select("b", "w2", "c2", "token", blocks("b", "b").alias("y"), every("a").alias("x")).hint("merge")
        found.append(one.join(two, ["token", "x", "y"]).where(agreeing == level).select("a", "b", near).where(f"distance <= {bits}"))
        break
    return reduce(DataFrame.unionByName, found)


def near_images(new: DataFrame, old: DataFrame, bits: int, digits: int = 64) -> DataFrame:
    """(path, ahash, n_near, distance, nearest): for each new image, how many old ones are within `bits` bits, and the nearest.

    Both have (path, ahash). Links are found between distinct hashes, so copies are counted, never paired; of
    the nearest, the least path is given. An image without a hash or without a near one has n_near 0.
    """
    copies = old.where("ahash is not null").groupBy(F.lower("ahash").alias("b")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    links = near_hashes(new.select("ahash"), copies.select("b"), bits, digits)
    of = links.join(copies, "b").groupBy("a").agg(F.sum("n").alias("n_near"), F.min(F.struct("distance", "path")).alias("best"))
    t = new.select("path", "ahash").join(of, F.lower(F.col("ahash")) == F.col("a"), "left")
    return t.select("path", "ahash", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.distance").cast("int").alias("distance"), F.col("best.path").alias("nearest"))


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot's last row for each path; no rows where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(SNAPSHOT).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SNAPSHOT)
    rest = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("path", "r.*")


def unhashed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of a listing (path, length, ...) that the snapshot has not, or has with another length."""
    return listing.dropDuplicates(["path"]).join(known.select("path", "length"), ["path", "length"], "left_anti")


def hash_new(rows: DataFrame, folder: str, batch: int, hashed: Callable[[DataFrame], DataFrame]) -> None:
    """Hashes the rows (path, length, ...) that the snapshot has not, and appends them under a batch number.

    hashed takes those rows and returns (path, length, sha256, ahash, ok, error). A batch that is
    run again after a failure appends only what is still missing.
    """
    spark = rows.sparkSession
    new = hashed(unhashed(rows, snapshot(spark, folder)))
    new.select("path", "length", "sha256", "ahash", "ok", "error", F.lit(batch).cast("bigint").alias("batch")).write.mode("append").parquet(folder)


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256, ahash, ok, error) of files; one that no decoder reads has no ahash."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    exact = spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))
    seen = measure(spark.read.format("image").option("dropInvalid", True).load(paths)).select(plain("origin").alias("key"), "ahash")
    t = exact.withColumn("key", plain("path")).join(seen, "key", "left")
    return t.select("path", "length", "sha256", "ahash", F.col("ahash").isNotNull().alias("ok"), F.when(F.col("ahash").isNull(), "undecodable").alias("error"))


def hash_new_files(spark: SparkSession, pattern: str, folder: str) -> int:
    """Hashes the files under a pattern that the snapshot has not; returns how many.

    Only names and lengths of all files are listed. New ones are read FILES at a time and
    appended at once, so a run that breaks off goes on where it stopped.
    """
    listing = spark.read.format("binaryFile").load(pattern).select("path", "length")
    new = cut(unhashed(listing, snapshot(spark, folder)).select("path"))
    batch = (snapshot(spark, folder).agg(F.max("batch")).first()[0] or 0) + 1

    def parts(rows: Iterator) -> Iterator[list[str]]:
        held: list[str] = []
        for r in rows:
            held.append(r["path"])
            if len(held) == FILES:
                yield held
                held = []
        if held:
            yield held

    n = 0
    for paths in parts(new.toLocalIterator()):
        _read(spark, paths).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("append").parquet(folder)
        n, batch = n + len(paths), batch + 1
    return n
