"""SimHash near-duplicates: generalised pigeonhole over groups of correlated bits.

A fingerprint's 64 bits are ordered so that correlated ones stand together and
cut into segments. Segment i gets a threshold t_i, -1 or more. If the sum of all
t_i + 1 is one more than the distance sought, any two fingerprints within that
distance agree to t_i bits in some segment i, so probing each segment's values
within t_i finds every link. Cuts and thresholds come from one dynamic program
over estimated probes and candidates, from counts over all fingerprints: few
fingerprints get many exact segments, many get fewer, wider ones.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, map_texts, partitions, reachable
from tesserae.llm.components import components

BITS, BLOCK = 64, 4
#: Members of a bucket that one task compares; larger buckets go by midpoints.
BUCKET_LIMIT = 20_000
#: Components that are few enough to send to every task.
BROADCAST_ROWS = 100_000
#: Relative costs of sending one probe and of comparing one pair.
PROBE_COST, PAIR_COST = 1.0, 0.01


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; without words zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], 42) for i, j in zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return signature(hashes)


def signature(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes; there is one at least."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint for each row; null or wordless texts get 0."""

    def make():
        return lambda texts: [(_signed(fingerprint(t, shingle)),) for t in texts]

    return map_texts(docs, make, "fp bigint", id_col, text_col)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, counts, n: int) -> np.ndarray:
    """Sums counts(array of fingerprints), n numbers, over all fingerprints."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            if b.num_rows:
                total += counts(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total)], names=["k", "v"])

    out = np.zeros(n, np.float64)
    for k, v in fps.select("fp").mapInArrow(run, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[k] = v
    return out


def _pairs(fps: np.ndarray) -> np.ndarray:
    total = np.zeros((BITS, BITS))
    for i in range(0, len(fps), 8192):
        b = _bits(fps[i : i + 8192]).astype(np.float32)
        total += b.T @ b
    return total.astype(np.int64).ravel()


def bit_order(both: np.ndarray, n: float) -> list[int]:
    """Bits with correlated ones together, from counts of bits that are set together."""
    both = both.reshape(BITS, BITS) / max(n, 1)
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(near, 0)
    left, order = set(range(BITS)), []
    group: list[int] = []
    while left:
        score = near[:, group].sum(1) if group else near[:, order[-BLOCK:]].sum(1) if order else near.sum(1)
        best = max(left, key=lambda i: (round(score[i], 9), -i))
        left.remove(best)
        order.append(best)
        group = [] if len(group) == BLOCK - 1 else [*group, best]
    return order


def plan(order: list[int], histograms: np.ndarray, n: float, distance: int) -> list[tuple[list[int], int]]:
    """Segments (bits, threshold) of least estimated cost whose thresholds + 1 add up to distance + 1.

    histograms: for each block of BLOCK bits in order, the count of each value.
    """
    blocks = BITS // BLOCK
    apart = np.zeros((blocks, distance + 1))
    values = 1 << BLOCK
    for b in range(blocks):
        h = histograms[b * values : (b + 1) * values] / max(n, 1)
        for x, y in itertools.product(range(values), repeat=2):
            if (d := (x ^ y).bit_count()) <= distance:
                apart[b, d] += h[x] * h[y]
    best = {(0, 0): (0.0, [])}
    for end in range(1, blocks + 1):
        for begin in range(end):
            spread = np.array([1.0])
            for b in range(begin, end):
                spread = np.convolve(spread, apart[b])[: distance + 1]
            bits = order[begin * BLOCK : end * BLOCK]
            for t in range(-1, distance + 1):
                probes = sum(math.comb(len(bits), k) for k in range(t + 1))
                cost = 0.0 if t < 0 else n * probes * PROBE_COST + (n * n / 2 * spread[: t + 1].sum() + n * (probes - 1)) * PAIR_COST
                for used in range(distance + 1 - t):
                    if (begin, used) in best:
                        total = best[begin, used][0] + cost
                        at = (end, used + t + 1)
                        if at not in best or total < best[at][0]:
                            best[at] = (total, [*best[begin, used][1], (bits, t)])
    return [s for s in best[blocks, distance + 1][1] if s[1] >= 0]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _local_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(fp, root) pairs that connect each cluster of distinct fps within distance."""
    left, out = fps, []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                open_ = ~near
                if not open_.any():
                    break
                near[open_] = np.bitwise_count(left[open_] ^ f) <= distance
            front, left = left[near], left[~near]
            out += [(int(x), int(root)) for x in front]
    return out


def _bucket_links(distance: int):
    def run(batches):
        held_key, held = None, []

        def close():
            fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            return _local_links(fps.view(np.uint64), distance) if len(fps) > 1 else []

        def batch_of(links):
            a = np.array([x for x, _ in links], np.uint64).view(np.int64)
            b = np.array([y for _, y in links], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            seg, sig, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            edges = np.flatnonzero((seg[1:] != seg[:-1]) | (sig[1:] != sig[:-1])) + 1
            starts = [0, *edges.tolist()]
            ends = [*edges.tolist(), len(seg)]
            links = []
            for i, j in zip(starts, ends, strict=True):
                key = (seg[i], sig[i])
                if key != held_key:
                    links += close()
                    held_key, held = key, []
                held.append(fp[i:j])
            yield batch_of(links)
        yield batch_of(close())

    return run


def links(fps: DataFrame, distance: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): pairs within distance that connect all fingerprints which pairs within distance connect.

    fps has one row for each distinct fingerprint. A bucket that holds more
    than bucket_limit is not gathered: its members meet at midpoints instead.
    Two fingerprints are within distance exactly if one value lies within half
    of it, rounded up, from one and half, rounded down, from the other; joining
    each member's surroundings to the smallest member there keeps components
    whole with rows in proportion to the members.
    """
    spark = fps.sparkSession
    reachable(spark)
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    order = bit_order(_summed(fps, _pairs, BITS * BITS), n)
    blocks = [order[i : i + BLOCK] for i in range(0, BITS, BLOCK)]
    size = 1 << BLOCK

    def values(x: np.ndarray) -> np.ndarray:
        u = x.view(np.uint64)
        out = []
        for bits in blocks:
            v = sum(((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(bits))
            out.append(np.bincount(v.astype(np.int64), minlength=size))
        return np.concatenate(out)

    segments = plan(order, _summed(fps, values, len(blocks) * size), n, distance)
    probes = [(i, _signed(_mask(bits)), _signed(_mask(c))) for i, (bits, t) in enumerate(segments) for k in range(t + 1) for c in itertools.combinations(bits, k)]
    # One reading of the fingerprints for all segments.
    seg, mask, flip = (F.lit(list(x)).cast("array<bigint>") for x in zip(*probes, strict=True))
    each = fps.select("fp", F.inline(F.arrays_zip(seg, mask, flip)).alias("seg", "mask", "flip"))
    probed = each.select("seg", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("sig"), "fp")
    # Half the value bits are hashed alike in every segment, so hash both columns.
    sizes = probed.groupBy("seg", "sig").agg(F.count("*").alias("members")).where(F.col("members") > bucket_limit)
    large = cut(sizes.select("seg", "sig"))
    n_large = large.count()
    small = probed if not n_large else probed.join(F.broadcast(large) if n_large <= 50_000 else large, ["seg", "sig"], "left_anti")
    found = small.repartition(partitions(spark), "seg", "sig").sortWithinPartitions("seg", "sig").mapInArrow(_bucket_links(distance), "a bigint, b bigint")
    if not n_large:
        return found
    hot = cut(probed.join(F.broadcast(large) if n_large <= 50_000 else large, ["seg", "sig"], "left_semi").select("fp").distinct())
    return found.union(midpoint_links(hot, distance))


def midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Connecting pairs by shared midpoints: exact components at any density, no pairs of a group."""
    around = lambda r: fps.select("fp", F.explode(F.lit([_signed(_mask(c)) for k in range(r + 1) for c in itertools.combinations(range(BITS), k)])).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"))
    near, far = around(distance // 2), around((distance + 1) // 2)
    least = near.groupBy("z").agg(F.min("fp").alias("m"), F.count("*").alias("c"))
    # All that lie within the larger half of a value are within distance of the least one within the smaller half.
    least = (least if distance % 2 else least.where("c > 1")).drop("c")
    return far.join(least, "z").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    component_id is the smallest id reachable over links of `distance` bits or
    fewer. Null and wordless texts have fingerprint zero and link like others;
    repeated rows each get a row; a null id never becomes a component's id
    unless all are null; an empty table gives an empty result; other columns
    of docs are ignored.
    """
    base = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = cut(base.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(links(fps.select("fp"), distance, bucket_limit))
    # A component's least id: over its members, added up before they meet, and its root's own.
    least = roots.join(fps, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("least"))
    heads = cut(fps.join(least, F.col("fp") == F.col("root")).select("root", F.least("least", "first").alias("component_id")))
    sent = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    named = roots.join(sent, "root").select(F.col("node").alias("fp"), "component_id").union(heads.select(F.col("root").alias("fp"), "component_id"))
    # Cut before the last join, so that a fingerprint of very many rows can be split there.
    of = cut(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return base.join(of, "fp").select(F.col(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id"))
