"""Benchmark passages in documents: one Aho-Corasick automaton over the items' word windows.

Of a benchmark that is too large for one automaton, only the windows that occur in the documents go on: windows'
hashes are put into a bitmap of fixed size, the documents' windows that it lets through meet the benchmark's by their hashes,
and the stretches of items that are left make up the automaton.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SLICE_BYTES, cut, held, map_texts, partitions, reachable, slices

WINDOW = 13
#: Benchmark words in one automaton; more items are scanned for in further blocks.
BLOCK_WORDS = 400_000
#: Bits of the bitmap of windows, and of a part of it that one task fills.
BITMAP_BITS, PART_BITS = 27, 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that meet all blocks before the next ones do, where there are several.
BLOCKS_SLICE_BYTES = 32 << 20
#: Maps A-Z to a-z, keeps digits, a-z and all bytes of other characters, and turns the rest into spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of words_of(text) in the text itself."""
    raw = text.encode().translate(_WORDS)
    spans, at = [], 0
    for w in raw.split():
        i = raw.index(w, at)
        at = i + len(w)
        spans.append((i, at))
    if len(raw) == len(text):
        return spans
    points, n = [0] * (len(raw) + 1), 0
    source = text.encode()
    for i, c in enumerate(source):
        points[i] = n - 1 if c & 0xC0 == 0x80 else n
        n += c & 0xC0 != 0x80
    points[len(raw)] = n
    return [(points[i], points[j]) for i, j in spans]


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Matcher:
    """Finds all windows of a block of items in a text's words, reading the words once."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            for w in windows(words, size):
                key = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in w)
                owners.setdefault(key, set()).update([] if item is None else [item])
        self.size = size
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.machine.add_word(key, (len(key), tuple(sorted(names))))
        self.machine.make_automaton()
        self.some = bool(owners)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (start, end) inside occurrences, and the items that occur."""
        if not self.some or not words:
            return [], set()
        get = self.ids.get
        ids = tuple([get(w, 0) for w in words])
        spans, items = [], set()
        for end, (n, names) in self.machine.iter(ids):
            spans.append((end - n + 1, end + 1))
            items.update(names)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each window of `size` words, in order."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, 5) for w in words), np.uint64, len(words))
    n, out, power = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            power = power * _STEP
            out += each[k : k + n] * power
        out ^= out >> np.uint64(29)
    return out


def _bitmap(windows_: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** BITMAP_BITS bits, one set for each hash; filled in parts, so what the driver gets has a fixed size."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)

    def fill(key, table):
        bits = np.zeros(1 << PART_BITS, bool)
        bits[table.column("at").to_numpy() & ((1 << PART_BITS) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    parts = windows_.select(place.alias("at")).distinct().groupBy(F.shiftright("at", PART_BITS).alias("part")).applyInArrow(fill, "part bigint, bits binary")
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[r.part << (PART_BITS - 3) : (r.part + 1) << (PART_BITS - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def occurring(docs: DataFrame, bench: DataFrame, text_col: str, size: int = WINDOW) -> DataFrame:
    """(item, text) of the stretches of bench (item, text) whose windows occur in docs, and perhaps a few more.

    Stretches have normalised words. Items' and documents' windows meet by 64-bit hashes; nothing but the bitmap passes the driver.
    """
    spark = docs.sparkSession
    reachable(spark)

    def of_items(batches):
        for b in slices(batches, 1):
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    n = min(size, len(words))
                    found = hashes(words, n)
                    k = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array([row] * k, pa.int64()), pa.array(np.arange(k)), pa.array([n] * k, pa.int32())], names=["hash", "row", "at", "n"])

    items = cut(bench.select(F.monotonically_increasing_id().alias("row"), "item", "text").where("text is not null"))
    own = cut(items.select("row", "text").mapInArrow(of_items, "hash bigint, row bigint, at bigint, n int"))
    sizes = sorted(r.n for r in own.select("n").distinct().collect())
    sent = spark.sparkContext.broadcast(_bitmap(own))

    def of_texts(batches):
        for b in slices(batches, 0):
            passed = [np.zeros(0, np.uint64)]
            for text in b.column(0).to_pylist():
                words = words_of(text)
                for n in sizes:
                    x = hashes(words, n)
                    at = x >> np.uint64(64 - BITMAP_BITS)
                    passed.append(x[(sent.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(passed)).view(np.int64))], names=["hash"])

    seen = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(of_texts, "hash bigint").distinct()
    kept = own.join(seen, "hash", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"), F.first("n").alias("n"))

    def stretches(batches):
        for b in batches:
            out = []
            for item, text, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = words_of(text)
                for i, j in merged([(k, k + n) for k in at]):
                    out.append((item, b" ".join(words[i:j]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.column(0).type), pa.array([o[1] for o in out], pa.string())], names=["item", "text"])

    return items.join(kept, "row").select("item", "text", "at", "n").repartition(partitions(spark)).mapInArrow(stretches, "item string, text string")


def benchmark_blocks(bench: DataFrame, id_col: str, text_col: str, size: int, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items' words in blocks of about block_words, one at a time.

    A longer item goes into several blocks, in stretches that share size - 1 words, so that
    every window stands whole in one of them.
    """
    held, count = [], 0
    rows = bench.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).where(F.col(f"`{text_col}`").isNotNull()).toLocalIterator()
    for item, text in rows:
        words = words_of(text)
        step = max(1, block_words - size + 1)
        for i in range(0, max(1, len(words) - size + 1), step):
            part = words[i : i + step + size - 1]
            if held and count + len(part) > block_words:
                yield held
                held, count = [], 0
            held.append((item, part))
            count += len(part)
    yield held


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, chars, contaminated) for every row of docs.

    A window is `size` consecutive words of an item, or a shorter item whole; hit
    words lie inside occurrences of any window. items are the occurring items' ids
    as sorted strings, chars the hit stretches in the text itself. A document is
    contaminated if it has a hit and hits are a twentieth of its words or more. Null
    texts and items have no words; repeated rows each get a row; an empty benchmark
    hits nothing; an item with a null id hits like any other, but is not listed; other
    columns are ignored. The benchmark is counted first. Up to block_words it is sent and texts are read once; of a larger one
    only what occurs in the texts is sent (see occurring), in blocks of block_words, so what passes the driver is bounded by hits.
    """
    sc = docs.sparkSession.sparkContext
    key = uuid.uuid4().hex
    bench = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("bigint")
    if (bench.agg(F.sum(words)).first()[0] or 0) > block_words:
        bench = cut(occurring(docs, bench, text_col, size))
    sent = [sc.broadcast(block) for block in benchmark_blocks(bench, "item", "text", size, block_words)]

    def make():
        def apply(texts):
            words = [words_of(t) for t in texts]
            spans, items = [[] for _ in texts], [set() for _ in texts]
            for k, block in enumerate(sent):
                m = held(f"matcher {key} {k}", lambda block=block: Matcher(block.value, size))
                for i, w in enumerate(words):
                    found, names = m.find(w)
                    spans[i] += found
                    items[i] |= names
            out = []
            for t, w, found, names in zip(texts, words, spans, items, strict=True):
                found = merged(found)
                at = word_spans(t) if found else []
                chars = [{"start": at[i][0], "end": at[j - 1][1]} for i, j in found]
                out.append((len(w), sum(j - i for i, j in found), sorted(names), chars))
            return out

        return apply

    schema = "n_words bigint, n_hit bigint, items array<string>, chars array<struct<start:int,end:int>>"
    found = map_texts(docs, make, schema, id_col, text_col, most=SLICE_BYTES if len(sent) == 1 else BLOCKS_SLICE_BYTES)
    out = found.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "chars")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def brute_force(text: str | None, items: list[tuple[str, str | None]], size: int = WINDOW) -> tuple:
    """(n_words, n_hit, n_items, items_sha256) by comparing every window at every place, for tests."""
    words = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        for w in windows(words_of(t), size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
