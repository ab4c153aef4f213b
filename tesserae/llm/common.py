"""Helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python helpers in slices of about this many bytes.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but on a local master only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not found:
            sc.setCheckpointDir(configured)
        return configured
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on a shared file system import this package, and keeps Arrow batches small.

    Batches are cut by bytes on the JVM's side already, so neither side ever holds more
    than a few of them for a task, however long texts are.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """A worker process's one large helper (vocabulary, automaton); another one takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, in runs whose texts hold about `most` bytes, one row at least."""
    parts: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, upto = 0, size
        for i, n in enumerate(sizes):
            if upto and upto + n > most:
                if i > start:
                    parts.append(batch.slice(start, i - start))
                yield joined()
                parts, start, upto = [], i, 0
            upto += n
        if start < len(sizes):
            parts.append(batch.slice(start))
        size = upto
    if parts:
        yield joined()


def map_texts(docs: DataFrame, make: Callable[[], Callable], schema: str, id_col: str, text_col: str, extra: dict[str, str | Column] | None = None, most: int = SLICE_BYTES, arrays: bool = False) -> DataFrame:
    """Applies a Python helper to every text, in Arrow batches cut to `most` bytes.

    make() is called once in each task and returns a function from a list of
    texts (null is None) to a list of tuples, one for each text; with arrays, from
    an Arrow array of texts. The result has the id column under its own name, the
    extra columns, then schema's columns.
    """
    spark = docs.sparkSession
    reachable(spark)
    extra = extra or {}
    narrow = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"__x_{k}") for k, c in extra.items()])
    kinds = dict(narrow.dtypes)
    out_schema = ", ".join([f"__id {kinds['__id']}", *[f"__x_{k} {kinds[f'__x_{k}']}" for k in extra], schema])

    def run(batches):
        apply = make()
        for part in slices(batches, 1, most):
            rows = apply(part.column(1) if arrays else part.column(1).to_pylist())
            kept = [part.column(0), *part.columns[2:]]
            own = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow.names[len(kept):]]
            made = [x.cast(t) for x, t in zip(kept, arrow.types, strict=False)]
            made += [pa.array(list(v), type=t) for v, t in zip(own, arrow.types[len(kept):], strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out_schema))
    mapped = narrow.mapInArrow(run, out_schema)
    return mapped.select(F.col("__id").alias(id_col), *[F.col(f"__x_{k}").alias(k) for k in extra], *[F.col(f"`{f.split()[0]}`") for f in _names(schema)])


def _names(schema: str) -> list[str]:
    """The top-level column names of a DDL schema."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
