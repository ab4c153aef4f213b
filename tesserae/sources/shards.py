"""Shards of an exact number of rows: ordinals over tasks decide a row's shard and slot, and a sink commits whole shards.

The sink is a data source of its own. A task writes its shards to a staging folder under names that
no other attempt has; the driver's commit checks that every shard is whole, puts the files of
the successful attempts in their places and writes an index last, so a folder with an index is complete. An
aborted write leaves what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tesserae.functions.ordinals import numbered

INDEX, NAME = "_shards.json", "shard-{:08d}.parquet"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """(shard, rows, staged file) of what one task has written."""

    files: list[tuple[int, int, str]]


class ExactShardWriter(DataSourceArrowWriter):
    """Rows with `shard` and `slot` columns, each shard's rows in one task and in order of slots."""

    def __init__(self, path: str, size: int, overwrite: bool = False):
        self.path, self.size, self.overwrite, self.staging = path, size, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at, out, rows = [], None, None, 0
        disk, root = store(self.path)
        disk.create_dir(f"{root}/{self.staging}", recursive=True)

        def close():
            if out is not None:
                out.close()
                files.append((at, rows, name))

        for batch in iterator:
            shards = batch.column("shard").to_numpy()
            start = 0
            while start < batch.num_rows:
                shard = int(shards[start])
                end = int((shards == shard).nonzero()[0][-1]) + 1
                if shard != at:
                    close()
                    name = f"{shard:08d}-{uuid.uuid4().hex}.parquet"
                    out, at, rows = pq.ParquetWriter(f"{root}/{self.staging}/{name}", batch.schema, filesystem=disk), shard, 0
                part = batch.slice(start, end - start)
                out.write_batch(part)
                rows += len(part)
                start = end
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        shards = [s for s, _, _ in files]
        if shards != list(range(len(files))) or any(n != self.size for _, n, _ in files[:-1]) or files and not 0 < files[-1][1] <= self.size:
            self.abort(messages)
            raise ValueError(f"shards are not whole: {[f[:2] for f in files if f[1] != self.size][:5]}")
        disk, root = store(self.path)
        if self.overwrite:  # the index goes first and comes last: in between, the folder is refused
            old = disk.get_file_info(fs.FileSelector(root, allow_not_found=True))
            for name in [f"{root}/{INDEX}", *[f.path for f in old if f.base_name.startswith("shard-")]]:
                if disk.get_file_info(name).type != fs.FileType.NotFound:
                    disk.delete_file(name)
        for s, _, name in files:
            disk.move(f"{root}/{self.staging}/{name}", f"{root}/{NAME.format(s)}")
        self.abort(messages)  # clears what is left of the staging folder
        disk.create_dir(root, recursive=True)
        with disk.open_output_stream(f"{root}/{INDEX}") as f:
            f.write(json.dumps({"size": self.size, "rows": [n for _, n, _ in files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        disk, root = store(self.path)
        if disk.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            disk.delete_dir(f"{root}/{self.staging}")


class ExactShards(DataSource):
    """The `exact_shards` sink; options: path, and size, the rows of every shard but the last."""

    @classmethod
    def name(cls) -> str:
        return "exact_shards"

    def writer(self, schema, overwrite: bool) -> ExactShardWriter:
        path, size = self.options["path"], int(self.options["size"])
        disk, root = store(path)
        if not overwrite and disk.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} already has shards")
        return ExactShardWriter(path, size, overwrite)


def place_rows(rows: DataFrame, size: int, *order) -> DataFrame:
    """rows with (shard, slot) in the given order: every shard but the last has `size` rows."""
    if size < 1:
        raise ValueError("a shard has one row at least")
    t = numbered(rows, *order, out="__ordinal")
    return t.withColumns({"shard": F.expr(f"__ordinal div {size}"), "slot": (F.col("__ordinal") % size).cast("int")}).drop("__ordinal")


def write_exact_shards(rows: DataFrame, path: str, size: int, *order, overwrite: bool = False) -> None:
    """Writes rows as Parquet files of exactly `size` rows each, the last one of the rest, in the given order.

    Shards are dealt to tasks whole. A path that has shards is an error unless overwrite is set.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ExactShards)
    placed = place_rows(rows, size, *order)
    dealt = placed.repartition("shard").sortWithinPartitions("shard", "slot")
    dealt.write.format("exact_shards").option("path", path).option("size", size).mode("overwrite" if overwrite else "append").save()


def read_exact_shards(spark, path: str) -> DataFrame:
    """The rows of all shards; a folder without an index was not committed and is refused."""
    disk, root = store(path)
    if disk.get_file_info(f"{root}/{INDEX}").type == fs.FileType.NotFound:
        raise ValueError(f"{path} has no committed shards")
    return spark.read.option("pathGlobFilter", "shard-*.parquet").parquet(path)
