"""Timers over several micro-batches, and a registry of deltas and snapshots."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tesserae.plans.streams import drained
from tesserae.streaming import telemetry as T

SCHEMA = "run_id string, rank int, ts timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def streamed(spark, folder, batches, before=None, silent_s=3600.0):
    """What a stream tells that sees one file after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r, k, at(m)) for r, k, m in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        for f in os.listdir(f"{folder}/in/{i}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{folder}/all", exist_ok=True)
                os.rename(f"{folder}/in/{i}/{f}", f"{folder}/all/{i}.parquet")
                os.utime(f"{folder}/all/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/all")
    with T.rocksdb(spark):
        got = drained(T.silences(events, silent_s, before=before), "append").collect()
    return sorted((r.run_id, r["rank"], r["last"]) for r in got)


def test_silences_over_batches(spark, tmp_path):
    """A silence inside a batch, one that a timer tells before its rank comes back, one told once, and one that has not ended."""
    batches = [
        [("a", 0, 0), ("a", 0, 10), ("a", 0, 100), ("b", 0, 95)],  # a is silent from 10 to 100
        [("b", 0, 100), ("c", 1, 400)],  # the watermark passes 390: a and b fall silent
        [("a", 0, 395), ("c", 1, 430)],  # a comes back, and was told already
        [("c", 1, 460), ("a", 0, 452)],
    ]
    got = streamed(spark, str(tmp_path), batches)
    assert got == [("a", 0, at(10)), ("a", 0, at(100)), ("b", 0, at(100))]
    # A batch over all events tells the same.
    rows = spark.createDataFrame([(r, k, at(m)) for b in batches for r, k, m in b], SCHEMA)
    assert sorted((r.run_id, r["rank"], r["last"]) for r in T.silences_so_far(rows, F.lit(at(450)), 3600.0).collect()) == got


def test_ranks_seen_before_the_stream(spark, tmp_path):
    before = spark.createDataFrame([("a", 0, at(-30)), ("z", 3, at(-300))], "run_id string, rank int, last timestamp")
    got = streamed(spark, str(tmp_path), [[("a", 0, 60), ("b", 0, 60)], [("b", 0, 90)]], before)
    assert got == [("a", 0, at(-30)), ("z", 3, at(-300))]


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = lambda x: spark.createDataFrame(x, "run string, at int, status string")
    return path, T.registry_log(path, ["run"], "at", buckets=8, compact_after=3), rows


def test_a_small_batch_touches_only_its_buckets(spark, log):
    path, merge, rows = log
    merge(rows([(f"r{i}", 1, "new") for i in range(200)]), 0)
    assert len([d for d in os.listdir(f"{path}/delta/epoch=0") if d.startswith("bucket=")]) == 8
    merge(rows([("r7", 2, "ready"), ("r7", 1, "late")]), 1)
    assert len([d for d in os.listdir(f"{path}/delta/epoch=1") if d.startswith("bucket=")]) == 1
    assert not os.path.exists(f"{path}/snapshot")
    now = {r.run: r.status for r in T.registry_as_of(spark, path, ["run"], "at").collect()}
    assert len(now) == 200 and now["r7"] == "ready" and now["r8"] == "new"


def test_snapshots_and_time_travel(spark, log):
    path, merge, rows = log
    assert T.registry_as_of(spark, path, ["run"], "at") is None
    for k in range(8):
        merge(rows([("a", k, f"s{k}"), (f"r{k}", k, "x")]), k)
        merge(rows([("a", k, f"s{k}"), (f"r{k}", k, "x")]), k)  # a batch that is run again
    merge(rows([]), 8)
    assert sorted(os.listdir(f"{path}/snapshot")) == ["epoch=2", "epoch=5"]
    for k in range(8):
        got = {r.run: r.status for r in T.registry_as_of(spark, path, ["run"], "at", k).collect()}
        assert got == {"a": f"s{k}"} | {f"r{i}": "x" for i in range(k + 1)}
    # A delta that was not finished is not read.
    os.remove(f"{path}/delta/epoch=7/_SUCCESS")
    assert {r.run: r.status for r in T.registry_as_of(spark, path, ["run"], "at").collect()}["a"] == "s6"
    part = T.registry_as_of(spark, path, ["run"], "at", buckets=[0, 1])
    assert "bucket" in part._jdf.queryExecution().toString() and part.count() < 8
