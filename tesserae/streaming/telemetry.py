"""Telemetry with Structured Streaming; every function also takes a batch frame where that makes sense.

Events are (ts, run_id, rank, world, phase, host_id, name, fields). Watermarks bound what is
kept of late data; state is one row for each rank, run or node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

EVENT_SCHEMA = "ts timestamp, run_id string, rank int, world int, phase string, host_id string, name string, fields map<string,string>"
LATE = "10 minutes"
#: Events that go on to a metric store.
METRIC_EVENTS = ("step", "epoch.end", "validation.end")


def read_events(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Typed JSON lines of a folder; broken lines have no name and go."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT_SCHEMA).json(folder).where("name is not null")


def metrics(events: DataFrame, keys: list[str]) -> DataFrame:
    """(ts, run_id, rank, name, keys): metric events with fields as numbers."""
    fields = [F.col("fields")[k].try_cast("double").alias(k) for k in keys]
    return events.where(F.col("name").isin(*METRIC_EVENTS)).select("ts", "run_id", "rank", "name", *fields)


def latest(events: DataFrame) -> DataFrame:
    """(run_id, rank, last, step): each rank's last event and last step. In a stream, in update or complete mode."""
    step = F.when(F.col("name") == "step", F.col("fields")["step"].try_cast("long"))
    return events.groupBy("run_id", "rank").agg(F.max("ts").alias("last"), F.max_by(step, F.when(step.isNotNull(), F.col("ts"))).alias("step"))


def liveness(last: DataFrame, ranks: DataFrame, now: Column, stale_s: float = 120.0) -> DataFrame:
    """(run_id, rank, silent_s, stale, step) of every expected rank; one that was never seen is stale."""
    t = ranks.join(last, ["run_id", "rank"], "left")
    silent = now.cast("double") - F.col("last").cast("double")
    return t.select("run_id", "rank", silent.alias("silent_s"), (F.col("last").isNull() | (silent > stale_s)).alias("stale"), "step")


def online(beats: DataFrame, now: Column, within_s: float = 30.0) -> DataFrame:
    """(node, last, status, online): each pod's rank by its last beat."""
    node = F.concat_ws("_", "pod", F.col("rank").cast("string"))
    t = beats.groupBy(node.alias("node")).agg(F.max("ts").alias("last"), F.max_by("status", "ts").alias("status"))
    return t.withColumn("online", now.cast("double") - F.col("last").cast("double") <= within_s)


def stale_transitions(events: DataFrame, stale_s: float = 120.0) -> DataFrame:
    """(run_id, rank, last, at): once for each time that a rank falls silent, by event time.

    State is a rank's last event; its timer fires when the watermark passes last + stale_s.
    A rank that was reported is armed again by its next event.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "rank": [key[1]], "last": [pd.Timestamp(last, unit="ms")], "at": [pd.Timestamp(last + int(stale_s * 1000), unit="ms")]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["ts"].max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + int(stale_s * 1000), state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", LATE).select("run_id", "rank", "ts").groupBy("run_id", "rank")
    return keyed.applyInPandasWithState(watch, "run_id string, rank int, last timestamp, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


class Silence(StatefulProcessor):
    """State of a rank: its last event in milliseconds, and whether its silence was told.

    One timer a rank: for the silence that its last event may begin, and after it was told for forgetting the rank, so
    that ranks of finished runs leave no state (time to live of the state itself follows the machine's clock, not the events').
    """

    def __init__(self, silent_ms: int, forget_ms: int):
        self.silent, self.forget = silent_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, told boolean")

    def _set(self, last: int, told: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update((last, told))
        self.handle.registerTimer(last + (self.forget if told else self.silent) + 1)

    def _rows(self, key: tuple, lasts: list[int]) -> Iterator[pd.DataFrame]:
        if lasts:
            at = [x + self.silent for x in lasts]
            yield pd.DataFrame({"run_id": key[0], "rank": key[1], "last": pd.to_datetime(lasts, unit="ms"), "at": pd.to_datetime(at, unit="ms")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, told = self.state.get() if self.state.exists() else (None, False)
        found = []
        times = sorted(int(t) for b in rows for t in b["ms"])
        for t in times:
            if last is not None and t <= last:
                continue
            if last is not None and not told and t - last > self.silent:
                found.append(last)
            last, told = t, False
        self._set(last, told)
        yield from self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        last, told = self.state.get()
        if told:
            self.state.clear()
            return
        self._set(last, True)
        yield from self._rows(key, [last])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self._set(int(initialState["ms"].max()), False)

    def close(self) -> None:
        pass


def silences(events: DataFrame, silent_s: float = 120.0, forget_s: float = 86_400.0, before: DataFrame | None = None) -> DataFrame:
    """(run_id, rank, last, at): once for each silence of a rank of more than silent_s between two events or after the last one, by event time.

    A silence after the last event is told when the watermark has passed its end. before: (run_id, rank, last) of ranks that
    were seen before the stream began. The state store must be RocksDB; see rocksdb(). Times are in milliseconds.
    """
    keyed = events.withWatermark("ts", LATE).select("run_id", "rank", "ts", F.unix_millis("ts").alias("ms")).groupBy("run_id", "rank")
    first = before.select("run_id", "rank", F.unix_millis("last").alias("ms")).groupBy("run_id", "rank") if before is not None else None
    return keyed.transformWithStateInPandas(Silence(int(silent_s * 1000), int(forget_s * 1000)), "run_id string, rank int, last timestamp, at timestamp", "append", "EventTime", initialState=first)


def silences_so_far(events: DataFrame, until: Column, silent_s: float = 120.0) -> DataFrame:
    """The same of a batch of events, by the next event of each rank; silences after the last one if they end before `until`."""
    ms = F.unix_millis("ts")
    t = events.select("run_id", "rank", ms.alias("ms")).withColumn("next", F.lead("ms").over(Window.partitionBy("run_id", "rank").orderBy("ms")))
    end = F.col("ms") + int(silent_s * 1000)
    t = t.where(F.when(F.col("next").isNull(), end < F.unix_millis(until)).otherwise(F.col("next") > end))
    return t.select("run_id", "rank", F.timestamp_millis("ms").alias("last"), F.timestamp_millis(end).alias("at"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers of custom state need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def throughput(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """(run_id, start, end, steps) by tumbling windows of event time; late events go after LATE."""
    w = events.where("name = 'step'").withWatermark("ts", LATE).groupBy("run_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("steps"))
    return w.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "steps")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(run_id, start, end, events): stretches of a run without a longer silence."""
    s = events.withWatermark("ts", LATE).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def once(events: DataFrame, key: str) -> DataFrame:
    """Each event once, as long as repeats come within LATE."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def registry_upsert(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the last row of each key in Parquet snapshots path/<batch>.

    A snapshot is the one before it merged with the batch; a batch that is repeated writes
    the same snapshot again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch and (before := registry(spark, path, epoch - 1)) is not None:
            rows = before.unionByName(batch)
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return merge


def registry(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """A snapshot, or nothing if that batch wrote none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{epoch}")
    except AnalysisException:
        return None


def _registry_epochs(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Epochs that have a finished delta or snapshot, ascending."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    disk = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not disk.exists(root):
        return []
    names = [f.getPath() for f in disk.listStatus(root)]
    return sorted(int(p.getName().removeprefix("epoch=")) for p in names if p.getName().startswith("epoch=") and disk.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; of equal orders the one of the later epoch."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "epoch")).alias("r")).select(*keys, "r.*")


def registry_log(path: str, keys: list[str], order: str, buckets: int = 16, compact_after: int = 20) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch writes a delta of its own keys; the table is read as the last snapshot and the deltas after it.

        delta/epoch=<n>/bucket=<b>       the last row of each key of batch n, by hash bucket of the key
        snapshot/epoch=<n>/bucket=<b>    all keys as of batch n

    A small batch touches only its keys' buckets. Every compact_after batches a snapshot is written. Both are complete only with
    their _SUCCESS mark, so a batch that breaks off is not read, and a batch that is repeated writes the same rows again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        at = F.lit(epoch).cast("bigint")
        own = _newest(batch.withColumn("epoch", at), keys, order).select(*batch.columns)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        own.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/epoch={epoch}")
        if len([e for e in _registry_epochs(spark, path, "delta") if e > max(_registry_epochs(spark, path, "snapshot"), default=-1)]) >= compact_after:
            whole = registry_as_of(spark, path, keys, order, epoch).withColumn("bucket", bucket)
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/snapshot/epoch={epoch}")

    return merge


def registry_as_of(spark: SparkSession, path: str, keys: list[str], order: str, epoch: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The registry as of a batch, by default the last one; of some buckets only, if given. Nothing if no batch was written by then."""
    upto = lambda kind: [e for e in _registry_epochs(spark, path, kind) if epoch is None or e <= epoch]
    base = max(upto("snapshot"), default=None)
    parts = [f"{path}/snapshot/epoch={base}"] if base is not None else []
    parts += [f"{path}/delta/epoch={e}" for e in upto("delta") if base is None or e > base]
    frames = []
    for p in parts:
        rows = spark.read.parquet(p)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        frames.append(rows.drop("bucket").withColumn("epoch", F.lit(int(p.rpartition("=")[2])).cast("bigint")))
    return _newest(reduce(DataFrame.unionByName, frames), keys, order) if frames else None


def to_harvest(wanted: DataFrame, harvested: DataFrame, key: str = "species_id") -> DataFrame:
    """What is still to be fetched: neither done nor only tried with an error."""
    return wanted.join(harvested.where("error is null").select(key), key, "left_anti")


def drain(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what there is, and returns its rows; for tests and audits of bounded input."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
