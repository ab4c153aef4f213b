"""Telemetry queries over events, as streams that run over what there is, and as batches.

An event's type stands for the run, the user mod 8 for the rank, and every third event is a step.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.lineage import checkpoints, scratch
from tesserae.plans.registry import query, r
from tesserae.plans.views import table
from tesserae.streaming import harvest as H
from tesserae.streaming import telemetry as T

EV = "ev AS (SELECT event_id, ts, event_type AS run_id, CAST(user_id % 8 AS INT) AS rank, CASE WHEN event_id % 3 = 0 THEN 'step' ELSE 'heartbeat' END AS name, event_id AS step, value FROM events)"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _events(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    name = F.when(i % 3 == 0, "step").otherwise("heartbeat")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("run_id"), (F.col("user_id") % 8).cast("int").alias("rank"), name.alias("name"), F.create_map(F.lit("step"), i.cast("string"), F.lit("loss"), F.col("value").cast("string")).alias("fields"))


def batch(spark: SparkSession, sf: str) -> DataFrame:
    return _events(table(spark, sf, "events"))


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a stream: its folder's files of that name."""
    schema = table(spark, sf, "events").schema
    return _events(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/[e]vents.parquet"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream over bounded input, as Parquet in the shared folder."""
    spark = df.sparkSession
    out = scratch(spark, "stream")
    sink = df.writeStream.option("checkpointLocation", f"{out}/state")
    if mode == "append":
        q = sink.format("parquet").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start()
    else:
        q = sink.outputMode(mode).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{out}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("t01_typed_events", f"WITH {EV} SELECT run_id, name, count(*) AS n FROM ev GROUP BY 1, 2")
def t01(spark, sf):
    """Events as JSON lines, read back with their types."""
    out = scratch(spark, "events")
    batch(spark, sf).select("ts", "run_id", "rank", "name", "fields").write.json(out)
    return T.read_events(spark, out, stream=False).groupBy("run_id", "name").agg(F.count("*").alias("n"))


LAST = f"WITH {EV}, la AS (SELECT run_id, rank, max(ts) AS last, arg_max(step, ts) FILTER (name = 'step') AS step FROM ev GROUP BY 1, 2)"


@query("t02_latest_stream", f"{LAST} SELECT run_id, rank, last, step FROM la")
def t02(spark, sf):
    return drained(T.latest(stream(spark, sf)), "complete")


@query("t02_liveness", f"{LAST}, rk AS (SELECT DISTINCT event_type AS run_id, CAST(i AS INT) AS rank FROM events, range(9) g(i)) SELECT run_id, rank, {r(f'epoch({NOW}) - epoch(last)', 'silent_s')}, last IS NULL OR epoch({NOW}) - epoch(last) > 3000 AS stale, step FROM rk LEFT JOIN la USING (run_id, rank)")
def t02b(spark, sf):
    b = batch(spark, sf)
    ranks = b.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("rank"))
    return T.liveness(T.latest(b), ranks, F.lit("2024-01-31 00:00:00").cast("timestamp"), 3000)


@query("t03_stale_transitions", f"WITH {EV}, wm AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS wm FROM ev), la AS (SELECT run_id, rank, max(epoch_us(ts) // 1000) AS last FROM ev GROUP BY 1, 2) SELECT run_id, rank, make_timestamp_ms(last) AS last, make_timestamp_ms(last + 7200000) AS at FROM la, wm WHERE last + 7200000 < wm")
def t03(spark, sf):
    """Timers of a custom state."""
    checkpoints(spark)
    return drained(T.stale_transitions(stream(spark, sf), 7200), "append")


GAPS = f"WITH {EV}, wm AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS wm FROM ev), g AS (SELECT run_id, rank, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY run_id, rank ORDER BY ts) AS nx FROM ev) SELECT run_id, rank, make_timestamp_ms(ms) AS last, make_timestamp_ms(ms + 7200000) AS at FROM g, wm WHERE CASE WHEN nx IS NULL THEN ms + 7200000 < wm ELSE nx - ms > 7200000 END"


@query("t03_silences", GAPS)
def t03b(spark, sf):
    """Every silence of a rank, by event-time timers over a stream."""
    with T.rocksdb(spark):
        return drained(T.silences(stream(spark, sf), 7200), "append")


@query("t03_silences_batch", GAPS)
def t03c(spark, sf):
    """The same of a batch, by each event's next one."""
    b = batch(spark, sf)
    until = b.agg(F.max("ts") - F.expr(f"INTERVAL '{T.LATE}'")).first()[0]
    return T.silences_so_far(b, F.lit(until), 7200)


@query("t04_online", f"WITH {EV} SELECT run_id || '_' || rank AS node, max(ts) AS last, arg_max(name, ts) AS status, epoch({NOW}) - epoch(max(ts)) <= 3000 AS online FROM ev GROUP BY 1")
def t04(spark, sf):
    b = batch(spark, sf).select(F.col("run_id").alias("pod"), "rank", "ts", F.col("name").alias("status"))
    return T.online(b, F.lit("2024-01-31 00:00:00").cast("timestamp"), 3000)


@query("t05_registry", "SELECT event_type AS run_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def t05(spark, sf):
    """Two micro-batches are merged into snapshots by key."""
    out = scratch(spark, "registry")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    merge = T.registry_upsert(out, ["run_id"], "ts")
    merge(rows.where("event_id % 2 = 0"), 0)
    merge(rows.where("event_id % 2 = 1"), 1)
    return T.registry(spark, out, 1)


@query("t05_registry_log", "SELECT CAST(a AS INT) AS as_of, user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events, (VALUES (1), (3), (4)) g(a) WHERE event_id % 5 <= a GROUP BY 1, 2")
def t05b(spark, sf):
    """Five batches as deltas, a snapshot after every second one, and the registry as of three of them."""
    out = scratch(spark, "registry")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("status"))
    merge = T.registry_log(out, ["user_id"], "event_id", compact_after=2)
    for k in range(5):
        merge(rows.where(F.col("event_id") % 5 == k), k)
    found = [T.registry_as_of(spark, out, ["user_id"], "event_id", k).select(F.lit(k).alias("as_of"), "user_id", "event_id", "status") for k in (1, 3)]
    return reduce(DataFrame.unionByName, [*found, T.registry_as_of(spark, out, ["user_id"], "event_id").select(F.lit(4).alias("as_of"), "user_id", "event_id", "status")])


@query("t06_metrics", f"WITH {EV} SELECT run_id, rank, count(*) AS n, {r('sum(value)', 'loss')} FROM ev WHERE name = 'step' GROUP BY 1, 2")
def t06(spark, sf):
    return T.metrics(batch(spark, sf), ["loss"]).groupBy("run_id", "rank").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))


@query("t07_to_harvest", "SELECT DISTINCT l_suppkey AS species_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal > 0)")
def t07(spark, sf):
    done = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("species_id"), F.when(F.col("s_acctbal") <= 0, "timeout").alias("error"))
    return T.to_harvest(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("species_id")).distinct(), done)


def _harvest(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Suppliers are wanted; a request for one fails as often as its key's remainder by 4, and may be tried three times."""
    out = scratch(spark, "harvest")
    wanted = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("species_id"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("species_id")).agg(F.count("*").alias("total"))

    def fetch(asked: DataFrame) -> DataFrame:
        fails = F.col("tries") < F.col("species_id") % 4
        t = asked.join(rows, "species_id", "left").withColumn("total", F.when(~fails, F.coalesce("total", F.lit(0))))
        return t.withColumn("error", F.when(fails, "unavailable"))

    return out, H.harvest(wanted, out, "species_id", fetch, max(4, -(-wanted.count() // 3)), 2)


@query("t07_harvest", "SELECT s_suppkey AS species_id, CASE WHEN s_suppkey % 4 < 3 THEN coalesce(n, 0) END AS total, CASE WHEN s_suppkey % 4 = 3 THEN 'unavailable' END AS error, CAST(least(s_suppkey % 4 + 1, 3) AS BIGINT) AS attempts FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def t07b(spark, sf):
    return _harvest(spark, sf)[1]


@query("t07_harvest_steps", "WITH t AS (SELECT CAST(a AS INT) AS attempt, s_suppkey AS k, row_number() OVER (PARTITION BY a ORDER BY s_suppkey) - 1 AS o, (SELECT greatest(4, CAST(ceil(count(*) / 3.0) AS BIGINT)) FROM supplier) AS most FROM supplier, range(3) g(a) WHERE s_suppkey % 4 >= a) SELECT attempt, CAST(o // most AS INT) AS step, count(*) AS n, min(k) AS low, max(k) AS high, CAST(count_if(k % 4 > attempt) AS BIGINT) AS errors FROM t GROUP BY 1, 2")
def t07c(spark, sf):
    """What each step of each attempt had under way: never more than the bound."""
    rows = H.results(spark, _harvest(spark, sf)[0])
    return rows.groupBy("attempt", "step").agg(F.count("*").alias("n"), F.min("species_id").alias("low"), F.max("species_id").alias("high"), F.count("error").alias("errors"))


WINDOW = "time_bucket(INTERVAL '5 minutes', ts)"


@query("t08_throughput", f"WITH {EV} SELECT run_id, {WINDOW} AS \"start\", {WINDOW} + INTERVAL '5 minutes' AS \"end\", count(*) AS steps FROM ev WHERE name = 'step' GROUP BY 1, 2, 3")
def t08(spark, sf):
    return T.throughput(batch(spark, sf))


@query("t08_throughput_stream", f"WITH {EV}, m AS (SELECT max(ts) - INTERVAL '10 minutes' AS wm FROM ev WHERE name = 'step') SELECT run_id, {WINDOW} AS \"start\", {WINDOW} + INTERVAL '5 minutes' AS \"end\", count(*) AS steps FROM ev, m WHERE name = 'step' AND {WINDOW} + INTERVAL '5 minutes' <= wm GROUP BY 1, 2, 3")
def t08b(spark, sf):
    """In append mode: windows that the watermark has passed."""
    return drained(T.throughput(stream(spark, sf)), "append")


@query("t09_sessions", f"WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS nw FROM ev), s AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT run_id, min(ts) AS \"start\", max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS events FROM s GROUP BY run_id, s")
def t09(spark, sf):
    return T.sessions(batch(spark, sf))


@query("t10_once", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def t10(spark, sf):
    """Every event sent twice arrives once."""
    s = stream(spark, sf)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return drained(T.once(twice, "event_id").select("event_id"), "append").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
