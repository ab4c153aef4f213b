"""A harvest in bounded steps: what is wanted and not yet there is admitted little by little, fetched and kept.

State lives in one folder, so a harvest that breaks off goes on where it stopped:

    todo/<attempt>             numbered rows of one attempt, fixed before it begins
    results/attempt=/step=     what each step has fetched
    state/<attempt>            the stream's checkpoint

An attempt is a stream over a source that admits at most `most` rows a step. A step that is run
again after a failure writes the same folder again. Rows that came back with an error are
wanted again by the next attempt, up to `retries` times more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tesserae.functions.ordinals import numbered

Fetch = Callable[[DataFrame], DataFrame]


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class AdmittedReader(DataSourceStreamReader):
    """Ordinals 0 to total - 1; every step has at most `most` more than the one before."""

    def __init__(self, total: int, most: int, at: int, tasks: int):
        self.total, self.most, self.at, self.tasks = total, most, at, tasks

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": min(self.at + self.most, self.total)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = start["at"], end["at"]
        self.at = max(self.at, b)
        width = max(1, -(-(b - a) // self.tasks))
        return [Range(i, min(i + width, b)) for i in range(a, b, width)]

    def read(self, partition: Range) -> Iterator[tuple[int]]:
        return ((i,) for i in range(partition.start, partition.end))


class Admitted(DataSource):
    """The `admitted` stream; options: total, most (rows a step), at (rows of earlier runs), tasks."""

    @classmethod
    def name(cls) -> str:
        return "admitted"

    def schema(self) -> str:
        return "ordinal bigint"

    def streamReader(self, schema) -> AdmittedReader:
        return AdmittedReader(*(int(self.options.get(k, d)) for k, d in (("total", 0), ("most", 100), ("at", 0), ("tasks", 4))))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or nothing if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def results(spark: SparkSession, folder: str) -> DataFrame | None:
    """(attempt, step, key, ..., error) of all attempts so far."""
    return _table(spark, f"{folder}/results")


def harvested(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Each key's last result, with its number of attempts."""
    rows = results(spark, folder)
    rest = [c for c in rows.columns if c not in (key, "attempt", "step")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "attempt").alias("r"), F.count("*").alias("attempts")).select(key, "r.*", "attempts")


def _attempt(todo: DataFrame, folder: str, attempt: int, fetch: Fetch, most: int, tasks: int) -> None:
    """Fetches what of an attempt's rows has no result yet."""
    spark, total = todo.sparkSession, todo.count()
    done = _table(spark, f"{folder}/results/attempt={attempt}")
    at = done.count() if done is not None else 0
    if at >= total:
        return

    def step(batch: DataFrame, number: int) -> None:
        """Only the step's range of the numbered table is read: the filter reaches the scan, and the table lies in order."""
        low, high = batch.agg(F.min("ordinal"), F.max("ordinal")).first()
        if low is not None:
            rows = todo.where(F.col("ordinal").between(low, high)).drop("ordinal")
            fetch(rows).drop("tries").write.mode("overwrite").parquet(f"{folder}/results/attempt={attempt}/step={number}")

    source = spark.readStream.format("admitted").option("total", total).option("most", most).option("at", at).option("tasks", tasks).load()
    query = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state/{attempt}").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def harvest(wanted: DataFrame, folder: str, key: str, fetch: Fetch, most: int = 1_000, retries: int = 2, known: DataFrame | None = None, tasks: int = 4) -> DataFrame:
    """Each fetched key's last result, with its attempts.

    fetch takes rows (key, ..., tries), of which tries is how often a key has failed, and returns one row for each with at
    least key and error (null if it went well). At most `most` rows are under way at any time. known: keys that need no fetching.
    A key that still fails after `retries` more attempts stays with its error; a later call with more
    retries, or with more wanted keys, goes on from there. Null keys and repeated ones are left out.
    """
    spark = wanted.sparkSession
    spark.dataSource.register(Admitted)
    wanted = wanted.where(F.col(key).isNotNull()).dropDuplicates([key])
    if known is not None:
        wanted = wanted.join(known.select(key), key, "left_anti")
    attempt = 0
    while True:
        path = f"{folder}/todo/{attempt}"
        if (todo := _table(spark, path)) is None:
            so_far = results(spark, folder)
            tries = spark.createDataFrame([], wanted.select(key).schema).withColumns({"tries": F.lit(0).cast("bigint"), "ok": F.lit(False)}) if so_far is None else so_far.groupBy(key).agg(F.count("*").alias("tries"), F.bool_or(F.col("error").isNull()).alias("ok"))
            left = wanted.join(tries, key, "left").withColumn("tries", F.coalesce("tries", F.lit(0))).where(f"tries <= {retries} and ok is not true").drop("ok")
            left = numbered(left, key)
            if not left.limit(1).count():
                break
            left.write.mode("overwrite").parquet(path)
            todo = spark.read.parquet(path)
        _attempt(todo, folder, attempt, fetch, most, tasks)
        attempt += 1
    if results(spark, folder) is None:
        return wanted.limit(0).select(key).withColumns({"error": F.lit(None).cast("string"), "attempts": F.lit(0).cast("bigint")})
    return harvested(spark, folder, key)
