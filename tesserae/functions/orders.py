"""Places in one order of many rows, without any task that sees them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.lineage import cut

#: Parts of a range that are counted at a time, values that are put in order at once, rows of a prefix, and keys of a list.
PARTS, FEW_VALUES, FEW_ROWS, LIST_KEYS = 4096, 100_000, 20_000, 1024
#: Rows that a task puts in order where their number is known.
TASK_ROWS = 500_000


def shuffle_key(key: Column | str, seed: int = 42) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def hashed(*parts: Column) -> Column:
    """A reproducible whole number from 0 to 2 ** 32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def places(df: DataFrame, groups: list[str], key: str, seed: int = 42, place: str = "__at", size: str = "__of") -> DataFrame:
    """df with each row's place, from 1, in its group's reproducible random order, and the group's size.

    Rows are counted by group and hash prefix; a row's place is the sum of the counts
    before its prefix and its rank inside it. Prefixes are as long as the largest group asks for, up to
    65,536 of them, so a group that holds most rows is ordered by many tasks. Null groups are groups.
    """
    most = df.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = next((d for d in range(1, 4) if most <= FEW_ROWS * 16**d), 4)
    t = df.withColumn("__h", shuffle_key(key, seed)).withColumn("__p", F.substring("__h", 1, digits))
    per = t.groupBy(*groups, "__p").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*groups)
    per = per.withColumn(size, F.sum("__c").over(whole)).withColumn("__before", F.sum("__c").over(whole.orderBy("__p")) - F.col("__c"))
    per = per.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__p").alias("__q"), size, "__before")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.col("__p") == F.col("__q"))
    rank = F.row_number().over(Window.partitionBy(*groups, "__p").orderBy("__h", key))
    out = t.withColumn(place, rank).join(per, same).withColumn(place, (F.col(place) + F.col("__before")).cast("bigint"))
    return out.select(*df.columns, place, size)


def listed(df: DataFrame, group: str, key: str, rows: int, largest: int, seed: int = 42) -> DataFrame:
    """(group, part, keys): each group's keys in the order of places(), in lists of LIST_KEYS; part 0 has the first.

    The number of rows and the largest group's are known. Groups of FEW_ROWS or fewer are each ordered by one task, others by prefixes.
    """
    if largest <= FEW_ROWS:
        # Hashes are taken behind the exchange, so they are not sent.
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        t = df.select(group, key).repartition(tasks, group)
        t = t.withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(shuffle_key(key, seed)), key)))
    else:
        t = places(df.select(group, key), [group], key, seed)
    t = t.groupBy(group, F.floor((F.col("__at") - 1) / LIST_KEYS).alias("part")).agg(F.sort_array(F.collect_list(F.struct("__at", F.col(key).alias("k")))).alias("l"))
    return t.select(group, "part", F.col("l.k").alias("keys"))


def order_statistic(df: DataFrame, value: str, at: int) -> float | None:
    """The value at a place, from 0, in ascending order; null values are left out; None beyond the end.

    Counts by equal parts of the range find the part that holds the place, until it has few
    values or one: each round reads the values once and only counts meet.
    """
    v = cut(df.select(F.col(value).cast("double").alias("v")).where("v is not null"))
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 <= at < n:
        return None
    while n > FEW_VALUES and low < high:
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") - low) / (high - low) * PARTS))
        counts = v.where(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
        for r in counts:
            if at < r["n"]:
                n, low, high = r["n"], r["low"], r["high"]
                break
            at -= r["n"]
    if low == high:
        return low
    return v.where(F.col("v").between(low, high)).orderBy("v").offset(at).limit(1).first()[0]
