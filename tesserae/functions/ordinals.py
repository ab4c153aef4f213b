"""Ordinals of one total order over all rows, by ranges and partition counts, without a window over everything."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.lineage import cut

#: monotonically_increasing_id() has the partition above these bits and the place in it below.
_BITS = 33


def numbered(df: DataFrame, *order: Column | str, out: str = "ordinal") -> DataFrame:
    """df with each row's place in the order, from zero and without gaps.

    Splitters from a sample deal the rows by ranges; each task sorts its range; a place is the one inside the range plus
    the counts of the ranges before it. Only these counts, one for each task, pass the driver. Rows that are equal
    in the whole order are numbered in any order, and as they stand in one range, the order should tell most rows apart.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _BITS)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, n = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(n)
        n += counts.get(p, 0)
    starts = F.from_json(F.lit(json.dumps(before)), "array<bigint>")
    return placed.withColumn(out, F.get(starts, part.cast("int")) + (F.col("__at") - F.shiftleft(part, _BITS))).drop("__at")
