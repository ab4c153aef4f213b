"""Named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Decimals that floating results are compared to; sums in another order differ beyond.
DECIMALS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with DuckDB SQL for the same rows."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    """Doubles and floats to DECIMALS, without negative zeros."""

    def one(c: str, kind: str) -> Column:
        col = F.col(f"`{c}`")
        return (F.round(col.cast("double"), DECIMALS) + F.lit(0.0)).alias(c) if kind in ("double", "float") else col

    return df.select(*[one(c, k) for c, k in df.dtypes])


def r(expr: str, name: str) -> str:
    """A rounded column in SQL."""
    return f"round(CAST({expr} AS DOUBLE), {DECIMALS}) + 0.0 AS {name}"
