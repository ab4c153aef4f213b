"""A hook for solvers whose steps depend on each other within a group, such as the tiles of one image."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def solve_groups(df: DataFrame, keys: list[str], solve: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """(keys, columns) from solve, which takes a group's rows without the keys and returns rows of columns.

    Groups are dealt by their keys and each is solved in one call, so a group, not the
    table, must fit a task. Groups are found anew in every call: solve keeps no state.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], columns])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(pdf.drop(columns=keys))
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)
