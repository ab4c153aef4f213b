"""Exact similarity join of two banks of unit vectors: a two-sided grid of blocks, pruned by triangle bounds round pivots.

Every vector belongs to the cell of its nearest pivot. Angles are a metric, so two cells
whose pivots are further apart than both radii and the limit hold no pair; no task is made for
them. Of the others every pair of blocks is a task of its own, and each side is copied only to the
blocks that it can match. Inside a task vectors are in order of their angle, and stretches of them
whose angles to any pivot lie too far apart are not multiplied.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tesserae.functions.lineage import cut

#: Pivots, numbers in a block, rows in a stretch, and rows of products at a time.
PIVOTS, BLOCK_NUMBERS, STRETCH, OUT_ROWS = 64, 1 << 20, 128, 1 << 20
#: Angles are rounded; a bound must be missed by more than this.
SLIP = 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of equal lengths as rows, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def chained(pivots: np.ndarray) -> np.ndarray:
    """Each pivot's place in a chain from one to the nearest that is left, so that cells beside each other lie near."""
    near, at, place = pivots @ pivots.T, 0, np.full(len(pivots), -1)
    for k in range(len(pivots)):
        place[at] = k
        at = int(np.where(place < 0, near[at], -np.inf).argmax())
    return place


def _stretches(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their nearest pivot and the angle to it, where stretches begin, and their least and largest angles to all pivots."""
    to = angles(x, pivots)
    cell = to.argmin(1)
    order = np.lexsort((to.min(1), chained(pivots)[cell]))
    to, cell = to[order], cell[order]
    # A stretch ends after STRETCH rows, and where the next cell's pivot is further away than a right angle's half.
    leap = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    leap = leap[(pivots[cell[leap]] * pivots[cell[leap - 1]]).sum(1) < math.sqrt(0.5)]
    start = np.union1d(np.arange(0, len(x), STRETCH), leap)
    low, high = np.minimum.reduceat(to, start), np.maximum.reduceat(to, start)
    none = np.flatnonzero(~x[order].any(1))  # a zero vector has no angle
    own = np.searchsorted(start, none, "right") - 1
    low[own], high[own] = 0.0, math.pi
    return order, start, low, high


def pruned_products(x: np.ndarray, y: np.ndarray, pivots: np.ndarray, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows of x, rows of y, their products from `least` on, pairs multiplied), a part at a time."""
    if not len(x) or not len(y):
        return
    if least is None or not len(pivots) or least <= 0:
        step = max(1, OUT_ROWS // len(y))
        for i in range(0, len(x), step):
            p = x[i : i + step] @ y.T
            a, b = np.indices(p.shape).reshape(2, -1) if least is None else np.nonzero(p >= least)
            yield a + i, b, p[a, b], p.size
        return
    limit = math.acos(min(1.0, least)) + SLIP
    (ox, sx, lx, hx), (oy, sy, ly, hy) = _stretches(x, pivots), _stretches(y, pivots)
    ends = np.append(sy[1:], len(y))
    for i, (s, e) in enumerate(zip(sx, np.append(sx[1:], len(x)), strict=True)):
        near = np.flatnonzero((np.maximum(lx[i] - hy, ly - hx[i]) <= limit).all(1))
        if len(near):
            rows, cols = ox[s:e], oy[np.concatenate([np.arange(sy[j], ends[j]) for j in near])]
            p = x[rows] @ y[cols].T
            a, b = np.nonzero(p >= least)
            yield rows[a], cols[b], p[a, b], p.size


def _cells(side: DataFrame, pivots: np.ndarray) -> DataFrame:
    """side (key, v) with each vector's cell and its angle to the pivot."""
    key, kind = side.columns[0], side.dtypes[0][1]
    schema = f"`{key}` {kind}, v array<double>, cell int, angle double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            x = matrix(b.column(1))
            to = angles(x, pivots) if len(x) else np.zeros((0, 1))
            cell = to.argmin(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            angle = np.where(x.any(1), to.min(1), math.pi) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.types[0]), b.column(1).cast(arrow.types[1]), pa.array(cell), pa.array(angle)], schema=arrow)

    return cut(side.mapInArrow(run, schema))


def near_vectors(a: DataFrame, b: DataFrame, least: float | None, out: str = "cosine", numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(a's key, b's key, out): every pair of unit vectors whose dot product is `least` or more; all pairs if least is None.

    a and b have two columns each, a key and an array<double>, all of the same size; rows without a vector have no pairs. Vectors of
    another length than 1, but for zeros, are found by a count, and then nothing is pruned. Keys' names must differ. A block has `numbers` numbers at most, on average, whatever its cell holds.
    """
    spark = a.sparkSession
    names = [a.columns[0], b.columns[0]]
    sides = [cut(df.select(F.col(df.columns[0]), F.col(df.columns[1]).cast("array<double>").alias("v")).where("v is not null")) for df in (a, b)]
    kinds = [df.dtypes[0][1] for df in sides]
    schema = f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}, `{out}` double"
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    about = [df.agg(F.max(F.size("v")).alias("width"), F.max(F.when(norm > 0, F.abs(norm - 1))).alias("off")).first() for df in sides]
    width = about[1]["width"]
    if not width:
        return spark.createDataFrame([], schema)
    unit = all((r["off"] or 0.0) < SLIP / 10 for r in about)
    drawn = sides[0].select("v").union(sides[1].select("v")).where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("v")).limit(PIVOTS).collect()
    pivots = np.array([r.v for r in drawn], float).reshape(-1, width) if drawn else np.eye(1, width)
    sides = [_cells(df, pivots) for df in sides]
    of = [{r["cell"]: (-(-r["n"] * width // numbers), r["far"]) for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()} for df in sides]
    apart = angles(pivots, pivots)
    limit = math.pi if least is None or least <= 0 or not unit else math.acos(min(1.0, least)) + SLIP
    met = [(x, y) for x in of[0] for y in of[1] if apart[x, y] - of[0][x][1] - of[1][y][1] <= limit]  # 64 x 64 at most
    routes = [[[y for i, y in met if i == c] for c in range(len(pivots))], [[x for x, j in met if j == c] for c in range(len(pivots))]]
    parts = [[of[s].get(c, (1, 0))[0] for c in range(len(pivots))] for s in (0, 1)]

    def dealt(s: int) -> DataFrame:
        """One side's rows, each copied to the other side's blocks that it can match."""
        mine, other = ("xc", "xs", "yc", "ys"), ("yc", "ys", "xc", "xs")
        own, own_part, far, far_part = mine if s == 0 else other
        to = F.from_json(F.lit(json.dumps(routes[s])), "array<array<int>>")
        counts = [F.from_json(F.lit(json.dumps(p)), "array<int>") for p in parts]
        t = sides[s].withColumns({own: F.col("cell"), own_part: F.pmod(F.xxhash64(names[s], "v"), F.get(counts[s], "cell")).cast("int")})
        t = t.withColumn(far, F.explode(F.get(to, "cell")))
        return t.withColumn(far_part, F.explode(F.sequence(F.lit(0), F.get(counts[1 - s], far) - 1))).select("xc", "xs", "yc", "ys", names[s], "v")

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [pa.table([pa.array([], t) for t in arrow.types], schema=arrow)]
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        for i, j, p, _ in pruned_products(x, y, pivots if unit else pivots[:0], least):
            made.append(pa.table([left.column(names[0]).take(pa.array(i)).cast(arrow.types[0]), right.column(names[1]).take(pa.array(j)).cast(arrow.types[1]), pa.array(p)], schema=arrow))
        return pa.concat_tables(made)

    block = ["xc", "xs", "yc", "ys"]
    return dealt(0).groupBy(*block).cogroup(dealt(1).groupBy(*block)).applyInArrow(multiply, schema)
