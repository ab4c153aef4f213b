"""Iteration over a sparse graph of classes: images are dealt once, and all steps of a batch of images run in one Arrow pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tesserae.functions.lineage import cut

#: Edges that are sent to every task as sparse columns, and numbers that a batch's step may hold.
SENT_EDGES, STEP_NUMBERS = 4 << 20, 4 << 20

Push = Callable[[np.ndarray], np.ndarray]
#: (values, present, push) of a batch of images to new values; all are images x classes.
Solve = Callable[[np.ndarray, np.ndarray, Push], np.ndarray]


class Columns:
    """A graph as compressed sparse columns: push(x) adds each class's value, times the weight, to the classes that it leads to."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.ids = np.unique(np.concatenate([a, b]))
        source, target = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        order = np.lexsort((source, target))
        self.source, self.weight = source[order], w[order].astype(float)
        self.target, self.start = np.unique(target[order], return_index=True)

    def push(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        if len(self.start):
            step = max(1, STEP_NUMBERS // len(self.source))
            for i in range(0, len(x), step):
                out[i : i + step, self.target] = np.add.reduceat(x[i : i + step][:, self.source] * self.weight, self.start, axis=1)
        return out


def on_graph(scores: DataFrame, value: str, edges: DataFrame, solve: Solve, out: str) -> DataFrame | None:
    """(image_id, species_id, out) from solve, or nothing if the graph is too large to be sent.

    edges: (a, b, w). Each image's rows are gathered once, however many steps solve takes; an image has a row for each class at most.
    Classes without edges have columns too; a null value counts as zero and stays null.
    """
    graph = cut(edges.select("a", "b", F.col("w").cast("double")).where("a is not null and b is not null and w is not null"))
    if graph.count() > SENT_EDGES:
        return None
    t = graph.toArrow()
    own = Columns(*[t.column(c).to_numpy() for c in ("a", "b", "w")])
    sent = scores.sparkSession.sparkContext.broadcast(own)
    kinds = dict(scores.dtypes)
    schema = f"image_id {kinds['image_id']}, species_id {kinds['species_id']}, `{out}` double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        graph = sent.value
        for b in batches:
            images, lists = b.column(0), b.column(1)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            species, values = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False).astype(float)
            ids = species.to_numpy(zero_copy_only=False)
            known = np.searchsorted(graph.ids, ids)
            is_known = graph.ids[np.minimum(known, len(graph.ids) - 1)] == ids if len(graph.ids) else np.zeros(len(ids), bool)
            other, place = np.unique(ids[~is_known], return_inverse=True)
            column = known.copy()
            column[~is_known] = len(graph.ids) + place
            width = max(1, len(graph.ids) + len(other))
            step = max(1, STEP_NUMBERS // width)
            for i in range(0, len(images), step):
                low, high = offsets[i], offsets[min(i + step, len(images))]
                row = np.repeat(np.arange(min(step, len(images) - i)), np.diff(offsets[i : i + step + 1]))
                x, present = np.zeros((min(step, len(images) - i), width)), np.zeros((min(step, len(images) - i), width), bool)
                null = np.isnan(values[low:high])
                x[row, column[low:high]] = np.where(null, 0.0, values[low:high])
                present[row, column[low:high]] = True
                found = solve(x, present, graph.push)[row, column[low:high]]
                yield pa.RecordBatch.from_arrays([images.slice(i, step).take(pa.array(row)).cast(arrow.types[0]), species.slice(low, high - low).cast(arrow.types[1]), pa.array(found, mask=null)], schema=arrow)

    dealt = scores.groupBy("image_id").agg(F.collect_list(F.struct("species_id", F.col(value).cast("double").alias("x"))).alias("rows"))
    return dealt.mapInArrow(run, schema)
