"""Embedding banks: prototypes, cosine scores, retrieval, components, audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from tesserae.functions.groups import solve_groups
from tesserae.functions.lineage import cut
from tesserae.operators.vector_join import matrix, near_vectors

#: Numbers of a bank that are sent to every task.
SENT_NUMBERS = 4 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def class_means(bank: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, mean): element-wise means of unit vectors, with sums by position before the shuffle."""
    e = bank.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(unit(F.transform(vector, lambda x: x.cast("double")))).alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def prototypes(bank: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, prototype): class means at length 1."""
    return class_means(bank, label, vector).select("label", unit(F.col("mean")).alias("prototype"))


def against_all(a: DataFrame, b: DataFrame, rows: int = 2_000) -> DataFrame:
    """Every row of a beside every row of b, in a two-sided grid: each cell of about rows x rows pairs is a task's part of its own."""
    nx, ny = (max(1, -(-df.count() // rows)) for df in (a, b))
    spread = lambda df, own, n, other, m: df.withColumns({own: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(n)), other: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))})
    return spread(a, "__x", nx, "__y", ny).join(spread(b, "__y", ny, "__x", nx), ["__x", "__y"]).drop("__x", "__y")


def products(queries: DataFrame, key: str, vector: str, bank: DataFrame, name: str, column: str, out: str, least: float | None = None, sent: int | None = None) -> DataFrame:
    """(key, name, out): the dot product of every query with every vector of a bank, or those from `least` on.

    The bank is a stated set such as class prototypes. It is counted first: up to
    `sent` numbers, by default SENT_NUMBERS, it is sent as one matrix and batches of queries are multiplied
    with it, beyond that both sides meet in a grid of blocks (near_vectors).
    Null vectors have no products.
    """
    bank = cut(bank.select(name, column).where(F.col(column).isNotNull()))
    n, width = bank.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    if n * width > (SENT_NUMBERS if sent is None else sent):
        return near_vectors(queries.select(key, vector), bank, least, out)
    rows = bank.orderBy(name).collect()
    kinds = dict(queries.dtypes) | {name: dict(bank.dtypes)[name]}
    names, table = [r[name] for r in rows], np.array([r[column] for r in rows], float).reshape(len(rows), -1)
    held = queries.sparkSession.sparkContext.broadcast((names, table))
    schema = f"`{key}` {kinds[key]}, `{name}` {kinds[name]}, `{out}` double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        names, table = held.value
        step = max(1, (1 << 20) // max(1, len(names)))
        for b in batches:
            for i in range(0, b.num_rows if names else 0, step):
                part = b.slice(i, step)
                x = matrix(part.column(1)) @ table.T
                row, col = np.indices(x.shape).reshape(2, -1) if least is None else np.nonzero(x >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)).cast(arrow.types[0]), pa.array(names, arrow.types[1]).take(pa.array(col)), pa.array(x[row, col])], schema=arrow)

    return queries.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)


def cosine_scores(queries: DataFrame, protos: DataFrame, key: str, vector: str, proto: str = "prototype") -> DataFrame:
    """(key, label, score) against every class."""
    q = queries.select(key, unit(F.transform(vector, lambda x: x.cast("double"))).alias("q"))
    return products(q, key, "q", protos, "label", proto, "score")


def mean_neighbour_scores(queries: DataFrame, bank: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean cosine with each class's members: by linearity, the dot product with its mean."""
    return cosine_scores(queries, class_means(bank).withColumnRenamed("mean", "prototype"), key, vector)


def retrieval_fusion(scores: DataFrame, cosine: DataFrame, alpha: float) -> DataFrame:
    """alpha * logit + (1 - alpha) * cosine, by (image_id, species_id)."""
    t = scores.join(cosine, ["image_id", "species_id"])
    return t.select("image_id", "species_id", (alpha * F.col("logit") + (1 - alpha) * F.col("cosine")).alias("score"))


def top_votes(scores: DataFrame, cosine: DataFrame, low: float, k: int = 5, weight: float = 2.0) -> DataFrame:
    """Adds weight / rank to the logits of the k nearest classes, for images whose best probability is low."""
    near = cosine.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("cosine"), "species_id"))).where(F.col("r") <= k).select("image_id", "species_id", "r")
    t = scores.withColumn("best", F.max("prob").over(Window.partitionBy("image_id"))).join(near, ["image_id", "species_id"], "left")
    add = F.when((F.col("best") < low) & F.col("r").isNotNull(), weight / F.col("r")).otherwise(0.0)
    return t.select("image_id", "species_id", (F.col("logit") + add).alias("score"))


def audit(bank: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, n, nans, zeros, intra): intra is the mean cosine of different members.

    The mean over pairs is (S.S - n) / (n (n - 1)) with S the sum of unit vectors: no pairs.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    t = bank.select(F.col(label).alias("label"), v.alias("v"), F.exists(v, F.isnan).alias("nan"), (dot(v, v) == 0).alias("zero"))
    n = t.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("nan"), 1)).alias("nans"), F.count(F.when(F.col("zero"), 1)).alias("zeros"))
    m = class_means(t, "label", "v")
    s = dot(F.col("mean"), F.col("mean")) * F.col("n") * F.col("n")
    return n.join(m, "label").select("label", "n", "nans", "zeros", F.when(F.col("n") > 1, (s - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("intra"))


def concatenated(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): both banks' vectors end to end."""
    return a.select(key, F.col(vector).alias("__a")).join(b.select(key, F.col(vector).alias("__b")), key).select(key, F.concat("__a", "__b").alias(vector))


def principal(bank: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, components): centred vectors on their k principal axes; signs are the solver's."""
    t = bank.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="c").fit(t)
    out = model.transform(t).select(key, vector_to_array("c").alias("c"))
    means = out.select(F.posexplode("c").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("means"))
    return out.crossJoin(F.broadcast(means)).select(key, F.zip_with("c", "means", lambda x, m: x - m).alias("components"))


def tile_clusters(tiles: DataFrame, vector: str, least: float, block: int = 512) -> DataFrame:
    """(image_id, tile_id, cluster): tiles of an image that cosines above the limit join, named by the smallest.

    An image is solved in one call: from its smallest open tile on, all open tiles that are
    near those just reached are reached, by products of blocks, until none is; no pairs are
    kept and paths have any length.
    """
    kind = dict(tiles.dtypes)["tile_id"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile_id")
        x, names = np.array(pdf["v"].tolist(), float), pdf["tile_id"].to_numpy()
        cluster = np.full(len(names), -1)
        left = np.arange(len(names))
        while len(left):
            root, front, left = left[0], left[:1], left[1:]
            while len(front):
                cluster[front] = root
                near = np.zeros(len(left), bool)
                for i in range(0, len(front), block):
                    near |= (x[left] @ x[front[i : i + block]].T > least).any(1)
                front, left = left[near], left[~near]
        return pd.DataFrame({"tile_id": names, "cluster": names[cluster]})

    u = tiles.select("image_id", "tile_id", unit(F.col(vector)).alias("v"))
    return solve_groups(u, ["image_id"], solve, f"tile_id {kind}, cluster {kind}")
