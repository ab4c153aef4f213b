"""Compositions and choices: mosaic plans, submodular tile choice, scorer hook, tile UDTF."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.groups import solve_groups
from tesserae.functions.lineage import cut
from tesserae.functions.orders import LIST_KEYS, hashed, listed, places

#: Shares of mosaics of 1 to 5 species.
MOSAIC_SHARES = (0.30, 0.30, 0.20, 0.12, 0.08)
#: Classes whose prototypes a scorer may hold in every task.
SCORER_CLASSES = 100_000


def mosaic_plan(spark: SparkSession, manifest: DataFrame, n: int, shares: tuple[float, ...] = MOSAIC_SHARES, seed: int = 42) -> DataFrame:
    """(mosaic, slot, species_id, image): n mosaics of different species, one image each.

    A mosaic's size follows the shares. Species have places in a reproducible random order;
    a mosaic draws twice as many places as it can need and takes the first different ones,
    after them the places from its first draw on, so no species comes twice and every set of
    species can be drawn. Each species' images have places too, and one is drawn.
    """
    per = cut(manifest.groupBy("species_id").agg(F.count("*").alias("n_images")))
    classes = cut(places(per, [], "species_id", seed, "code", "classes").select("species_id", (F.col("code") - 1).alias("code"), "n_images"))
    n_classes, rows, largest = classes.agg(F.count("*"), F.sum("n_images"), F.max("n_images")).first()
    kinds = dict(manifest.dtypes)
    if not n_classes:
        return spark.createDataFrame([], f"mosaic bigint, slot int, species_id {kinds['species_id']}, image {kinds['image']}")
    of = lambda what, *parts: hashed(F.lit(f"{seed}{what}"), *[p.cast("string") for p in parts])
    most, size = len(shares), F.lit(len(shares))
    for k in reversed(range(most - 1)):
        size = F.when(of("k", F.col("id")) / float(1 << 32) < sum(shares[: k + 1]), k + 1).otherwise(size)
    draw = lambda j: of("c", F.col("id"), j) % n_classes
    drawn = F.transform(F.sequence(F.lit(0), F.lit(2 * most - 1)), draw)
    rest = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: (F.get("first", F.lit(0)) + j) % n_classes)
    # As many draws as the mosaic has species; the others are taken only where these are not all different.
    first = F.slice(F.array(*[F.when(F.col("size") > j, draw(F.lit(j))) for j in range(most)]), F.lit(1), F.col("size"))
    m = spark.range(n).select("id", F.least(size, F.lit(n_classes)).cast("int").alias("size")).select("id", "size", first.alias("first"))
    codes = F.when(F.size(F.array_distinct("first")) == F.col("size"), F.col("first")).otherwise(F.slice(F.array_distinct(F.concat(drawn, rest)), F.lit(1), F.col("size")))
    m = m.select(F.col("id").alias("mosaic"), F.posexplode(codes).alias("slot", "code"))
    # A class goes along with its first list of images, so what is drawn meets it once; longer lists are met by those rows that need them.
    lists = listed(manifest, "species_id", "image", rows, largest, seed)
    known = classes.join(lists.where("part = 0").drop("part"), "species_id")
    m = m.join(known, "code").withColumn("at", of("i", F.col("mosaic"), F.col("slot")) % F.col("n_images"))
    image = lambda: F.get("keys", (F.col("at") % LIST_KEYS).cast("int"))
    part = F.floor(F.col("at") / LIST_KEYS)
    m = m.select("mosaic", "slot", "species_id", "at", F.when(part > 0, part).alias("part"), F.when(part == 0, image()).alias("image"))
    if largest > LIST_KEYS:
        m = m.join(lists.where("part > 0"), ["species_id", "part"], "left").withColumn("image", F.coalesce("image", image()))
    return m.select("mosaic", "slot", "species_id", "image")


def lazy_greedy(probs: np.ndarray, k: int, least: float) -> tuple[list[tuple[int, float]], int]:
    """(row, gain) of each step, and how many gains were computed.

    Gains only shrink as coverage grows, so a gain computed earlier bounds the one now. A heap holds the bounds; the first row is computed
    anew until one is first with a gain of this step. Of equal gains the smaller row comes first.
    """
    n, covered, steps = len(probs), np.zeros(probs.shape[1]), []
    bounds = [(-g, i, 0) for i, g in enumerate(np.clip(probs - covered, 0, None).sum(1).tolist())]
    heapq.heapify(bounds)
    computed = n
    while len(steps) < min(k, n):
        minus, i, step = heapq.heappop(bounds)
        if step < len(steps):
            computed += 1
            heapq.heappush(bounds, (-float(np.clip(probs[i] - covered, 0, None).sum()), i, len(steps)))
            continue
        steps.append((i, -minus))
        covered = np.maximum(covered, probs[i])
        if n > k and -minus < least:
            break
    return steps, computed


def greedy_tiles(tiles: DataFrame, k: int = 20, least: float = 0.01) -> DataFrame:
    """(image_id, step, tile_id, gain): tiles by largest gain in coverage, the sum over species of the best score so far.

    An image of k tiles or fewer keeps them all; another one keeps k at most and ends with
    the first tile that gains less than `least`. Of equal gains the smaller tile comes first.
    tiles: (image_id, tile_id, probs array).
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile_id")
        steps, _ = lazy_greedy(np.array(pdf["probs"].tolist(), float), k, least)
        return pd.DataFrame({"step": np.arange(len(steps), dtype=np.int32), "tile_id": pdf["tile_id"].to_numpy()[[i for i, _ in steps]], "gain": [float(g) for _, g in steps]})

    return solve_groups(tiles.select("image_id", "tile_id", "probs"), ["image_id"], solve, f"step int, tile_id {dict(tiles.dtypes)['tile_id']}, gain double")


def score_batches(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a user's scorer to batches of rows; it returns rows of the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield predict(b)

    return df.mapInPandas(run, schema)


def cosine_scorer(prototypes: dict[int, list[float]], key: str, vector: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A scorer for score_batches: cosines with a fixed set of class prototypes."""
    labels = sorted(prototypes)
    m = np.array([prototypes[c] for c in labels], float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def predict(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = x @ m.T
        return pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(labels)), "species_id": np.tile(labels, len(b)), "score": s.ravel()})

    return predict


class GridBoxes:
    """A table function for SQL callers: grid_boxes(width, height, n) yields (tile_id, x0, y0, x1, y1)."""

    def eval(self, width: int, height: int, n: int):
        for r in range(n):
            for c in range(n):
                yield r * n + c, round(c * width / n), round(r * height / n), round((c + 1) * width / n), round((r + 1) * height / n)


def register_grid_boxes(spark: SparkSession, name: str = "grid_boxes") -> None:
    spark.udtf.register(name, F.udtf(GridBoxes, returnType="tile_id int, x0 int, y0 int, x1 int, y1 int"))
