"""Compatibility of species within an image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.groups import solve_groups
from tesserae.operators.vectors import against_all, products, unit


def niche_compatibility(niches: DataFrame, indicators: list[str], below: float = 1.0, mu: float = 0.0, sd: float = 1.5) -> DataFrame:
    """(a, b, c) for pairs under a cut-off: the product of the indicators' Bhattacharyya coefficients.

    niches: (species_id, <indicator>_m, <indicator>_s); missing or non-positive spreads take
    the defaults. All pairs are asked for by definition; they are made in blocks.
    """
    def filled(side: str) -> DataFrame:
        cols = []
        for i in indicators:
            good = F.col(f"{i}_m").isNotNull() & (F.coalesce(F.col(f"{i}_s"), F.lit(0.0)) > 0)
            cols += [F.when(good, F.col(f"{i}_m")).otherwise(mu).alias(f"{side}{i}_m"), F.when(good, F.col(f"{i}_s")).otherwise(sd).alias(f"{side}{i}_s")]
        return niches.select(F.col("species_id").alias(side), *cols)

    log_c = F.lit(0.0)
    for i in indicators:
        s2 = F.pow(f"a{i}_s", F.lit(2.0)) + F.pow(f"b{i}_s", F.lit(2.0))
        log_c = log_c + 0.5 * F.log(2 * F.col(f"a{i}_s") * F.col(f"b{i}_s") / s2) - F.pow(F.col(f"a{i}_m") - F.col(f"b{i}_m"), F.lit(2.0)) / (4 * s2)
    pairs = against_all(filled("a"), filled("b")).where("a <> b")
    return pairs.select("a", "b", F.exp(log_c).alias("c")).where(F.col("c") < below)


def continuous_consistency(tiles: DataFrame, edges: DataFrame, compat: DataFrame, threshold: float) -> DataFrame:
    """Tile scores times the least compatibility with any species that the image predicts in some tile.

    A pair counts 1 if it is an edge, else its compatibility, 1 where none is given.
    Only pairs below 1 that are no edges can lower a score, so these alone are joined.
    """
    predicted = tiles.where(F.col("prob") > threshold).select("image_id", F.col("species_id").alias("b")).distinct()
    harmful = compat.where("c < 1 and a <> b").join(edges, ["a", "b"], "left_anti")
    worst = predicted.join(harmful, "b").groupBy("image_id", F.col("a").alias("species_id")).agg(F.min("c").alias("c"))
    t = tiles.join(worst, ["image_id", "species_id"], "left")
    return t.select("image_id", "tile_id", "species_id", (F.col("prob") * F.coalesce("c", F.lit(1.0))).alias("prob"))


def hard_consistency(tiles: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Tile scores, zero for species that some other tile of the image cannot stand beside.

    A species stays if every tile of the image keeps a species next to it, or itself; what
    fails is dropped until nothing does, so the largest set that stays is left. Whether a
    species has support is the same in all tiles that hold it. An image is solved in one
    call, by a matrix of tiles by species; a single tile keeps its scores.
    """
    n_tiles = tiles.select("image_id", "tile_id").distinct().groupBy("image_id").agg(F.count("*").alias("tiles"))
    near = edges.groupBy(F.col("a").alias("species_id")).agg(F.collect_set("b").alias("near"))
    above = tiles.where(F.col("prob") > threshold).select("image_id", "tile_id", "species_id").join(n_tiles, "image_id").where("tiles > 1").join(near, "species_id", "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        species, which = np.unique(pdf["species_id"].to_numpy(), return_inverse=True)
        names, tile = np.unique(pdf["tile_id"].to_numpy(), return_inverse=True)
        kind = pdf["species_id"].dtype
        if len(names) < pdf["tiles"].iloc[0]:
            return pd.DataFrame({"species_id": np.zeros(0, kind)})
        holds = np.zeros((len(names), len(species)), np.float32)
        holds[tile, which] = 1
        beside = np.eye(len(species), dtype=np.float32)
        for i, found in zip(which, pdf["near"], strict=True):
            if found is not None:
                beside[np.searchsorted(species, np.intersect1d(found, species)), i] = 1
        kept = np.ones(len(species), bool)
        while True:
            good = kept & ((holds * kept) @ beside > 0).all(0)
            if (good == kept).all():
                return pd.DataFrame({"species_id": species[kept].astype(kind)})
            kept = good

    kept = solve_groups(above, ["image_id"], solve, f"species_id {dict(tiles.dtypes)['species_id']}")
    t = tiles.join(n_tiles, "image_id").join(kept.withColumn("ok", F.lit(True)), ["image_id", "species_id"], "left")
    stays = (F.col("tiles") == 1) | (F.col("ok") & (F.col("prob") > threshold))
    return t.select("image_id", "tile_id", "species_id", F.when(stays, F.col("prob")).otherwise(0.0).alias("prob"))


def prune_and_recover(selected: DataFrame, reserve: DataFrame, compat: DataFrame, low: float, high: float) -> DataFrame:
    """Selected species whose mean compatibility with the image's others is low go; reserves with a high one come in.

    Pairs that compat does not give count 1.
    """
    def mean(side: DataFrame) -> DataFrame:
        others = selected.select("image_id", F.col("species_id").alias("b"))
        p = side.join(others, "image_id").where("species_id <> b").join(compat, (F.col("species_id") == F.col("a")) & (others["b"] == compat["b"]), "left")
        return p.groupBy("image_id", "species_id").agg(F.avg(F.coalesce("c", F.lit(1.0))).alias("m"))

    ids = ["image_id", "species_id"]
    drop = mean(selected).where(F.col("m") < low).select(*ids)
    add = mean(reserve).where(F.col("m") > high).select(*ids)
    return selected.select(*ids).join(drop, ids, "left_anti").union(add).distinct()


def climate_profiles(points: DataFrame, grid: DataFrame, columns: list[str], cell: float) -> DataFrame:
    """(species_id, z array): mean grid values at a species' points, as z-scores over species.

    points: (species_id, x, y); grid: (cx, cy, columns), one row a cell of the given size.
    """
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    m = p.join(grid, ["cx", "cy"]).groupBy("species_id").agg(*[F.avg(c).alias(c) for c in columns])
    stats = m.agg(*[F.avg(c).alias(f"{c}_a") for c in columns], *[F.stddev_pop(c).alias(f"{c}_d") for c in columns])
    z = [(F.col(c) - F.col(f"{c}_a")) / F.greatest(F.col(f"{c}_d"), F.lit(1e-9)) for c in columns]
    return m.crossJoin(F.broadcast(stats)).select("species_id", F.array(*z).alias("z"))


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(a, b, cosine) of different classes from `least`: only these leave the products of whole batches."""
    v = vectors.select(key, unit(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    pairs = products(v.withColumnRenamed(key, "a"), "a", "v", v.withColumnRenamed(key, "b"), "b", "v", "cosine", least)
    return pairs.where("a <> b")
