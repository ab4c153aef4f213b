"""Pooling of tile scores into image scores.

Scores are long: (image_id, tile_id, species_id, logit and prob), each tile complete over
the species. Every method takes them already dealt by image_id (functions.columns.by_image),
computes what it needs of each tile by a window and then groups by image and species, so a
pooling costs one exchange in all. Results are (image_id, species_id, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tesserae.functions.columns import TINY, clip, entropy, log_floor, ranked, safe_weighted_mean, sigmoid, softmax

KEYS = ["image_id", "species_id"]


def _tile() -> WindowSpec:
    return Window.partitionBy("image_id", "tile_id")


def _grouped(t: DataFrame, score: Column) -> DataFrame:
    return t.groupBy(*KEYS).agg(score.alias("score"))


def pool_max(t: DataFrame, value: str = "logit") -> DataFrame:
    return _grouped(t, F.max(value))


def pool_mean(t: DataFrame, value: str = "logit") -> DataFrame:
    return _grouped(t, F.avg(value))


def pool_softmax_mean(t: DataFrame) -> DataFrame:
    """Log of the mean of the tiles' softmax, with a floor."""
    return _grouped(t, log_floor(F.avg("prob")))


def pool_topk_species(t: DataFrame, k: int = 3, value: str = "prob") -> DataFrame:
    """Mean of the k best tiles of each species."""
    top = t.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(value), "tile_id")))
    return _grouped(top.where(F.col("r") <= k), F.avg(value))


def _top_tiles(t: DataFrame, measure: Column, k: int) -> DataFrame:
    """The rows of each image's k tiles of largest measure; ties by the smaller tile."""
    m = t.withColumn("__m", measure)
    return m.withColumn("__r", F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.desc("__m"), "tile_id"))).where(F.col("__r") <= k).drop("__m", "__r")


def pool_topk_tiles(t: DataFrame, k: int = 3) -> DataFrame:
    """Mean over the k tiles of largest best logit."""
    return _grouped(_top_tiles(t, F.max("logit").over(_tile()), k), F.avg("logit"))


def _lse(value: Column, t: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS)
    m = t.withColumn("__v", value).withColumn("__m", F.max("__v").over(w))
    return m.groupBy(*KEYS).agg((F.max("__m") + F.log(F.sum(F.exp(F.col("__v") - F.col("__m")))) - F.log(F.count("*"))).alias("score"))


def pool_lse_prob(t: DataFrame, temperature: float = 1.0) -> DataFrame:
    return _lse(F.col("prob") / temperature, t).withColumn("score", clip(F.exp("score"), 0.0, 1.0))


def pool_lse_logit(t: DataFrame) -> DataFrame:
    return _lse(F.col("logit"), t)


def pool_confidence_prob(t: DataFrame) -> DataFrame:
    """Weights are the tiles' largest probabilities."""
    return _grouped(t.withColumn("w", F.max("prob").over(_tile())), safe_weighted_mean(F.col("prob"), F.col("w")))


def pool_confidence_logit(t: DataFrame) -> DataFrame:
    w = t.withColumn("w", F.max("prob").over(_tile()))
    return _grouped(w, F.sum(F.col("logit") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8)))


def _certainty(t: DataFrame, prob: str = "prob") -> DataFrame:
    """Adds each tile's exp(-entropy)."""
    return t.withColumn("w", F.exp(-F.sum(entropy(F.col(prob))).over(_tile())))


def pool_entropy(t: DataFrame) -> DataFrame:
    return _grouped(_certainty(t), safe_weighted_mean(F.col("prob"), F.col("w")))


def pool_entropy_veg(t: DataFrame) -> DataFrame:
    """t also has veg_weight."""
    return _grouped(_certainty(t), safe_weighted_mean(F.col("prob"), F.col("w") * F.col("veg_weight")))


def pool_entropy_veg_scaled(t: DataFrame) -> DataFrame:
    """Probabilities times vegetation first, then entropy weights of the scaled ones."""
    s = _certainty(t.withColumn("s", F.col("prob") * F.col("veg_weight")), "s")
    return _grouped(s, F.sum(F.col("s") * F.col("w")) / (F.sum("w") + F.lit(TINY)))


def pool_entropy_veg_logit(t: DataFrame) -> DataFrame:
    w = _certainty(t).withColumn("w", F.col("w") * F.col("veg_weight"))
    return _grouped(w, F.sum(F.col("logit") * F.col("w")) / (F.sum("w") + F.lit(TINY)))


def pool_entropy_exg(t: DataFrame) -> DataFrame:
    """As pool_entropy_veg, but images whose weights add up to nothing have no score."""
    w = _certainty(t).withColumn("w", F.col("w") * F.col("veg_weight"))
    return _grouped(w, F.when(F.sum("w") > 0, F.sum(F.col("prob") * F.col("w")) / F.sum("w")))


def pool_veg(t: DataFrame) -> DataFrame:
    return _grouped(t, safe_weighted_mean(F.col("prob"), F.col("veg_weight")))


def pool_veg_topk(t: DataFrame, k: int = 3) -> DataFrame:
    """The k tiles of largest vegetation times best logit, and their weighted mean."""
    top = _top_tiles(t, F.col("veg_weight") * F.max("logit").over(_tile()), k)
    return _grouped(top, F.sum(F.col("logit") * F.col("veg_weight")) / F.greatest(F.sum("veg_weight"), F.lit(1e-8)))


def pool_noisy_or_prob(t: DataFrame, eps: float = 1e-6) -> DataFrame:
    return _grouped(t, 1.0 - F.exp(F.sum(F.log1p(-clip(F.col("prob"), eps, 1 - eps)))))


def pool_noisy_or_logit(t: DataFrame, eps: float = 1e-6) -> DataFrame:
    return _grouped(t, 1.0 - F.exp(F.sum(F.log1p(-clip(sigmoid(F.col("logit")), eps, 1 - eps)))))


POOLS = {
    "max": pool_max, "mean": pool_mean, "softmax_mean": pool_softmax_mean, "topk_species": pool_topk_species, "topk_tiles": pool_topk_tiles, "lse_prob": pool_lse_prob, "lse_logit": pool_lse_logit,
    "confidence_prob": pool_confidence_prob, "confidence_logit": pool_confidence_logit, "entropy": pool_entropy, "entropy_veg": pool_entropy_veg, "entropy_veg_scaled": pool_entropy_veg_scaled,
    "entropy_veg_logit": pool_entropy_veg_logit, "entropy_exg": pool_entropy_exg, "veg": pool_veg, "veg_topk": pool_veg_topk, "noisy_or_prob": pool_noisy_or_prob, "noisy_or_logit": pool_noisy_or_logit,
}


def top_p_tiles(t: DataFrame, percent: float = 80.0) -> DataFrame:
    """Tiles whose largest probability reaches the (100 - percent)th percentile of their image."""
    m = t.withColumn("__m", F.max("prob").over(_tile()))
    # Each tile has as many rows as any other, so one row a tile gives its percentile.
    first = F.when(F.col("species_id") == F.min("species_id").over(_tile()), F.col("__m"))
    m = m.withColumn("__f", first).withColumn("__q", F.percentile("__f", F.lit(1 - percent / 100)).over(Window.partitionBy("image_id")))
    return m.where(F.col("__m") >= F.col("__q")).drop("__m", "__f", "__q")


def noise_penalty(t: DataFrame, share: float = 0.35) -> DataFrame:
    return t.withColumn("prob", F.col("prob") * (1.0 - share * F.col("noise_fraction")))


def multi_scale(t: DataFrame, methods: tuple[str, ...] = ("max", "mean"), value: str = "prob") -> DataFrame:
    """Mean of several poolings within each scale, then the largest across scales. t also has scale."""
    one = {"max": F.max(value), "mean": F.avg(value)}
    within = t.groupBy("image_id", "scale", "species_id").agg((sum(one[m] for m in methods) / float(len(methods))).alias("s"))
    return _grouped(within, F.max("s"))


def veg_tile_weight(c: Column) -> Column:
    return clip(c + 0.5, 0.1, 2.0)


def veg_filter(meta: DataFrame, least: float) -> DataFrame:
    """Tiles with enough vegetation; where none has, the best quarter of the image's, one at least."""
    image = Window.partitionBy("image_id")
    m = meta.withColumn("ok", F.sum((F.col("veg_weight") >= least).cast("int")).over(image)).withColumn("n", F.count("*").over(image)).withColumn("r", F.row_number().over(image.orderBy(F.desc("veg_weight"), "tile_id")))
    return m.where(F.when(F.col("ok") > 0, F.col("veg_weight") >= least).otherwise(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4)))).drop("ok", "n", "r")


def dominant_claim(t: DataFrame, confidence: float = 0.85, decay: float = 0.5) -> DataFrame:
    """Damps the other species' logits in tiles that one species claims."""
    p = sigmoid(F.col("logit"))
    m = t.withColumn("__p", F.max(p).over(_tile())).withColumn("__d", F.first("species_id").over(_tile().orderBy(F.desc("logit"), "species_id")))
    factor = 1.0 - decay * (F.col("__p") - confidence) / (1.0 - confidence)
    claimed = (F.col("__p") > confidence) & (F.col("species_id") != F.col("__d"))
    return m.withColumn("logit", F.when(claimed, F.col("logit") * factor).otherwise(F.col("logit"))).drop("__p", "__d")


def mean_over(scores: DataFrame, over: str, keys: list[str], value: str = "prob") -> DataFrame:
    """Mean of a score over models, resolutions or views."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("score"))


__all__ = ["POOLS", "ranked", "softmax", *[f"pool_{k}" for k in POOLS]]
