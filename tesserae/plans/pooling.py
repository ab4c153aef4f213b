"""Pooling queries over the tiles that embeddings stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.columns import by_image, softmax
from tesserae.operators import pooling as P
from tesserae.plans.registry import query, r
from tesserae.plans.views import TILE, tile_meta, tiles


def soft(spark, sf):
    """Tiles dealt by image, with their softmax."""
    return softmax(by_image(tiles(spark, sf)), ["image_id", "tile_id"])


def soft_meta(spark, sf):
    return softmax(tiles(spark, sf).join(tile_meta(spark, sf), ["image_id", "tile_id"]).repartition("image_id"), ["image_id", "tile_id"])


def pooled(score: str, frm: str = "p", more: str = "") -> str:
    return f"WITH {TILE}{more} SELECT image_id, species_id, {r(score, 'score')} FROM {frm} GROUP BY 1, 2"


ENT = ", w AS (SELECT image_id, tile_id, exp(-sum(-greatest(prob, 1e-12) * ln(greatest(prob, 1e-12)))) AS w, max(prob) AS mp, max(logit) AS ml FROM p GROUP BY 1, 2), pw AS (SELECT p.*, w, mp, ml, veg_weight, noise_fraction FROM p JOIN w USING (image_id, tile_id) JOIN meta USING (image_id, tile_id))"
SAFE = "CASE WHEN sum({w}) < 1e-12 THEN avg({v}) ELSE sum({v} * {w}) / sum({w}) END"
RANKED = ENT + ", ranked AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY {by} DESC, tile_id) AS rk FROM pw)"
SCALED = ENT + ", sc AS (SELECT image_id, tile_id, species_id, prob * veg_weight AS s FROM pw), sw AS (SELECT image_id, tile_id, exp(-sum(-least(greatest(s, 1e-12), 1) * ln(least(greatest(s, 1e-12), 1)))) AS u FROM sc GROUP BY 1, 2), ss AS (SELECT * FROM sc JOIN sw USING (image_id, tile_id))"

_PLAIN = {
    "g01_pool_max": ("max", pooled("max(logit)")),
    "g02_pool_mean": ("mean", pooled("avg(logit)")),
    "g03_pool_softmax_mean": ("softmax_mean", pooled("ln(greatest(avg(prob), 1e-12))")),
    "g04_pool_topk_species": ("topk_species", pooled("avg(prob)", "k WHERE rk <= 3", ", k AS (SELECT *, row_number() OVER (PARTITION BY image_id, species_id ORDER BY prob DESC, tile_id) AS rk FROM p)")),
    "g05_pool_topk_tiles": ("topk_tiles", pooled("avg(logit)", "ranked WHERE rk <= 3", RANKED.format(by="ml"))),
    "g06_pool_lse_prob": ("lse_prob", pooled("least(greatest(sum(exp(prob)) / count(*), 0), 1)")),
    "g07_pool_lse_logit": ("lse_logit", pooled("ln(sum(exp(logit))) - ln(count(*))")),
    "g08_pool_confidence_prob": ("confidence_prob", pooled(SAFE.format(w="mp", v="prob"), "pw", ENT)),
    "g09_pool_confidence_logit": ("confidence_logit", pooled("sum(logit * mp) / greatest(sum(mp), 1e-8)", "pw", ENT)),
    "g10_pool_entropy": ("entropy", pooled(SAFE.format(w="w", v="prob"), "pw", ENT)),
    "g17_pool_noisy_or_prob": ("noisy_or_prob", pooled("1 - exp(sum(ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6))))")),
    "g18_pool_noisy_or_logit": ("noisy_or_logit", pooled("1 - exp(sum(ln(1 - least(greatest(1 / (1 + exp(-logit)), 1e-6), 1 - 1e-6))))")),
}
_WEIGHTED = {
    "g11_pool_entropy_veg": ("entropy_veg", pooled(SAFE.format(w="(w * veg_weight)", v="prob"), "pw", ENT)),
    "g12_pool_entropy_veg_scaled": ("entropy_veg_scaled", pooled("sum(s * u) / (sum(u) + 1e-12)", "ss", SCALED)),
    "g13_pool_entropy_veg_logit": ("entropy_veg_logit", pooled("sum(logit * w * veg_weight) / (sum(w * veg_weight) + 1e-12)", "pw", ENT)),
    "g14_pool_entropy_exg": ("entropy_exg", pooled("CASE WHEN sum(w * veg_weight) > 0 THEN sum(prob * w * veg_weight) / sum(w * veg_weight) END", "pw", ENT)),
    "g15_pool_veg": ("veg", pooled(SAFE.format(w="veg_weight", v="prob"), "pw", ENT)),
    "g16_pool_veg_topk": ("veg_topk", pooled("sum(logit * veg_weight) / greatest(sum(veg_weight), 1e-8)", "ranked WHERE rk <= 3", RANKED.format(by="veg_weight * ml"))),
}
for _name, (_method, _sql) in _PLAIN.items():
    query(_name, _sql)(lambda spark, sf, f=P.POOLS[_method]: f(soft(spark, sf)))
for _name, (_method, _sql) in _WEIGHTED.items():
    query(_name, _sql)(lambda spark, sf, f=P.POOLS[_method]: f(soft_meta(spark, sf)))


@query("g19_top_p_tiles", pooled("max(prob)", "pq WHERE mp >= q", ENT + ", q AS (SELECT image_id, quantile_cont(mp, 0.2) AS q FROM w GROUP BY 1), pq AS (SELECT * FROM pw JOIN q USING (image_id))"))
def top_p(spark, sf):
    return P.pool_max(P.top_p_tiles(soft(spark, sf), 80.0), "prob")


@query("g20_noise_penalty", pooled("avg(prob * (1 - 0.35 * noise_fraction))", "pw", ENT))
def noise(spark, sf):
    return P.pool_mean(P.noise_penalty(soft_meta(spark, sf)), "prob")


@query("g21_multi_scale", f"WITH {TILE}, a AS (SELECT image_id, tile_id % 2 AS scale, species_id, (max(prob) + avg(prob)) / 2 AS s FROM p GROUP BY ALL) SELECT image_id, species_id, {r('max(s)', 'score')} FROM a GROUP BY 1, 2")
def scales(spark, sf):
    return P.multi_scale(soft(spark, sf).withColumn("scale", F.col("tile_id") % 2))


@query("g22_veg_tile_weight", f"WITH {TILE} SELECT image_id, tile_id, {r('least(greatest(veg_weight + 0.5, 0.1), 2.0)', 'weight')} FROM meta")
def veg_weight(spark, sf):
    return tile_meta(spark, sf).select("image_id", "tile_id", P.veg_tile_weight(F.col("veg_weight")).alias("weight"))


@query("g23_veg_filter", f"WITH {TILE}, f AS (SELECT *, sum(CASE WHEN veg_weight >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS ok, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY veg_weight DESC, tile_id) AS rk FROM meta) SELECT image_id, tile_id, {r('veg_weight', 'veg_weight')} FROM f WHERE CASE WHEN ok > 0 THEN veg_weight >= 0.9 ELSE rk <= greatest(1, floor(n / 4)) END")
def veg_kept(spark, sf):
    return P.veg_filter(tile_meta(spark, sf), 0.9).select("image_id", "tile_id", "veg_weight")


@query("g24_dominant_claim", f"WITH {TILE}, d AS (SELECT *, max(1 / (1 + exp(-logit))) OVER (PARTITION BY image_id, tile_id) AS mp, first_value(species_id) OVER (PARTITION BY image_id, tile_id ORDER BY logit DESC, species_id) AS dom FROM tile) SELECT image_id, species_id, {r('avg(CASE WHEN mp > 0.6 AND species_id <> dom THEN logit * (1 - 0.5 * (mp - 0.6) / 0.4) ELSE logit END)', 'score')} FROM d GROUP BY 1, 2")
def claim(spark, sf):
    return P.pool_mean(P.dominant_claim(by_image(tiles(spark, sf)), 0.6))


@query("g25_model_mean", f"WITH {TILE} SELECT image_id, tile_id, species_id, {r('avg(prob * f)', 'score')} FROM p, (VALUES (1.0), (0.5)) m(f) GROUP BY 1, 2, 3")
def models(spark, sf):
    t = soft(spark, sf)
    both = t.withColumn("model_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("prob", F.when(F.col("model_id") == 0, F.col("prob")).otherwise(F.col("prob") * 0.5))
    return P.mean_over(both, "model_id", ["image_id", "tile_id", "species_id"])


@query("g26_resolution_mean", f"WITH {TILE}, a AS (SELECT image_id, tile_id % 2 AS res, species_id, avg(prob) AS s FROM p GROUP BY ALL) SELECT image_id, species_id, {r('avg(s)', 'score')} FROM a GROUP BY 1, 2")
def resolutions(spark, sf):
    t = soft(spark, sf).withColumn("resolution", F.col("tile_id") % 2)
    return P.mean_over(t.groupBy("image_id", "resolution", "species_id").agg(F.avg("prob").alias("prob")), "resolution", P.KEYS)


@query("g27_view_mean", f"WITH {TILE} SELECT image_id, species_id, {r('avg(logit)', 'score')} FROM tile GROUP BY 1, 2")
def views(spark, sf):
    return P.mean_over(by_image(tiles(spark, sf)), "tile_id", P.KEYS, "logit")
