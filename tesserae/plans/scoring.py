"""Queries of score algebra over image scores, the mean softmax of an image's tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.columns import sigmoid
from tesserae.operators import scores as S
from tesserae.plans.pooling import soft
from tesserae.plans.registry import query, r
from tesserae.plans.views import CLASSES_SQL, COUNTS, TILE, counts, taxonomy

IMG = f"WITH {TILE}, img AS (SELECT image_id, species_id, avg(prob) AS prob, avg(logit) AS logit, max(prob) AS mx FROM p GROUP BY 1, 2)"
TAX = "tax AS (SELECT DISTINCT species_id, species_id // 4 AS genus_id, species_id // 16 AS family_id FROM tile)"
EDGES = "edges AS (SELECT a.species_id AS a, b.species_id AS b FROM tax a JOIN tax b USING (genus_id) WHERE a.species_id <> b.species_id)"
LAPLACE = f"{CLASSES_SQL}, {COUNTS}, pr AS (SELECT species_id, ln((coalesce(n, 0) + 1) / (SELECT sum(coalesce(n, 0) + 1) FROM cls LEFT JOIN cnt USING (species_id))) AS prior FROM cls LEFT JOIN cnt USING (species_id))"


def images(spark, sf):
    """(image_id, species_id, prob, logit, mx): means over tiles, and the largest probability."""
    return soft(spark, sf).groupBy("image_id", "species_id").agg(F.avg("prob").alias("prob"), F.avg("logit").alias("logit"), F.max("prob").alias("mx"))


def classes(spark, sf):
    return taxonomy(spark, sf).select("species_id")


def softmaxed(x: str, frm: str = "img") -> str:
    """SQL for the softmax of x within each image."""
    return f", x AS (SELECT image_id, species_id, {x} AS x FROM {frm}), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY image_id)) AS e FROM x) SELECT image_id, species_id, {r('e / sum(e) OVER (PARTITION BY image_id)', 'score')} FROM e"


@query("e01_softmax_sigmoid_log", f"WITH {TILE} SELECT image_id, tile_id, species_id, {r('prob', 'prob')}, {r('1 / (1 + exp(-logit))', 'sig')}, {r('ln(greatest(prob, 1e-12))', 'lg')} FROM p")
def e01(spark, sf):
    return soft(spark, sf).select("image_id", "tile_id", "species_id", "prob", sigmoid(F.col("logit")).alias("sig"), F.log(F.greatest("prob", F.lit(1e-12))).alias("lg"))


@query("e02_log_prior_laplace", f"WITH {TILE}, {LAPLACE} SELECT species_id, {r('prior', 'prior')} FROM pr")
def e02(spark, sf):
    return S.log_prior(classes(spark, sf), counts(spark, sf))


_N = f"WITH {TILE}, {CLASSES_SQL}, {COUNTS}, c AS (SELECT species_id, coalesce(n, {{d}}) AS n FROM cls LEFT JOIN cnt USING (species_id)), s AS (SELECT *, n / (SELECT sum(n) FROM c) AS sh FROM c) SELECT species_id, {{x}} FROM s"
_SMOOTHINGS = (("scaled", "scaled", 0, "0.5 * ln(sh + 1e-6)"), ("padded", "padded", 1, "ln(sh)"), ("floored", "floored", 1, "ln(sh + 1e-9)"), ("sqrt", "sqrt", 0, "sqrt(sh)"))
for _name, _kind, _d, _x in _SMOOTHINGS:
    query(f"e03_log_prior_{_name}", _N.format(d=_d, x=r(_x, "prior")))(lambda spark, sf, k=_kind: S.log_prior(classes(spark, sf), counts(spark, sf), k, 0.5))


@query("f01_prior_registry", " UNION ALL ".join(f"SELECT '{n}' AS prior_name, species_id, prior FROM ({q})" for n, q in [("laplace", f"WITH {TILE}, {LAPLACE} SELECT species_id, {r('prior', 'prior')} FROM pr"), *[(k, _N.format(d=d, x=r(x.replace("0.5 *", "1.0 *"), "prior"))) for _, k, d, x in _SMOOTHINGS]]))
def f01(spark, sf):
    """Every class prior of the registry, by its name."""
    out = None
    for name, prior in S.PRIORS.items():
        one = prior(classes(spark, sf), counts(spark, sf)).select(F.lit(name).alias("prior_name"), "species_id", "prior")
        out = one if out is None else out.union(one)
    return out


@query("e04_phylo_weights", f"WITH {TILE}, {TAX}, w AS (SELECT a.species_id AS a, b.species_id AS b, a.family_id = b.family_id AS fam, CASE WHEN a.genus_id = b.genus_id THEN 1 WHEN a.family_id = b.family_id THEN exp(-1) ELSE exp(-2) END AS w FROM tax a, tax b), n AS (SELECT *, w / sum(w) OVER (PARTITION BY a) AS nw FROM w) SELECT a, b, {r('nw', 'w')} FROM n WHERE fam")
def e04(spark, sf):
    return S.phylo_weights(taxonomy(spark, sf))


@query("e05_adjust_softmax", IMG + f", {LAPLACE}" + softmaxed("ln(greatest(prob, 1e-12)) - 0.25 * prior", "img JOIN pr USING (species_id)"))
def e05(spark, sf):
    return S.adjust_softmax(images(spark, sf), S.log_prior(classes(spark, sf), counts(spark, sf)), 0.25)


@query("e06_adjust_sigmoid", IMG + f", {CLASSES_SQL}, {COUNTS}, c AS (SELECT species_id, coalesce(n, 1) AS n FROM cls LEFT JOIN cnt USING (species_id)), q AS (SELECT image_id, species_id, n, least(greatest(prob, 1e-6), 1 - 1e-6) AS p FROM img JOIN c USING (species_id)) SELECT image_id, species_id, {r('1 / (1 + exp(-(ln(p / (1 - p)) - 0.1 * ln(n + 1e-6))))', 'score')} FROM q")
def e06(spark, sf):
    return S.adjust_sigmoid(images(spark, sf), S.class_counts(classes(spark, sf), counts(spark, sf), 1), 0.1)


@query("e13_genus_family_rerank", IMG + f", {TAX}, g AS (SELECT image_id, species_id, prob, sum(prob) OVER (PARTITION BY image_id, genus_id) AS pg, sum(prob) OVER (PARTITION BY image_id, family_id) AS pf FROM img JOIN tax USING (species_id))" + softmaxed("ln(greatest(prob, 1e-12)) + 0.1 * ln(greatest(pg, 1e-12)) + 0.05 * ln(greatest(pf, 1e-12))", "g"))
def e13(spark, sf):
    return S.genus_family_rerank(images(spark, sf), taxonomy(spark, sf), 0.1, 0.05)


@query("e14_hierarchy_boost", IMG + f", {TAX} SELECT image_id, species_id, {r('prob * power(sum(prob) OVER (PARTITION BY image_id, genus_id), 0.3)', 'score')} FROM img JOIN tax USING (species_id)")
def e14(spark, sf):
    return S.hierarchy_boost(images(spark, sf), taxonomy(spark, sf), 0.3)


@query("j15_genus_edges", f"WITH {TILE}, {TAX}, {EDGES} SELECT a, b FROM edges")
def j15(spark, sf):
    return S.genus_edges(taxonomy(spark, sf))


@query("j17_two_hops", f"WITH {TILE}, {TAX}, fe AS (SELECT a.species_id AS a, b.species_id AS b FROM tax a JOIN tax b ON abs(a.species_id - b.species_id) = 3) SELECT DISTINCT a, b FROM (SELECT a, b FROM fe UNION SELECT x.a, y.b FROM fe x JOIN fe y ON x.b = y.a WHERE x.a <> y.b)")
def j17(spark, sf):
    t = taxonomy(spark, sf).select("species_id")
    steps = t.select(F.col("species_id").alias("a"), F.explode(F.array(F.col("species_id") - 3, F.col("species_id") + 3)).alias("b"))
    return S.two_hops(steps.join(t.withColumnRenamed("species_id", "b"), "b", "left_semi").select("a", "b"))


@query("e17_repulsion", f"WITH {TILE}, {TAX}, {EDGES}, d AS (SELECT a AS species_id, count(*) AS d FROM edges GROUP BY 1) SELECT species_id, (SELECT count(*) FROM tax) - 1 - coalesce(d, 0) AS n_outside, {r('((SELECT count(*) FROM tax) - 1 - coalesce(d, 0)) * -0.1', 'total')} FROM tax LEFT JOIN d USING (species_id)")
def e17(spark, sf):
    t = taxonomy(spark, sf)
    return S.repulsion(t, S.genus_edges(t))


@query("e18_mean_field", IMG + f", {TAX}, {EDGES}, f AS (SELECT image_id, a AS species_id, sum(-0.1 / (1 + exp(-logit))) AS f FROM img JOIN edges ON b = species_id GROUP BY 1, 2) SELECT image_id, species_id, {r('logit + coalesce(f, 0) - avg(coalesce(f, 0)) OVER (PARTITION BY image_id)', 'score')} FROM img LEFT JOIN f USING (image_id, species_id)")
def e18(spark, sf):
    return S.mean_field(images(spark, sf), S.genus_edges(taxonomy(spark, sf)).withColumn("w", F.lit(-0.1)))


@query("e19_anchor_filter", IMG + f", {TAX}, an AS (SELECT image_id, species_id // 4 AS g FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, species_id) AS k FROM img) WHERE k = 1) SELECT image_id, species_id, {r('CASE WHEN species_id // 4 = g THEN prob ELSE 0 END', 'score')} FROM img JOIN an USING (image_id)")
def e19(spark, sf):
    return S.anchor_filter(images(spark, sf), S.genus_edges(taxonomy(spark, sf)))


@query("e20_cluster_mask", IMG + f" SELECT image_id, species_id, {r('prob', 'score')} FROM img WHERE species_id % 3 = image_id % 3")
def e20(spark, sf):
    allowed = taxonomy(spark, sf).select((F.col("species_id") % 3).cast("long").alias("cluster"), "species_id")
    t = images(spark, sf).withColumn("cluster", F.col("image_id") % 3)
    return t.join(allowed, ["cluster", "species_id"], "left_semi").select("image_id", "species_id", F.col("prob").alias("score"))


_WALK = [f"s{k} AS (SELECT i.image_id, i.species_id, 0.85 * coalesce(m, 0) + 0.15 * i.prob AS s FROM img i LEFT JOIN (SELECT image_id, b AS species_id, sum(s * w) AS m FROM s{k - 1} JOIN ew ON a = species_id GROUP BY 1, 2) USING (image_id, species_id))" for k in range(1, 4)]


@query("e24_random_walk", IMG + f", {TAX}, {EDGES}, ew AS (SELECT a, b, 1.0 / count(*) OVER (PARTITION BY a) AS w FROM edges), s0 AS (SELECT image_id, species_id, prob AS s FROM img), " + ", ".join(_WALK) + f" SELECT image_id, species_id, {r('s', 'score')} FROM s3")
def e24(spark, sf):
    return S.random_walk(images(spark, sf), S.genus_edges(taxonomy(spark, sf)).withColumn("w", F.lit(1.0)), steps=3)


def two_models(spark, sf):
    """(model_id, image_id, species_id, prob): means and maxima over tiles as two models."""
    t = images(spark, sf)
    return t.select(F.lit("a").alias("model_id"), "image_id", "species_id", "prob").union(t.select(F.lit("b"), "image_id", "species_id", F.col("mx")))


@query("e26_weighted_ensemble", IMG + f" SELECT image_id, species_id, {r('0.75 * prob + 0.25 * mx', 'score')} FROM img")
def e26(spark, sf):
    return S.weighted_ensemble(two_models(spark, sf), {"a": 3.0, "b": 1.0})


@query("e27_ensemble_adjusted", IMG + f", {LAPLACE}" + softmaxed("ln(greatest(0.5 * prob + 0.5 * mx, 1e-12)) - 0.25 * prior", "img JOIN pr USING (species_id)"))
def e27(spark, sf):
    mixed = S.weighted_ensemble(two_models(spark, sf), {"a": 1.0, "b": 1.0}).withColumnRenamed("score", "prob")
    return S.adjust_softmax(mixed, S.log_prior(classes(spark, sf), counts(spark, sf)), 0.25)


@query("e28_blend", IMG + f" SELECT image_id, species_id, {r('0.6 * prob + 0.4 * mx', 'arithmetic')}, {r('exp(0.6 * ln(greatest(prob, 1e-8)) + 0.4 * ln(greatest(mx, 1e-8)))', 'geometric')} FROM img")
def e28(spark, sf):
    p, m = F.col("prob"), F.col("mx")
    return images(spark, sf).select("image_id", "species_id", S.blend(p, m, 0.6).alias("arithmetic"), S.blend(p, m, 0.6, True).alias("geometric"))


@query("e29_geometric_mean", IMG + f" SELECT image_id, species_id, {r('exp(0.5 * ln(greatest(mx, 1e-8)) + 0.3 * ln(greatest(prob, 1e-8)) + 0.2 * ln(greatest(prob * mx, 1e-8)))', 'score')} FROM img")
def e29(spark, sf):
    t = images(spark, sf).withColumn("both", F.col("prob") * F.col("mx"))
    return t.select("image_id", "species_id", S.geometric_mean({"mx": 0.5, "prob": 0.3, "both": 0.2}).alias("score"))


@query("e30_alpha_mix", IMG + f" SELECT image_id, CAST(alpha AS DOUBLE) AS alpha, {r('max(alpha * mx + (1 - alpha) * prob)', 'best')} FROM img, (VALUES (0.0), (0.25), (0.5), (1.0)) g(alpha) GROUP BY 1, 2")
def e30(spark, sf):
    t = images(spark, sf).select("image_id", "prob", "mx", F.explode(F.array(*[F.lit(a) for a in (0.0, 0.25, 0.5, 1.0)])).alias("alpha"))
    return t.groupBy("image_id", "alpha").agg(F.max(S.blend(F.col("mx"), F.col("prob"), 1.0) * F.col("alpha") + (1 - F.col("alpha")) * F.col("prob")).alias("best"))


@query("e31_reciprocal_ranks", IMG + f", k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, species_id) AS ra, row_number() OVER (PARTITION BY image_id ORDER BY mx DESC, species_id) AS rb FROM img), u AS (SELECT image_id, species_id, ra AS rk FROM k WHERE ra <= 10 UNION ALL SELECT image_id, species_id, rb FROM k WHERE rb <= 10) SELECT image_id, species_id, {r('sum(1.0 / (60 + rk))', 'score')} FROM u GROUP BY 1, 2")
def e31(spark, sf):
    t = two_models(spark, sf).groupBy("model_id", "image_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("s"), "species_id"))), 1, 10), lambda x: x["species_id"]).alias("ids"))
    return S.reciprocal_ranks(t.withColumnRenamed("model_id", "list_id"))


@query("e32_weighted_ranks", IMG + f", k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, species_id) AS ra, row_number() OVER (PARTITION BY image_id ORDER BY mx DESC, species_id) AS rb FROM img) SELECT image_id, species_id, {r('1.0 / (60 + ra - 1) + 0.5 / (60 + rb - 1)', 'score')} FROM k")
def e32(spark, sf):
    return S.weighted_ranks(two_models(spark, sf), {"a": 1.0, "b": 0.5})


@query("e34_energy", IMG + f" SELECT image_id, {r('-ln(sum(exp(logit)))', 'energy')}, max(prob) < 0.05 AS low FROM img GROUP BY 1")
def e34(spark, sf):
    return S.energy(images(spark, sf), 0.05)


@query("e35_focusing", f"WITH {COUNTS}, t AS (SELECT *, (SELECT sum(n) FROM cnt) AS tot FROM cnt) SELECT species_id, {r('2 + least(greatest(4 * ln(greatest(tot - n, 1) / greatest(n, 1)) / greatest(ln(greatest(tot - n, 1)), 1e-12), 0), 4)', 'gamma')} FROM t")
def e35(spark, sf):
    return S.focusing(counts(spark, sf))


@query("e36_month_gate", IMG + f" SELECT image_id, species_id, {r('CASE WHEN species_id % 5 = 0 OR ((species_id * 61 + 7) % 4096 >> (image_id % 12)::INT) & 1 = 1 THEN prob ELSE 0 END', 'score')} FROM img")
def e36(spark, sf):
    masks = taxonomy(spark, sf).where("species_id % 5 <> 0").select("species_id", ((F.col("species_id") * 61 + 7) % 4096).alias("mask"))
    return S.month_gate(images(spark, sf), masks, (F.col("image_id") % 12 + 1).cast("int"))


@query("j08_axis_alignment", IMG + " SELECT DISTINCT image_id, CAST(2 AS INT) AS have, CAST(63 AS INT) AS least, CAST(64 AS INT) AS most FROM img WHERE image_id % 4 = 0")
def j08(spark, sf):
    """Images whose second model lacks a species are named."""
    t = S.complete_axes(two_models(spark, sf).where("not (model_id = 'b' and species_id = 0 and image_id % 4 = 0)"))
    return t.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("have", "least", "most")])


@query("j12_class_counts", f"WITH {TILE}, {CLASSES_SQL}, {COUNTS} SELECT species_id, coalesce(n, 1) AS n FROM cls LEFT JOIN cnt USING (species_id)")
def j12(spark, sf):
    return S.class_counts(classes(spark, sf), counts(spark, sf), 1)
