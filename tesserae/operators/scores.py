"""Score algebra on image scores: normalise, adjust by priors, constrain, blend."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tesserae.functions.columns import TINY, log_floor, ranked, softmax
from tesserae.operators.graphs import Push, on_graph


def _image() -> WindowSpec:
    return Window.partitionBy("image_id")


def class_counts(classes: DataFrame, counts: DataFrame, default: int = 0) -> DataFrame:
    """Every class with its count, or the default."""
    return classes.join(counts, "species_id", "left").select("species_id", F.coalesce("n", F.lit(default)).alias("n"))


def _summed(df: DataFrame, value: Column) -> DataFrame:
    """df with the total of value in every row: one number is grouped and sent, no window over all."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("total"))))


def log_prior(classes: DataFrame, counts: DataFrame, smoothing: str = "laplace", tau: float = 1.0) -> DataFrame:
    """(species_id, prior): log of the classes' shares by one of four smoothings, or sqrt of the share.

    laplace: ln((n+1) / sum(n+1)); scaled: tau ln(share + 1e-6); padded: ln(n / sum), missing
    classes counting one; floored: the same with ln(share + 1e-9); sqrt: the share's root.
    """
    n = class_counts(classes, counts, 1 if smoothing in ("padded", "floored") else 0)
    plus = 1 if smoothing == "laplace" else 0
    share = (F.col("n") + plus) / F.col("total")
    value = {"laplace": F.log(share), "scaled": tau * F.log(share + 1e-6), "padded": F.log(share), "floored": F.log(share + 1e-9), "sqrt": F.sqrt(share)}[smoothing]
    return _summed(n, F.col("n") + plus).select("species_id", value.alias("prior"))


#: Class priors by name: from (classes, counts) to (species_id, prior).
PRIORS = {k: functools.partial(log_prior, smoothing=k) for k in ("laplace", "scaled", "padded", "floored", "sqrt")}


def adjust_softmax(scores: DataFrame, prior: DataFrame, tau: float, temperature: float = 1.0) -> DataFrame:
    """softmax((ln p - tau * prior) / T) within each image; scores has prob, prior one row a class."""
    x = scores.join(prior, "species_id").withColumn("x", log_floor(F.col("prob")) - tau * F.col("prior"))
    return softmax(x, ["image_id"], "x", "score", temperature).select("image_id", "species_id", "score")


def adjust_sigmoid(scores: DataFrame, counts: DataFrame, tau: float, eps: float = 1e-6) -> DataFrame:
    """sigma(logit(p) - tau ln(n + 1e-6))."""
    p = F.least(F.greatest(F.col("prob"), F.lit(eps)), F.lit(1 - eps))
    x = F.log(p / (1 - p)) - tau * F.log(F.col("n") + 1e-6)
    return scores.join(counts, "species_id").select("image_id", "species_id", (1 / (1 + F.exp(-x))).alias("score"))


def genus_family_rerank(scores: DataFrame, taxonomy: DataFrame, genus: float, family: float) -> DataFrame:
    """softmax(ln p + genus ln P(genus) + family ln P(family)) within each image."""
    t = scores.join(taxonomy, "species_id")
    g, f = F.sum("prob").over(Window.partitionBy("image_id", "genus_id")), F.sum("prob").over(Window.partitionBy("image_id", "family_id"))
    x = t.withColumn("x", log_floor(F.col("prob")) + genus * log_floor(g) + family * log_floor(f))
    return softmax(x, ["image_id"], "x", "score").select("image_id", "species_id", "score")


def hierarchy_boost(scores: DataFrame, taxonomy: DataFrame, alpha: float) -> DataFrame:
    """p times the best score of its genus to the power alpha."""
    t = scores.join(taxonomy, "species_id")
    return t.select("image_id", "species_id", (F.col("prob") * F.pow(F.sum("prob").over(Window.partitionBy("image_id", "genus_id")), F.lit(alpha))).alias("score"))


def phylo_weights(taxonomy: DataFrame, edges: str = "genus") -> DataFrame:
    """(a, b, w) for pairs of a family, rows normalised over all species in closed form.

    Weights are 1 within a genus, e^-1 within a family and e^-2 beyond; the last are not
    written out, but count in each row's sum: n_g + e^-1 (n_f - n_g) + e^-2 (N - n_f).
    """
    e1, e2 = math.exp(-1), math.exp(-2)
    per = taxonomy.groupBy("family_id", "genus_id").agg(F.count("*").alias("ng"))
    fam = taxonomy.groupBy("family_id").agg(F.count("*").alias("nf"))
    n = taxonomy.agg(F.count("*").alias("n"))
    a = taxonomy.join(per, ["family_id", "genus_id"]).join(fam, "family_id").crossJoin(F.broadcast(n))
    total = F.col("ng") + e1 * (F.col("nf") - F.col("ng")) + e2 * (F.col("n") - F.col("nf"))
    a = a.select(F.col("species_id").alias("a"), "family_id", F.col("genus_id").alias("ga"), total.alias("total"))
    b = taxonomy.select(F.col("species_id").alias("b"), "family_id", F.col("genus_id").alias("gb"))
    return a.join(b, "family_id").select("a", "b", (F.when(F.col("ga") == F.col("gb"), 1.0).otherwise(e1) / F.col("total")).alias("w"))


def genus_edges(taxonomy: DataFrame) -> DataFrame:
    """(a, b): different species of one genus."""
    a = taxonomy.select(F.col("species_id").alias("a"), "genus_id")
    return a.join(taxonomy.select(F.col("species_id").alias("b"), "genus_id"), "genus_id").where("a <> b").select("a", "b")


def two_hops(edges: DataFrame) -> DataFrame:
    """Edges, and pairs with a common neighbour."""
    far = edges.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").where(F.col("x.a") != F.col("y.b"))
    return edges.union(far).distinct()


def anchor_filter(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores of zero for species that are not next to their image's best one."""
    best = scores.groupBy("image_id").agg(F.max_by("species_id", F.struct("prob", -F.col("species_id"))).alias("anchor"))
    near = edges.select(F.col("a").alias("anchor"), F.col("b").alias("species_id"), F.lit(True).alias("near"))
    t = scores.join(best, "image_id").join(near, ["anchor", "species_id"], "left")
    return t.select("image_id", "species_id", F.when(F.col("near") | (F.col("species_id") == F.col("anchor")), F.col("prob")).otherwise(0.0).alias("score"))


def mean_field(scores: DataFrame, edges: DataFrame, weight: str = "w") -> DataFrame:
    """logit plus each species' centred sum of its neighbours' weighted sigmoids.

    A graph that is counted small is sent, and an image is solved in one pass; a larger one is joined.
    """
    def centred(x: np.ndarray, present: np.ndarray, push: Push) -> np.ndarray:
        force = push(np.where(present, 1 / (1 + np.exp(-x)), 0.0))
        mean = (force * present).sum(1) / np.maximum(1, present.sum(1))
        return x + force - mean[:, None]

    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col(weight).alias("w"))
    if (sent := on_graph(scores, "logit", turned, centred, "score")) is not None:
        return sent
    s = scores.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    push = s.join(edges.withColumnRenamed("b", "species_id"), "species_id").groupBy("image_id", F.col("a").alias("species_id")).agg(F.sum(F.col(weight) * F.col("p")).alias("f"))
    t = s.join(push, ["image_id", "species_id"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return t.select("image_id", "species_id", (F.col("logit") + F.col("f") - F.avg("f").over(_image())).alias("score"))


def repulsion(taxonomy: DataFrame, inside: DataFrame, value: float = -0.1) -> DataFrame:
    """(species_id, n_outside, sum): how many species lie outside each one's pairs, and their repulsion.

    The dense table of repulsions is a constant less its inside pairs; only these are kept.
    """
    n = taxonomy.agg(F.count("*").alias("n"))
    degree = inside.groupBy(F.col("a").alias("species_id")).agg(F.count("*").alias("d"))
    t = taxonomy.select("species_id").join(degree, "species_id", "left").crossJoin(F.broadcast(n))
    out = F.col("n") - 1 - F.coalesce("d", F.lit(0))
    return t.select("species_id", out.alias("n_outside"), (out * value).alias("total"))


def random_walk(scores: DataFrame, edges: DataFrame, keep: float = 0.85, steps: int = 5) -> DataFrame:
    """Scores after a walk with restart: each step moves along row-normalised edges, and restarts by 1 - keep.

    A graph that is counted small is sent, and an image takes all its steps in one pass; with a larger one each step joins and
    groups.
    """
    out = Window.partitionBy("a")
    moves = edges.withColumn("w", F.col("w") / F.sum("w").over(out)).select("a", "b", "w")

    def walked(x: np.ndarray, present: np.ndarray, push: Push) -> np.ndarray:
        at = x
        for _ in range(steps):
            at = np.where(present, keep * push(at) + (1 - keep) * x, 0.0)
        return at

    if (sent := on_graph(scores, "prob", moves, walked, "score")) is not None:
        return sent
    start = scores.select("image_id", "species_id", F.col("prob").alias("s0"))
    at = start.withColumn("s", F.col("s0"))
    for _ in range(steps):
        moved = at.join(moves, at.species_id == moves.a).groupBy("image_id", F.col("b").alias("species_id")).agg(F.sum(F.col("s") * F.col("w")).alias("m"))
        at = start.join(moved, ["image_id", "species_id"], "left").withColumn("s", keep * F.coalesce("m", F.lit(0.0)) + (1 - keep) * F.col("s0")).drop("m")
    return at.select("image_id", "species_id", F.col("s").alias("score"))


def weighted_ensemble(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean of models' scores by weights, which must be positive for every model and are normalised.

    scores: (model_id, image_id, species_id, prob).
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("every model needs a positive weight")
    total = sum(weights.values())
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)])
    return scores.groupBy("image_id", "species_id").agg(F.sum(w[F.col("model_id")] * F.col("prob")).alias("score"))


def complete_axes(scores: DataFrame) -> DataFrame:
    """(image_id, models, species): images whose models do not all score the same number of species."""
    per = scores.groupBy("image_id", "model_id").agg(F.count_distinct("species_id").alias("n"))
    n_models = scores.select("model_id").distinct().agg(F.count("*").alias("models"))
    whole = per.groupBy("image_id").agg(F.count("*").alias("have"), F.min("n").alias("least"), F.max("n").alias("most"))
    return whole.crossJoin(F.broadcast(n_models)).where("have <> models or least <> most")


def blend(a: Column, b: Column, weight: float, geometric: bool = False, eps: float = 1e-8) -> Column:
    """weight * a + (1 - weight) * b, or the same of their logs."""
    if geometric:
        return F.exp(weight * F.log(F.greatest(a, F.lit(eps))) + (1 - weight) * F.log(F.greatest(b, F.lit(eps))))
    return weight * a + (1 - weight) * b


def geometric_mean(parts: dict[str, float], eps: float = 1e-8) -> Column:
    """Weighted geometric mean of columns."""
    total = sum(parts.values())
    return F.exp(sum(w / total * F.log(F.greatest(F.col(c), F.lit(eps))) for c, w in parts.items()))


def reciprocal_ranks(lists: DataFrame, k: int = 60) -> DataFrame:
    """Fusion of ranked lists: (list_id, image_id, ids array) to (image_id, species_id, score)."""
    each = lists.select("image_id", F.posexplode("ids").alias("pos", "species_id"))
    return each.groupBy("image_id", "species_id").agg(F.sum(1.0 / (k + F.col("pos") + 1)).alias("score"))


def weighted_ranks(scores: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Weighted fusion of dense score lists by rank from zero: (model_id, image_id, species_id, prob)."""
    rk = ranked(scores, ["model_id", "image_id"], "prob", "r")
    w = F.create_map(*[F.lit(x) for m, v in weights.items() for x in (m, float(v))])
    return rk.groupBy("image_id", "species_id").agg(F.sum(w[F.col("model_id")] / (k + F.col("r") - 1)).alias("score"))


def energy(scores: DataFrame, least: float) -> DataFrame:
    """(image_id, energy, low): minus the log-sum-exp of an image's logits, and whether its best probability is low."""
    m = scores.withColumn("m", F.max("logit").over(_image()))
    return m.groupBy("image_id").agg((-(F.max("m") + F.log(F.sum(F.exp(F.col("logit") - F.col("m")))))).alias("energy"), (F.max("prob") < least).alias("low"))


def focusing(counts: DataFrame) -> DataFrame:
    """(species_id, gamma): 2 + clamp(4 ln(neg / pos) / ln(neg), 0, 4)."""
    t = _summed(counts, F.col("n"))
    neg = F.greatest(F.col("total") - F.col("n"), F.lit(1))
    x = 4 * F.log(neg / F.greatest(F.col("n"), F.lit(1))) / F.greatest(F.log(neg), F.lit(TINY))
    return t.select("species_id", (2 + F.least(F.greatest(x, F.lit(0.0)), F.lit(4.0))).alias("gamma"))


def month_gate(scores: DataFrame, masks: DataFrame, month: Column) -> DataFrame:
    """Scores of zero outside the months of a species' mask; without a mask all months pass."""
    t = scores.join(masks, "species_id", "left")
    open_ = F.call_function("shiftright", F.coalesce("mask", F.lit(4095)).cast("int"), (month - 1).cast("int")).bitwiseAND(F.lit(1)) == 1
    return t.select("image_id", "species_id", F.when(open_, F.col("prob")).otherwise(0.0).alias("score"))
