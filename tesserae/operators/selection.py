"""Which species of an image are predicted. Scores are (image_id, species_id, score); ties go to the smaller id."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tesserae.functions.columns import ranked
from tesserae.functions.lineage import cut
from tesserae.functions.orders import order_statistic


def _image() -> WindowSpec:
    return Window.partitionBy("image_id")


def _so_far() -> WindowSpec:
    """From the best species down to the row's own rank."""
    return _image().orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ranked(scores: DataFrame) -> DataFrame:
    return ranked(scores, ["image_id"])


def _out(df: DataFrame) -> DataFrame:
    """Kept rows, ranked anew from one."""
    return ranked(df, ["image_id"]).select("image_id", "rank", "species_id", "score")


def fixed_topk(scores: DataFrame, k: int) -> DataFrame:
    return _ranked(scores).where(F.col("rank") <= k).select("image_id", "rank", "species_id", "score")


def threshold(scores: DataFrame, least: float, min_k: int = 1, max_k: int = 10) -> DataFrame:
    """As many of the best as reach the threshold, min_k to max_k."""
    n = F.least(F.greatest(F.sum((F.col("score") >= least).cast("int")).over(_image()), F.lit(min_k)), F.lit(max_k))
    return _ranked(scores).withColumn("n", n).where("rank <= n").select("image_id", "rank", "species_id", "score")


def relative(scores: DataFrame, share: float, min_k: int = 1, max_k: int = 10) -> DataFrame:
    """As many as reach the best score less a share of it."""
    n = F.sum((F.col("score") >= F.col("top") * (1 - share)).cast("int")).over(_image())
    top = _ranked(scores).withColumn("top", F.max("score").over(_image()))
    return top.withColumn("n", F.least(F.greatest(n, F.lit(min_k)), F.lit(max_k))).where("rank <= n").select("image_id", "rank", "species_id", "score")


def gap(scores: DataFrame, drop: float, min_k: int = 1, max_k: int = 10) -> DataFrame:
    """The best up to the first relative drop of `drop` or more within max_k, else max_k."""
    r = _ranked(scores).where(F.col("rank") <= max_k + 1).withColumn("next", F.lead("score").over(_image().orderBy("rank")))
    falls = (F.col("rank") >= min_k) & (F.col("rank") < max_k) & (F.col("score") > 0) & ((F.col("score") - F.col("next")) / F.col("score") >= drop)
    cut_at = F.coalesce(F.min(F.when(falls, F.col("rank"))).over(_image()), F.lit(max_k))
    return r.withColumn("n", cut_at).where("rank <= n").select("image_id", "rank", "species_id", "score")


def per_class(scores: DataFrame, thresholds: DataFrame, default: float, top_k: int, min_k: int = 1) -> DataFrame:
    """Scores that reach their class's threshold, top_k at most, filled up to min_k by the best others."""
    t = _ranked(scores.join(thresholds, "species_id", "left").withColumn("ok", F.col("score") >= F.coalesce("threshold", F.lit(default))))
    t = t.withColumn("kept", F.row_number().over(_image().orderBy(F.desc("ok"), "rank"))).withColumn("n", F.greatest(F.least(F.sum(F.col("ok").cast("int")).over(_image()), F.lit(top_k)), F.lit(min_k)))
    return _out(t.where("kept <= n"))


def stop_at_failure(scores: DataFrame, thresholds: DataFrame, default: float, top_n: int) -> DataFrame:
    """The best top_n up to the first that misses its class's threshold."""
    t = _ranked(scores).where(F.col("rank") <= top_n).join(thresholds, "species_id", "left")
    missed = F.max((F.col("score") < F.coalesce("threshold", F.lit(default))).cast("int")).over(_so_far())
    return t.withColumn("missed", missed).where("missed = 0").select("image_id", "rank", "species_id", "score")


def scan_all(scores: DataFrame, thresholds: DataFrame, default: float, top_n: int, min_preds: int) -> DataFrame:
    """All that reach their class's threshold, then the best top_n; the best min_preds if fewer do."""
    t = _ranked(scores.join(thresholds, "species_id", "left").withColumn("ok", F.col("score") >= F.coalesce("threshold", F.lit(default))))
    t = t.withColumn("oks", F.sum(F.col("ok").cast("int")).over(_image())).withColumn("okrank", F.sum(F.col("ok").cast("int")).over(_so_far()))
    return _out(t.where(F.when(F.col("oks") >= min_preds, F.col("ok") & (F.col("okrank") <= top_n)).otherwise(F.col("rank") <= min_preds)))


def cap_first(scores: DataFrame, least: float, top_k: int, min_preds: int) -> DataFrame:
    """The best top_k, then those of them that reach the threshold; the best min_preds if fewer do."""
    t = _ranked(scores).where(F.col("rank") <= top_k)
    return t.where((F.col("score") >= least) | (F.col("rank") <= min_preds)).select("image_id", "rank", "species_id", "score")


def top1_and_candidates(scores: DataFrame, thresholds: DataFrame, default: float = 0.05, candidates: int = 20) -> DataFrame:
    """The best always, and others of the best `candidates` above their class's threshold."""
    t = _ranked(scores).join(thresholds, "species_id", "left")
    return _out(t.where((F.col("rank") == 1) | ((F.col("rank") <= candidates) & (F.col("score") > F.coalesce("threshold", F.lit(default))))))


def safety_net(selected: DataFrame, raw: DataFrame, net: int, cap: int) -> DataFrame:
    """Selected species and the best `net` by raw score, cap at most by raw score."""
    both = selected.select("image_id", "species_id").union(fixed_topk(raw, net).select("image_id", "species_id")).distinct()
    return fixed_topk(both.join(raw, ["image_id", "species_id"]), cap)


def pseudo_labels(scores: DataFrame, tau: float, cap: int, least: int) -> DataFrame:
    """Scores from tau, cap an image at most, for images with `least` species or more."""
    t = _ranked(scores.where(F.col("score") >= tau)).where(F.col("rank") <= cap).withColumn("n", F.count("*").over(_image()))
    return t.where(F.col("n") >= least).select("image_id", "rank", "species_id", "score")


def conformal_calibrate(scores: DataFrame, truth: DataFrame, alpha: float) -> DataFrame:
    """One row, q: the least cumulative score, at true labels, that covers 1 - alpha of them.

    It is the order statistic at ceil((n - 1) min(1, (1 - alpha)(n + 1) / n)), from zero,
    found by counts of ever narrower ranges.
    """
    cum = cut(_ranked(scores).withColumn("cum", F.sum("score").over(_so_far())).join(truth, ["image_id", "species_id"]).select("cum"))
    n = cum.count()
    at = math.ceil((n - 1) * min(1.0, (1 - alpha) * (n + 1) / n) - 1e-12) if n else 0
    return scores.sparkSession.createDataFrame([(order_statistic(cum, "cum", at),)], "q double")


def conformal_set(scores: DataFrame, q: float) -> DataFrame:
    """The best up to the first whose cumulative score passes q, it included."""
    t = _ranked(scores).withColumn("cum", F.sum("score").over(_so_far()))
    return t.where((F.col("cum") - F.col("score")) <= q).select("image_id", "rank", "species_id", "score")


def conformal_rollup(chosen: DataFrame, taxonomy: DataFrame, max_size: int) -> DataFrame:
    """(image_id, size, genus_id): sets above max_size name their most frequent genus, ties the smaller."""
    per = chosen.join(taxonomy, "species_id").groupBy("image_id", "genus_id").agg(F.count("*").alias("c"))
    best = per.groupBy("image_id").agg(F.sum("c").alias("size"), F.max_by("genus_id", F.struct("c", -F.col("genus_id"))).alias("genus_id"))
    return best.select("image_id", "size", F.when(F.col("size") > max_size, F.col("genus_id")).alias("genus_id"))


def conformal_clamped(scores: DataFrame, q: float, min_k: int, top_k: int) -> DataFrame:
    """A conformal set of scores that are normalised first, min_k to top_k species."""
    s = scores.withColumn("share", F.col("score") / F.sum("score").over(_image()))
    t = _ranked(s).withColumn("cum", F.sum("share").over(_so_far()))
    n = F.least(F.greatest(F.sum(((F.col("cum") - F.col("share")) <= q).cast("int")).over(_image()), F.lit(min_k)), F.lit(top_k))
    return t.withColumn("n", n).where("rank <= n").select("image_id", "rank", "species_id", "score")


def target_threshold(scores: DataFrame, mean_predictions: float) -> DataFrame:
    """One row, threshold: the score that the mean number of predictions an image asks for.

    It is the (images x mean)th largest score, found by counts of ever narrower ranges.
    """
    n, images = scores.agg(F.count("score"), F.count_distinct("image_id")).first()
    found = order_statistic(scores, "score", n - max(1, math.floor(images * mean_predictions)))
    return scores.sparkSession.createDataFrame([(found,)], "threshold double")


def best_thresholds(scores: DataFrame, truth: DataFrame, grid: list[float], strict: bool, unseen: float, min_positives: int = 0, fallback: float | None = None) -> DataFrame:
    """(species_id, threshold, f1) of largest F1 over the grid, the first of equals.

    Each score falls into the bucket of the largest grid value it passes; counts by bucket,
    summed from above, are the true and false positives of every grid value in one
    pass. Classes without truths get `unseen`; with fewer than min_positives, the fallback.
    """
    g = F.array(*[F.lit(float(x)) for x in grid])
    s = F.col("score")
    bucket = F.size(F.filter(g, (lambda x: x < s) if strict else (lambda x: x <= s)))
    t = scores.join(truth.withColumn("y", F.lit(1)), ["image_id", "species_id"], "left").select("species_id", bucket.alias("b"), F.coalesce("y", F.lit(0)).alias("y"))
    per = t.groupBy("species_id", "b").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    classes = per.groupBy("species_id").agg(F.sum("p").alias("pos"))
    steps = classes.select("species_id", "pos", F.posexplode(g).alias("i", "threshold"))
    at = steps.join(per.select("species_id", "b", "p", "c"), "species_id").where(F.col("b") > F.col("i")).groupBy("species_id", "i").agg(F.sum("p").alias("tp"), F.sum("c").alias("predicted"))
    f = steps.join(at, ["species_id", "i"], "left").fillna(0, ["tp", "predicted"])
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("predicted") + F.col("pos"))).otherwise(0.0)
    best = f.withColumn("f1", f1).groupBy("species_id").agg(F.first("pos").alias("pos"), F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("i"))).alias("x"))
    few = F.col("pos") < max(1, min_positives)
    value = F.when(F.col("pos") == 0, F.lit(unseen)).when(few, F.lit(unseen if fallback is None else fallback)).otherwise(F.col("x.threshold"))
    return best.select("species_id", value.alias("threshold"), F.when(few, 0.0).otherwise(F.col("x.f1")).alias("f1"))


def ambiguous(scores: DataFrame, margin: float = 0.15) -> DataFrame:
    """(image_id, margin, ambiguous): the best score less the second."""
    t = _ranked(scores).where("rank <= 2").groupBy("image_id").agg((F.max("score") - F.min("score")).alias("margin"))
    return t.withColumn("ambiguous", F.col("margin") < margin)


def greedy_compatible(scores: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Species by score, each kept only if it is next to all kept before it, until there are k.

    Candidates of an image are one array, best first, with their neighbours; a fold keeps
    or skips each. Zero and negative scores are never kept.
    """
    near = edges.groupBy(F.col("a").alias("species_id")).agg(F.collect_set("b").alias("near"))
    t = scores.where("score > 0").join(near, "species_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    rows = t.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("species_id").cast("int").alias("species_id"), "near"))).alias("c"))
    fits = lambda kept, x: (F.size(kept) < k) & (F.size(F.array_except(kept, x["near"])) == 0)
    kept = F.aggregate("c", F.array().cast("array<int>"), lambda a, x: F.when(fits(a, x), F.concat(a, F.array(x["species_id"]))).otherwise(a))
    return rows.select("image_id", F.posexplode(kept).alias("pos", "species_id")).select("image_id", (F.col("pos") + 1).alias("rank"), "species_id")


def levels(ranked: DataFrame, grid: list[float], min_k: int) -> DataFrame:
    """ranked with `level`: how many thresholds of an ascending grid keep a row; the best min_k are kept by all."""
    if sorted(set(grid)) != list(grid):
        raise ValueError("a grid is ascending and without repeats")
    points = F.array(*[F.lit(float(g)) for g in grid])
    reached = F.size(F.filter(points, lambda g: g <= F.col("score")))
    return ranked.withColumn("level", F.when(F.col("rank") <= min_k, len(grid)).otherwise(reached))


def sweep(scores: DataFrame, grid: list[float], min_k: int, max_k: int) -> DataFrame:
    """(threshold, mean_k, n_species) for each threshold of a grid that keeps any row, from one aggregate of the scores.

    A row's level tells for which thresholds it is kept. Rows by level, and images and species by their highest
    level, are counted together; what a threshold keeps is the sum of the levels above it.
    """
    grid = sorted({float(g) for g in grid})
    t = levels(_ranked(scores).where(F.col("rank") <= max_k).select("image_id", "rank", "species_id", "score"), grid, min_k).where("level > 0")
    of = F.grouping_id()
    highest = t.groupingSets([["image_id"], ["species_id"], ["level"]], "image_id", "species_id", "level").agg(of.alias("of"), F.count("*").alias("n"), F.max(F.col("level")).alias("top"))
    # grouping_id has a bit for each column that is not grouped by: 3 by image, 5 by species, 6 by level.
    per = highest.groupBy("of", F.coalesce("level", "top").alias("level")).agg(F.sum(F.when(F.col("of") == 6, F.col("n")).otherwise(1)).alias("n"))
    held = per.agg(F.collect_list(F.struct("of", "level", "n")).alias("held"))  # three times the grid at most
    above = lambda j, kind: F.aggregate("held", F.lit(0).cast("bigint"), lambda s, h: s + F.when((h["of"] == kind) & (h["level"] > j), h["n"]).otherwise(0))
    points = F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("j", "threshold")
    out = held.select("held", points).select("threshold", above(F.col("j"), 6).alias("rows"), above(F.col("j"), 3).alias("images"), above(F.col("j"), 5).alias("n_species"))
    return out.where("rows > 0").select("threshold", (F.col("rows") / F.col("images")).alias("mean_k"), "n_species")


SELECTIONS = {"fixed_topk": fixed_topk, "threshold": threshold, "relative": relative, "gap": gap}
