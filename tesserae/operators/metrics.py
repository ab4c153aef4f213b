"""Evaluation of predictions against truths: (image_id, species_id) pairs, predictions with rank and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.ordinals import numbered


def per_image(pred: DataFrame, truth: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, tp, n_pred, n_true) for each of the images, zeros where it has none."""
    hit = pred.select("image_id", "species_id", F.lit(1).alias("p")).unionByName(truth.select("image_id", "species_id").withColumn("t", F.lit(1)), allowMissingColumns=True)
    both = hit.groupBy("image_id", "species_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    n = both.groupBy("image_id").agg(F.count(F.expr("p + t")).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    return images.select("image_id").distinct().join(n, "image_id", "left").fillna(0, ["tp", "n_pred", "n_true"])


def sample_f1(tp: Column, n_pred: Column, n_true: Column, both_empty: float) -> Column:
    return F.when(n_pred + n_true == 0, F.lit(both_empty)).otherwise(2.0 * tp / (n_pred + n_true))


def mean_sample_f1(pred: DataFrame, truth: DataFrame, images: DataFrame, both_empty: float = 0.0) -> DataFrame:
    f = sample_f1(F.col("tp"), F.col("n_pred"), F.col("n_true"), both_empty)
    return per_image(pred, truth, images).agg(F.avg(f).alias("f1"))


def transect_f1(pred: DataFrame, truth: DataFrame, images: DataFrame, transect: Column, both_empty: float = 0.0) -> DataFrame:
    """Mean over transects of their images' mean F1."""
    f = sample_f1(F.col("tp"), F.col("n_pred"), F.col("n_true"), both_empty)
    return per_image(pred, truth, images).groupBy(transect.alias("transect")).agg(F.avg(f).alias("f")).agg(F.avg("f").alias("f1"))


def label_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(species_id, tp, fp, fn) over all labels that are true or predicted."""
    p = pred.select("image_id", "species_id").withColumn("p", F.lit(1))
    t = truth.select("image_id", "species_id").withColumn("t", F.lit(1))
    both = p.join(t, ["image_id", "species_id"], "full_outer")
    return both.groupBy("species_id").agg(F.count(F.expr("p + t")).alias("tp"), (F.count("p") - F.count(F.expr("p + t"))).alias("fp"), (F.count("t") - F.count(F.expr("p + t"))).alias("fn"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def label_f1(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: macro, weighted and micro F1 over labels."""
    c = label_counts(pred, truth).withColumn("f", f1_of(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("n", F.col("tp") + F.col("fn"))
    micro = f1_of(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return c.agg(F.avg("f").alias("macro"), (F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("weighted"), micro.alias("micro"))


def label_f1_sweep(leveled: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, macro, weighted, micro): label_f1 of what each threshold of an ascending grid keeps, from one aggregate.

    leveled: (image_id, species_id, level) of selection.levels, of which a row is kept by the first `level` thresholds. Hits are
    counted by species and level; a species' F1 changes only at its own levels, so each of its stretches adds its F1 where it
    begins and takes it off where it ends, and sums along the grid give all thresholds.
    """
    size = len(grid)
    hit = leveled.where("level > 0").join(truth.select("image_id", "species_id", F.lit(1).alias("hit")), ["image_id", "species_id"], "left")
    per = hit.groupBy("species_id", "level").agg(F.count("*").alias("p"), F.count("hit").alias("tp"))
    true = truth.groupBy("species_id").agg(F.count("*").alias("n"))
    down = Window.partitionBy("species_id").orderBy(F.desc("level"))
    step = per.select("species_id", F.lead("level", 1, 0).over(down).alias("from"), F.col("level").alias("to"), F.sum("p").over(down).alias("p"), F.sum("tp").over(down).alias("tp"))
    step = step.join(true, "species_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    f = f1_of(F.col("tp"), F.col("p") - F.col("tp"), F.col("n") - F.col("tp"))
    step = step.withColumns({"f": f, "w": f * F.col("n"), "new": (F.col("n") == 0).cast("int")})
    values = ["f", "w", "new", "p", "tp"]
    ends = F.explode(F.array(F.struct(F.col("from").alias("j"), F.lit(1).alias("sign")), F.struct(F.col("to").alias("j"), F.lit(-1).alias("sign")))).alias("e")
    change = step.select(*values, ends).groupBy("e.j").agg(*[F.sum(F.col(v) * F.col("e.sign")).alias(v) for v in values])
    totals = true.agg(F.count("*").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    one = change.agg(F.collect_list(F.struct("j", *values)).alias("changes")).join(totals)  # one row each
    upto = lambda v: F.aggregate(F.array_sort("changes"), F.lit(0.0), lambda s, c: s + F.when(c["j"] <= F.col("k"), c[v]).otherwise(0))
    points = F.posexplode(F.array(*[F.lit(float(g)) for g in grid[:size]])).alias("k", "threshold")
    t = one.select("changes", "labels", "all", points).select("threshold", "labels", "all", *[upto(v).alias(v) for v in values])
    return t.where("labels + new > 0").select("threshold", (F.col("f") / (F.col("labels") + F.col("new"))).alias("macro"), F.when(F.col("all") > 0, F.col("w") / F.col("all")).alias("weighted"), F.when(F.col("p") + F.col("all") > 0, 2 * F.col("tp") / (F.col("p") + F.col("all"))).otherwise(0.0).alias("micro"))


def topk_curve(ranked: DataFrame, truth: DataFrame, images: DataFrame, ks: list[int]) -> DataFrame:
    """(k, accuracy): share of images with a true species among their best k."""
    first = ranked.join(truth, ["image_id", "species_id"]).groupBy("image_id").agg(F.min("rank").alias("first"))
    all_ = images.select("image_id").distinct().join(first, "image_id", "left")
    return all_.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "first").groupBy("k").agg(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("accuracy"))


def precision_recall_at(ranked: DataFrame, truth: DataFrame, images: DataFrame, ks: list[int]) -> DataFrame:
    """(k, precision, recall, f1), micro over images."""
    t = truth.join(images.select("image_id").distinct(), "image_id", "left_semi")
    hits = ranked.join(t.withColumn("t", F.lit(1)), ["image_id", "species_id"], "left").select("rank", F.coalesce("t", F.lit(0)).alias("t"))
    each = hits.select("t", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k").groupBy("k").agg(F.sum("t").alias("tp"), F.count("*").alias("p"))
    x = each.crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))
    return x.select("k", (F.col("tp") / F.col("p")).alias("precision"), (F.col("tp") / F.col("n")).alias("recall"), (2.0 * F.col("tp") / (F.col("p") + F.col("n"))).alias("f1"))


def query_recall(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall at k, micro precision, recall and F1 by set sizes, and macro recall by species.

    False positives of an image are its predictions less one, zero at least.
    """
    top = ranked.where(F.col("rank") <= k)
    n = top.groupBy("image_id").agg(F.count("*").alias("n"))
    hit = top.join(truth, ["image_id", "species_id"]).select("image_id", "species_id", F.lit(1).alias("hit"))
    t = truth.join(hit, ["image_id", "species_id"], "left").join(n, "image_id", "left").fillna(0, ["hit", "n"])
    per = t.groupBy("species_id").agg(F.avg("hit").alias("r"), F.sum("hit").alias("h"), F.count("*").alias("c"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("fp"))
    tp, fp, all_ = F.sum("h"), F.sum("fp"), F.sum("c")
    return per.agg((tp / all_).alias("recall_at_k"), (tp / (tp + fp)).alias("precision"), (2.0 * tp / (tp + fp + all_)).alias("f1"), F.avg("r").alias("macro_recall"))


def species_accuracy(top1: DataFrame, truth: DataFrame, train: DataFrame) -> DataFrame:
    """(species_id, n, accuracy, f1, n_train), with the images of training."""
    c = label_counts(top1, truth)
    return c.where("tp + fn > 0").join(train.withColumnRenamed("n", "n_train"), "species_id", "left").select("species_id", (F.col("tp") + F.col("fn")).alias("n"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("accuracy"), f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), F.coalesce("n_train", F.lit(0)).alias("n_train"))


def group_accuracy(top1: DataFrame, truth: DataFrame, taxonomy: DataFrame, level: str) -> DataFrame:
    """(level, n, accuracy) of truths whose group the top prediction of the image meets."""
    t = truth.join(taxonomy.select("species_id", F.col(level).alias("g")), "species_id").select("image_id", "species_id", "g")
    p = top1.join(taxonomy.select("species_id", F.col(level).alias("pg")), "species_id").select("image_id", "pg")
    return t.join(p, "image_id", "left").groupBy(F.col("g").alias(level)).agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("g") == F.col("pg")).cast("int"), F.lit(0))).alias("accuracy"))


def confusion(top1: DataFrame, truth: DataFrame, taxonomy: DataFrame, level: str) -> DataFrame:
    """(true_group, pred_group, share): a row-normalised confusion of groups."""
    tx = taxonomy.select("species_id", F.col(level).alias("g"))
    t = truth.join(tx.withColumnRenamed("g", "true_group"), "species_id").select("image_id", "true_group")
    p = top1.join(tx.withColumnRenamed("g", "pred_group"), "species_id").select("image_id", "pred_group")
    c = t.join(p, "image_id").groupBy("true_group", "pred_group").agg(F.count("*").alias("c"))
    return c.select("true_group", "pred_group", (F.col("c") / F.sum("c").over(Window.partitionBy("true_group"))).alias("share"))


def most_confused(top1: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """(true_id, pred_id, count): the n most frequent wrong pairs; ties by ids."""
    t, p = truth.withColumnRenamed("species_id", "true_id"), top1.select("image_id", F.col("species_id").alias("pred_id"))
    return t.join(p, "image_id").where("true_id <> pred_id").groupBy("true_id", "pred_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "true_id", "pred_id").limit(n)


def predicted_and_true(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(species_id, n_pred, n_true), zeros where a species has none."""
    p, t = pred.groupBy("species_id").agg(F.count("*").alias("n_pred")), truth.groupBy("species_id").agg(F.count("*").alias("n_true"))
    return p.join(t, "species_id", "full_outer").fillna(0, ["n_pred", "n_true"])


def head_tail(top1: DataFrame, truth: DataFrame, train: DataFrame, share: float = 0.2) -> DataFrame:
    """(part, n, accuracy) for the classes most frequent in training, a share of all, and the rest."""
    c = numbered(train, F.desc("n"), F.asc("species_id"), out="r")
    part = c.select("species_id", F.when(F.col("r") < F.floor(F.lit(share) * c.count()), "head").otherwise("tail").alias("part"))
    hit = top1.select("image_id", "species_id", F.lit(1).alias("hit"))
    t = truth.join(hit, ["image_id", "species_id"], "left").join(part, "species_id", "left").fillna("tail", ["part"])
    return t.groupBy("part").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))


def masked_accuracy(top1: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: accuracy of (image_id, species_id) labels, -1 left out."""
    x = labels.where("species_id <> -1").join(top1.select("image_id", F.col("species_id").alias("p")), "image_id", "left")
    return x.agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("species_id") == F.col("p")).cast("int"), F.lit(0))).alias("accuracy"))


def set_constancy(ranked: DataFrame, k: int) -> DataFrame:
    """One row: images, and distinct sets of their best k species."""
    sets = ranked.where(F.col("rank") <= k).groupBy("image_id").agg(F.sort_array(F.collect_set("species_id")).alias("s"))
    return sets.agg(F.count("*").alias("images"), F.count_distinct("s").alias("sets"))


def difficulty(top1: DataFrame, truth: DataFrame) -> DataFrame:
    """(species_id, n, accuracy, level) with levels HARD under 0.3, MEDIUM under 0.7, EASY."""
    t = truth.join(top1.select("image_id", "species_id", F.lit(1).alias("hit")), ["image_id", "species_id"], "left")
    a = t.groupBy("species_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))
    return a.withColumn("level", F.when(F.col("accuracy") < 0.3, "HARD").when(F.col("accuracy") < 0.7, "MEDIUM").otherwise("EASY"))


def mean_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean overlap of the sets of images that both have, and the share of equal sets."""
    x, y = (d.groupBy("image_id").agg(F.collect_set("species_id").alias(n)) for d, n in ((a, "x"), (b, "y")))
    j = x.join(y, "image_id").select((F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("j"))
    return j.agg(F.avg("j").alias("jaccard"), F.avg((F.col("j") == 1).cast("int")).alias("equal"))
