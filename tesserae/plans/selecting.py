"""Selection and evaluation queries over image scores; truths are the labels of an image's tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.columns import ranked
from tesserae.operators import metrics as M
from tesserae.operators import selection as K
from tesserae.operators import scores as S
from tesserae.plans.pooling import soft
from tesserae.plans.registry import query, r
from tesserae.plans.scoring import EDGES, IMG, TAX, images
from tesserae.plans.views import COUNTS, TRUTH, counts, taxonomy, tile_arrays, truth

BEST = IMG + ", k AS (SELECT image_id, species_id, prob AS score, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, species_id) AS rank FROM img)"
#: Thresholds by class: three quarters of the classes have one.
THR = "thr AS (SELECT DISTINCT species_id, 0.0155 + (species_id % 7) * 0.0004 AS threshold FROM tile WHERE species_id % 4 <> 0), kt AS (SELECT k.*, coalesce(threshold, 0.0168) AS t FROM k LEFT JOIN thr USING (species_id))"
OUT = f"SELECT image_id, CAST(rank AS INT) AS rank, species_id, {r('score', 'score')}"
RERANK = f"SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, species_id) AS INT) AS rank, species_id, {r('score', 'score')}"
T = 0.0172


def scored(spark, sf):
    return images(spark, sf).select("image_id", "species_id", F.col("prob").alias("score"))


def thresholds(spark, sf):
    s = F.col("species_id")
    return taxonomy(spark, sf).where(s % 4 != 0).select("species_id", (0.0155 + (s % 7) * 0.0004).alias("threshold"))


def base(spark, sf):
    return tile_arrays(spark, sf).select("image_id")


_SELECT = {
    "k01_fixed_topk": (lambda s, f: K.fixed_topk(scored(s, f), 4), f"{BEST} {OUT} FROM k WHERE rank <= 4"),
    "k02_threshold": (lambda s, f: K.threshold(scored(s, f), T, 1, 8), f"{BEST}, n AS (SELECT image_id, least(greatest(sum(CASE WHEN score >= {T} THEN 1 ELSE 0 END), 1), 8) AS n FROM k GROUP BY 1) {OUT} FROM k JOIN n USING (image_id) WHERE rank <= n"),
    "k03_relative": (lambda s, f: K.relative(scored(s, f), 0.04, 1, 8), f"{BEST}, m AS (SELECT image_id, max(score) AS m FROM k GROUP BY 1), n AS (SELECT image_id, least(greatest(sum(CASE WHEN score >= m * 0.96 THEN 1 ELSE 0 END), 1), 8) AS n FROM k JOIN m USING (image_id) GROUP BY 1) {OUT} FROM k JOIN n USING (image_id) WHERE rank <= n"),
    "k04_gap": (lambda s, f: K.gap(scored(s, f), 0.015, 1, 8), f"{BEST}, g AS (SELECT *, lead(score) OVER (PARTITION BY image_id ORDER BY rank) AS nx FROM k), c AS (SELECT image_id, coalesce(min(CASE WHEN rank < 8 AND (score - nx) / score >= 0.015 THEN rank END), 8) AS n FROM g GROUP BY 1) {OUT} FROM k JOIN c USING (image_id) WHERE rank <= n"),
    "k05_per_class": (lambda s, f: K.per_class(scored(s, f), thresholds(s, f), 0.0168, 6, 2), f"{BEST}, {THR}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score >= t DESC, rank) AS kept, greatest(least(sum(CASE WHEN score >= t THEN 1 ELSE 0 END) OVER (PARTITION BY image_id), 6), 2) AS n FROM kt) {RERANK} FROM o WHERE kept <= n"),
    "k06_stop_at_failure": (lambda s, f: K.stop_at_failure(scored(s, f), thresholds(s, f), 0.0168, 6), f"{BEST}, {THR}, m AS (SELECT *, max(CASE WHEN score < t THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS miss FROM kt WHERE rank <= 6) {OUT} FROM m WHERE miss = 0"),
    "k07_scan_all": (lambda s, f: K.scan_all(scored(s, f), thresholds(s, f), 0.0168, 5, 2), f"{BEST}, {THR}, o AS (SELECT *, sum(CASE WHEN score >= t THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS oks, sum(CASE WHEN score >= t THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS okr FROM kt) {RERANK} FROM o WHERE CASE WHEN oks >= 2 THEN score >= t AND okr <= 5 ELSE rank <= 2 END"),
    "k08_cap_first": (lambda s, f: K.cap_first(scored(s, f), T, 5, 2), f"{BEST} {OUT} FROM k WHERE rank <= 5 AND (score >= {T} OR rank <= 2)"),
    "k09_top1_and_candidates": (lambda s, f: K.top1_and_candidates(scored(s, f), thresholds(s, f), 0.0168, 8), f"{BEST}, {THR} {RERANK} FROM kt WHERE rank = 1 OR (rank <= 8 AND score > t)"),
    "k10_safety_net": (lambda s, f: K.safety_net(K.cap_first(scored(s, f), T, 9, 0), scored(s, f), 2, 4), f"{BEST} {RERANK} FROM k WHERE rank <= 4 AND (score >= {T} OR rank <= 2)"),
    "k11_pseudo_labels": (lambda s, f: K.pseudo_labels(scored(s, f), T, 5, 2), f"{BEST}, n AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM k WHERE score >= {T} AND rank <= 5) {OUT} FROM n WHERE n >= 2"),
    "k13_conformal_set": (lambda s, f: K.conformal_set(scored(s, f), 0.3), f"{BEST}, c AS (SELECT *, sum(score) OVER (PARTITION BY image_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM k) {OUT} FROM c WHERE cum - score <= 0.3"),
    "k15_conformal_clamped": (lambda s, f: K.conformal_clamped(scored(s, f), 0.3, 2, 12), f"{BEST}, c AS (SELECT *, sum(score) OVER (PARTITION BY image_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - score AS cum, sum(score) OVER (PARTITION BY image_id) AS tot FROM k), n AS (SELECT image_id, least(greatest(sum(CASE WHEN cum / tot <= 0.3 THEN 1 ELSE 0 END), 2), 12) AS n FROM c GROUP BY 1) {OUT} FROM k JOIN n USING (image_id) WHERE rank <= n"),
}
for _name, (_f, _sql) in _SELECT.items():
    query(_name, _sql)(lambda spark, sf, f=_f: f(spark, sf).withColumn("rank", F.col("rank").cast("int")))


@query("k12_conformal_calibrate", f"{BEST}, {TRUTH}, c AS (SELECT *, sum(score) OVER (PARTITION BY image_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM k), t AS (SELECT cum, row_number() OVER (ORDER BY cum) - 1 AS i, count(*) OVER () AS n FROM c JOIN truth USING (image_id, species_id)) SELECT {r('min(cum)', 'q')} FROM t WHERE i >= ceil((n - 1) * least(1.0, 0.9 * (n + 1) / n) - 1e-12)")
def k12(spark, sf):
    return K.conformal_calibrate(scored(spark, sf), truth(spark, sf), 0.1)


@query("k14_conformal_rollup", f"{BEST}, {TAX}, c AS (SELECT *, sum(score) OVER (PARTITION BY image_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM k), g AS (SELECT image_id, genus_id, count(*) AS n FROM c JOIN tax USING (species_id) WHERE cum - score <= 0.3 GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS size, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, genus_id) AS i FROM g) SELECT image_id, CAST(size AS BIGINT) AS size, CAST(CASE WHEN size > 11 THEN genus_id END AS INT) AS genus_id FROM b WHERE i = 1")
def k14(spark, sf):
    return K.conformal_rollup(K.conformal_set(scored(spark, sf), 0.3), taxonomy(spark, sf), 11)


@query("k16_sweep", f"{BEST}, s AS (SELECT threshold, image_id, species_id FROM k, (VALUES (0.0165), (0.017), (0.0175)) g(threshold) WHERE rank <= 8 AND (score >= threshold OR rank <= 1)) SELECT CAST(threshold AS DOUBLE) AS threshold, {r('count(*) / count(DISTINCT image_id)', 'mean_k')}, count(DISTINCT species_id) AS n_species FROM s GROUP BY 1")
def k16(spark, sf):
    return K.sweep(scored(spark, sf), [0.0165, 0.017, 0.0175], 1, 8)


@query("k17_target_threshold", f"{BEST}, o AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i FROM k) SELECT {r('max(score)', 'threshold')} FROM o WHERE i >= (SELECT CAST(floor(count(DISTINCT image_id) * 3.5) AS BIGINT) FROM k)")
def k17(spark, sf):
    return K.target_threshold(scored(spark, sf), 3.5)


def _best_sql(strict: bool, steps: int, unit: str, unseen: str, few: str = "1", fallback: str | None = None) -> str:
    op = ">" if strict else ">="
    return f"{BEST}, {TRUTH}, g AS (SELECT i, {unit} AS t FROM range({steps}) r(i)), y AS (SELECT k.*, CASE WHEN t.image_id IS NULL THEN 0 ELSE 1 END AS y FROM k LEFT JOIN truth t USING (image_id, species_id)), c AS (SELECT species_id, i, t, sum(CASE WHEN score {op} t THEN y ELSE 0 END) AS tp, sum(CASE WHEN score {op} t THEN 1 ELSE 0 END) AS p, sum(y) AS pos FROM y, g GROUP BY ALL), f AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (p + pos) ELSE 0 END AS f1 FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY species_id ORDER BY round(f1, 12) DESC, i) AS o FROM f) SELECT species_id, {r(f'CASE WHEN pos = 0 THEN {unseen} WHEN pos < {few} THEN {fallback or unseen} ELSE t END', 'threshold')}, {r(f'CASE WHEN pos < {few} THEN 0 ELSE f1 END', 'f1')} FROM b WHERE o = 1"


@query("k18_best_thresholds_50", _best_sql(True, 50, "0.014 + 0.0001 * i", "0.1"))
def k18(spark, sf):
    return K.best_thresholds(scored(spark, sf), truth(spark, sf), [0.014 + 0.0001 * i for i in range(50)], True, 0.1)


@query("k19_best_thresholds_99", _best_sql(True, 99, "(i + 1) / 200.0", "0.005"))
def k19(spark, sf):
    return K.best_thresholds(scored(spark, sf), truth(spark, sf), [(i + 1) / 200 for i in range(99)], True, 0.005)


@query("k20_best_thresholds_fallback", _best_sql(False, 40, "0.014 + 0.0001 * i", "0.07", "25", "0.05"))
def k20(spark, sf):
    return K.best_thresholds(scored(spark, sf), truth(spark, sf), [0.014 + 0.0001 * i for i in range(40)], False, 0.07, 25, 0.05)


@query("k21_ambiguous", f"{BEST} SELECT image_id, {r('max(score) - min(score)', 'margin')}, max(score) - min(score) < 0.0003 AS ambiguous FROM k WHERE rank <= 2 GROUP BY 1")
def k21(spark, sf):
    return K.ambiguous(scored(spark, sf), 0.0003)


@query("e25_greedy_compatible", BEST.replace("WITH ", "WITH RECURSIVE ", 1) + ", kk AS MATERIALIZED (SELECT image_id, CAST(species_id AS INT) AS s, CAST(rank AS BIGINT) AS at FROM k), st AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS pos, CAST([] AS INT[]) AS kept FROM kk UNION ALL SELECT st.image_id, st.pos + 1, CASE WHEN len(st.kept) < 5 AND len(list_filter(st.kept, lambda x: x // 4 = kk.s // 4)) = 0 THEN list_append(st.kept, kk.s) ELSE st.kept END FROM st JOIN kk ON st.image_id = kk.image_id AND kk.at = st.pos + 1), f AS (SELECT image_id, kept FROM st WHERE pos = 64) SELECT image_id, CAST(unnest(range(1, len(kept) + 1)) AS INT) AS rank, unnest(kept) AS species_id FROM f")
def e25(spark, sf):
    """Greedy choice under compatibility; sequential in an image."""
    far = S.genus_edges(taxonomy(spark, sf))
    every = taxonomy(spark, sf).select(F.col("species_id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where("a <> b")
    return K.greedy_compatible(scored(spark, sf), every.join(far, ["a", "b"], "left_anti"), 5)


@query("w12_topk_arrays", f"{BEST} SELECT image_id, string_agg(CAST(species_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM k WHERE rank <= 5 GROUP BY 1")
def w12(spark, sf):
    t = K.fixed_topk(scored(spark, sf), 5).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "species_id"))).alias("x"))
    return t.select("image_id", F.array_join(F.transform("x", lambda x: x["species_id"].cast("string")), ",").alias("ids"))


@query("w13_ranks", f"{BEST} SELECT image_id, species_id, CAST(rank - 1 AS INT) AS rank FROM k")
def w13(spark, sf):
    return ranked(scored(spark, sf), ["image_id"]).select("image_id", "species_id", (F.col("rank") - 1).alias("rank"))


@query("w14_tile_topk", f"{IMG}, t AS (SELECT image_id, tile_id, species_id, prob, row_number() OVER (PARTITION BY image_id, tile_id ORDER BY prob DESC, species_id) AS rank FROM p) SELECT image_id, tile_id, CAST(rank AS INT) AS rank, species_id, {r('prob', 'prob')} FROM t WHERE rank <= 3")
def w14(spark, sf):
    return ranked(soft(spark, sf), ["image_id", "tile_id"], "prob").where("rank <= 3").select("image_id", "tile_id", "rank", "species_id", "prob")


PRED = f"pred AS (SELECT * FROM k WHERE rank <= 5 AND (score >= {T} OR rank <= 2))"
TOP1 = "top1 AS (SELECT image_id, species_id FROM k WHERE rank = 1)"
PER = "ims AS (SELECT DISTINCT image_id FROM img), pi AS (SELECT i.image_id, (SELECT count(*) FROM pred p JOIN truth t USING (image_id, species_id) WHERE p.image_id = i.image_id) AS tp, (SELECT count(*) FROM pred p WHERE p.image_id = i.image_id) AS np, (SELECT count(*) FROM truth t WHERE t.image_id = i.image_id) AS nt FROM ims i)"
LAB = "lab AS (SELECT species_id, sum(CASE WHEN p = 1 AND t = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p = 1 AND t IS NULL THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p IS NULL AND t = 1 THEN 1 ELSE 0 END) AS fn FROM (SELECT image_id, species_id, 1 AS p FROM {pred}) FULL JOIN (SELECT image_id, species_id, 1 AS t FROM truth) USING (image_id, species_id) GROUP BY 1), lf AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM lab)"


def pred(spark, sf):
    return K.cap_first(scored(spark, sf), T, 5, 2)


def rank_all(spark, sf):
    return ranked(scored(spark, sf), ["image_id"])


def top1(spark, sf):
    return rank_all(spark, sf).where("rank = 1").select("image_id", "species_id")


def _mean_f1(empty: str) -> str:
    return f"{BEST}, {TRUTH}, {PRED}, {PER} SELECT {r(f'avg(CASE WHEN np + nt = 0 THEN {empty} ELSE 2.0 * tp / (np + nt) END)', 'f1')} FROM pi"


_METRIC = {
    "m01_sample_f1": (lambda s, f: M.mean_sample_f1(pred(s, f), truth(s, f), base(s, f), 0.0), _mean_f1("0")),
    "m02_sample_f1_empty_one": (lambda s, f: M.mean_sample_f1(pred(s, f).where("image_id % 5 <> 0"), truth(s, f).where("image_id % 5 <> 0"), base(s, f), 1.0), f"{BEST}, {TRUTH}, {PRED}, {PER} SELECT {r('avg(CASE WHEN image_id % 5 = 0 THEN 1.0 WHEN np + nt = 0 THEN 1.0 ELSE 2.0 * tp / (np + nt) END)', 'f1')} FROM pi"),
    "m03_transect_f1": (lambda s, f: M.transect_f1(pred(s, f), truth(s, f), base(s, f), F.col("image_id") % 7), f"{BEST}, {TRUTH}, {PRED}, {PER}, t AS (SELECT image_id % 7 AS t, avg(2.0 * tp / (np + nt)) AS f FROM pi GROUP BY 1) SELECT {r('avg(f)', 'f1')} FROM t"),
    "m04_label_counts": (lambda s, f: M.label_counts(pred(s, f), truth(s, f)), f"{BEST}, {TRUTH}, {PRED}, {LAB.format(pred='pred')} SELECT species_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM lab"),
    "m05_label_f1": (lambda s, f: M.label_f1(top1(s, f), truth(s, f)), f"{BEST}, {TRUTH}, {TOP1}, {LAB.format(pred='top1')} SELECT {r('avg(f)', 'macro')}, {r('sum(f * (tp + fn)) / sum(tp + fn)', 'weighted')}, {r('2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))', 'micro')} FROM lf"),
    "m06_topk_curve": (lambda s, f: M.topk_curve(rank_all(s, f), truth(s, f), base(s, f), [1, 5, 10]), f"{BEST}, {TRUTH}, fh AS (SELECT i.image_id, min(rank) AS first FROM (SELECT DISTINCT image_id FROM img) i LEFT JOIN (SELECT k.* FROM k JOIN truth USING (image_id, species_id)) h USING (image_id) GROUP BY 1) SELECT CAST(kk AS INT) AS k, {r('avg(CASE WHEN first <= kk THEN 1.0 ELSE 0 END)', 'accuracy')} FROM fh, (VALUES (1), (5), (10)) g(kk) GROUP BY 1"),
    "m07_query_recall": (lambda s, f: M.query_recall(rank_all(s, f), truth(s, f), 5), f"{BEST}, {TRUTH}, h AS (SELECT t.*, CASE WHEN k.rank IS NULL THEN 0 ELSE 1 END AS hit FROM truth t LEFT JOIN (SELECT * FROM k WHERE rank <= 5) k USING (image_id, species_id)), sp AS (SELECT species_id, avg(hit) AS r FROM h GROUP BY 1) SELECT {r('(SELECT sum(hit) / count(*) FROM h)', 'recall_at_k')}, {r('(SELECT sum(hit) / (sum(hit) + 4 * count(*)) FROM h)', 'precision')}, {r('(SELECT 2.0 * sum(hit) / (sum(hit) + 4 * count(*) + count(*)) FROM h)', 'f1')}, {r('(SELECT avg(r) FROM sp)', 'macro_recall')}"),
    "m08_precision_recall_at": (lambda s, f: M.precision_recall_at(rank_all(s, f), truth(s, f), base(s, f), [1, 3, 10]), f"{BEST}, {TRUTH}, y AS (SELECT k.rank, CASE WHEN t.image_id IS NULL THEN 0 ELSE 1 END AS y FROM k LEFT JOIN truth t USING (image_id, species_id)) SELECT CAST(kk AS INT) AS k, {r('sum(y) / count(*)', 'precision')}, {r('sum(y) / (SELECT count(*) FROM truth)', 'recall')}, {r('2.0 * sum(y) / (count(*) + (SELECT count(*) FROM truth))', 'f1')} FROM y, (VALUES (1), (3), (10)) g(kk) WHERE rank <= kk GROUP BY 1"),
    "m09_species_accuracy": (lambda s, f: M.species_accuracy(top1(s, f), truth(s, f), counts(s, f)), f"{BEST}, {TRUTH}, {TOP1}, {COUNTS}, {LAB.format(pred='top1')} SELECT species_id, CAST(tp + fn AS BIGINT) AS n, {r('tp / (tp + fn)', 'accuracy')}, {r('f', 'f1')}, coalesce(cnt.n, 0) AS n_train FROM lf LEFT JOIN cnt USING (species_id) WHERE tp + fn > 0"),
    "m12_predicted_and_true": (lambda s, f: M.predicted_and_true(pred(s, f), truth(s, f)), f"{BEST}, {TRUTH}, {PRED}, a AS (SELECT species_id, count(*) AS n FROM pred GROUP BY 1), b AS (SELECT species_id, count(*) AS n FROM truth GROUP BY 1) SELECT species_id, coalesce(a.n, 0) AS n_pred, coalesce(b.n, 0) AS n_true FROM a FULL JOIN b USING (species_id)"),
    "m13_head_tail": (lambda s, f: M.head_tail(top1(s, f), truth(s, f), counts(s, f)), f"{BEST}, {TRUTH}, {TOP1}, {COUNTS}, hd AS (SELECT species_id FROM (SELECT species_id, row_number() OVER (ORDER BY n DESC, species_id) AS o, count(*) OVER () AS c FROM cnt) WHERE o <= floor(0.2 * c)) SELECT CASE WHEN species_id IN (SELECT species_id FROM hd) THEN 'head' ELSE 'tail' END AS part, count(*) AS n, {r('avg(CASE WHEN (image_id, species_id) IN (SELECT image_id, species_id FROM top1) THEN 1.0 ELSE 0 END)', 'accuracy')} FROM truth GROUP BY 1"),
    "m14_masked_accuracy": (lambda s, f: M.masked_accuracy(top1(s, f), truth(s, f).withColumn("species_id", F.when(F.col("species_id") == 0, -1).otherwise(F.col("species_id")))), f"{BEST}, {TRUTH}, {TOP1} SELECT count(*) AS n, {r('avg(CASE WHEN t.species_id = p.species_id THEN 1.0 ELSE 0 END)', 'accuracy')} FROM truth t LEFT JOIN top1 p USING (image_id) WHERE t.species_id <> 0"),
    "m15_set_constancy": (lambda s, f: M.set_constancy(rank_all(s, f), 3), f"{BEST}, s AS (SELECT image_id, list_sort(list(species_id)) AS s FROM k WHERE rank <= 3 GROUP BY 1) SELECT count(*) AS images, count(DISTINCT s) AS sets FROM s"),
    "m15_most_confused": (lambda s, f: M.most_confused(top1(s, f), truth(s, f), 15), f"{BEST}, {TRUTH}, {TOP1} SELECT t.species_id AS true_id, p.species_id AS pred_id, count(*) AS count FROM truth t JOIN top1 p USING (image_id) WHERE t.species_id <> p.species_id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15"),
    "a19_difficulty": (lambda s, f: M.difficulty(top1(s, f), truth(s, f)), f"{BEST}, {TRUTH}, {TOP1}, a AS (SELECT t.species_id, count(*) AS n, avg(CASE WHEN p.image_id IS NULL THEN 0.0 ELSE 1 END) AS a FROM truth t LEFT JOIN top1 p USING (image_id, species_id) GROUP BY 1) SELECT species_id, n, {r('a', 'accuracy')}, CASE WHEN a < 0.3 THEN 'HARD' WHEN a < 0.7 THEN 'MEDIUM' ELSE 'EASY' END AS level FROM a"),
    "a18_mean_jaccard": (lambda s, f: M.mean_jaccard(K.fixed_topk(scored(s, f), 3), K.fixed_topk(images(s, f).select("image_id", "species_id", F.col("mx").alias("score")), 3)), f"{BEST}, km AS (SELECT image_id, species_id, row_number() OVER (PARTITION BY image_id ORDER BY mx DESC, species_id) AS rank FROM img), c AS (SELECT image_id, count(*) AS n FROM k JOIN km USING (image_id, species_id) WHERE k.rank <= 3 AND km.rank <= 3 GROUP BY 1), j AS (SELECT image_id, coalesce(n, 0) / (6 - coalesce(n, 0)) AS j FROM (SELECT DISTINCT image_id FROM img) LEFT JOIN c USING (image_id)) SELECT {r('avg(j)', 'jaccard')}, {r('avg(CASE WHEN j = 1 THEN 1.0 ELSE 0 END)', 'equal')} FROM j"),
}
for _level, _id in (("genus_id", "j14_genus_accuracy"), ("family_id", "m10_family_accuracy")):
    _METRIC[_id] = (lambda s, f, lv=_level: M.group_accuracy(top1(s, f), truth(s, f), taxonomy(s, f), lv), f"{BEST}, {TRUTH}, {TOP1}, {TAX} SELECT CAST(a.{_level} AS INT) AS {_level}, count(*) AS n, {r(f'avg(CASE WHEN a.{_level} = b.{_level} THEN 1.0 ELSE 0 END)', 'accuracy')} FROM truth t JOIN tax a USING (species_id) LEFT JOIN top1 p USING (image_id) LEFT JOIN tax b ON b.species_id = p.species_id GROUP BY 1")
_METRIC["m11_confusion"] = (lambda s, f: M.confusion(top1(s, f), truth(s, f), taxonomy(s, f), "family_id"), f"{BEST}, {TRUTH}, {TOP1}, {TAX}, c AS (SELECT a.family_id AS ta, b.family_id AS pa, count(*) AS c FROM truth t JOIN tax a USING (species_id) JOIN top1 p USING (image_id) JOIN tax b ON b.species_id = p.species_id GROUP BY 1, 2) SELECT CAST(ta AS INT) AS true_group, CAST(pa AS INT) AS pred_group, {r('c / sum(c) OVER (PARTITION BY ta)', 'share')} FROM c")
for _name, (_f, _sql) in _METRIC.items():
    query(_name, _sql)(_f)
