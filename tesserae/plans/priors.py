"""Queries of seasonal priors, compatibility, embeddings and tile boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import boxes as B
from tesserae.operators import constraints as C
from tesserae.operators import scores as S
from tesserae.operators import seasons as Z
from tesserae.operators import vectors as V
from tesserae.plans.pooling import soft
from tesserae.plans.registry import query, r
from tesserae.plans.scoring import EDGES, IMG, TAX, images
from tesserae.plans.views import TILE, table, taxonomy, tile_arrays

#: Orders give months: the customer, mod 60, is the species; those from 60 have none.
HIST = "hist AS (SELECT CAST(o_custkey % 60 AS INT) AS species_id, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1, 2)"
CEN = "cen AS (SELECT CAST(i AS INT) AS month, ({c})[CAST(i AS INT)] AS centre FROM range(1, 13) g(i))"
BELL = "exp(-0.5 * power(least(abs({a} - {b}), 365 - abs({a} - {b})) / 18.0, 2))"
CLS = "cls AS (SELECT CAST(i AS INT) AS species_id FROM range(64) g(i))"


def histogram(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 60).cast("int").alias("species_id"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


def classes(spark, sf):
    return taxonomy(spark, sf).select("species_id")


def _pdf_sql(first: int, centres: tuple[int, ...], per_month: bool) -> str:
    base = f"{CEN.format(c=list(centres))}, k0 AS (SELECT CAST(d AS INT) AS doy, month, {BELL.format(a='d', b='centre')} AS k FROM range({first}, {first + 365}) g(d), cen), kn AS (SELECT doy, month, {'k / sum(k) OVER (PARTITION BY month)' if per_month else 'k'} AS k FROM k0), tot AS (SELECT species_id, sum(n) AS t FROM hist GROUP BY 1)"
    share = "s / t" if per_month else "s / (sum(s) OVER (PARTITION BY species_id) + 1e-12)"
    last = "p" if per_month else "p / sum(p) OVER (PARTITION BY species_id)"
    return f"{base}, sm AS (SELECT species_id, doy, sum(n * k) AS s FROM hist JOIN kn USING (month) GROUP BY 1, 2), pd AS (SELECT species_id, doy, 0.95 * {share} + 0.05 / 365 AS p FROM sm JOIN tot USING (species_id)), pdf AS (SELECT species_id, doy, {last} AS p FROM pd WHERE species_id < 64 UNION ALL SELECT species_id, CAST(d AS INT), 1.0 / 365 FROM cls, range({first}, {first + 365}) g(d) WHERE species_id NOT IN (SELECT species_id FROM hist))"


PDF = _pdf_sql(1, Z.CENTRES_PER_MONTH, True)
EFF = f"{CEN.format(c=list(Z.CENTRES_SUMMED))}, me AS (SELECT species_id, b.month AS month, sum(n * {BELL.format(a='a.centre', b='b.centre')}) AS s FROM hist JOIN cen a USING (month), cen b GROUP BY 1, 2), mp AS (SELECT species_id, month, 0.95 * s / sum(s) OVER (PARTITION BY species_id) + 0.05 / 12 AS p FROM me), eff AS (SELECT species_id, month, p / max(p) OVER (PARTITION BY species_id) AS e FROM mp UNION ALL SELECT species_id, CAST(m AS INT), 1.0 FROM cls, range(1, 13) g(m) WHERE species_id NOT IN (SELECT species_id FROM hist))"


@query("e07_day_pdf", f"WITH {HIST}, {CLS}, {PDF} SELECT species_id, doy, {r('p', 'p')} FROM pdf")
def e07(spark, sf):
    return Z.day_pdf(spark, histogram(spark, sf), classes(spark, sf))


@query("e08_day_pdf_summed", f"WITH {HIST}, {CLS}, {_pdf_sql(0, Z.CENTRES_SUMMED, False)} SELECT species_id, doy, {r('p', 'p')} FROM pdf")
def e08(spark, sf):
    return Z.day_pdf(spark, histogram(spark, sf), classes(spark, sf), "summed")


@query("e09_month_efficiency", f"WITH {HIST}, {CLS}, {EFF} SELECT species_id, month, {r('e', 'efficiency')} FROM eff WHERE species_id < 64")
def e09(spark, sf):
    return Z.month_efficiency(spark, histogram(spark, sf), classes(spark, sf))


@query("e10_bloom_months", f"WITH {CLS}, m AS (SELECT species_id, CASE WHEN species_id % 5 = 0 THEN 4095 ELSE (species_id * 61 + 7) % 4096 END AS mask FROM cls), b AS (SELECT species_id, CAST(i AS INT) AS i, CAST((mask >> CAST(i AS INT)) & 1 AS DOUBLE) AS b FROM m, range(12) g(i)) SELECT x.species_id, CAST(x.i + 1 AS INT) AS month, {r('least(1.0, x.b + 0.3 * y.b + 0.3 * z.b)', 'open')} FROM b x JOIN b y ON x.species_id = y.species_id AND y.i = (x.i + 11) % 12 JOIN b z ON x.species_id = z.species_id AND z.i = (x.i + 1) % 12")
def e10(spark, sf):
    s = F.col("species_id")
    return Z.bloom_months(classes(spark, sf).select("species_id", F.when(s % 5 == 0, 0).otherwise((s * 61 + 7) % 4096).cast("int").alias("mask")))


RR = IMG + f", {HIST}, {CLS}, {PDF}, x AS (SELECT image_id, species_id, prob, ln(greatest(prob, 1e-12)) + ln(greatest(p, 1e-12)) AS x FROM img JOIN pdf USING (species_id) WHERE doy = 1 + (image_id * 37) % 365), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY image_id)) AS e FROM x), f AS (SELECT image_id, species_id, prob, e / sum(e) OVER (PARTITION BY image_id) AS score FROM e)"


def reranked(spark, sf):
    from tesserae.functions.columns import log_floor, softmax

    day = (1 + F.col("image_id") * 37 % 365).cast("int")
    t = images(spark, sf).withColumn("doy", day).join(Z.day_pdf(spark, histogram(spark, sf), classes(spark, sf)), ["species_id", "doy"])
    x = t.withColumn("x", log_floor(F.col("prob")) + log_floor(F.col("p")))
    return softmax(x, ["image_id"], "x", "score").select("image_id", "species_id", "prob", "score")


@query("e11_season_rerank", RR + f" SELECT image_id, species_id, {r('score', 'score')} FROM f")
def e11(spark, sf):
    return reranked(spark, sf).drop("prob")


@query("e11_flip_rate", RR + f", b AS (SELECT image_id, arg_max(species_id, prob) AS a, arg_max(species_id, score) AS b FROM f GROUP BY 1) SELECT {r('avg(CASE WHEN a <> b THEN 1.0 ELSE 0 END)', 'flips')} FROM b")
def e11b(spark, sf):
    t = reranked(spark, sf).groupBy("image_id").agg(F.max_by("species_id", "prob").alias("a"), F.max_by("species_id", "score").alias("b"))
    return t.agg(F.avg((F.col("a") != F.col("b")).cast("int")).alias("flips"))


@query("e12_month_penalty", IMG + f", {HIST}, {CLS}, {EFF} SELECT image_id, species_id, {r('logit + 0.5 * ln(e + 1e-9)', 'score')} FROM img JOIN eff USING (species_id) WHERE month = 1 + image_id % 12")
def e12(spark, sf):
    return Z.month_penalty(images(spark, sf), Z.month_efficiency(spark, histogram(spark, sf), classes(spark, sf)), (1 + F.col("image_id") % 12).cast("int"), 0.5)


NICHE = "nic AS (SELECT DISTINCT species_id, (species_id * 13 % 29) / 3.0 AS mm, CASE WHEN species_id % 4 = 0 THEN 0 ELSE 1 + species_id % 3 / 2.0 END AS ms, (species_id * 7 % 17) / 2.0 AS nm, 0.5 + species_id % 5 / 4.0 AS ns FROM tile), nf AS (SELECT species_id, CASE WHEN ms > 0 THEN mm ELSE 0 END AS mm, CASE WHEN ms > 0 THEN ms ELSE 1.5 END AS ms, nm, ns FROM nic), bc AS (SELECT a.species_id AS a, b.species_id AS b, sqrt(2 * a.ms * b.ms / (a.ms ** 2 + b.ms ** 2)) * exp(-((a.mm - b.mm) ** 2) / (4 * (a.ms ** 2 + b.ms ** 2))) * sqrt(2 * a.ns * b.ns / (a.ns ** 2 + b.ns ** 2)) * exp(-((a.nm - b.nm) ** 2) / (4 * (a.ns ** 2 + b.ns ** 2))) AS c FROM nf a, nf b WHERE a.species_id <> b.species_id)"


def niches(spark, sf):
    s = F.col("species_id")
    return classes(spark, sf).select("species_id", ((s * 13 % 29) / 3.0).alias("m_m"), F.when(s % 4 == 0, 0.0).otherwise(1 + s % 3 / 2.0).alias("m_s"), ((s * 7 % 17) / 2.0).alias("n_m"), (0.5 + s % 5 / 4.0).alias("n_s"))


def compat(spark, sf, below=1.0):
    return C.niche_compatibility(niches(spark, sf), ["m", "n"], below)


@query("e15_niche_compatibility", f"WITH {TILE}, {NICHE} SELECT a, b, {r('c', 'c')} FROM bc WHERE c < 0.9")
def e15(spark, sf):
    return compat(spark, sf, 0.9)


@query("e16_climate_pairs", f"WITH g AS (SELECT cx, cy, (cx * 7 + cy * 3) % 11 AS t, (cx * 5 + cy) % 13 AS w FROM range(20) a(cx), range(20) b(cy)), p AS (SELECT CAST(c_custkey % 40 AS INT) AS species_id, (c_custkey * 31 % 1000) / 50.0 AS x, (c_custkey * 17 % 1000) / 50.0 AS y FROM customer), m AS (SELECT species_id, avg(t) AS t, avg(w) AS w FROM p JOIN g ON cx = floor(x) AND cy = floor(y) GROUP BY 1), z AS (SELECT species_id, (t - avg(t) OVER ()) / greatest(stddev_pop(t) OVER (), 1e-9) AS t, (w - avg(w) OVER ()) / greatest(stddev_pop(w) OVER (), 1e-9) AS w FROM m) SELECT a.species_id AS a, b.species_id AS b, {r('(a.t * b.t + a.w * b.w) / sqrt(a.t ** 2 + a.w ** 2) / sqrt(b.t ** 2 + b.w ** 2)', 'cosine')} FROM z a, z b WHERE a.species_id <> b.species_id AND (a.t * b.t + a.w * b.w) / sqrt(a.t ** 2 + a.w ** 2) / sqrt(b.t ** 2 + b.w ** 2) >= 0.7")
def e16(spark, sf):
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select((k % 40).cast("int").alias("species_id"), ((k * 31 % 1000) / 50.0).alias("x"), ((k * 17 % 1000) / 50.0).alias("y"))
    side = spark.range(20)
    grid = side.select(F.col("id").alias("cx")).join(side.select(F.col("id").alias("cy"))).select("cx", "cy", ((F.col("cx") * 7 + F.col("cy") * 3) % 11).alias("t"), ((F.col("cx") * 5 + F.col("cy")) % 13).alias("w"))
    return C.similar_pairs(C.climate_profiles(points, F.broadcast(grid), ["t", "w"], 1.0), "species_id", "z", 0.7)


_FIXPOINT = "cand AS (SELECT image_id, tile_id, species_id FROM p WHERE prob > 0.022), nt AS (SELECT image_id, count(DISTINCT tile_id) AS n FROM tile GROUP BY 1), doms AS (SELECT image_id, list(sp) AS doms FROM (SELECT image_id, tile_id, list(species_id) AS sp FROM cand GROUP BY ALL) GROUP BY 1), st AS (SELECT image_id, list(DISTINCT species_id) AS kept, true AS more FROM cand GROUP BY 1 UNION ALL SELECT image_id, now, len(now) < len(kept) FROM (SELECT image_id, kept, list_filter(kept, lambda s: len(doms) = n AND len(list_filter(doms, lambda d: len(list_filter(d, lambda x: x // 4 = s // 4 AND list_contains(kept, x))) = 0)) = 0) AS now FROM st JOIN doms USING (image_id) JOIN nt USING (image_id) WHERE more)), fin AS (SELECT image_id, kept FROM st WHERE NOT more)"


@query("e21_hard_consistency", f"WITH RECURSIVE {TILE}, {_FIXPOINT} SELECT image_id, tile_id, species_id, {r('CASE WHEN n = 1 OR (prob > 0.022 AND list_contains(kept, species_id)) THEN prob ELSE 0 END', 'prob')} FROM p JOIN nt USING (image_id) LEFT JOIN fin USING (image_id)")
def e21(spark, sf):
    t = soft(spark, sf).select("image_id", "tile_id", "species_id", "prob")
    return C.hard_consistency(t, S.genus_edges(taxonomy(spark, sf)), 0.022)


@query("e22_continuous_consistency", f"WITH {TILE}, {TAX}, {EDGES}, {NICHE}, h AS (SELECT bc.* FROM bc LEFT JOIN edges e ON e.a = bc.a AND e.b = bc.b WHERE e.a IS NULL AND c < 1), pr AS (SELECT DISTINCT image_id, species_id AS b FROM p WHERE prob > 0.03), w AS (SELECT image_id, a AS species_id, min(c) AS c FROM pr JOIN h USING (b) GROUP BY 1, 2) SELECT image_id, tile_id, species_id, {r('prob * coalesce(c, 1)', 'prob')} FROM p LEFT JOIN w USING (image_id, species_id)")
def e22(spark, sf):
    return C.continuous_consistency(soft(spark, sf).select("image_id", "tile_id", "species_id", "prob"), S.genus_edges(taxonomy(spark, sf)), compat(spark, sf), 0.03)


@query("e23_prune_and_recover", IMG + f", {NICHE}, k AS (SELECT image_id, species_id, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, species_id) AS rk FROM img), s AS (SELECT image_id, species_id FROM k WHERE rk <= 5), q AS (SELECT image_id, species_id FROM k WHERE rk BETWEEN 6 AND 12), ms AS (SELECT s.image_id, s.species_id, avg(c) AS m FROM s JOIN s o ON s.image_id = o.image_id AND s.species_id <> o.species_id JOIN bc ON a = s.species_id AND b = o.species_id GROUP BY 1, 2), mq AS (SELECT q.image_id, q.species_id, avg(c) AS m FROM q JOIN s o ON q.image_id = o.image_id JOIN bc ON a = q.species_id AND b = o.species_id GROUP BY 1, 2) SELECT image_id, species_id FROM s WHERE (image_id, species_id) NOT IN (SELECT image_id, species_id FROM ms WHERE m < 0.2) UNION SELECT image_id, species_id FROM mq WHERE m > 0.5")
def e23(spark, sf):
    from tesserae.functions.columns import ranked

    k = ranked(images(spark, sf), ["image_id"], "prob")
    return C.prune_and_recover(k.where("rank <= 5"), k.where("rank between 6 and 12").select("image_id", "species_id"), compat(spark, sf, 2.0), 0.2, 0.5)


UNIT = "un AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)), cm AS (SELECT label, i, avg(x) AS x FROM un GROUP BY 1, 2), pt AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM cm)"


def bank(spark, sf):
    return table(spark, sf, "embeddings")


@query("v01_prototypes", f"WITH {UNIT} SELECT label, CAST(i - 1 AS INT) AS pos, {r('x', 'x')} FROM pt")
def v01(spark, sf):
    return V.prototypes(bank(spark, sf)).select("label", F.posexplode("prototype").alias("pos", "x"))


@query("v02_cosine_scores", f"WITH {UNIT} SELECT un.vec_id, pt.label, {r('sum(un.x * pt.x)', 'score')} FROM un JOIN pt USING (i) GROUP BY 1, 2")
def v02(spark, sf):
    return V.cosine_scores(bank(spark, sf).select("vec_id", "embedding"), V.prototypes(bank(spark, sf)), "vec_id", "embedding")


@query("v03_mean_neighbour_scores", f"WITH {UNIT} SELECT un.vec_id, cm.label, {r('sum(un.x * cm.x)', 'score')} FROM un JOIN cm USING (i) GROUP BY 1, 2")
def v03(spark, sf):
    return V.mean_neighbour_scores(bank(spark, sf).select("vec_id", "embedding"), bank(spark, sf), "vec_id", "embedding")


FUSE = f"{UNIT}, co AS (SELECT vec_id // 5 AS image_id, CAST(pt.label AS INT) AS species_id, max(s) AS c FROM (SELECT un.vec_id, pt.label, sum(un.x * pt.x) AS s FROM un JOIN pt USING (i) GROUP BY 1, 2) pt GROUP BY 1, 2)"


def cosines(spark, sf):
    c = V.cosine_scores(bank(spark, sf).select("vec_id", "embedding"), V.prototypes(bank(spark, sf)), "vec_id", "embedding")
    return c.groupBy(F.expr("vec_id div 5").alias("image_id"), F.col("label").cast("int").alias("species_id")).agg(F.max("score").alias("cosine"))


@query("v04_retrieval_fusion", IMG + f", {FUSE} SELECT image_id, species_id, {r('0.7 * logit + 0.3 * c', 'score')} FROM img JOIN co USING (image_id, species_id)")
def v04(spark, sf):
    return V.retrieval_fusion(images(spark, sf), cosines(spark, sf), 0.7)


@query("v05_top_votes", IMG + f", {FUSE}, b AS (SELECT image_id, max(prob) AS b FROM img GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c DESC, species_id) AS rk FROM co) SELECT image_id, species_id, {r('logit + CASE WHEN b < 0.03 AND rk <= 5 THEN 2.0 / rk ELSE 0 END', 'score')} FROM img JOIN b USING (image_id) LEFT JOIN k USING (image_id, species_id)")
def v05(spark, sf):
    return V.top_votes(images(spark, sf), cosines(spark, sf), 0.03)


@query("v06_tile_clusters", f"WITH RECURSIVE {UNIT}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM un a JOIN un b ON a.vec_id // 5 = b.vec_id // 5 AND a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2 HAVING sum(a.x * b.x) > 0.1), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a // 5 AS image_id, CAST(a % 5 AS INT) AS tile_id, CAST(min(b) % 5 AS INT) AS cluster FROM reach GROUP BY a")
def v06(spark, sf):
    """Components of an image's tiles."""
    return V.tile_clusters(tile_arrays(spark, sf), "logits", 0.1)


@query("v07_audit", f"WITH {UNIT}, s AS (SELECT label, sum(x2) AS ss FROM (SELECT label, i, power(sum(x), 2) AS x2 FROM un GROUP BY 1, 2) GROUP BY 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS zeros, {r('(ss - n) / (n * (n - 1))', 'intra')} FROM n JOIN s USING (label)")
def v07(spark, sf):
    return V.audit(bank(spark, sf))


@query("v08_principal")
def v08(spark, sf):
    """Signs of axes are the solver's; tests compare variances."""
    return V.principal(bank(spark, sf), "vec_id", "embedding", 8)


@query("v08_principal_energy", f"WITH n AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM n GROUP BY 1) SELECT vec_id, {r('sum((x - m) * (x - m))', 'energy')} FROM n JOIN m USING (i) GROUP BY 1")
def v08_energy(spark, sf):
    """All principal axes together keep each vector's distance from the mean, whatever their signs."""
    t = V.principal(bank(spark, sf), "vec_id", "embedding", 64)
    return t.select("vec_id", V.dot(F.col("components"), F.col("components")).alias("energy"))


@query("v09_concatenated", f"SELECT vec_id, CAST(128 AS INT) AS n, {r('list_sum(embedding) * 2', 's')} FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def v09(spark, sf):
    b = bank(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    t = V.concatenated(b, b, "vec_id", "embedding")
    return t.select("vec_id", F.size("embedding").alias("n"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("s"))


IM = "im AS (SELECT p_partkey AS image_id, CAST(300 + p_partkey * 37 % 900 AS INT) AS width, CAST(200 + p_partkey * 53 % 700 AS INT) AS height FROM part)"


def sizes(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("image_id"), (300 + k * 37 % 900).cast("int").alias("width"), (200 + k * 53 % 700).cast("int").alias("height"))


def _cells_sql(n: int, x0: str, y0: str, x1: str, y1: str, mode: str) -> str:
    i = "CAST({} AS INT)"
    return f"WITH {IM} SELECT image_id, '{mode}' AS mode, CAST(r * {n} + c AS INT) AS tile_id, {i.format(x0)} AS x0, {i.format(y0)} AS y0, {i.format(x1)} AS x1, {i.format(y1)} AS y1 FROM im, range({n}) a(r), range({n}) b(c)"


_BOXES = {
    "i01_grid": (lambda s, f: B.grid(sizes(s, f), 3, 0.1), _cells_sql(3, "greatest(0, round_even(c * width / 3 - width / 3 * 0.1, 0))", "greatest(0, round_even(r * height / 3 - height / 3 * 0.1, 0))", "least(width, round_even((c + 1) * width / 3 + width / 3 * 0.1, 0))", "least(height, round_even((r + 1) * height / 3 + height / 3 * 0.1, 0))", "grid_3x3")),
    "i02_integer_grid": (lambda s, f: B.integer_grid(sizes(s, f), 4), _cells_sql(4, "c * (width // 4)", "r * (height // 4)", "CASE WHEN c = 3 THEN width ELSE (c + 1) * (width // 4) END", "CASE WHEN r = 3 THEN height ELSE (r + 1) * (height // 4) END", "cells_4x4")),
    "i01_five_crop": (lambda s, f: B.five_crop(sizes(s, f), 448), f"WITH {IM}, q AS (SELECT *, least(width, height, 448) AS s FROM im), b AS (SELECT image_id, 0 AS tile_id, width // 2 - s // 2 AS x0, height // 2 - s // 2 AS y0, s FROM q UNION ALL SELECT image_id, 1, 0, 0, s FROM q UNION ALL SELECT image_id, 2, width - s, 0, s FROM q UNION ALL SELECT image_id, 3, 0, height - s, s FROM q UNION ALL SELECT image_id, 4, width - s, height - s, s FROM q) SELECT image_id, 'five_crop' AS mode, CAST(tile_id AS INT) AS tile_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x0 + s AS INT) AS x1, CAST(y0 + s AS INT) AS y1 FROM b"),
    "i02_tile_count": (lambda s, f: B.tile_count(sizes(s, f), 224, 112, [1.0, 0.5]), f"WITH {IM}, d AS (SELECT image_id, round_even(width * s, 0) AS w, round_even(height * s, 0) AS h FROM im, (VALUES (1.0), (0.5)) g(s)) SELECT image_id, CAST(sum(CASE WHEN w <= 224 THEN 1 ELSE ceil((w - 224) / 112) + 1 END * CASE WHEN h <= 224 THEN 1 ELSE ceil((h - 224) / 112) + 1 END) AS INT) AS n FROM d GROUP BY 1"),
    "i04_strips": (lambda s, f: B.strips(sizes(s, f), 3, True), f"WITH {IM} SELECT image_id, 'hstrips_3' AS mode, CAST(i AS INT) AS tile_id, CAST(0 AS INT) AS x0, CAST(round_even(i * height / 3, 0) AS INT) AS y0, width AS x1, CAST(least(height, round_even((i + 1) * height / 3, 0)) AS INT) AS y1 FROM im, range(3) g(i)"),
    "i04_centre_crop": (lambda s, f: B.centre_crop(sizes(s, f), 224), f"WITH {IM}, q AS (SELECT *, least(width, height, 224) AS s FROM im) SELECT image_id, 'centre' AS mode, CAST(0 AS INT) AS tile_id, CAST(width // 2 - s // 2 AS INT) AS x0, CAST(height // 2 - s // 2 AS INT) AS y0, CAST(width // 2 - s // 2 + s AS INT) AS x1, CAST(height // 2 - s // 2 + s AS INT) AS y1 FROM q"),
    "i01_multiscale": (lambda s, f: B.multiscale(sizes(s, f), 0.0, 6).groupBy("image_id").agg(F.count("*").alias("n"), F.sum((F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))).alias("area")), f"WITH {IM}, q AS (SELECT image_id, width, height, CAST(round_even(width / 4, 0) AS BIGINT) AS w4, CAST(round_even(height / 4, 0) AS BIGINT) AS h4 FROM im) SELECT image_id, CAST(6 AS BIGINT) AS n, CAST(2 * width * height + w4 * h4 AS BIGINT) AS area FROM q"),
    "i01_sliding": (lambda s, f: B.sliding(sizes(s, f), 448, 224).groupBy("image_id").agg(F.count("*").alias("n"), F.max("x1").alias("right"), F.max("y1").alias("bottom")), f"WITH {IM}, d AS (SELECT *, CASE WHEN width <= 448 THEN 1 ELSE ceil((width - 448) / 224) + 1 END AS nx, CASE WHEN height <= 448 THEN 1 ELSE ceil((height - 448) / 224) + 1 END AS ny FROM im) SELECT image_id, CAST(nx * ny AS BIGINT) AS n, width AS right, height AS bottom FROM d"),
    "i04_dense": (lambda s, f: B.dense(sizes(s, f), (1, 2, 3)).groupBy("image_id").agg(F.count("*").alias("n"), F.max("tile_id").alias("last"), F.sum("x1").alias("right")), f"WITH {IM}, b AS (SELECT image_id, width AS x1 FROM im UNION ALL SELECT image_id, CAST(least(width, round_even((c + 1) * width / 2, 0)) AS INT) FROM im, range(2) a(r), range(2) b(c) UNION ALL SELECT image_id, CAST(least(width, round_even((c + 1) * width / 3, 0)) AS INT) FROM im, range(3) a(r), range(3) b(c)) SELECT image_id, count(*) AS n, CAST(13 AS INT) AS last, CAST(sum(x1) AS BIGINT) AS right FROM b GROUP BY 1"),
    "i03_centred_grid": (lambda s, f: B.centred_grid(sizes(s, f), 0.8).groupBy("image_id").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")), f"WITH {IM}, q AS (SELECT *, CAST(round_even(width * 0.8, 0) AS INT) AS sw FROM im) SELECT image_id, CAST((width - sw) // 2 AS INT) AS x0, CAST((width - sw) // 2 + sw AS INT) AS x1 FROM q"),
}
for _name, (_f, _sql) in _BOXES.items():
    query(_name, _sql)(_f)


_PER = {"whole": "1", "grid": "9", "cells": "16", "centred_grid": "16", "centre": "1", "five_crop": "5", "strips": "3", "multiscale": "6", "dense": "5", "sliding": "CASE WHEN width <= 448 THEN 1 ELSE ceil((width - 448) / 224) + 1 END * CASE WHEN height <= 448 THEN 1 ELSE ceil((height - 448) / 224) + 1 END"}


@query("f01_tiling_registry", " UNION ALL ".join(f"SELECT '{n}' AS tiling, CAST(sum({x}) AS BIGINT) AS boxes FROM im" for n, x in _PER.items()).join([f"WITH {IM} ", ""]))
def f01(spark, sf):
    """How many boxes every tiling of the registry makes of all images."""
    out = None
    for name, tiling in B.TILINGS.items():
        one = tiling(sizes(spark, sf)).agg(F.lit(name).alias("tiling"), F.count("*").alias("boxes"))
        out = one if out is None else out.union(one)
    return out
