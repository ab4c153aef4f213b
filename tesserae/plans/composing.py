"""Queries of compositions, choices and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.groups import solve_groups
from tesserae.functions.lineage import cut, scratch
from tesserae.functions.orders import places
from tesserae.operators import compose as C
from tesserae.operators import metrics as M
from tesserae.operators import selection as K
from tesserae.operators import vectors as V
from tesserae.operators.constraints import similar_pairs
from tesserae.plans.priors import UNIT, sizes
from tesserae.plans.registry import query, r
from tesserae.plans.selecting import BEST, base, scored
from tesserae.plans.views import TILE, TRUTH, table, tile_arrays, truth


def _drawn(text: str) -> str:
    """SQL for functions.orders.hashed."""
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _mosaic_sql(species: str, shares: tuple[float, ...], seed: int) -> str:
    most = len(shares)
    size = " ".join(f"WHEN u < {sum(shares[: k + 1])} THEN {k + 1}" for k in range(most - 1))
    return f"""WITH man AS (SELECT {species} AS species_id, l_orderkey || '-' || l_linenumber AS image FROM lineitem),
 cls AS (SELECT species_id, row_number() OVER (ORDER BY md5('{seed}:' || species_id), species_id) - 1 AS code, count(*) OVER () AS nc FROM (SELECT DISTINCT species_id FROM man)),
 img AS (SELECT species_id, image, row_number() OVER (PARTITION BY species_id ORDER BY md5('{seed}:' || image), image) AS pos, count(*) OVER (PARTITION BY species_id) AS ni FROM man),
 d AS (SELECT i AS id, {_drawn(f"'{seed}k:' || i")} / 4294967296.0 AS u, nc, list_transform(range({2 * most}), lambda j: {_drawn(f"'{seed}c:' || i || ':' || j")} % nc) AS d FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i), (SELECT max(nc) AS nc FROM cls)),
 c AS (SELECT id, least(CASE {size} ELSE {most} END, nc) AS k, list_concat(d, list_transform(range({most}), lambda j: (d[1] + j) % nc)) AS l FROM d),
 s AS (SELECT id AS mosaic, k, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM c),
 e AS (SELECT mosaic, CAST(slot AS INT) AS slot, l[slot + 1] AS code FROM (SELECT mosaic, l, unnest(range(k)) AS slot FROM s))
 SELECT mosaic, slot, species_id, image FROM e JOIN cls USING (code) JOIN img USING (species_id) WHERE pos = {_drawn(f"'{seed}i:' || mosaic || ':' || slot")} % ni + 1"""


#: A background and three to six others, all as likely.
COLLAGE_SHARES = (0, 0, 0, 0.25, 0.25, 0.25, 0.25)


@query("w10_mosaic_plan", _mosaic_sql("l_suppkey", C.MOSAIC_SHARES, 42))
def w10(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("species_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image"))
    return C.mosaic_plan(spark, m, table(spark, sf, "orders").count())


@query("w11_collage_plan", _mosaic_sql("l_partkey", COLLAGE_SHARES, 7))
def w11(spark, sf):
    """A background and three to six others."""
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("species_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image"))
    return C.mosaic_plan(spark, m, table(spark, sf, "orders").count(), COLLAGE_SHARES, 7)


def _greedy_sql(k: int) -> str:
    steps = ["s1 AS (SELECT image_id, n, [tile_id] AS chosen, pr AS cov, tile_id, list_sum(pr) AS gain FROM t QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY list_sum(pr) DESC, tile_id) = 1)"]
    for i in range(2, k + 1):
        gain = "list_sum(list_transform(range(1, 65), lambda i: greatest(t.pr[i] - s.cov[i], 0)))"
        steps.append(f"s{i} AS (SELECT image_id, n, list_append(chosen, tile_id) AS chosen, list_transform(range(1, 65), lambda i: greatest(pr[i], cov[i])) AS cov, tile_id, gain FROM (SELECT t.image_id, t.n, s.chosen, s.cov, t.pr, t.tile_id, {gain} AS gain FROM t JOIN s{i - 1} s ON t.image_id = s.image_id AND NOT list_contains(s.chosen, t.tile_id) WHERE t.n <= {k} OR s.gain >= 0.01) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY gain DESC, tile_id) = 1)")
    union = " UNION ALL ".join(f"SELECT image_id, CAST({i - 1} AS INT) AS step, tile_id, {r('gain', 'gain')} FROM s{i}" for i in range(1, k + 1))
    return f"WITH t AS (SELECT vec_id // 5 AS image_id, CAST(vec_id % 5 AS INT) AS tile_id, list_transform(embedding, lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE)))) AS pr, count(*) OVER (PARTITION BY vec_id // 5) AS n FROM embeddings), {', '.join(steps)} {union}"


@query("w16_greedy_tiles", _greedy_sql(3))
def w16(spark, sf):
    """Sequential in an image."""
    probs = F.transform("logits", lambda x: 1 / (1 + F.exp(-x)))
    return C.greedy_tiles(tile_arrays(spark, sf).select("image_id", "tile_id", probs.alias("probs")), 3)


@query("f03_solver_hook", f"WITH {TILE}, s AS (SELECT image_id, tile_id, max(logit) AS best FROM tile GROUP BY 1, 2) SELECT image_id, tile_id, {r('best', 'best')} FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY best DESC, tile_id) = 1")
def f03(spark, sf):
    """A user's solver for each image: here its tile with the largest logit."""

    def solve(pdf):
        best = pdf.assign(best=[max(x) for x in pdf["logits"]]).sort_values(["best", "tile_id"], ascending=[False, True])
        return best.head(1)[["tile_id", "best"]]

    return solve_groups(tile_arrays(spark, sf).select("image_id", "tile_id", "logits"), ["image_id"], solve, "tile_id int, best double")


@query("j16_similar_pairs", f"WITH {UNIT} SELECT a.label AS a, b.label AS b, {r('sum(a.x * b.x)', 'cosine')} FROM pt a JOIN pt b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.05")
def j16(spark, sf):
    return similar_pairs(V.prototypes(table(spark, sf, "embeddings")), "label", "prototype", 0.05)


@query("f02_scorer_hook", f"WITH {UNIT} SELECT un.vec_id, pt.label AS species_id, {r('sum(un.x * pt.x)', 'score')} FROM un JOIN pt USING (i) GROUP BY 1, 2")
def f02(spark, sf):
    bank = table(spark, sf, "embeddings")
    found = cut(V.prototypes(bank))
    if found.count() > C.SCORER_CLASSES:
        raise ValueError("too many classes for a scorer that holds them all; V.products joins them in blocks")
    protos = {p["label"]: p["prototype"] for p in found.collect()}
    return C.score_batches(bank.select("vec_id", "embedding"), C.cosine_scorer(protos, "vec_id", "embedding"), "vec_id bigint, species_id int, score double")


@query("f04_grid_boxes", "WITH im AS (SELECT p_partkey AS image_id, 300 + p_partkey * 37 % 900 AS width, 200 + p_partkey * 53 % 700 AS height FROM part) SELECT image_id, CAST(a * 2 + b AS INT) AS tile_id, CAST(round_even(b * width / 2, 0) AS INT) AS x0, CAST(round_even(a * height / 2, 0) AS INT) AS y0 FROM im, range(2) g(a), range(2) h(b)")
def f04(spark, sf):
    C.register_grid_boxes(spark)
    sizes(spark, sf).createOrReplaceTempView("image_sizes")
    return spark.sql("SELECT image_id, tile_id, x0, y0 FROM image_sizes, LATERAL grid_boxes(width, height, 2)")


GRID = [0.016, 0.0165, 0.017, 0.0175]


@query("m16_threshold_search", f"{BEST}, {TRUTH}, g AS (SELECT unnest({GRID}) AS t), q AS (SELECT t, image_id, species_id FROM k, g WHERE rank <= 5 AND (score >= t OR rank <= 1)), a AS (SELECT t, species_id, count(*) AS p, count(tr.image_id) AS tp FROM q LEFT JOIN truth tr USING (image_id, species_id) GROUP BY 1, 2), n AS (SELECT species_id, count(*) AS n FROM truth GROUP BY 1), f AS (SELECT g.t, s.species_id, CASE WHEN coalesce(tp, 0) > 0 THEN 2.0 * tp / (p + n) ELSE 0 END AS f FROM g CROSS JOIN (SELECT DISTINCT species_id FROM k) s LEFT JOIN a ON a.t = g.t AND a.species_id = s.species_id LEFT JOIN n ON n.species_id = s.species_id WHERE p IS NOT NULL OR n IS NOT NULL) SELECT CAST(t AS DOUBLE) AS threshold, {r('avg(f)', 'macro')} FROM f GROUP BY 1")
def m16(spark, sf):
    """Macro F1 over labels for each threshold of a grid."""
    ranked = K.cap_first(scored(spark, sf), float("-inf"), 5, 1)
    return M.label_f1_sweep(K.levels(ranked, GRID, 1), truth(spark, sf), GRID).select("threshold", "macro")


@query("a17_unseen_species", f"{BEST} SELECT image_id, count(*) AS n FROM k WHERE rank <= 3 AND species_id % 5 = 0 GROUP BY 1")
def a17(spark, sf):
    known = K.fixed_topk(scored(spark, sf), 3).select("species_id").distinct().where("species_id % 5 <> 0")
    return K.fixed_topk(scored(spark, sf), 3).join(known, "species_id", "left_anti").groupBy("image_id").agg(F.count("*").alias("n"))


@query("j05_listed_images", f"{BEST} SELECT DISTINCT image_id FROM k WHERE image_id % 3 = 0")
def j05(spark, sf):
    from tesserae.sources.readers import existing

    items = base(spark, sf).distinct()
    listing = items.select(F.col("image_id").alias("image_path"), F.when(F.col("image_id") % 3 == 0, 5_000).otherwise(10).alias("length"))
    return existing(items, listing, "image_id")


@query("j13_traits_of_species", "SELECT p_brand AS species, min(c_mktsegment) AS trait, count(*) AS n FROM part JOIN customer ON p_partkey = c_custkey GROUP BY 1")
def j13(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), F.col("c_mktsegment").alias("trait"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.col("p_brand").alias("species")).join(t, "image").groupBy("species").agg(F.min("trait").alias("trait"), F.count("*").alias("n"))


@query("j10_ordinal_pairs", "SELECT a.o_orderkey, b.o_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS i FROM orders) a JOIN (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS i FROM orders) b USING (i)")
def j10(spark, sf):
    """Two files that pair by place: each is written with its rows' places, and the places are joined."""
    out = scratch(spark, "paired")
    for name, column in (("predictions", "o_orderkey"), ("truths", "o_custkey")):
        places(table(spark, sf, "orders"), [], "o_orderkey").select("__at", column).write.csv(f"{out}/{name}", header=True)
    a = spark.read.schema("at bigint, o_orderkey bigint").csv(f"{out}/predictions", header=True)
    return a.join(spark.read.schema("at bigint, o_custkey bigint").csv(f"{out}/truths", header=True), "at").select("o_orderkey", "o_custkey")


@query("e33_text_fusion", f"WITH {UNIT}, s AS (SELECT un.vec_id, pt.label, sum(un.x * pt.x) AS s FROM un JOIN pt USING (i) GROUP BY 1, 2) SELECT vec_id, label, {r('0.6 * s + 0.4 * (1.0 / (1 + label))', 'score')} FROM s")
def e33(spark, sf):
    bank = table(spark, sf, "embeddings")
    c = V.cosine_scores(bank.select("vec_id", "embedding"), V.prototypes(bank), "vec_id", "embedding")
    return c.select("vec_id", "label", (0.6 * F.col("score") + 0.4 / (1 + F.col("label"))).alias("score"))
