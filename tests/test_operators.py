"""Hand-computed cases, invariants, and brute force for what SQL cannot express."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.functions.columns import norm_species_id, softmax
from tesserae.operators import boxes, compose, constraints, curation, metrics, pooling, scores, seasons, selection, vectors
from tesserae.plans.selecting import scored
from tesserae.plans.views import table, tile_arrays

RUN = catalog.queries()


def long(spark, tiles):
    """Dense tile vectors as (image_id, tile_id, species_id, prob, logit)."""
    return spark.createDataFrame([(1, t, s, float(p), float(p)) for t, v in enumerate(tiles) for s, p in enumerate(v)], "image_id int, tile_id int, species_id int, prob double, logit double")


def edges(spark, near):
    return spark.createDataFrame([(a, b) for a, bs in near.items() for b in bs if a != b], "a int, b int")


def test_continuous_consistency(spark):
    """Hand-computed: 0.9 x 0.1 and 0.8 x 0.01."""
    compat = [[1, 0.5, 0.1, 0.9], [0.5, 1, 0.5, 0.2], [0.1, 0.5, 1, 0.01], [0.9, 0.2, 0.01, 1]]
    c = spark.createDataFrame([(a, b, float(x)) for a, r in enumerate(compat) for b, x in enumerate(r) if a != b], "a int, b int, c double")
    t = long(spark, [[0.9, 0, 0.8, 0], [0, 0.7, 0, 0.6]])
    got = {(r.tile_id, r.species_id): r.prob for r in constraints.continuous_consistency(t, edges(spark, {0: {1}, 1: {0}}), c, 0.1).collect()}
    assert got[0, 0] == pytest.approx(0.09)
    assert got[0, 2] == pytest.approx(0.008)
    assert got[1, 0] == 0


def test_greedy_compatible(spark):
    """Hand-computed: 0 is taken, 1 does not stand beside it."""
    s = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([10, 9, 1, 0, 0])], "image_id int, species_id int, score double")
    got = [r.species_id for r in selection.greedy_compatible(s, edges(spark, {0: {2}, 1: {2}, 2: {0, 1}}), 2).orderBy("rank").collect()]
    assert got == [0, 2]


def test_greedy_compatible_against_a_loop(spark, sf):
    chosen = {}
    for r in RUN["e25_greedy_compatible"](spark, sf).collect():
        chosen.setdefault(r.image_id, {})[r["rank"]] = r.species_id
    by_image = {}
    for r in scored(spark, sf).collect():
        by_image.setdefault(r.image_id, []).append((-r.score, r.species_id))
    for image, found in by_image.items():
        kept = []
        for _, s in sorted(found):
            if len(kept) < 5 and all(k // 4 != s // 4 for k in kept):
                kept.append(s)
        assert [chosen[image][i + 1] for i in range(len(kept))] == kept


def test_hard_consistency_against_a_loop(spark):
    rng = random.Random(2)
    spark.sparkContext.getCheckpointDir()
    for _ in range(3):
        near = {a: {b for b in range(6) if b != a and rng.random() < 0.4} for a in range(6)}
        near = {a: near[a] | {b for b in near if a in near[b]} for a in near}
        tiles = [[rng.random() for _ in range(6)] for _ in range(3)]
        domain = [{s for s, p in enumerate(v) if p > 0.5} for v in tiles]
        changed = True
        while changed:
            changed = False
            for i, j in itertools.permutations(range(3), 2):
                keep = {s for s in domain[i] if domain[j] & (near[s] | {s})}
                changed |= keep != domain[i]
                domain[i] = keep
        got = constraints.hard_consistency(long(spark, tiles), edges(spark, near), 0.5).collect()
        assert {(r.tile_id, r.species_id) for r in got if r.prob > 0} == {(i, s) for i in range(3) for s in domain[i]}


@pytest.mark.parametrize("n", [60, 61])
def test_hard_consistency_of_a_long_chain(spark, n):
    """Species i of one tile is next to i - 1 and i + 1 of the other one; the last support is missing, so none stays."""
    rows = [(1, i % 2, i, 0.9) for i in range(n)] + [(2, 0, 5, 0.9), (2, 0, 6, 0.1), (3, 0, 1, 0.9), (3, 1, 2, 0.1)]
    t = spark.createDataFrame(rows, "image_id int, tile_id int, species_id int, prob double")
    chain = {i: {i + 1} for i in range(n - 1)}
    one_way = spark.createDataFrame([(a, b) for a, bs in chain.items() for b in bs], "a int, b int")
    got = {(r.image_id, r.tile_id, r.species_id): r.prob for r in constraints.hard_consistency(t, one_way, 0.5).collect()}
    assert all(got[1, i % 2, i] == 0 for i in range(n))
    assert got[2, 0, 5] == 0.9 and got[2, 0, 6] == 0.1 and got[3, 0, 1] == 0
    both = one_way.union(one_way.select("b", "a"))
    got = {(r.image_id, r.tile_id, r.species_id): r.prob for r in constraints.hard_consistency(t, both, 0.5).collect()}
    assert all(got[1, i % 2, i] == 0.9 for i in range(n))


def test_tile_clusters_of_a_long_chain(spark):
    """Each tile is near the next one only; the chain is one cluster, another image has its own."""
    n = 200
    chain = [(1, i, [math.cos(i * 0.012), math.sin(i * 0.012)]) for i in range(n)]
    t = spark.createDataFrame([*chain, (2, 7, [1.0, 0.0]), (2, 8, [0.0, 1.0]), (2, 9, [1.0, 0.001])], "image_id int, tile_id int, v array<double>")
    got = {(r.image_id, r.tile_id): r.cluster for r in vectors.tile_clusters(t, "v", math.cos(0.013), block=16).collect()}
    assert all(got[1, i] == 0 for i in range(n))
    assert [got[2, i] for i in (7, 8, 9)] == [7, 8, 7]


def test_order_statistic(spark, monkeypatch):
    from tesserae.functions import orders

    rng = random.Random(4)
    values = [rng.choice([rng.random() ** 8, 0.25, -3.0]) for _ in range(3000)] + [1e9, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(v for v in values if v is not None)
    monkeypatch.setattr(orders, "FEW_VALUES", 10)
    for at in (0, 1, 700, 1500, 2222, 2999, 3000):
        assert orders.order_statistic(df, "v", at) == want[at]
    assert orders.order_statistic(df, "v", 3001) is None and orders.order_statistic(df, "v", -1) is None


def test_places_of_one_hot_group(spark):
    """Places in a group that holds most rows, in null groups and over all, against one plain order; no window over whole groups."""
    import hashlib

    from tesserae.functions import orders

    rows = [(None if i % 10 == 0 else "hot" if i % 3 else "rare", f"k{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k string")
    for groups in (["g"], []):
        got = {(r.g, r.k): (r["__at"], r["__of"]) for r in orders.places(df, groups, "k").collect()}
        found = {}
        for g, k in rows:
            found.setdefault(g if groups else 0, []).append((hashlib.md5(f"42:{k}".encode()).hexdigest(), k, g))
        for x in found.values():
            assert [got[g, k] for _, k, g in sorted(x)] == [(i + 1, len(x)) for i in range(len(x))]
    plan = curation.split_train(df, "g", 0.1, "k")._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(g#" in plan and "__p#" in plan.split("row_number() windowspecdefinition(g#")[1].split(")")[0]


@pytest.mark.parametrize("sent", [1 << 22, 10])
def test_products_sent_or_joined(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT_NUMBERS", sent)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=(7, 5))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>")
    b = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(y)] + [("none", None)], "c string, w array<double>")
    for least in (None, 0.5):
        got = {(r.id, r.c): r.s for r in vectors.products(q, "id", "v", b, "c", "w", "s", least).collect()}
        want = {(i, f"c{j}"): z for (i, j), z in np.ndenumerate(x @ y.T) if least is None or z >= least}
        assert got == pytest.approx(want)


def test_greedy_tiles_keeps_small_images_and_the_last_step(spark):
    t = [(1, 0, [0.5, 0.0]), (1, 1, [0.5, 0.005]), (2, 0, [0.9, 0.0]), (2, 1, [0.9, 0.004]), (2, 2, [0.9, 0.0]), (2, 3, [0.1, 0.0])]
    df = spark.createDataFrame(t, "image_id int, tile_id int, probs array<double>")
    got = {}
    for r in compose.greedy_tiles(df, 3).orderBy("image_id", "step").collect():
        got.setdefault(r.image_id, []).append((r.tile_id, round(r.gain, 6)))
    assert got == {1: [(1, 0.505), (0, 0.0)], 2: [(1, 0.904), (0, 0.0)]}


def test_softmax_adds_up(spark):
    t = long(spark, [[1000.0, 999.0, -5.0], [0.0, 0.0, 0.0]]).drop("prob")
    got = softmax(t, ["image_id", "tile_id"]).groupBy("tile_id").agg(F.sum("prob").alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([1, 1])


@pytest.mark.parametrize("name", sorted(pooling.POOLS))
def test_pools_keep_every_species(spark, name):
    rng = np.random.default_rng(1)
    t = softmax(long(spark, rng.normal(size=(4, 5))).drop("prob"), ["image_id", "tile_id"]).withColumn("veg_weight", F.lit(0.5))
    got = pooling.POOLS[name](t).collect()
    assert sorted(r.species_id for r in got) == list(range(5))
    assert all(math.isfinite(r.score) for r in got)


def test_pool_costs_one_exchange(spark, sf):
    from tesserae.plans.pooling import soft

    plan = pooling.pool_entropy(soft(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_zero_weights_fall_back_to_the_mean(spark):
    t = long(spark, [[0.2, 0.4], [0.6, 0.0]]).withColumn("veg_weight", F.lit(0.0))
    assert sorted(r.score for r in pooling.pool_veg(t).collect()) == pytest.approx([0.2, 0.4])
    assert all(r.score is None for r in pooling.pool_entropy_exg(t).collect())


def test_phylo_rows_add_up(spark):
    """With the pairs beyond a family, each row adds up to 1, and a genus weighs more than a family."""
    tax = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 2, 1)], "species_id int, genus_id int, family_id int")
    w = {(r.a, r.b): r.w for r in scores.phylo_weights(tax).collect()}
    far = w[0, 0] * math.exp(-2)
    assert sum(w[0, b] for b in (0, 1, 2)) + far == pytest.approx(1)
    assert w[0, 1] > w[0, 2] > far


def test_anchor_filter(spark):
    s = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7)], "image_id int, species_id int, prob double")
    assert {r.species_id: r.score for r in scores.anchor_filter(s, edges(spark, {0: {1}, 1: {0}})).collect()} == {0: 0.9, 1: 0.8, 2: 0.0}


def test_a_prior_never_adds_mass_without_tau(spark):
    s = spark.createDataFrame([(1, 0, 0.7), (1, 1, 0.3)], "image_id int, species_id int, prob double")
    p = spark.createDataFrame([(0, -0.1), (1, -2.0)], "species_id int, prior double")
    same = {r.species_id: r.score for r in scores.adjust_softmax(s, p, 0.0).collect()}
    assert same == pytest.approx({0: 0.7, 1: 0.3})
    moved = {r.species_id: r.score for r in scores.adjust_softmax(s, p, 1.0).collect()}
    assert moved[1] > same[1]


def test_ensemble_checks_weights(spark):
    with pytest.raises(ValueError):
        scores.weighted_ensemble(spark.createDataFrame([], "model_id string, image_id int, species_id int, prob double"), {"a": 0.0})


def test_day_pdf_adds_up(spark):
    h = spark.createDataFrame([(0, 1, 5), (0, 12, 3), (1, 6, 0)], "species_id int, month int, n bigint")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "species_id int")
    for variant in ("per_month", "summed"):
        got = seasons.day_pdf(spark, h, classes, variant).groupBy("species_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
        assert sorted(r.n for r in got) == [365] * 3
        assert [r.s for r in got] == pytest.approx([1] * 3)
    assert seasons.month_efficiency(spark, h, classes).groupBy("species_id").agg(F.max("efficiency").alias("m")).where("m <> 1").count() == 0


def test_f1_of_empty_sets(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    none = spark.createDataFrame([], "image_id int, species_id int")
    assert metrics.mean_sample_f1(none, none, images, 0.0).first().f1 == 0
    assert metrics.mean_sample_f1(none, none, images, 1.0).first().f1 == 1
    one = spark.createDataFrame([(1, 5)], "image_id int, species_id int")
    assert metrics.mean_sample_f1(one, one, images, 1.0).first().f1 == 1
    assert metrics.mean_sample_f1(one, one, images, 0.0).first().f1 == 0.5


def test_norm_species_id(spark):
    t = spark.createDataFrame([(" 123.0 ",), ("7",), ("",), (None,), ("x.05",)], "s string")
    assert [r.s for r in t.select(norm_species_id("s").alias("s")).collect()] == ["123", "7", None, None, "x.05"]


def test_cap_and_split_counts(spark):
    sizes = {"a": 1, "b": 4, "c": 5, "d": 40}
    t = spark.createDataFrame([(g, f"{g}{i}") for g, n in sizes.items() for i in range(n)], "species_id string, image string")
    capped = {r.species_id: r["count"] for r in curation.cap(t, "species_id", 10, "image").groupBy("species_id").count().collect()}
    assert capped == {g: min(n, 10) for g, n in sizes.items()}
    val = {r.species_id: r["count"] for r in curation.split_train(t, "species_id", 0.1, "image").where("split = 'val'").groupBy("species_id").count().collect()}
    assert val == {"c": 1, "d": 4}


def test_weighted_draws(spark):
    t = spark.createDataFrame([(f"k{i}", w) for i, w in enumerate([0.0, 1.0, 3.0, float("nan"), -2.0, None, 6.0])], "key string, w double")
    got = curation.weighted_draws(t, F.col("w"), 4000, "key").groupBy("key").count().collect()
    counts = {r.key: r["count"] for r in got}
    assert sum(counts.values()) == 4000 and set(counts) == {"k1", "k2", "k6"}
    assert counts["k6"] == pytest.approx(2400, abs=60) and counts["k2"] == pytest.approx(1200, abs=60)


def test_day_of_year(spark):
    t = spark.createDataFrame([("x-20240229",), ("99999999-20201231",), ("12345",), ("18991231",)], "q string")
    assert [r.d for r in t.select(curation.day_of_year(F.col("q")).alias("d")).collect()] == [60, 365, None, None]


def test_resolve_and_align(spark):
    t = spark.createDataFrame([("1", "g")], "Class_ID string, genus_name string")
    out = curation.align(curation.resolve(t, {"species_id": ["class_id"], "genus": ["GENUS_NAME"]}), ["genus", "species_id", "order"])
    assert out.collect() == [("g", "1", None)]


def test_fill_keeps_rows(spark):
    t = spark.createDataFrame([(1, None), (1, "own"), (2, None)], "k int, genus string")
    tax = spark.createDataFrame([(1, "b"), (1, "a")], "k int, genus string")
    assert sorted(map(str, (r.genus for r in curation.fill_taxonomy(t, tax, "k", ["genus"]).collect()))) == ["None", "a", "own"]


def test_mosaics_follow_their_shares(spark, sf):
    got = RUN["w10_mosaic_plan"](spark, sf)
    n = table(spark, sf, "orders").count()
    per = got.groupBy("mosaic").agg(F.count("*").alias("k"), F.count_distinct("species_id").alias("d"))
    assert per.count() == n and per.where("k <> d").count() == 0
    share = {r.k: r["count"] / n for r in per.groupBy("k").count().collect()}
    assert [share[k] for k in range(1, 6)] == pytest.approx(compose.MOSAIC_SHARES, abs=0.05)


def test_tile_clusters_against_union_find(spark, sf):
    got = {(r.image_id, r.tile_id): r.cluster for r in RUN["v06_tile_clusters"](spark, sf).collect()}
    images = {}
    for r in tile_arrays(spark, sf).collect():
        v = np.array(r.logits)
        images.setdefault(r.image_id, {})[r.tile_id] = v / np.linalg.norm(v)
    for image, tiles in images.items():
        root = {t: t for t in tiles}
        for _ in tiles:
            for a, b in itertools.combinations(tiles, 2):
                if tiles[a] @ tiles[b] > 0.1:
                    root[a] = root[b] = min(root[a], root[b])
        assert {t: got[image, t] for t in tiles} == root


def test_principal_axes(spark, sf):
    x = np.array([r.embedding for r in table(spark, sf, "embeddings").orderBy("vec_id").collect()], float)
    got = np.array([r.components for r in RUN["v08_principal"](spark, sf).orderBy("vec_id").collect()])
    want = np.linalg.svd(x - x.mean(0), compute_uv=False)[:8]
    assert np.linalg.norm(got, axis=0) == pytest.approx(want, rel=1e-3)


def test_audit_finds_bad_vectors(spark):
    b = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 0.0]), (1, [float("nan"), 1.0])], "label int, embedding array<double>")
    got = {r.label: (r.n, r.nans, r.zeros) for r in vectors.audit(b).collect()}
    assert got == {0: (2, 0, 1), 1: (1, 1, 0)}


def test_sliding_covers_the_image(spark):
    im = spark.createDataFrame([(1, 1000, 700), (2, 100, 50), (3, 448, 449)], "image_id int, width int, height int")
    t = boxes.sliding(im, 448, 224)
    assert t.where("x0 < 0 or y0 < 0 or x1 <= x0 or y1 <= y0").count() == 0
    assert {(r.image_id, r.a, r.b) for r in t.groupBy("image_id").agg(F.max("x1").alias("a"), F.max("y1").alias("b")).collect()} == {(1, 1000, 700), (2, 100, 50), (3, 448, 449)}
    assert {r.image_id: r.n for r in boxes.tile_count(im, 448, 224, [1.0]).collect()} == {r.image_id: r["count"] for r in t.groupBy("image_id").count().collect()}


def test_stale_transitions_against_gaps(spark, sf):
    got = {(r.run_id, r["rank"], r["last"]) for r in RUN["t03_stale_transitions"](spark, sf).collect()}
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 8).cast("int"), F.col("ts").cast("timestamp")).collect()
    last = {}
    for run, rank, ts in rows:
        last[run, rank] = max(last.get((run, rank), ts), ts)
    end = max(last.values())
    silent = {(run, rank, ts) for (run, rank), ts in last.items() if (end - ts).total_seconds() > 7200 + 600 + 1}
    cut = {(run, rank) for run, rank, _ in got}
    assert len(cut) == len(got)
    assert {(a, b, c.replace(microsecond=c.microsecond // 1000 * 1000)) for a, b, c in silent} <= got


def test_tilings_hold_no_table_of_images(spark, sf):
    """Sizes go along with the boxes: no tiling joins the images again, however many there are."""
    assert "Join" not in RUN["f01_tiling_registry"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_centred_cells_of_repeated_images(spark):
    """Every row of images has its own cells, also one that comes twice or has no id."""
    im = spark.createDataFrame([(1, 100, 60), (1, 100, 60), (None, 3, 2)], "image_id int, width int, height int")
    got = boxes.centred_grid(im, 0.8, 2)
    assert sorted(((r.image_id, r.tile_id, r.x0, r.y0, r.x1, r.y1) for r in got.collect()), key=str)[::2] == [(1, 0, 10, 6, 50, 30), (1, 1, 50, 6, 90, 30), (1, 2, 10, 30, 50, 54), (1, 3, 50, 30, 90, 54), (None, 0, 0, 0, 1, 1), (None, 2, 0, 1, 1, 2)]


def test_added_species_take_no_table_of_maxima(spark, sf, monkeypatch):
    """What visits have is left out as it stands, by tasks of so many rows; a plot of one visit, an unknown visit and a missing plot add nothing."""
    plan = RUN["w17_propagate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" not in plan and "Join LeftAnti" in plan
    monkeypatch.setattr(curation, "TASK_ROWS", 2)
    visits = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, None), (6, None)], "visit int, plot int")
    seen = spark.createDataFrame([(1, 10, 0.99), (1, 10, 0.1), (2, 10, None), (2, 11, 1.0), (3, 12, 0.98), (4, 13, 1.0), (5, 14, 1.0), (9, 15, 1.0)], "visit int, species int, p double")
    got = curation.propagated(visits, seen, 0.98)
    assert sorted(map(tuple, got.collect())) == [(1, 11), (3, 10), (3, 11)]
    assert got.rdd.getNumPartitions() == 7  # 6 pairs and 8 rows


@pytest.mark.parametrize("few", [20_000, 2])
def test_mosaics_meet_lists_of_images(spark, sf, monkeypatch, few):
    """What is drawn meets its class and images in one join; with short lists, and in groups ordered by prefixes, the same images are drawn."""
    from tesserae.functions import orders

    assert RUN["w11_collage_plan"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    rows = [(s, f"{s}-{i}") for s, n in enumerate((1, 2, 7, 12)) for i in range(n)]
    m = spark.createDataFrame(rows, "species_id int, image string")
    shares = (0, 0, 0.5, 0.3, 0.2)
    want = sorted(map(tuple, compose.mosaic_plan(spark, m, 300, shares).collect()))
    per = {}
    for mosaic, _, species, image in want:
        per.setdefault(mosaic, []).append(species)
        assert image.startswith(f"{species}-")
    assert all(len(set(x)) == len(x) for x in per.values()) and {len(x) for x in per.values()} == {3, 4}
    assert {x[3] for x in want} == {i for _, i in rows}
    monkeypatch.setattr(orders, "FEW_ROWS", few)
    for module in (orders, compose):
        monkeypatch.setattr(module, "LIST_KEYS", 3)
    assert sorted(map(tuple, compose.mosaic_plan(spark, m, 300, shares).collect())) == want
