"""Grids of thresholds from one aggregate, against one threshold at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import metrics as M
from tesserae.operators import selection as K

GRID = [i / 200 for i in range(200)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    scores = [(i, s, rng.choice([0.0, 0.005, rng.random(), rng.random() ** 3])) for i in range(30) for s in rng.sample(range(25), 12)]
    truth = {(i, rng.randrange(28)) for i in range(30) for _ in range(3)}
    return spark.createDataFrame(scores, "image_id int, species_id int, score double").cache(), spark.createDataFrame(sorted(truth), "image_id int, species_id int").cache()


def scans(df):
    """Reads of the cached scores, as the plan has them."""
    return df._jdf.queryExecution().executedPlan().toString().count("score#") and df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")


@pytest.mark.parametrize(("min_k", "max_k"), [(1, 8), (0, 4), (3, 12)])
def test_sweep(spark, tables, min_k, max_k):
    scores, _ = tables
    got = {r.threshold: (r.mean_k, r.n_species) for r in K.sweep(scores, GRID[::-1], min_k, max_k).collect()}
    want = {}
    for g in GRID[::9] + [GRID[-1]]:
        kept = K.cap_first(scores, g, max_k, min_k)
        n, images, species = kept.agg(F.count("*"), F.count_distinct("image_id"), F.count_distinct("species_id")).first()
        if n:
            want[g] = (n / images, species)
    some = [g for g in got if g in GRID[::9] + [GRID[-1]]]
    assert sorted(some) == sorted(want)
    assert all(got[g] == pytest.approx(want[g]) for g in some)
    assert scans(K.sweep(scores, GRID, min_k, max_k)) == scans(K.sweep(scores, GRID[:2], min_k, max_k)) == 1


def test_label_f1_sweep(spark, tables):
    scores, truth = tables
    for min_k in (0, 1):
        ranked = K.cap_first(scores, float("-inf"), 6, 1)
        got = {r.threshold: (r.macro, r.weighted, r.micro) for r in M.label_f1_sweep(K.levels(ranked, GRID, min_k), truth, GRID).collect()}
        assert len(got) == len(GRID)
        for g in GRID[::23] + [GRID[-1]]:
            assert got[g] == pytest.approx(tuple(M.label_f1(K.cap_first(scores, g, 6, min_k), truth).first()))
    few, many = (M.label_f1_sweep(K.levels(ranked, g, 1), truth, g) for g in (GRID[:2], GRID))
    assert scans(few) == scans(many)


def test_nothing_kept(spark, tables):
    scores, truth = tables
    assert K.sweep(scores, [2.0, 3.0], 0, 5).count() == 0
    rows = M.label_f1_sweep(K.levels(K.cap_first(scores, float("-inf"), 6, 1), [2.0, 3.0], 0), truth, [2.0, 3.0]).collect()
    assert [(r.threshold, r.macro, r.micro) for r in rows] == [(2.0, 0.0, 0.0), (3.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="ascending"):
        K.levels(scores, [0.2, 0.1], 1)
