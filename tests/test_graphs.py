"""Walks over a sparse graph in one pass, against the joins of each step."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import graphs
from tesserae.operators import scores as S


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.gauss(0, 1), rng.random()) for i in range(40) for s in rng.sample(range(30), rng.randint(1, 20))]
    rows += [(50, 3, None, None), (50, 4, 1.0, 0.5)]
    edges = [(a, b, rng.random()) for a in range(25) for b in rng.sample(range(28), 4) if a != b]
    return spark.createDataFrame(rows, "image_id int, species_id int, logit double, prob double").repartition(3), spark.createDataFrame(edges, "a int, b int, w double")


def found(df):
    return {(r.image_id, r.species_id): r.score for r in df.collect()}


@pytest.mark.parametrize("numbers", [1 << 22, 64])
def test_one_pass_equals_joins(spark, tables, monkeypatch, numbers):
    scores, edges = tables
    scores = scores.where("prob is not null")
    monkeypatch.setattr(graphs, "STEP_NUMBERS", numbers)
    one = [found(S.random_walk(scores, edges, steps=4)), found(S.mean_field(scores, edges))]
    monkeypatch.setattr(graphs, "SENT_EDGES", 0)
    assert [found(S.random_walk(scores, edges, steps=4)), found(S.mean_field(scores, edges))] == [pytest.approx(x) for x in one]


def test_exchanges_do_not_grow_with_steps(spark, tables):
    scores, edges = tables
    plans = [S.random_walk(scores, edges, steps=n)._jdf.queryExecution().executedPlan().toString() for n in (1, 30)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_nulls_and_no_edges(spark, tables):
    scores, edges = tables
    got = found(S.random_walk(scores.where("image_id = 50"), edges.where("false"), keep=0.5, steps=2))
    assert got == {(50, 3): None, (50, 4): 0.25}
    assert S.random_walk(scores.where("image_id < 0"), edges).count() == 0
