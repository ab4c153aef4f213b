"""Exact pruned similarity joins against all products."""

import numpy as np
import pytest

from tesserae.operators import vector_join as J
from tesserae.operators import vectors as V


def clustered(seed, n, width=24, groups=12):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(groups, width))
    x = centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, width))
    x[:3] = 0
    x[3:9] = x[9]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def frame(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], f"{key} int, vec array<double>").repartition(3)


@pytest.mark.parametrize(("least", "numbers"), [(0.8, 1 << 20), (0.8, 600), (0.3, 2000), (1.0 - 1e-9, 600), (-0.2, 4000), (None, 4000)])
def test_near_vectors(spark, least, numbers):
    x, y = clustered(1, 150), clustered(2, 130)
    want = x @ y.T
    pairs = {(i, j): want[i, j] for i, j in zip(*np.nonzero(want >= (-9 if least is None else least)), strict=True)}
    got = {(r.a, r.b): r.cosine for r in J.near_vectors(frame(spark, x, "a"), frame(spark, y, "b"), least, numbers=numbers).collect()}
    assert got == pytest.approx(pairs)
    assert J.near_vectors(frame(spark, x, "a"), frame(spark, y[:0], "b"), least).count() == 0


def test_few_pairs_are_multiplied():
    x, y = clustered(3, 4000), clustered(4, 3000)
    pivots = x[10 : 10 + J.PIVOTS]
    parts = list(J.pruned_products(x, y, pivots, 0.8))
    assert sum(n for *_, n in parts) < len(x) * len(y) / 5
    got = {(i, j) for a, b, _, _ in parts for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.8)), strict=True))


def test_large_banks_take_the_grid(spark):
    x, y = clustered(5, 60), clustered(6, 50)
    for least in (None, 0.5):
        few, many = (V.products(frame(spark, x, "a"), "a", "vec", frame(spark, y, "b"), "b", "vec", "s", least, sent=n) for n in (1 << 22, 0))
        assert "cogroup" in many._jdf.queryExecution().toString().lower()
        assert {(r.a, r.b): r.s for r in many.collect()} == pytest.approx({(r.a, r.b): r.s for r in few.collect()})


def test_grid_of_all_pairs(spark):
    a, b = spark.range(70).withColumnRenamed("id", "a"), spark.range(50).withColumnRenamed("id", "b")
    got = V.against_all(a, b, rows=20)
    assert sorted(map(tuple, got.collect())) == [(i, j) for i in range(70) for j in range(50)]
