"""Draws that do not depend on how rows are dealt, and lazy greedy choices."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import orders
from tesserae.operators import compose, curation


def test_draws_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.random() ** 9, 0.1, 1e-300, 3.3, 0.0, -1.0, math.nan])) for i in range(3000)] + [(5000, None)]
    made = spark.createDataFrame(rows, "key int, w double")
    found = [sorted(map(tuple, curation.weighted_draws(made.repartition(n), F.col("w"), 5000, "key").collect())) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2]
    assert [d for d, _ in found[0]] == list(range(5000))
    weights = {k: w for k, w in rows if w is not None and w > 0}
    counts = Counter(k for _, k in found[0])
    assert set(counts) <= set(weights)
    heavy = [k for k, w in weights.items() if w == 3.3]
    assert sum(counts[k] for k in heavy) == pytest.approx(5000 * 3.3 * len(heavy) / sum(weights.values()), rel=0.02)
    assert curation.weighted_draws(made.where("w <= 0"), F.col("w"), 10, "key").count() == 0


def test_places_of_small_and_large_groups(spark, monkeypatch):
    """Short and long prefixes give the same places."""
    rows = spark.createDataFrame([(i % 7 if i % 11 else None, i) for i in range(2000)], "g int, k int").repartition(5)
    found = []
    for few in (orders.FEW_ROWS, 0):
        monkeypatch.setattr(orders, "FEW_ROWS", few)
        found.append(sorted(map(tuple, orders.places(rows, ["g"], "k").collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == 2000


def plain_greedy(probs, k, least):
    """All gains computed anew in each step."""
    covered, steps = np.zeros(probs.shape[1]), []
    while len(steps) < min(k, len(probs)):
        gains = np.clip(probs - covered, 0, None).sum(1)
        gains[[i for i, _ in steps]] = -1
        best = int(gains.argmax())
        steps.append((best, gains[best]))
        covered = np.maximum(covered, probs[best])
        if len(probs) > k and gains[best] < least:
            break
    return steps


@pytest.mark.parametrize("seed", range(6))
def test_lazy_greedy(seed):
    """The same steps, ties included, from fewer gains."""
    rng = np.random.default_rng(seed)
    probs = np.where(rng.random((200, 60)) < 0.1, rng.random((200, 60)), 0.02).round(seed % 3 + 1)
    probs[50:60] = probs[40:50]
    for k in (1, 20, 200, 300):
        steps, computed = compose.lazy_greedy(probs, k, 0.01)
        want = plain_greedy(probs, k, 0.01)
        assert [i for i, _ in steps] == [i for i, _ in want]
        assert [g for _, g in steps] == pytest.approx([g for _, g in want])
        assert computed < 0.6 * 200 * len(steps) or len(steps) < 3
    assert compose.lazy_greedy(np.zeros((0, 3)), 5, 0.1) == ([], 0)
