import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.components import components
from tests.llm.cases import SCHEMA, clashing, documents, long_text, rows


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, near):
    """pairs of (id, fp); the smallest id reachable for each."""
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(pairs)), 2):
        if near(pairs[i][1], pairs[j][1]):
            parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [ids.get(find(i)) for i in range(len(pairs))]


@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, clash):
    docs = documents(spark)
    got = simhash.near_duplicates(clashing(docs) if clash else docs).collect()
    want = [(d, brute_fingerprint(t)) for d, t, *_ in rows()]
    least = brute_components(want, lambda a, b: (a ^ b).bit_count() <= 4)
    expected = sorted(((d if d is not None else -1), f"{f:016x}", c) for (d, f), c in zip(want, least, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == expected


def test_all_documents(spark, sf):
    """Every document's fingerprint and component against all pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    least = brute_components(found, lambda a, b: (a ^ b).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", c) for (d, f), c in zip(found, least, strict=True))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in rng.choice(base, n)]
    dense = [0xF0F0 ^ sum(1 << int(k) for k in rng.choice(64, 2, replace=False)) for _ in range(60)]
    return sorted({int(x) for x in base} | set(near) | set(dense))


@pytest.mark.parametrize("limit", [20_000, 3])
def test_links_connect_what_pairs_connect(spark, limit):
    fps = planted(150, limit)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    roots = dict(components(simhash.links(df, 4, limit)).collect())
    got = [roots.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps]
    want = brute_components(list(enumerate(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    same = lambda xs: [xs.index(x) for x in xs]
    assert same(got) == same(want)


@pytest.mark.parametrize("limit", [20_000, 2])
@pytest.mark.parametrize("distance", [1, 3])
def test_odd_distances(spark, distance, limit):
    """In crowded buckets too: the least value in the smaller half is met by all in the larger one."""
    fps = planted(60, 11)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = dict(components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), distance, limit)).collect())
    want = brute_components(list(enumerate(fps)), lambda a, b: (a ^ b).bit_count() <= distance)
    same = lambda xs: [xs.index(x) for x in xs]
    assert same([roots.get(f, f) for f in signed]) == same(want)


@pytest.mark.parametrize("n", [10, 10_000, 10**6, 10**9, 10**11])
def test_plan_keeps_the_pigeonhole_bound(n):
    order = simhash.bit_order(np.eye(64).ravel() * n / 2 + n / 4, n)
    assert sorted(order) == list(range(64))
    segments = simhash.plan(order, np.full(16 * 16, n / 16), n, 4)
    bits = [b for s, _ in segments for b in s]
    assert len(bits) == len(set(bits))
    assert sum(t + 1 for _, t in segments) == 5


def test_more_fingerprints_get_wider_segments():
    width = lambda n: min(len(b) for b, _ in simhash.plan(list(range(64)), np.full(256, n / 16), n, 4))
    assert width(10**10) > width(10**5)


def test_long_paths_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a bigint, b bigint")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


@pytest.mark.parametrize("few", [200_000, 0])
def test_stars_with_a_hot_centre(spark, monkeypatch, few):
    """A star of 3,000 nodes, a path and lone pairs settle, with minima sent or joined; a centre's edges are not dealt by it."""
    from tesserae.llm import components as module

    monkeypatch.setattr(module, "FEW_EDGES", few)
    edges = [(5, i) for i in range(10, 3010)] + [(i, i + 1) for i in range(5000, 5040)] + [(2, 3009), (7000, 6999)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 2 for i in [5, *range(10, 3010)]}, **{i: 5000 for i in range(5001, 5041)}, 7000: 6999}


def test_shared_texts_stay_together(spark):
    text = long_text(300, 3)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    assert simhash.near_duplicates(docs).select("component_id").distinct().collect() == [(0,)]


def test_settled_edges_take_no_round(spark, monkeypatch):
    """Stars are seen as such by one count; two stars and an edge between them take rounds of one checkpoint each."""
    from tesserae.llm import components as module

    made, keep = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: made.append(1) or keep(df))
    stars = [(1, i) for i in range(2, 40)] + [(50, i) for i in range(51, 90)]
    assert dict(components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()) == {i: r for r, i in stars}
    assert len(made) == 1
    assert set(dict(components(spark.createDataFrame([*stars, (39, 89)], "a bigint, b bigint")).collect()).values()) == {1}
    assert len(made) <= 4


def test_segments_share_one_reading(spark):
    """Probes of all segments are made in one pass, so tasks do not grow with the segments."""
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().toString()
    assert "Union" not in plan
