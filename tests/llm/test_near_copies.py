import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import near_copies
from tests.llm.cases import SCHEMA, long_text
from tests.llm.test_simhash import brute_components


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def edited(text, n, seed):
    words = text.split()
    for i in random.Random(seed).sample(range(len(words)), n):
        words[i] = f"new{i}x{seed}"
    return " ".join(words)


def rows():
    """Copies with few and many edits, a chain of edits, shared passages, short and wordless texts."""
    texts = [None, "", "one", "two words", "a b c d e", "a b c d e f", "A b  c d e"]
    for k in range(30):
        base = long_text(150 + 10 * k, 900 + k)
        texts += [base, edited(base, 2, k), edited(base, 3 + k % 5, 100 + k), edited(base, 12, 200 + k), base + " " + long_text(60, 3000 + k)]
    step = long_text(400, 77)
    for k in range(8):
        step = edited(step, 6, 500 + k)
        texts.append(step)
    hub = long_text(200, 88)
    texts += [edited(hub, 2, 700 + k) for k in range(40)]
    made = [(i, t, "en", "h", 1) for i, t in enumerate(texts)]
    return [*made, made[9], (None, texts[12], "en", "h", 1)]


def test_against_brute_force_jaccard(spark):
    docs = rows()
    key = lambda d: (d[0] is not None, d[0] or 0)
    sets = [grams(d[1]) for d in docs]
    far = sum(alike(x, y) and x != y for x, y in itertools.combinations(sets, 2))
    assert far > 60
    want = list({d for d, g in zip(docs, brute_components([(key(d), s) for d, s in zip(docs, sets, strict=True)], alike), strict=True) if key(d) == g})
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sets_decide_where_heads_do_not(spark, monkeypatch):
    """With sets too large to send, results stay the same."""
    monkeypatch.setattr(near_copies, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", 0)
    test_against_brute_force_jaccard(spark)


def test_bands_find_the_least_similarity():
    """Sets at 0.8 always share a band; unrelated ones never do here."""
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(10, 400)
        common, own = [rng.getrandbits(64) for _ in range(8 * n)], [[rng.getrandbits(64) for _ in range(n)] for _ in range(2)]
        a, b = (near_copies.bands(near_copies.np.array(sorted(common + x), "u8")) for x in own)
        assert set(a) & set(b)
        assert not set(near_copies.bands(near_copies.np.array(sorted(own[0]), "u8"))) & set(near_copies.bands(near_copies.np.array(sorted(own[1]), "u8")))


def star(n, seed):
    """Copies of one text with up to six edits each: many are alike to the least edited ones alone, some to none."""
    base = long_text(146, 4000 + seed)
    return [(i, edited(base, i % 7, 9000 + i + seed), "en", "h", 1) for i in range(n)]


def test_large_group_of_unlike_copies(spark, monkeypatch):
    """Components are those of all pairs, and the pairs that are held against each other grow with the group, not with its square."""
    counted, alike_ = {}, near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, sets, few: counted.setdefault(n, []).append(pairs.count()) or alike_(pairs, sets, few))
    for n in (140, 420):
        docs = star(n, 5)
        got = near_copies.near_copies(spark.createDataFrame(docs, SCHEMA).withColumn("key", F.xxhash64("doc_id", "text")), "key").collect()
        want = brute_components([(d[0], grams(d[1])) for d in docs], alike)
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d[0], c) for d, c in zip(docs, want, strict=True))
        assert 1 < len(set(want)) < n
    assert sum(counted[420]) < 4.5 * sum(counted[140]) and sum(counted[420]) < 420 * 30


def test_pairs_of_unlike_members_are_not_made(spark, monkeypatch):
    """Outsiders with few shingles of their own meet no member of a large group whose missing parts are others."""
    made, keep = [], near_copies._pairs
    monkeypatch.setattr(near_copies, "_pairs", lambda found: made.append(found.count()) or keep(found))
    docs = star(420, 5)
    near_copies.near_copies(spark.createDataFrame(docs, SCHEMA).withColumn("key", F.xxhash64("doc_id", "text")), "key").collect()
    assert len(made) == 3 and made[2] < 420


def test_fingerprints_find_candidates(spark, monkeypatch):
    """Copies that share no band are found by their fingerprints, and sets decide: what is linked but not alike stays."""
    monkeypatch.setattr(near_copies, "bands", lambda found: [])
    long = long_text(800, 5)
    docs = [(1, long, "en", "h", 1), (2, edited(long, 1, 3), "en", "h", 1), (3, "a a a a a a a a b", "en", "h", 1), (4, "a a a a a a a a b a a a a a a", "en", "h", 1), (5, None, "en", "h", 1)]
    monkeypatch.setattr(near_copies, "DISTANCE", 12)
    got = near_copies.near_copies(spark.createDataFrame(docs, SCHEMA).withColumn("key", F.xxhash64("doc_id", "text")), "key").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
