import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.llm import prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()]


def key(r):
    return r[1], r[0], str(r)


def made(seed, convs=260, most=9):
    """Conversations with common openings, copies, prefixes of others and missing first conversations."""
    rng = random.Random(seed)
    out, known = [], []
    for c in rng.sample(range(900), convs):
        if known and rng.random() < 0.4:
            seq = rng.choice(known)
            seq = seq[: rng.randint(0, len(seq))] + [rng.choice("abc") * rng.randint(0, 3) for _ in range(rng.randint(0, 2))]
        else:
            seq = [rng.choice("abcd") for _ in range(rng.randint(1, most))]
        seq = seq or ["a"]
        known.append(seq)
        out += [(c, i if i or rng.random() < 0.5 else None, "user" if i % 2 == 0 else None, t or None) for i, t in enumerate(seq)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("section", [128, 3, 1])
def test_against_brute_force(spark, section):
    rows = made(section)
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), section=section)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("section", [128, 2])
def test_many_partitions(spark, section):
    """Nodes that reach over many boundaries: copies, one opening for most, and tasks with a row or none."""
    rows = made(9, 150, 6)
    rows += [(1000 + c, i, "r", t) for c in range(120) for i, t in enumerate(["first", "second", f"own {c % 40}", "x"][: 2 + c % 3])]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 23, 90):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), section=section).collect()
            assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_long_conversations(spark):
    """A conversation with most of the turns, one that follows it for long, and repeated turns."""
    rng = random.Random(2)
    long = [rng.choice("ab") for _ in range(700)]
    rows = [(1, i, "r", t) for i, t in enumerate(long)] + [(2, i, "r", t) for i, t in enumerate(long[:500] + ["z"] * 30)] + [(3, i, "r", t) for i, t in enumerate(long[:512])]
    rows += [(4, 1, "r", "a")] * 9 + made(4, 40)
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), section=64).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_edges(spark):
    rows = [(None, 1, "r", "x"), (5, None, None, None), (7, 1, "r", "é東🙂"), (7, 2, "", ""), (107, 1, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in ("k", "pa", "items", "conv", "depth", "part", "a b.c"):
        docs = docs.withColumn(n, F.lit("x"))
    assert sorted(map(tuple, trie.prefix_trie(docs).collect()), key=key) == sorted(brute(rows), key=key)
    assert trie.prefix_trie(docs.limit(0)).count() == 0
    alone = [(3, 1, "r", "x")]
    assert sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(alone, SCHEMA)).collect()), key=key) == sorted(brute(alone), key=key)
