import math
import random
import re
from collections import Counter

import pytest

from tesserae.llm import lexical
from tests.llm.cases import SCHEMA, clashing, documents, long_text, rows

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    """Every item against every document."""
    counted = [(d, Counter(words(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in counted:
            m = 75 + (25 * c.total() * n) // total if total else 0
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(words(text)).items() if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return out


def key(r):
    return [(x is not None, x) for x in r[:2]], str(r)


def corpus(n=400, seed=5):
    """Documents of drawn words, some of them very frequent, and items from them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    weights = [1 / (1 + i) for i in range(600)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 80)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for i in range(25)] + [(100 + i, " ".join(docs[i][1].split()[:20])) for i in range(10)]
    return docs, items


@pytest.mark.parametrize("sizes", [(4096, 64), (16, 4)])
def test_against_brute_force(spark, sizes):
    docs, items = corpus()
    made = spark.createDataFrame([(*d, "", "", 1) for d in docs], SCHEMA).repartition(5)
    got = lexical.search(made, spark.createDataFrame(items, "item_id bigint, text string"), block_docs=sizes[0], bundle_items=sizes[1])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_all_terms_are_indexed_where_items_have_too_many(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SENT_CHARS", 0)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 500)
    test_against_brute_force(spark, (64, 4))


@pytest.mark.parametrize("clash", [False, True])
def test_edges(spark, clash):
    docs = documents(spark)
    items = [(1, None), (2, ""), (3, "old harbour LAMPS old"), (3, "old harbour LAMPS old"), (4, "--- 東京 é don't"), (None, "the the ferry"), (5, "absent"), (6, long_text(400, 7)), (6, "one two")]
    got = lexical.search(clashing(docs) if clash else docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute([r[:2] for r in rows()], items), key=key)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], SCHEMA), documents(spark)
    items = spark.createDataFrame([(1, "old harbour")], "item_id bigint, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs.where("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_frequent_terms_touch_few_documents(spark, monkeypatch):
    """What the last owner's terms are added to is a small part of the documents that hold them."""
    docs, _ = corpus(3000, 8)
    items = [(i, docs[i][1]) for i in range(0, 200, 10)]
    held, cut = [], lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda df: held.append(cut(df)) or held[-1])
    got = lexical.search(spark.createDataFrame([(*d, "", "", 1) for d in docs], SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)
    bundles = [sum(len(r.docs) // 2 for r in df.collect()) for df in held if "scores" in df.columns]
    assert len(bundles) == lexical.STAGES
    assert bundles[-2] < 0.5 * len(items) * len(docs)
