import hashlib

import pytest

from tesserae.llm import decontaminate as dec
from tests.llm.cases import PROSE, SCHEMA, clashing, documents, long_text, rows

ITEMS = [(1, PROSE.lower()), (2, "little words"), (3, None), (4, ""), (10, "ÜNÏCODE wörds"), (11, long_text(60, 7)), (None, "one"), (1, "two words"), (12, "b a")]


@pytest.mark.parametrize("block_words", [dec.BLOCK_WORDS, 20])
@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, block_words, clash):
    docs, bench = documents(spark), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = dec.contamination(clashing(docs) if clash else docs, bench, block_words=block_words).collect()
    want = sorted((d if d is not None else -1, *dec.brute_force(t, ITEMS)) for d, t, *_ in rows())
    sha = lambda xs: hashlib.sha256(",".join(sorted(xs)).encode()).hexdigest()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, sha(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_offsets_lead_to_the_text(spark):
    text = "Nö! " + PROSE.upper() + " ...ñ"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = dec.contamination(docs, spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")).first()
    (span,) = row["chars"]
    assert text[span.start : span.end] == PROSE.upper().rstrip(".")


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert dec.contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert not dec.contamination(documents(spark), bench).where("n_hit > 0").count()


@pytest.mark.parametrize("block_words", [dec.BLOCK_WORDS, 300])
def test_all_documents(spark, sf, block_words):
    """The whole table against brute force over windows, by a set of all windows of the benchmark."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    owners = {}
    for item, t in bench.select("item_id", "text").collect():
        for w in dec.windows(dec.words_of(t)):
            owners.setdefault(w, set()).add(str(item))
    sizes = {len(w) for w in owners}
    texts = dict(docs.select("doc_id", "text").collect())
    got = dec.contamination(docs, bench, block_words=block_words).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and any(r.contaminated for r in got)
    for r in got:
        words, hit, found = dec.words_of(texts[r.doc_id]), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[w]
        assert (r.n_words, r.n_hit, sorted(found)) == (len(words), len(hit), r["items"])
        assert sum(len(dec.words_of(texts[r.doc_id][c.start : c.end])) for c in r["chars"]) == len(hit)


def test_a_large_benchmark_leaves_what_occurs(spark, monkeypatch):
    """Of a benchmark of many blocks, one block of what the documents hold is sent; shorter items and null ids are kept."""
    items = [(i, long_text(120, 10_000 + i)) for i in range(300)] + [(None, long_text(90, 7)), (900, "three little words"), (901, "little absent"), (902, None)]
    docs = [(k, long_text(200, 50 + k) + " " + " ".join(items[5 * k][1].upper().split()[20:60]) + " " + long_text(40, 90 + k)) for k in range(12)]
    docs += [(50, long_text(90, 7)), (51, "x Three, little WORDS y"), (52, None)]
    made = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    sent, blocks = [], dec.benchmark_blocks
    monkeypatch.setattr(dec, "benchmark_blocks", lambda *a: sent.extend(x := list(blocks(*a))) or x)
    few = {r.doc_id: tuple(r) for r in dec.contamination(*made, block_words=3000).collect()}
    assert len(sent) == 1 and sum(len(w) for _, w in sent[0]) < 800
    assert few == {r.doc_id: tuple(r) for r in dec.contamination(*made).collect()}
    assert few[50][2] == 90 and few[51][2:4] == (3, 1)


def test_items_longer_than_a_block(spark):
    item = long_text(500, 3)
    docs = [(1, long_text(20, 9) + " " + " ".join(item.split()[90:110])), (2, item.upper()), (3, " ".join(item.split()[:12]))]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in dec.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("q", item)], "item_id string, text string"), block_words=100).collect()}
    assert got == {1: (20, ["q"]), 2: (500, ["q"]), 3: (0, [])}
