import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality
from tests.llm.cases import PROSE, SCHEMA, clashing, documents, long_text, rows


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("clash", [False, True])
def test_base_rules(spark, clash):
    docs = documents(spark)
    got = quality.quality(clashing(docs) if clash else docs).collect()
    want = sorted((d if d is not None else -1, *brute(t), not brute(t)[-1]) for d, t, *_ in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def brute_removed(docs, limit):
    """For each (text, host): the words in lines that more than limit distinct documents of the host have, and the other lines."""
    held = {}
    for text, host in docs:
        own = frozenset(normal(x) for x in (text or "").split("\n")) - {""}
        for x in own:
            held.setdefault((host, x), set()).add(own)
    out = []
    for text, host in docs:
        gone = {x for x in map(normal, (text or "").split("\n")) if x and len(held[host, x]) > limit}
        lines = (text or "").split("\n")
        out.append((sum(len(normal(x).split(" ")) for x in lines if normal(x) in gone), "\n".join(x for x in lines if normal(x) not in gone)))
    return out


def held_to_brute_force(df, limit, share=0.6):
    found = df.select("doc_id", "text", "source").collect()
    removed = brute_removed([(r.text, r.source) for r in found], limit)
    want = sorted((r.doc_id, *brute(r.text), n, not brute(r.text)[-1] and n <= share * brute(r.text)[0], left) for r, (n, left) in zip(found, removed, strict=True))
    got = quality.quality(df, max_host_documents=limit, max_removed=share).withColumnRenamed("doc_id", "id").join(df.select("doc_id", "text"), F.col("id") == F.col("doc_id"))
    got = got.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept", quality.stripped(F.coalesce("text", F.lit("")), F.col("removed")))
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_all_documents(spark, sf, limit):
    """Counts, verdicts and remaining lines of the whole table against brute force."""
    held_to_brute_force(spark.read.parquet(f"{sf}/documents.parquet"), limit)


@pytest.mark.parametrize("seed", range(4))
def test_notices_of_several_lines(spark, seed):
    """Whatever the notice, all its lines count once for each document that has it."""
    notice = "\n".join(long_text(20, 100 * seed + 11 + i) for i in range(10))
    docs = [(i, long_text(40, 5000 + i) + "\n" + notice, "a") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = quality.quality(df).groupBy("n_removed", "kept").count().collect()
    assert [tuple(r) for r in got] == [(200, False, 400)]


def test_random_lines_against_brute_force(spark):
    import random

    rng = random.Random(3)
    pool = [long_text(rng.randint(1, 30), 300 + i) for i in range(25)]
    docs = []
    for i in range(300):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 8))] + [long_text(rng.randint(1, 60), 9000 + rng.randint(0, 250)) for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        docs.append((i, "\n".join(rng.choice(["  ", "", "\t"]) + x + rng.choice(["", " ", "\n"]) for x in lines), rng.choice("ab")))
    want = held_to_brute_force(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), 12)
    assert {w[8] for w in want} == {True, False} and len({w[7] for w in want}) > 20


def remaining(df, limit):
    found = quality.quality(df, max_host_documents=limit).select(F.col("doc_id").alias("of"), "removed").join(df, F.col("of") == F.col("doc_id"))
    return {r.doc_id: r.t for r in found.select("doc_id", quality.stripped(F.col("text"), F.col("removed")).alias("t")).collect()}


def test_line_frequency(spark):
    """Boilerplate below different articles goes by host; copies and clean documents stay."""
    notice = "We use cookies here " + long_text(120, 77)
    docs = [(i, long_text(60, i) + "\n" + notice, "a") for i in range(12)]
    docs += [(100 + i, long_text(60, 500 + i) + "\n  " + notice.upper(), "b") for i in range(3)]
    docs += [(200 + i, long_text(90, 900) + "\n" + long_text(30, 901), "a") for i in range(40)]
    docs += [(300 + i, long_text(90, 1000 + i) + "\n" + PROSE, "a") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    words = len(notice.split())
    got = {r.doc_id: r for r in quality.quality(df, max_host_documents=5, max_removed=0.5).collect()}
    assert all(got[i].n_removed == words and not got[i].base_failed and not got[i].kept for i in range(12))
    assert all(got[100 + i].n_removed == 0 and got[100 + i].kept for i in range(3))
    assert all(got[200 + i].n_removed == 0 and got[200 + i].kept for i in range(40))
    assert all(got[300 + i].n_removed == len(PROSE.split()) and got[300 + i].kept for i in range(12))
    texts = remaining(df, 5)
    assert texts[0] == long_text(60, 0) and texts[200] == docs[15][1] and texts[100] == docs[12][1]


def test_plan_is_native(spark, sf):
    plan = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert quality.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_with_many_shared_lines(spark):
    """All lines that different pages share are boilerplate, not only those beside a least line."""
    shared = [long_text(12, 7000 + i) for i in range(8)]
    docs = [(i, "\n".join([*shared, long_text(20, 8000 + i)]), "a") for i in range(40)]
    docs += [(100 + i, "\n".join([long_text(40, 9000), long_text(41, 9001)]), "a") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality.quality(df, max_host_documents=30).collect()}
    assert all(got[i].n_removed == 96 and not got[i].kept for i in range(40))
    assert all(got[100 + i].n_removed == 0 and got[100 + i].kept for i in range(40))
    texts = remaining(df, 30)
    assert texts[3] == long_text(20, 8003) and texts[100] == docs[40][1]
