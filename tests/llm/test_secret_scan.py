import random
import re

import pytest

from tesserae.llm import secret_scan
from tests.llm.cases import SCHEMA, clashing, documents, rows


def brute(text):
    text = text or ""
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
    spans = []
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{i}:{j}" for i, k, j in sorted(spans))


@pytest.mark.parametrize("clash", [False, True])
def test_base_spans(spark, clash):
    docs = documents(spark)
    got = secret_scan.secret_spans(clashing(docs) if clash else docs).collect()
    want = sorted((d if d is not None else -1, brute(t)) for d, t, *_ in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base) for r in got) == want
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(r.base.count(k + ":") for k in secret_scan.KINDS)


def test_base_spans_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in secret_scan.secret_spans(docs).collect():
        assert r.base == brute(texts[r.doc_id])


def test_empty(spark):
    assert secret_scan.secret_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def drawn(rng, signs, n):
    return "".join(rng.choice(signs) for _ in range(n))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def test_learned_formats(spark):
    """A credential without its key is found by its format; names, numbers, dates and addresses are not."""
    rng = random.Random(5)
    key = lambda n: "sk_" + drawn(rng, LOWER + UPPER + DIGITS, n)
    docs = [(i, f"some words before api_key={key(28)} and after") for i in range(300)]
    docs += [(1000 + i, f"bare {key(28)} here") for i in range(40)]
    docs += [(1500 + i, f"bare {drawn(rng, '0123456789abcdef', 18)}, too") for i in range(40)] + [(1600 + i, f"password: {drawn(rng, '0123456789abcdef', 18)} set") for i in range(60)]
    docs += [(2000 + i, f"see the.long-domain.name{i}.of.some-example.company and wordsthatrunonandonwithoutanyend{i} on 2024-05-{i % 28 + 1} at 10.0.{i % 9}.7, 4556-{1000 + i}, Version-3.{i}") for i in range(300)]
    got = {r.doc_id: r.spans for r in secret_scan.secret_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum("like_assign" in got[1000 + i] for i in range(40)) >= 36
    assert sum("like_assign" in got[1500 + i] for i in range(40)) >= 36
    assert sum("like_" in got[2000 + i] for i in range(300)) == 0
    assert all("like_" not in got[i] for i in range(300))


def test_planted_in_all_documents(spark, sf):
    """Credentials planted without their keys are found, and clean documents are left alone."""
    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    spans = {r.doc_id: r.spans for r in secret_scan.secret_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum("like_" in s for s in spans.values()) <= 0.02 * len(docs)
    planted = [(10_000 + i, f"{docs[i][1]}\nThen {drawn(rng, DIGITS + 'abcdef', 18)} came") for i in range(30)]
    labelled = [(20_000 + i, f"Here password={drawn(rng, DIGITS + 'abcdef', 18)} stands") for i in range(30)]
    got = {r.doc_id: r for r in secret_scan.secret_spans(spark.createDataFrame(docs + planted + labelled, "doc_id bigint, text string")).collect()}
    assert sum("like_assign" in got[10_000 + i].spans for i in range(30)) >= 27
    assert sum("like_" in got[d].spans and not spans[d] for d, _ in docs) <= 0.02 * len(docs)
    assert all(got[20_000 + i].score >= secret_scan.LEAST_BITS for i in range(30))


def test_formats():
    assert [secret_scan.format_of(x) for x in ("a1f0", "abc", "Abc", "a1z", "A1", "aB3-42", "x_=")] == ["xxxx", "lll", "CCC", "mmm", "NN", "AAA-dd", "l_="]
    assert secret_scan.parts(secret_scan.classes_of("key=a1b2==")) == [(0, 3, "lll"), (4, 10, "xxxx==")]
    assert secret_scan.parts(secret_scan.classes_of("-word.")) == [(1, 5, "llll")]
    assert secret_scan.parts(b"===") == [] and secret_scan.parts(b"...") == []


def test_inference_learns_lengths_and_order():
    """What one state cannot tell apart: where a format ends, and what stands where."""
    machine = secret_scan.infer([("x" * 40, 90), ("x" * 18, 80), ("ll_" + "A" * 20, 70)])
    assert len(machine.moves) > 20
    assert machine.bits("x" * 40) > machine.bits("x" * 39) + 8 and machine.bits("x" * 18) > machine.bits("x" * 17) + 8
    assert machine.bits("ll_" + "A" * 20) > machine.bits("AA_" + "l" * 20) + 8
    one = secret_scan.infer([("x" * 40, 90), ("x" * 18, 80), ("ll_" + "A" * 20, 70)], alpha=1e-300)
    assert len(one.moves) < len(machine.moves) and one.bits("x" * 40) < one.bits("x" * 39) + 8
    for state in machine.moves:
        assert abs(sum(2**b for _, b in state.values()) - 1) < 1e-9


def test_inference_merges_states():
    """A loop is found again: pairs that go on with a chance of a half."""
    formats = [("dl" * n, max(1, 4096 >> n)) for n in range(1, 13)]
    machine = secret_scan.infer(formats)
    assert 2 <= len(machine.moves) <= 6
    assert machine.bits("dl" * 20) > machine.bits("dl" * 19 + "d") + 5 and machine.bits("dl" * 20) > machine.bits("ld" * 20) + 20
    few = secret_scan.infer([("x" * n, 1) for n in range(1, 19)])
    assert len(few.moves) == 1


def test_long_tokens(spark):
    docs = [(1, "token=" + "a1" * 300_000), (2, "Az9" * 200_000), (3, None), (4, "secret: abcdef0123")]
    got = {r.doc_id: r for r in secret_scan.secret_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1].base == "assign:0:600006,hex:6:600006" and got[3].spans == "" and got[3].score is None
    assert got[1].spans == got[1].base and got[4].n_assign == 1
