import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import byte_bpe, token_counts, token_files
from tesserae.llm.pieces import Pieces, pieces
from tests.llm.cases import SCHEMA, clashing, documents, long_text, rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n.,'|<>sStT0étEß́\x00\x1c"), st.characters(codec="utf-8")), max_size=25), max_size=4))
def test_pieces_equal_the_library(texts):
    texts = [*texts, "<|endoftext|>", None]
    got = pieces(PATH).encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [ids_of(t) for t in texts]
    assert pieces(PATH).counts(pa.array(texts, pa.string())).tolist() == [len(g) for g in got]


def test_forgotten_pieces():
    texts = [f"Word{i}, again{i}. x.{i} a..., b.,c <|endoftext|>. é., " + "Long" * (i % 5) for i in range(500)]
    p = Pieces(PATH, remembered=50)
    for k in range(0, 500, 20):
        part = texts[k : k + 20] + texts[:3]
        assert [g.tolist() for g in p.encode(pa.array(part))] == [ids_of(t) for t in part]
        assert len(p.known) < 400


def test_pieces_equal_the_library_on_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert [g.tolist() for g in pieces(PATH).encode(pa.array(texts))] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("clash", [False, True])
def test_counts(spark, clash):
    docs = documents(spark)
    got = token_counts.token_counts(clashing(docs) if clash else docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for d, t, *_ in rows())
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("clash", [False, True])
def test_files(spark, clash):
    docs = documents(spark)
    got = token_files.token_files(clashing(docs) if clash else docs).collect()
    made = {}
    for d, t, *_ in rows():
        made.setdefault(d if d is not None else -1, []).append((len(ids_of(t)) + 1, zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes())))
    found = sorted((r.start, r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got)
    assert [s for s, *_ in found] == np.cumsum([0, *[n for _, _, n, _ in found]])[:-1].tolist()
    assert [d for _, d, *_ in found] == sorted(d for d, x in made.items() for _ in x)
    assert sorted(found, key=lambda x: x[1:])[0][1] == -1
    assert sorted((d, n, c) for _, d, n, c in found) == sorted((d, n, c) for d, x in made.items() for n, c in x)


@pytest.mark.parametrize("hot", [None, 7])
def test_files_of_one_hot_id(spark, tmp_path, hot):
    """Rows of one id, half of them alike, are spread over tasks and still stand in the order of ids."""
    docs = [(hot if i % 2 else i, "the same words" if i % 4 == 1 else f"words number {i} " + long_text(i % 9, i)) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    token_files.write_token_files(df, str(tmp_path / "f"))
    sizes = spark.read.parquet(str(tmp_path / "f" / "segments")).selectExpr("bucket", "size(ids) as n").groupBy("bucket").sum("n").collect()
    assert len(sizes) >= 3 and max(r[1] for r in sizes) <= 1000
    got = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.id for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert sorted(map(tuple, [(r.n_tokens, r.crc32) for r in got])) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ([*ids_of(t), 1] for _, t in docs))


def test_file_format(spark, tmp_path):
    words = [long_text(200 + i, i) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    token_files.write_token_files(docs, str(tmp_path / "f"))
    dictionary = spark.read.parquet(str(tmp_path / "f" / "dictionary")).first()
    assert hashlib.sha256(bytes(dictionary["data"])).hexdigest() == dictionary["hash"]
    assert len(dictionary["data"]) > 0
    segments = spark.read.parquet(str(tmp_path / "f" / "segments"))
    assert {r.dictionary for r in segments.select("dictionary").collect()} == {dictionary["hash"]}
    one = token_files.read_token_files(spark, str(tmp_path / "f"), [17, 250, 999])
    assert {r.id: np.frombuffer(r.token_ids, "<u4").tolist() for r in one.collect()} == {i: [*ids_of(words[i]), 1] for i in (17, 250)}
    all_ = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("id").collect()
    assert [r.start for r in all_] == np.cumsum([0, *[r.n_tokens for r in all_]])[:-1].tolist()


def test_empty_files(spark):
    assert token_files.token_files(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("clash", [False, True])
def test_byte_bpe(spark, clash):
    docs = documents(spark)
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))
    got = byte_bpe.round_trip(clashing(docs) if clash else docs).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, *_ in rows():
        ids = enc.encode_ordinary(t or "")
        want.append((d if d is not None else -1, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(want)
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_byte_bpe_of_all_documents(spark, sf):
    """Ids and bytes of the whole table against the library on whole texts."""
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in byte_bpe.round_trip(docs).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_byte_bpe_parts():
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("ab Z  \n\t.,'st1é東") for _ in range(rng.randint(0, 300)))
        found = byte_bpe.parts(text, 20)
        assert "".join(found) == text
        assert [i for p in found for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
        assert byte_bpe.decode(enc, byte_bpe.packed(enc.encode_ordinary(text))) == text.encode()


def test_single_ids_decode_to_raw_bytes():
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))
    ids = enc.encode_ordinary("東🙂")
    assert b"".join(byte_bpe.decode(enc, byte_bpe.packed([i])) for i in ids) == "東🙂".encode()


def test_other_vocabularies_are_encoded_whole():
    """A byte-level file keeps spaces in its pieces, so its texts are not split."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Pieces(path), Tokenizer.from_file(path)
    texts = [None, "", "Two  words, and more.\n\tLines here.", long_text(300), "<|endoftext|> x"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not own.parted and pieces(PATH).parted
    assert [x.tolist() for x in own.encode(pa.array(texts))] == want and own.counts(pa.array(texts)).tolist() == list(map(len, want))
