import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import piece_bpe
from tests.llm.cases import SCHEMA, clashing, documents, long_text, rows

PATH = public_tokenizers.path(piece_bpe.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = piece_bpe.vocabulary(PATH)


def same(texts):
    assert OWN.encode(texts) == [LIBRARY.encode(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\r▁.,'<>s/theingÀé\x00"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_random_texts(texts):
    same([*texts, None, ""])


@pytest.mark.parametrize("alphabet", ["x", "ab", "ing ", "the n", "xy=", "-=#*", "0123456789abcdef", "etaoinshrdlu", " \n▁a", "АБВабв ", "日本語の漢字"])
def test_long_words(alphabet):
    """Words of many symbols merge several pairs in a round and come out like the library's."""
    rng = random.Random(len(alphabet))
    same(["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 30, 65, 66, 200, 3000, 20_000)])


def test_joined_pieces():
    rng = random.Random(1)
    normal = [LIBRARY.id_to_piece(i) for i in range(259, LIBRARY.get_piece_size())]
    for _ in range(60):
        same(["".join(rng.choice(normal)[: rng.randint(1, 9)] for _ in range(rng.choice([2, 10, 100, 400]))) for _ in range(5)])


def test_rounds_do_not_grow_with_repeated_signs(monkeypatch):
    rounds, chosen = [], piece_bpe.Vocabulary._chosen
    monkeypatch.setattr(piece_bpe.Vocabulary, "_chosen", lambda self, *a: rounds.append(1) or chosen(self, *a))
    same(["=" * 100_000])
    assert len(rounds) < 60


def test_forgotten_words():
    own = piece_bpe.Vocabulary(PATH, remembered=40)
    texts = [f"Word{i} again{i}.\nnew{i % 7}  x{i}" for i in range(300)]
    for k in range(0, 300, 20):
        part = texts[k : k + 20] + texts[:2]
        assert own.encode(part) == [LIBRARY.encode(t) for t in part]
        assert len(own.known) < 200


def test_other_models_are_refused(tmp_path, monkeypatch):
    bad = tmp_path / "bad.model"
    with open(PATH, "rb") as f:
        raw = f.read()
    bad.write_bytes(raw + bytes([0x0A, 7, 0x0A, 3]) + b"zqz" + bytes([0x18, 4]))  # one more piece, defined by a user
    with pytest.raises(ValueError, match="plain BPE"):
        piece_bpe.Vocabulary(str(bad))


@pytest.mark.parametrize("clash", [False, True])
def test_round_trip(spark, clash):
    docs = documents(spark)
    got = piece_bpe.round_trip(clashing(docs) if clash else docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: (r[0] is None, *map(str, r))
    want = []
    for d, t, *_ in rows():
        ids = LIBRARY.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert piece_bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_decode_to_texts(spark):
    docs = spark.createDataFrame([(1, long_text(300), "", "", 1), (2, None, "", "", 1), (3, "a  b\n c 東", "", "", 1)], SCHEMA)
    got = {r.doc_id: r.text for r in piece_bpe.decoded(piece_bpe.encoded(docs)).collect()}
    assert got == {r.doc_id: r.text or "" for r in docs.collect()}


def test_query_on_documents(spark, sf):
    from tesserae.llm.queries import op13_sentencepiece

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op13_sentencepiece(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids = LIBRARY.encode(t)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
