"""Byte-level BPE by a local rank file: ids of whole texts, and the bytes that ids stand for."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from tesserae.llm.common import held, map_texts

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts of more characters are cut before a space that stands between letters: there a
#: match of the pattern always ends and the next one begins, whatever stands around it.
PART_CHARS = 50_000
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The rank file's encoding, read once in a worker process."""

    def read() -> tiktoken.Encoding:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return held(f"ranks {path} {pattern}", read)


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """The text in parts of about `most` characters that are encoded alike alone and together."""
    out, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    ids: list[int] = []
    for p in parts(text or ""):
        ids += enc.encode_ordinary(p)
    return ids


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids) for every row: ids as little-endian 32-bit binary. Null texts are empty."""
    path = path or public_tokenizers.path(RANKS)

    def make():
        enc = encoding(path)

        def apply(texts):
            out = []
            for t in texts:
                ids = encode(enc, t)
                out.append((len(ids), packed(ids)))
            return out

        return apply

    return map_texts(docs, make, "n_tokens bigint, ids binary", id_col, text_col)


def decode(enc: tiktoken.Encoding, ids: bytes | None) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids or b"", dtype="<u4").tolist())


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes again in one pass.

    Only lengths and digests leave the task. decoded_sha256 is of the raw bytes that the
    ids decode to, which need not be valid UTF-8 for single ids. Null texts are
    empty; repeated rows each get a row; other columns of docs are ignored.
    """
    path = path or public_tokenizers.path(RANKS)

    def make():
        enc = encoding(path)

        def apply(texts):
            out = []
            for t in texts:
                ids = encode(enc, t)
                blob = packed(ids)
                out.append((len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256(decode(enc, blob)).hexdigest()))
            return out

        return apply

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
