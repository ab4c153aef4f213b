"""Token ids of a word-level BPE vocabulary by the tokenizers library, with each distinct piece encoded once.

The vocabulary drops white space before its merges and parts letters from signs, so a text
can be split at spaces, tabs and line ends, and before the full stops and commas that end
a piece after an ASCII letter: a text's ids are the ids of these pieces, in order. Arrow
splits a batch's texts and numbers the distinct pieces; only those that the worker has not
met are encoded, by the library alone: printable ASCII and letters by its BPE model, word by word as its
pattern parts them; others in runs with a special token between pieces, which
the library finds before it does anything else, so each piece is encoded as if by itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from tesserae.llm.common import held  # noqa: E402

#: Bytes of text whose pieces are numbered together.
SLICE_BYTES = 4 << 20
#: Pieces, and characters of pieces, whose ids a worker remembers; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 600_000, 16 << 20
#: Pieces in one text for the library, and characters in one call of it.
RUN, CALL_CHARS = 200, 256 << 10
#: The pattern and the normalisers of vocabularies whose texts can be split as above; texts of others are encoded whole.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The pattern on printable ASCII in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The signs that stand for bytes: printable ones for themselves, the others in order from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: What is split off at a piece's end.
_TAIL, _TAILED, _LONG = ".,", r"[A-Za-z][.,]+$", r"[.,]{2}$"


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in runs of about CALL_CHARS characters, one text at least."""
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > CALL_CHARS:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def splits(library: Tokenizer) -> bool:
    """Whether a tokenizer drops white space and parts letters from signs, so that its texts can be split into pieces."""
    spec = json.loads(library.to_str())
    flat = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    steps = flat(spec["pre_tokenizer"], "pretokenizers")
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["model"]["type"] != "BPE":
        return False
    first, second = steps
    by_pattern = first["pattern"] == {"Regex": _PATTERN} and (first["behavior"], first["invert"]) == ("Removed", True) and not second["add_prefix_space"] and not second["use_regex"]
    return by_pattern and flat(spec["normalizer"], "normalizers") == _NORMALISERS


class Pieces:
    """Encodes texts by a tokenizers .json file; see the module. A file of another kind is taken by the library, text by text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.remembered, self.parted = remembered, splits(self.library)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        # A special token that is found before anything else is done to a text parts it for good.
        plain = [(t.content, i) for i, t in added.items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.between, self.mark = max(plain, key=lambda x: x[1], default=("", 0))
        self._forget()

    def _forget(self) -> None:
        """No piece but the empty one, number 0."""
        self.known, self.chars, self.at = {"": 0}, 0, 0
        self.parts: dict[str, list[int]] = {}
        self.ids, self.start, self.number = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _words(self, new: list[str]) -> tuple[list[str], list[list[int]]]:
        """The pieces whose words the model can take one by one, and their ids: printable ASCII, and letters in normal form."""
        found, flat, known = [], [], self.parts
        tokenize = self.library.model.tokenize
        for p in new:
            if p.isascii():
                if not p.isprintable() or any(t in p for t in self.special if t[0] in p):
                    continue
                words = [p.lower()] if p.isalpha() else _PARTS.findall(p.lower())
            elif p.isalpha() and p.islower() and unicodedata.is_normalized("NFC", p):  # what changes case beyond ASCII is left to the library
                words = ["".join(map(_SIGNS.__getitem__, p.encode()))]
            else:
                continue
            ids: list[int] = []
            for w in words:
                if (own := known.get(w)) is None:
                    own = [t.id for t in tokenize(w)]
                    if len(w) <= 3:  # digits, signs and endings come again and again
                        known[w] = own
                ids += own
            found.append(p)
            flat.append(ids)
        return found, flat

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces that are not known: words by the model, others in runs with a special token between them, or by themselves."""
        words, word_ids = self._words(new)
        if words:
            as_words = set(words)
            new = [p for p in new if p not in as_words]
        some = set(self.special) and set.intersection(*map(set, self.special))
        sign = min(some, default="")  # a sign that all special tokens have, so most pieces take one look
        alone = [p for p in new if not self.between or sign in p and any(t in p for t in self.special)]
        if alone:
            with_special = set(alone)
            new = [p for p in new if p not in with_special]
        flat, sizes = [], [np.fromiter(map(len, word_ids), np.int64, len(words))]
        for texts in _batches([self.between.join(new[i : i + RUN]) for i in range(0, len(new), RUN)]):
            for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
                flat.append(np.array([*e.ids, self.mark], np.uint32))
        if flat:
            ids = np.concatenate(flat)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(new):
                raise RuntimeError("special tokens have not parted the pieces")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat = [ids[ids != self.mark]]
        for texts in _batches(alone):
            found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat += found
        flat = [np.fromiter(chain.from_iterable(word_ids), np.uint32), *flat]
        sizes = np.concatenate(sizes)
        for k, p in enumerate([*words, *new, *alone], len(self.known)):
            self.known[p] = k
            self.chars += len(p)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.number = np.concatenate([self.number, sizes])
        self.ids = np.concatenate([self.ids, *flat])

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's pieces begin, and each piece's number; two for each run between spaces."""
        flat = pc.fill_null(texts.cast(pa.large_string()), "")
        for c in "\n\t":
            flat = pc.replace_substring(flat, c, " ")
        split = pc.split_pattern(flat, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        whole = coded.dictionary
        tailed = pc.match_substring_regex(whole, _TAILED)
        heads = pc.if_else(tailed, pc.utf8_rtrim(whole, _TAIL), whole).dictionary_encode()
        both = np.zeros((len(whole), 2), np.int32)
        at = np.flatnonzero(tailed.to_numpy(zero_copy_only=False))
        ends = whole.take(pa.array(at))
        tails = pc.utf8_slice_codeunits(ends, -1)  # nearly all are one sign
        long = pc.match_substring_regex(ends, _LONG).to_numpy(zero_copy_only=False)
        tails = tails.to_pylist()
        for i in np.flatnonzero(long):
            end = ends[i].as_py()
            tails[i] = end[len(end.rstrip(_TAIL)) :]
        texts = heads.dictionary.to_pylist()
        if len(self.known) > self.remembered or self.chars > REMEMBERED_CHARS:
            self._forget()
        known = self.known
        if new := [p for p in texts if p not in known] + [p for p in set(tails) if p not in known]:
            self._learn(list(dict.fromkeys(new)))
        get = known.__getitem__
        both[:, 0] = np.array([get(p) for p in texts], np.int32)[heads.indices.to_numpy()] if texts else 0
        both[at, 1] = [get(t) for t in tails]
        return 2 * bounds, both[coded.indices.to_numpy()].ravel()

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has. Null is empty."""
        if not self.parted:
            return np.array([len(x) for x in self._whole(texts)], np.int64)
        bounds, which = self._numbered(texts)
        upto = np.concatenate([[0], np.cumsum(self.number[which])])
        return np.diff(upto[bounds])

    def _whole(self, texts: pa.Array) -> list[np.ndarray]:
        out = []
        for some in _batches([t or "" for t in texts.to_pylist()]):
            out += [np.array(e.ids, np.uint32) for e in self.library.encode_batch(some, add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids, unsigned 32-bit. Null is empty."""
        if not self.parted:
            return self._whole(texts)
        bounds, which = self._numbered(texts)
        which, kept = which[which > 0], np.concatenate([[0], np.cumsum(which > 0)])
        bounds = kept[bounds]
        sizes = self.number[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat((self.start[which] - upto[:-1]).astype(np.int32), sizes)
        take += np.arange(len(take), dtype=np.int32)
        flat = self.ids[take]
        ends = upto[bounds]
        return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def pieces(path: str) -> Pieces:
    """The file's encoder, made once in a worker process."""
    return held(f"pieces {path}", lambda: Pieces(path))
