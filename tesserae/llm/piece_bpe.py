"""SentencePiece BPE in merge rounds over flat numpy arrays: ids of whole texts, and the texts that ids stand for.

A normalised text is parted where no piece of the vocabulary stands across: before every
space sign after another sign, around line ends, and at last between any two
signs that no piece holds side by side. Each distinct word is encoded once in a worker. All new words of
a slice stand in one flat array of symbols, with the rank of every neighbouring pair. In a
round each word merges its leftmost pair of least rank, all words at once; words without
a pair drop out, the others are compacted, until none is left. In words of many symbols
every pair of least rank within REACH pieces' lengths is merged in the same round: no piece
that reaches it can come into being before it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from tesserae.llm.common import held, map_texts

MODEL = "piece_bpe_32k.model"
#: Words, and characters of words, whose ids a worker remembers; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 600_000, 16 << 20
#: Words of more symbols merge several pairs in a round; so many lengths of the longest piece a pair is least in.
LONG, REACH = 64, 2
_NONE = np.iinfo(np.int32).max
_SPACE = "▁"


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message; values are whole numbers or bytes."""
    at = 0

    def varint():
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def _words(line: str) -> list[str]:
    """A line's words without the space sign that begins them; one that begins without is led by a line end.

    A run of space signs stands whole at the front of the word that follows it.
    """
    head, *words = line.split(_SPACE)
    if "" in words:
        runs = re.findall(f"{_SPACE}+[^{_SPACE}]*", line[len(head) :])
        words = [w[1:] for w in runs]
    return [f"\n{head}", *words] if head else words


class Vocabulary:
    """Pieces, ranks of pairs, and the signs that may stand side by side; see the module.

    The model must be a BPE model with byte fallback and without unused or user-defined pieces;
    any other one raises ValueError.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        parts = list(_fields(raw))
        kinds = [dict(_fields(v)).get(3, 1) for n, v in parts if n == 1]
        trainer = dict(_fields(dict(parts).get(2, b"")))
        if trainer.get(3, 1) != 2 or {4, 5} & set(kinds) or kinds.count(6) != 256:
            raise ValueError(f"{path} is not a plain BPE model with byte fallback")
        size = len(kinds)
        piece = self.library.id_to_piece
        self.bytes = np.zeros(256, np.int32)
        for i in np.flatnonzero(np.array(kinds) == 6).tolist():
            self.bytes[int(piece(i)[3:5], 16)] = i
        normal = {piece(i): i for i in range(size) if kinds[i] == 1}
        self.size = size
        # A sign without a piece is a symbol of its own, beyond all pieces.
        self.symbol = np.arange(0x110000, dtype=np.int32) + size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = np.array([self.library.get_score(i) for i in normal.values()])
        order = {s: k for k, s in enumerate(sorted(set((-scores).tolist())))}
        self.rank = np.full(size, _NONE, np.int32)
        for i, s in zip(normal.values(), scores.tolist(), strict=True):
            self.rank[i] = order[-s]
        of = lambda p: normal.get(p, int(self.symbol[ord(p)]) if len(p) == 1 else None)
        pairs, beside = {}, set()
        self.longest = max(map(len, normal))
        for p, i in normal.items():
            for k in range(1, len(p)):
                beside.add((ord(p[k - 1]), ord(p[k])))
                a, b = of(p[:k]), of(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.beside = np.array(sorted(a << 32 | b for a, b in beside), np.int64)
        # Calm pieces: what they can take part in has no lower rank, so equal pairs may merge together.
        least = np.full(size, _NONE, np.int32)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            known = side < size
            np.minimum.at(least, side[known], self.rank[self.made[known]])
        self.calm = least > self.rank
        if any(y == ord(_SPACE) and x != y or 10 in (x, y) for x, y in beside):
            raise ValueError(f"{path} has pieces with a space or a line end inside")
        self.line_end = [int(self.symbol[10])] if self.symbol[10] < size else [int(self.bytes[10])]
        self.shared = np.array(range(size), object)  # ids as objects that all lists share
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, list[int]] = {}
        self.chars = 0

    def _of_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece and the rank of each pair; a pair without a piece has the last rank."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        made = np.where(found, self.made[at], -1)
        return made, np.where(found, self.rank[made], _NONE).astype(np.int32)

    def _chosen(self, rank: np.ndarray, made: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the pairs that merge in this round; no two of them share a symbol."""
        least = np.minimum.reduceat(rank, start)
        hit = np.flatnonzero(rank == np.repeat(least, end - start))
        word = np.searchsorted(start, hit, "right") - 1
        first = np.ones(len(hit), bool)
        first[1:] = word[1:] != word[:-1]
        chosen = hit[first & (least[word] < _NONE)]
        if (end - start).max() <= LONG:
            return chosen
        long = np.repeat(end - start > LONG, end - start)
        near, reach = rank.copy(), 1
        before = np.full(len(rank), _NONE, np.int32)  # least of the pairs to the left
        before[1:] = rank[:-1]
        want = REACH * self.longest
        while reach < want:  # words are parted by a pair of the last rank, so a wider look only waits longer
            step = min(reach, want - reach)
            near[:-step] = np.minimum(near[:-step], near[step:].copy())
            before[step:] = np.minimum(before[step:], before[:-step].copy())
            reach += step
        free = long & (rank < _NONE) & (rank <= near) & (rank <= before)
        tied = free & (rank == before)
        free &= ~tied | self.calm[made]
        # Runs of overlapping equal pairs merge every other one from the run's true beginning.
        at = np.flatnonzero(free)  # the leftmost least pair of a word is always among them
        opens = np.ones(len(at), bool)
        opens[1:] = at[1:] != at[:-1] + 1
        head = at[opens][np.cumsum(opens) - 1]
        blocked = (head > 0) & (rank[np.maximum(head - 1, 0)] == rank[head])
        return np.union1d(chosen[~long[chosen]], at[((at - head) % 2 == 0) & ~blocked])

    def merged(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, in merge rounds over all words at once."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        # Cut where no piece holds the two signs side by side.
        both = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, both), len(self.beside) - 1)
        cut = np.ones(len(codes), bool)
        cut[1:] = self.beside[at] != both
        cut[bounds[:-1]] = True
        start = np.flatnonzero(cut)
        symbols = self.symbol[codes]
        place = np.arange(len(codes))
        done_symbols, done_place = [], []
        made, rank = self._of_pairs(symbols, np.append(symbols[1:], -1))
        last = np.append(start[1:], len(symbols)) - 1
        made[last], rank[last] = -1, _NONE
        while len(symbols):
            end = np.append(start[1:], len(symbols))
            live = np.minimum.reduceat(rank, start) < _NONE
            if not live.all():
                keep = np.repeat(live, end - start)
                done_symbols.append(symbols[~keep])
                done_place.append(place[~keep])
                sizes = (end - start)[live]
                symbols, place, rank, made = symbols[keep], place[keep], rank[keep], made[keep]
                end = np.cumsum(sizes)
                start = end - sizes
                if not len(symbols):
                    break
            chosen = self._chosen(rank, made, start, end)
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            shift = np.cumsum(keep) - 1
            symbols, place, rank, made = symbols[keep], place[keep], rank[keep], made[keep]
            start = shift[start]
            last = np.zeros(len(symbols), bool)
            last[np.append(start[1:], len(symbols)) - 1] = True
            new = shift[chosen]
            changed = np.concatenate([new, new[new > 0] - 1])
            follow = np.where(last[changed], -1, symbols[np.minimum(changed + 1, len(symbols) - 1)])
            made[changed], rank[changed] = self._of_pairs(symbols[changed], follow)
        symbols, place = np.concatenate([np.zeros(0, np.int32), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_place])
        order = np.argsort(place)
        symbols, place = symbols[order], place[order]
        upto = np.searchsorted(place, bounds)
        found = self.shared[np.where(symbols < self.size, symbols, 0)].tolist()
        out = [found[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        for k in np.unique(np.searchsorted(upto, np.flatnonzero(symbols >= self.size), "right") - 1).tolist():
            ids: list[int] = []
            for s in symbols[upto[k] : upto[k + 1]].tolist():
                ids += [s] if s < self.size else self.bytes[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tolist()
            out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text. Null is empty."""
        lines = [[_words(line) for line in self.library.normalize(t).split("\n")] if t else [] for t in texts]
        if len(self.known) > self.remembered or self.chars > REMEMBERED_CHARS:
            self.forget()
        known = self.known
        if new := list(set().union(*[words for t in lines for words in t]) - known.keys()):
            self.chars += sum(map(len, new))
            known.update(zip(new, self.merged([_SPACE + w if w[:1] != "\n" else w[1:] for w in new]), strict=True))
        get, between = known.__getitem__, self.line_end
        out = []
        for t in lines:
            ids: list[int] = []
            for k, words in enumerate(t):
                if k:
                    ids += between
                ids += chain.from_iterable(map(get, words))
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in a worker process."""
    return held(f"pieces of {path}", lambda: Vocabulary(path))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids array<int>) for every row. Null texts are empty and have no ids."""
    path = path or public_tokenizers.path(MODEL)

    def make():
        own = vocabulary(path)
        return lambda texts: [(len(ids), ids) for ids in own.encode(texts)]

    return map_texts(docs, make, "n_tokens bigint, ids array<int>", id_col, text_col)


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from a column of ids; null ids are an empty text."""
    path = path or public_tokenizers.path(MODEL)
    from pyspark.sql import functions as F

    def make():
        own = vocabulary(path)
        return lambda joined: [(own.decode(list(map(int, x.split(",")))) if x else "",) for x in joined]

    text = tokens.withColumn("__ids", F.concat_ws(",", F.col(f"`{ids_col}`").cast("array<string>")))
    return map_texts(text, make, "text string", id_col, "__ids")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes again in one pass.

    Only lengths and digests leave the task. Null and empty texts have no ids and decode
    to an empty text; repeated rows each get a row; an empty table gives an empty result;
    other columns of docs are ignored. A very long word is merged in rounds like any other.
    """
    path = path or public_tokenizers.path(MODEL)

    def make():
        own = vocabulary(path)

        def apply(texts):
            out = []
            for ids in own.encode(texts):
                joined = str(ids)[1:-1].replace(" ", "").encode()
                out.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            return out

        return apply

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
