"""Secrets in texts: fixed patterns, and formats learned from what they find.

The fixed patterns label credentials of three kinds. A token's format names, for each of its
characters, what its stretch between signs is made of (digits, lower-case hexadecimals,
letters and digits, ...), so tokens that are drawn alike share a format. From the formats of
each kind, with their counts, a prefix tree is built and its statistically compatible states
are merged into a probabilistic automaton, which knows where moves and endings fall. Every
token of the corpus is then scored by how much likelier an automaton makes its format than
the corpus's other tokens do. One pass over the texts counts, another one scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, map_texts, reachable, slices

#: Fixed patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text must hold, in lower case, for ASSIGN to match, and the same for HEX with its signs as x.
ASSIGN_NEEDS, HEX_NEEDS = (b"passw", b"secret", b"token", b"api"), b"x" * 24
_HEX = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
#: Tokens, and what their characters are: digits, a-f, g-z, A-Z, signs; all else parts tokens.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_CLASS = bytes(100 if 48 <= c <= 57 else 104 if 97 <= c <= 102 else 108 if 103 <= c <= 122 else 85 if 65 <= c <= 90 else c if chr(c) in "+/_.=-" else 32 for c in range(256))
_PART, _STRETCH, _EDGES = re.compile(rb"[^=]+(?:=+$)?"), re.compile(rb"[dhlU]+"), b".-"
#: Symbols of formats: digits, lower and upper case alone, digits with a-f, with lower case, with
#: upper case, both cases, all three, then the signs themselves; the last one stands for an ending.
SYMBOLS, END = "dlUxmNCA+/_.=-", "$"
#: Distinct labelled formats of each kind that an automaton is learned from, and their longest length.
MAX_LABELLED, MAX_FORMAT = 1500, 256
#: A state needs this many labelled tokens to stand for itself; with fewer it joins the state that fits best.
MIN_SUPPORT = 20
#: log2 share of moves and endings that an automaton has not seen.
UNSEEN = -14.0
#: A token is taken for a secret if an automaton makes it 2 ** LEAST_BITS times likelier than the other tokens do.
LEAST_BITS = 5.0
#: Verdicts on tokens' classes that a task remembers.
REMEMBERED = 1 << 18


def _symbol(m: re.Match) -> bytes:
    found = set(m.group())
    digit, low, plain, up = 100 in found, 104 in found or 108 in found, 108 in found, 85 in found
    if digit and low and up:
        return b"A" * len(m.group())
    if digit and low:
        return (b"m" if plain else b"x") * len(m.group())
    one = b"N" if digit and up else b"C" if low and up else b"d" if digit else b"l" if low else b"U"
    return one * len(m.group())


def parts(classes: bytes) -> list[tuple[int, int, str]]:
    """(start, end, format) of a token's parts: an equals sign parts it, unless it pads the end; full stops and dashes at the edges go."""
    out = []
    for m in _PART.finditer(classes):
        part = m.group().rstrip(_EDGES)
        start = m.start() + len(part) - len(part.lstrip(_EDGES))
        if part := part.lstrip(_EDGES):
            out.append((start, start + len(part), _STRETCH.sub(_symbol, part).decode()))
    return out


def classes_of(token: str) -> bytes:
    return token.encode().translate(_CLASS)


def format_of(token: str) -> str:
    """The whole token's format."""
    return _STRETCH.sub(_symbol, classes_of(token)).decode()


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns' matches, in order."""
    raw = text.encode() if raw is None else raw
    found = []
    low = raw.lower()
    if any(w in low for w in ASSIGN_NEEDS):
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    if HEX_NEEDS in raw.translate(_HEX):
        found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def counted(texts: list[str | None]) -> Counter:
    """Counts of (kind, format) of labelled credentials, and of ("", three symbols) in all other tokens."""
    out: Counter = Counter()
    rest = []
    for text in texts:
        raw = (text or "").encode()
        base = base_spans(text or "", raw)
        if base:
            left, at = [], 0
            for i, k, j, v, w in base:
                if w - v <= MAX_FORMAT:
                    out[KINDS[k], format_of(text[v:w])] += 1
                if i > at:
                    left.append(text[at:i])
                at = max(at, j)
            raw = " ".join([*left, text[at:]]).encode()
        rest.append(raw)
    for classes, n in Counter(b" ".join(rest).translate(_CLASS).split()).items():
        for _, _, form in parts(classes):
            for i, c in enumerate(form + END):
                out["", (END * 2 + form)[i : i + 2] + c] += n
    return out


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, format, n) over all texts, added up in tasks before they meet."""
    reachable(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("format", pa.string()), ("n", pa.int64())])

    def run(batches):
        for part in slices(batches, 0):
            found = sorted(counted(part.column(0).to_pylist()).items())
            yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in found], pa.string()), pa.array([f for (_, f), _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], schema=schema)

    narrow = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    return narrow.mapInArrow(run, "kind string, format string, n bigint").groupBy("kind", "format").agg(F.sum("n").alias("n"))


@dataclass
class Automaton:
    """A probabilistic automaton: for each state the next state and log2 share of each symbol, END included."""

    moves: list[dict[str, tuple[int, float]]]

    def bits(self, form: str) -> float:
        """log2 of the format's probability; unseen moves stay in place."""
        state, total = 0, 0.0
        for c in form:
            state, gain = self.moves[state].get(c, (state, UNSEEN))
            total += gain
        return total + self.moves[state].get(END, (0, UNSEEN))[1]


def infer(formats: list[tuple[str, int]], alpha: float = 0.05, min_support: int = MIN_SUPPORT) -> Automaton:
    """Merges compatible states of the formats' prefix tree, states that are kept first, nearest the root.

    Two states are compatible if the shares of ending and of each next symbol differ by
    less than Hoeffding's bound at alpha, and so do those of all states that their merging
    would fold together, as far as both have min_support tokens. A state with fewer tokens
    has no say of its own: it joins the kept state under which its tokens are likeliest.
    """
    nxt: list[dict[str, int]] = [{}]
    seen: list[Counter] = [Counter()]
    for form, n in formats:
        s = 0
        for c in form:
            seen[s][c] += n
            if c not in nxt[s]:
                nxt[s][c] = len(nxt)
                nxt.append({})
                seen.append(Counter())
            s = nxt[s][c]
        seen[s][END] += n
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            na, nb = seen[a].total(), seen[b].total()
            if (a, b) in met or min(na, nb) < min_support:
                continue
            met.add((a, b))
            bound = width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if any(abs(seen[a][c] / na - seen[b][c] / nb) >= bound for c in seen[a].keys() | seen[b].keys()):
                return False
            todo += [(nxt[a][c], nxt[b][c]) for c in nxt[a].keys() & nxt[b].keys() if nxt[a][c] != nxt[b][c]]
        return True

    def likelihood(a: int, b: int) -> float:
        """How likely a's shares make what b has seen."""
        na = seen[a].total() + len(SYMBOLS) + 1
        return sum(n * math.log2((seen[a][c] + 1) / na) for c, n in seen[b].items())

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a].update(seen[b])
            for c, t in nxt[b].items():
                if c not in nxt[a]:
                    nxt[a][c] = t
                elif nxt[a][c] != t:
                    todo.append((nxt[a][c], t))

    kept = [0]
    edges = deque((0, c) for c in sorted(nxt[0]))
    while edges:
        p, c = edges.popleft()
        b = nxt[p][c]
        if b in kept:
            continue
        if seen[b].total() < min_support:
            into = max(kept, key=lambda r: (likelihood(r, b), -r))
        else:
            into = next((r for r in kept if compatible(r, b)), None)
        if into is None:
            kept.append(b)
            edges += [(b, x) for x in sorted(nxt[b])]
        else:
            nxt[p][c] = into
            fold(into, b)
            edges += [(r, x) for r in kept for x in sorted(nxt[r]) if nxt[r][x] not in kept and (r, x) not in edges]
    number = {s: i for i, s in enumerate(kept)}
    moves = []
    for s in kept:
        n = seen[s].total()
        moves.append({c: (number.get(nxt[s].get(c), 0), math.log2(k / n)) for c, k in sorted(seen[s].items()) if k})
    return Automaton(moves)


@dataclass
class Model:
    """Automata by kind, and counts of each symbol after two others in tokens without a label."""

    automata: dict[str, Automaton]
    after: dict[str, Counter]

    def others(self, form: str) -> float:
        """log2 of the format's probability among the other tokens."""
        total, before = 0.0, END * 2
        for c in form + END:
            seen = self.after.get(before, Counter())
            total += math.log2((seen[c] + 1) / (seen.total() + len(SYMBOLS) + 1))
            before = before[1] + c
        return total

    def score(self, form: str) -> tuple[float, str]:
        """Bits by which the best automaton makes the format likelier than the other tokens do, and its kind."""
        rest = self.others(form)
        return max(((a.bits(form) - rest, k) for k, a in self.automata.items()), default=(-math.inf, ""))


def learn(docs: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """The model of a table.

    Labelled formats of up to MAX_FORMAT characters are counted in all texts; of each kind the
    max_labelled distinct ones with the smallest hashes are learned from, with their counts.
    """
    found = cut(counts(docs, text_col))
    labelled = {}
    for kind in KINDS:
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("format"), "format").limit(max_labelled).collect()
        labelled[kind] = sorted((r["format"], r["n"]) for r in rows)
    after: dict[str, Counter] = defaultdict(Counter)
    for r in found.where("kind = ''").collect():  # at most one row for each three symbols
        after[r["format"][:2]][r["format"][2]] = r["n"]
    return Model({k: infer(x) for k, x in labelled.items() if x}, dict(after))


class Scorer:
    """Scores all tokens of texts, remembering the verdicts on tokens' classes."""

    def __init__(self, model: Model, least: float):
        self.model, self.least, self.known = model, least, {}

    def judge(self, classes: bytes) -> tuple[float, list[tuple[int, int, str]]]:
        """The best score among a token's parts, and (start, end, kind) of those taken for secrets."""
        found = self.known.get(classes)
        if found is None:
            best, taken = -math.inf, []
            for i, j, form in parts(classes):
                score, kind = self.model.score(form)
                best = max(best, score)
                if score >= self.least:
                    taken.append((i, j, kind))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[classes] = (best, taken)
        return found

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        base = base_spans(text, raw)
        spans = [(i, k, j, KINDS[k]) for i, k, j, _, _ in base]
        best, some = -math.inf, False
        for classes in set(raw.translate(_CLASS).split()):
            score, taken = self.judge(classes)
            best, some = max(best, score), some or bool(taken)
        if some:
            for m in TOKEN.finditer(text):
                for i, j, kind in self.judge(classes_of(m.group()))[1]:
                    i, j = m.start() + i, m.start() + j
                    if not any(s <= i and j <= e for s, _, e, *_ in base):
                        spans.append((i, len(KINDS) + KINDS.index(kind), j, f"like_{kind}"))
        listed = lambda found: ",".join(f"{k}:{i}:{j}" for i, _, j, k in found)
        return (*[sum(b[1] == k for b in base) for k in range(3)], listed(spans[: len(base)]), listed(sorted(spans)), None if best == -math.inf else round(best, 3))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, least_bits: float = LEAST_BITS) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans, score) for every row of docs.

    base and spans list kind:start:end by start, then kind as listed, comma-joined; spans
    adds the tokens whose format an automaton makes likelier than the other tokens do by
    least_bits or more, as like_<kind>, unless they lie in a base span. score is the best of
    all the text's tokens, base ones included; null without tokens or automata. Null and
    empty texts have no spans; repeated rows each get a row; with no labelled credential in
    the table nothing is added; a token of any length is one token; other columns of docs are
    ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col, max_labelled))

    def make():
        scorer = Scorer(sent.value, least_bits)
        return lambda texts: [scorer(t) for t in texts]

    return map_texts(docs, make, "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, score double", id_col, text_col)
