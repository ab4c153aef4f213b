"""Chat formatting: the cheapest repair of each conversation's roles, then its rendering.

A legal conversation is an optional system message, then user and assistant messages in
turn, the last by the assistant; any number of tool messages may stand between two of the
assistant's. Each turn is kept, given another role, or merged into the
message before it; messages without text are put in where a role is missing. Costs add
up along a path through the automaton of legal turns, so a stretch of turns is a square
table of least costs between states, and tables of neighbouring stretches combine: a
conversation too long for one task is repaired in stretches, whose tables and entries alone meet.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, partitions, reachable

#: States: nothing yet, then the role of the last message.
START, SYSTEM, USER, ASSISTANT, TOOL = range(5)
ROLES = ("", "system", "user", "assistant", "tool")
N = len(ROLES)
#: Other names of roles; anything else has no known role.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT, "tool": TOOL, "function": TOOL, "ipython": TOOL, "observation": TOOL}
#: Costs of merging into a message of the same role, of another role, of inserting a message, of naming an
#: unknown role, and of another role where one of both is a tool: its output does not become speech, nor speech its output.
MERGE, RELABEL, INSERT, NAME, RELABEL_TOOL = 1, 4, 3, 1, 9
FAR = 1 << 40
#: Costs of the states in which a conversation begins.
BEGIN = [0, *[FAR] * (N - 1)]
#: Which role may follow which state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (TOOL, ASSISTANT)}
#: Turns of a conversation that one task repairs at once, and of a stretch of a longer one.
WHOLE_TURNS, STRETCH_TURNS = 5_000, 1_000
#: Turns in a part of a rendered conversation.
PART_TURNS = 1_000


@dataclass(frozen=True)
class Step:
    cost: int
    role: int  # the message that the turn ends up in
    inserted: tuple[int, ...]  # messages without text before it
    merged: bool


def label_cost(turn: int, role: int) -> int:
    return 0 if turn == role else RELABEL_TOOL if TOOL in (turn, role) else RELABEL if turn else NAME


def _steps() -> dict[int, list[list[Step | None]]]:
    """For each role of a turn (0: unknown), the cheapest step between each two states."""
    bridges: dict[tuple[int, int], tuple[int, ...]] = {}
    for n in range(3):
        for s in range(N):
            for path in itertools.product((SYSTEM, USER, ASSISTANT), repeat=n):
                at = s
                for r in path:
                    at = r if r in NEXT[at] else -1
                    if at < 0:
                        break
                if at >= 0:
                    bridges.setdefault((s, at), path)
    out = {}
    for turn in range(N):
        table: list[list[Step | None]] = [[None] * N for _ in range(N)]
        for s, t in itertools.product(range(N), range(1, N)):
            label = label_cost(turn, t)
            options = [Step(label + INSERT * len(path), t, path, False) for (a, b), path in bridges.items() if a == s and t in NEXT[b]]
            if s == t:
                options.append(Step(label + MERGE, t, (), True))
            table[s][t] = min(options, key=lambda o: (o.cost, len(o.inserted), o.merged), default=None)
        out[turn] = table
    return out


STEPS = _steps()
#: What it costs to end in each state, and with which message without text.
ENDS = {START: FAR, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0, TOOL: INSERT}
TAIL = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (), TOOL: (ASSISTANT,)}


def role_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), 0)


def table_of(turns: list[int]) -> np.ndarray:
    """Least costs from each state to each over the turns."""
    costs = {k: np.array([[FAR if x is None else x.cost for x in row] for row in t], np.int64) for k, t in STEPS.items()}
    out = np.where(np.eye(N, dtype=bool), 0, FAR).astype(np.int64)
    for t in turns:
        out = np.minimum((out[:, :, None] + costs[t][None]).min(1), FAR)
    return out


def path_from(turns: list[int], begin: list[int], end: int | None) -> tuple[list[int], int]:
    """States after each turn on the cheapest path from entry states of the given costs, and its entry state.

    Of equal paths the one whose state is the smallest before each turn, the last turn first.
    """
    best, back = list(begin), []
    for t in turns:
        now, how = [FAR] * N, [0] * N
        for s, x in itertools.product(range(N), range(N)):
            step = STEPS[t][s][x]
            if step and best[s] < FAR and best[s] + step.cost < now[x]:
                now[x], how[x] = best[s] + step.cost, s
        best = now
        back.append(how)
    at = min(range(N), key=lambda s: (best[s] + ENDS[s], s)) if end is None else end
    states = []
    for how in reversed(back):
        states.append(at)
        at = how[at]
    return states[::-1], at


def path_between(turns: list[int], begin: int, end: int | None) -> list[int]:
    """States after each turn on the cheapest path from one state."""
    return path_from(turns, [0 if s == begin else FAR for s in range(N)], end)[0]


def piece(role: int, text: str | None, inserted: tuple[int, ...], merged: bool, first: bool, last: bool) -> str:
    """A turn's share of the rendered chat: pieces in order make up the whole."""
    out = "" if merged or first else "<|end|>\n"
    for r in inserted:
        out += f"<|{ROLES[r]}|>\n<|end|>\n"
    out += "\n\n" if merged else f"<|{ROLES[role]}|>\n"
    out += text or ""
    if last:
        out += "<|end|>\n"
        for r in TAIL[role]:
            out += f"<|{ROLES[r]}|>\n<|end|>\n"
    return out


def actions(turns: list[int], begin: int, states: list[int], message: int) -> list[tuple[int, str, int, tuple[int, ...], bool]]:
    """(message number, action, role, inserted, merged) for each turn."""
    out, at = [], begin
    for t, s in zip(turns, states, strict=True):
        step = STEPS[t][at][s]
        message += len(step.inserted) + (not step.merged)
        names = ["insert"] * bool(step.inserted) + [("relabel" if t else "name")] * (t != s) + ["merge"] * step.merged
        out.append((message, "+".join(names) or "keep", s, step.inserted, step.merged))
        at = s
    return out


_OUT = [("position", pa.int64()), ("message", pa.int64()), ("new_role", pa.string()), ("action", pa.string()), ("piece", pa.large_string())]
_SCHEMA = "position bigint, message bigint, new_role string, action string, piece string"


def _whole(batches):
    """Repairs conversations that stand together, in order of their turns."""
    key, rows = None, []

    def close():
        turns = [role_of(r[2]) for r in rows]
        states, _ = path_from(turns, BEGIN, None)
        made = actions(turns, START, states, -1)
        return [(*r[:3], i, m, ROLES[s], a, piece(s, r[3], ins, mg, i == 0, i == len(rows) - 1)) for i, (r, (m, a, s, ins, mg)) in enumerate(zip(rows, made, strict=True))]

    for b in batches:
        done = []
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if rows and row[0] != key:
                done += close()
                rows = []
            key = row[0]
            rows.append(row)
        if done:
            yield _batch(done, b.schema)
        last = b.schema
    if rows:
        yield _batch(close(), last)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [*[schema.field(i).type for i in range(3)], *[t for _, t in _OUT[:4]], pa.string()]
    names = [*schema.names[:3], *[n for n, _ in _OUT]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", whole_turns: int = WHOLE_TURNS, stretch: int = STRETCH_TURNS) -> DataFrame:
    """(id, turn, role, position, message, new_role, action, piece) for every row of turns.

    The pieces of a conversation in order of position are its rendered chat: a message that
    is inserted stands in the piece of the turn after it, or of the last turn. Turns with
    equal numbers, or none, are ordered by role, then text; a null text is empty; a null or
    unknown role costs a name only; rows with a null id are one conversation; repeated
    rows are turns of their own; an empty table gives an empty result; other columns are
    ignored. Conversations of more than whole_turns turns are dealt by ranges of turns and come out
    the same, row by row: tables of their stretches meet and give each stretch what it costs to enter it in each state,
    then the entry that belongs to each exit of a stretch meets the others'.
    """
    spark = turns.sparkSession
    reachable(spark)
    rows = turns.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, turn {kinds['turn']}, role {kinds['role']}, {_SCHEMA}"
    long_ones = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > whole_turns).select(F.col("id").alias("long"), "n"))
    n_long, longest = long_ones.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    long_ones = long_ones.select("long")
    few = F.broadcast(long_ones) if n_long <= 20_000 else long_ones
    order = ["id", "turn", "role", "text"]
    usual = rows if not n_long else rows.join(few, rows["id"].eqNullSafe(F.col("long")), "left_anti")
    out = usual.repartition(partitions(spark), "id").sortWithinPartitions(*order).mapInArrow(_whole, schema)
    if n_long:
        out = out.union(_stretched(rows.join(few, rows["id"].eqNullSafe(F.col("long")), "left_semi"), order, schema, max(stretch, math.isqrt(longest))))
    return out.select(F.col("id").alias(id_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "position", "message", "new_role", "action", "piece")


def rendered(found: DataFrame, id_col: str = "conv_id", part_turns: int = PART_TURNS) -> DataFrame:
    """(id, part, n_turns, n_changed, actions, text) from the rows of repaired().

    The rendered chat of each conversation; one of more than part_turns turns has several
    parts, and its whole chat is their texts in order. actions lists what became of each
    turn, comma-joined.
    """
    part = F.floor(F.col("position") / part_turns).cast("int")
    rows = found.groupBy(F.col(f"`{id_col}`").alias("id"), part.alias("part")).agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("action") != "keep").alias("n_changed"), F.array_sort(F.collect_list(F.struct("position", "action", "piece"))).alias("x")
    )
    joined = lambda c, by: F.array_join(F.transform("x", lambda x: x[c]), by).alias
    return rows.select(F.col("id").alias(id_col), "part", "n_turns", "n_changed", joined("action", ",")("actions"), joined("piece", "")("text"))


def _stretched(rows: DataFrame, order: list[str], schema: str, stretch: int) -> DataFrame:
    """As _whole, for conversations in stretches over many tasks."""
    spark = rows.sparkSession
    placed = cut(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))

    def runs(batches):
        """Stretches of one conversation in one partition: (id, first place, rows)."""
        held = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (row[0] != held[0][0] or len(held) == stretch):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def tables(batches):
        for run in runs(batches):
            costs = table_of([role_of(r[1]) for r in run]).ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array([run[0][2]], pa.int64()), pa.array([run[0][0]], id_kind), pa.array([costs], pa.list_(pa.int64()))], names=["at", "id", "costs"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(placed.schema["id"].dataType)
    own_kinds = [to_arrow_type(placed.schema[c].dataType) for c in ("id", "turn", "role")]
    summaries = cut(placed.select("id", "role", "at").mapInArrow(tables, f"at bigint, id {dict(placed.dtypes)['id']}, costs array<bigint>"))

    def enter(pdf):
        """What it costs to enter each stretch of a conversation in each state, from the tables before it."""
        pdf = pdf.sort_values("at")
        best, found = np.array(BEGIN), []
        for costs in pdf["costs"]:
            found.append(best.tolist())
            best = np.minimum((best[:, None] + np.asarray(costs, np.int64).reshape(N, N)).min(0), FAR)
        pdf["begin"] = found
        pdf["first"], pdf["last"] = [i == 0 for i in range(len(pdf))], [i == len(pdf) - 1 for i in range(len(pdf))]
        return pdf[["id", "at", "begin", "first", "last"]]

    id_type = dict(placed.dtypes)["id"]
    begins = cut(summaries.groupBy("id").applyInPandas(enter, f"id {id_type}, at bigint, begin array<bigint>, first boolean, last boolean"))
    few_stretches = begins.count() <= 100_000

    def marked(stretches: DataFrame, columns: list[str]) -> DataFrame:
        """Rows, of which each stretch's first carries the stretch's columns; a stretch is never parted."""
        t = placed.join(F.broadcast(stretches) if few_stretches else stretches, "at", "left")
        t = t if few_stretches else t.repartition(partitions(spark), F.shiftright("at", 33)).sortWithinPartitions("at")
        return t.select("id", "turn", "role", "text", "at", *columns)

    def opened(batches, given: int):
        """(a stretch's columns, its rows); the column `given` is null but in a first row."""
        held, mark = [], None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[given] is not None:
                    if held:
                        yield mark, held
                    held, mark = [], row[5:]
                held.append(row[:5])
        if held:
            yield mark, held

    def entries(batches):
        for (begin, last), run in opened(batches, 5):
            turns = [role_of(r[2]) for r in run]
            leave = path_from(turns, begin, None)[0][-1] if last else None
            at = [path_from(turns, begin, x)[1] for x in range(N)]
            yield pa.RecordBatch.from_arrays([pa.array([run[0][0]], id_kind), pa.array([run[0][4]], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([leave], pa.int32())], names=["id", "at", "entries", "leave"])

    def meet(pdf):
        """The exit of each stretch on the conversation's path, the last one first."""
        pdf = pdf.sort_values("at")
        at, ends = int(pdf["leave"].iloc[-1]), []
        for found in reversed(pdf["entries"].tolist()):
            ends.append(at)
            at = int(found[at])
        pdf["leave"] = ends[::-1]
        return pdf[["at", "leave"]]

    lead = marked(begins.select("at", "begin", "last"), ["begin", "last"]).mapInArrow(entries, f"id {id_type}, at bigint, entries array<int>, leave int")
    exits = lead.groupBy("id").applyInPandas(meet, "at bigint, leave int")
    fields = marked(cut(begins.drop("id").join(exits, "at")), ["begin", "leave", "first", "last"])

    def render(batches, count_only: bool):
        def out(mark, held):
            begin, leave, first, last = mark
            turns = [role_of(r[2]) for r in held]
            states, enters = path_from(turns, begin, leave)
            made = actions(turns, enters, states, -1 if first else 0)
            if count_only:
                return [(held[0][0], held[0][4], made[-1][0] + first, len(held))]
            return [(*r[:3], r[4], held[0][4], i, m, ROLES[s], a, piece(s, r[3], ins, mg, first and i == 0, last and i == len(held) - 1)) for i, (r, (m, a, s, ins, mg)) in enumerate(zip(held, made, strict=True))]

        def batch(rows):
            if count_only:
                kinds, names = [id_kind, pa.int64(), pa.int64(), pa.int64()], ["id", "stretch", "n", "rows"]
            else:
                kinds = [*own_kinds, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["id", "turn", "role", "at", "stretch", "position", "message", "new_role", "action", "piece"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for mark, held in opened(batches, 5):
            yield batch(out(mark, held))

    kinds = dict(placed.dtypes)
    counts = fields.mapInArrow(lambda bs: render(bs, True), f"id {kinds['id']}, stretch bigint, n bigint, rows bigint")
    from pyspark.sql import Window as W

    # One row for each stretch: how many messages and turns stand before it in its conversation.
    upto = W.partitionBy("id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.select("stretch", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("n", "rows")])
    before = cut(sums.select("stretch", F.when(F.col("n") > 0, F.col("n") - 1).otherwise(0).alias("before"), F.col("rows").alias("start")))
    full = fields.mapInArrow(lambda bs: render(bs, False), f"id {kinds['id']}, turn {kinds['turn']}, role {kinds['role']}, at bigint, stretch bigint, {_SCHEMA}")
    few = F.broadcast(before) if before.count() <= 100_000 else before
    return full.join(few, "stretch").select("id", "turn", "role", (F.col("position") + F.col("start")).alias("position"), (F.col("message") + F.col("before")).alias("message"), "new_role", "action", "piece")
