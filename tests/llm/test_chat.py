import itertools
import random

import pytest

from tesserae.llm import chat

LEGAL = {(chat.START, chat.SYSTEM), (chat.START, chat.USER), (chat.SYSTEM, chat.USER), (chat.USER, chat.ASSISTANT), (chat.ASSISTANT, chat.USER), (chat.ASSISTANT, chat.TOOL), (chat.TOOL, chat.TOOL), (chat.TOOL, chat.ASSISTANT)}


def brute_cost(turns):
    """The least cost over all ways to give each turn a role, merge it, and insert messages."""
    best = chat.FAR
    for roles in itertools.product((1, 2, 3, 4), repeat=len(turns)):
        for merges in itertools.product((False, True), repeat=len(turns)):
            cost, at = 0, chat.START
            for t, r, m in zip(turns, roles, merges, strict=True):
                cost += 0 if t == r else chat.RELABEL_TOOL if 4 in (t, r) else chat.RELABEL if t else chat.NAME
                if m:
                    if at != r:
                        cost = chat.FAR
                        break
                    cost += chat.MERGE
                else:
                    cost += chat.INSERT * fewest(at, r)
                at = r
            best = min(best, cost + chat.INSERT * fewest_end(at)) if cost < chat.FAR else best
    return best


def fewest(a, b):
    for n in range(4):
        for path in itertools.product((1, 2, 3), repeat=n):
            steps = [a, *path, b]
            if all(p in LEGAL for p in itertools.pairwise(steps)):
                return n
    return chat.FAR


def fewest_end(a):
    return {chat.START: chat.FAR, chat.SYSTEM: 2, chat.USER: 1, chat.ASSISTANT: 0, chat.TOOL: 1}[a]


def cost_of(turns):
    states = chat.path_between(turns, chat.START, None)
    cost, at = 0, chat.START
    for t, s in zip(turns, states, strict=True):
        cost += chat.STEPS[t][at][s].cost
        at = s
    return cost + chat.ENDS[at]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_least_cost(n):
    for turns in itertools.product(range(5), repeat=n):
        assert cost_of(list(turns)) == brute_cost(turns), turns


def parsed(rendered):
    out = []
    for block in rendered.split("<|end|>\n"):
        if block:
            role, _, text = block.partition("|>\n")
            out.append((role.removeprefix("<|"), text.removesuffix("\n")))
    return out


def conversations(seed=3):
    rng = random.Random(seed)
    names = ["user", "assistant", "system", "Human", None, "bot", "tool", ""]
    return [(c if c else None, t if rng.random() < 0.95 else None, rng.choice(names[: 2 + c % 7]), rng.choice([None, "", f"text {c} {t}"])) for c in range(30) for t in range(1 + (c * 7) % 23)]


def pieces(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.conv_id, []).append(r)
    return got


def test_rendered_chats_are_legal_and_whole(spark):
    rows = conversations()
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = pieces(chat.repaired(df))
    assert sum(map(len, got.values())) == len(rows)
    for found in got.values():
        order = sorted(found, key=lambda r: (r.message, not r.piece.startswith("<|") and r.message >= 0))
        assert [r.message for r in order] == sorted(r.message for r in order)
    for conv, found in got.items():
        if not any(r.turn is None for r in found) and len({r.turn for r in found}) == len(found):
            chatted = parsed("".join(r.piece for r in sorted(found, key=lambda r: r.turn)))
            at = chat.START
            for role, _ in chatted:
                assert (at, chat.ROLES.index(role)) in LEGAL, conv
                at = chat.ROLES.index(role)
            assert at == chat.ASSISTANT
            texts = [t for c, n, _, t in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]) if t]
            assert "".join(texts) == "".join(t.replace("\n", "") for _, t in chatted)


def test_stretches_give_what_whole_conversations_give(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system", None]), f"t{t}") for t in range(400)] + [(2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    whole = sorted(map(tuple, chat.repaired(df).collect()))
    parts = sorted(map(tuple, chat.repaired(df, whole_turns=10, stretch=7).collect()))
    turns = [chat.role_of(r[2]) for r in rows[:400]]
    assert len(parts) == len(whole)
    cost = 0
    at = chat.START
    for r in [p for p in parts if p[0] == 1]:
        s = chat.ROLES.index(r[5])
        cost += chat.STEPS[chat.role_of(r[2])][at][s].cost
        at = s
    assert cost + chat.ENDS[at] == cost_of(turns)
    assert [p[4] for p in parts] == sorted(p[4] for p in parts if p[0] == 1) + [p[4] for p in parts if p[0] == 2]
    assert [p[3] for p in parts] == [*range(400), 0] == [p[3] for p in whole]
    chatted = parsed("".join(p[7] for p in parts if p[0] == 1))
    assert [r for r, _ in chatted if r != "system"] == ["user", "assistant"] * (len([r for r, _ in chatted if r != "system"]) // 2)
    assert parts[-1][4] == len(parsed(parts[-1][7])) - 1
    last = [p for p in parts if p[0] == 1][-1]
    assert last[4] + len(chat.TAIL[chat.ROLES.index(last[5])]) == len(chatted) - 1
    for size in (1000, 30):
        found = chat.rendered(chat.repaired(df, whole_turns=10, stretch=7), part_turns=size).orderBy("conv_id", "part").collect()
        one = [r for r in found if r.conv_id == 1]
        assert [r.n_turns for r in one] == [min(size, 400 - i) for i in range(0, 400, size)] and "".join(r.text for r in one) == "".join(p[7] for p in parts if p[0] == 1)
        assert ",".join(r.actions for r in one).split(",") == [p[6] for p in parts if p[0] == 1] and sum(r.n_changed for r in one) == sum(p[6] != "keep" for p in parts if p[0] == 1)


@pytest.mark.parametrize("stretch", [3, 7, 50])
def test_stretches_and_whole_conversations_are_equal_row_by_row(spark, stretch):
    """Where costs tie too: random roles of all kinds, in conversations of many lengths."""
    rng = random.Random(stretch)
    names = ["user", "assistant", "system", "tool", None]
    rows = [(c, t, rng.choice(names), f"t{c} {t}") for c in range(60) for t in range(rng.choice([11, 23, 40, 70]))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    assert sorted(map(tuple, chat.repaired(df, whole_turns=10, stretch=stretch).collect())) == sorted(map(tuple, chat.repaired(df).collect()))


def test_tool_turns_stay_tools(spark):
    rows = [(1, t, r, r) for t, r in enumerate(["user", "assistant", "tool", "function", "assistant"])] + [(2, 0, "tool", "late"), (2, 1, "assistant", "a")]
    got = {r.conv_id: r for r in chat.rendered(chat.repaired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert [r for r, _ in parsed(got[1].text)] == ["user", "assistant", "tool", "tool", "assistant"] and got[1].n_changed == 0
    assert [r for r, _ in parsed(got[2].text)] == ["user", "assistant", "tool", "assistant"] and got[2].actions == "insert,keep"


def test_clashing_columns_and_all_conversations(spark, sf):
    from pyspark.sql import functions as F

    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    clash = turns.select("*", *[F.lit("x").alias(c) for c in ("id", "position", "message", "piece", "at", "n", "long", "part", "stretch")])
    a = chat.rendered(chat.repaired(clash)).orderBy("conv_id").collect()
    assert a == chat.rendered(chat.repaired(turns)).orderBy("conv_id").collect()
    assert sum(r.n_turns for r in a) == turns.count() and len(a) == turns.select("conv_id").distinct().count()
    for r in a:
        at = chat.START
        for role, _ in parsed(r.text):
            assert (at, chat.ROLES.index(role)) in LEGAL
            at = chat.ROLES.index(role)
        assert at == chat.ASSISTANT


def test_empty(spark):
    assert chat.repaired(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
