"""Conversation repair against a search that tries all ways."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from signalspark.llm import repair

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, letters and the roles that the turns get, by uniform-cost search over whole strings."""
    wrong = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (i, state) in done:
            continue
        done.add((i, state))
        role = {"u": "user", "a": "assistant"}[NEXT[state]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state], (*kept, f"{role}:")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            if wrong[i] in ("", "truncated"):
                more = 3 if wrong[i] else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[state], (*kept, f"{role}:{rows[i][1]}")))
                to = STEP.get((state, rows[i][0][:1]))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*kept, f"{rows[i][0]}:{rows[i][1]}")))


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), text.encode()


def report(rows):
    """rows: (turn, role, text) of one conversation, damaged already."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    plain = [(r, x) for _, r, x in rows]
    wrong = faults(plain)
    roles = [r[:1] for r, _ in plain]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit, kept = cheapest(plain)
    counts = (gaps, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), illegal, cost)
    return (*counts, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversations(seed, n=120, longest=14):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "open", " ", "", "And?", "tail ", "Good. ", None, "é?", "\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rnd.randrange(longest)):
            turn += rnd.choice([0, 1, 1, 1, 1, 2, 5])
            rows.append((None if conv == 7 else conv, None if rnd.random() < 0.05 else turn, rnd.choice(roles), rnd.choice(texts)))
    return rows


KIND = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_repair_is_the_cheapest(spark, seed):
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND + ", conv string, header string")
    got = {r[0]: tuple(r[1:]) for r in repair.repair(repair.damage(frame), frame).collect()}
    after = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == report(after[conv]), (conv, after[conv])


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(1, t, r, x) for _, t, r, x in conversations(9, 60)] + conversations(10, 4)
    frame = spark.createDataFrame(rows, KIND)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.repair(frame).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    assert {r[0]: tuple(r[1:]) for r in found} == {c: report(x) for c, x in by.items()}


def test_tables_compose_to_the_whole():
    rnd = random.Random(4)
    for _ in range(60):
        turns = [(rnd.choice("suat"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randrange(12))]
        cuts = sorted(rnd.randrange(len(turns) + 1) for _ in range(2))
        made = repair.table(turns[: cuts[0]])
        for a, b in zip(cuts, [cuts[1], len(turns)]):
            made = repair.composed(made, repair.table(turns[a:b]))
        width, best = repair.least(turns, repair.FINAL)
        assert repair.ending(*made) == repair.decoded(width, best[0])


def test_parts_of_many_pieces(monkeypatch):
    monkeypatch.setattr(repair, "_CHUNK", 3)
    rnd = random.Random(5)
    turns = [(rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", " ", "c!"])) for _ in range(40)]
    part, seen = repair._Part(), set()
    for i, (role, text) in enumerate(turns):
        part.add(role, text, i, (role, text) in seen)
        seen.add((role, text))
    assert part.answer() == cheapest(turns)[:2]


def test_repaired_turns_alternate(spark):
    rows = conversations(3, 40)
    frame = spark.createDataFrame(rows, KIND)
    found = defaultdict(list)
    for r in sorted(repair.repaired_turns(frame).collect(), key=lambda r: r.position):
        found[r.conv_id].append(r.role[:1])
    assert found and all(re.fullmatch("s?(ua)+", "".join(x)) for x in found.values())


def test_copies_long_texts_and_empty_tables(spark):
    rows = [(1, 1, "user", "Hi.")] * 2000 + [(1, 2, "assistant", "word " * 200_000 + ".")]
    [found] = repair.repair(spark.createDataFrame(rows, KIND)).collect()
    assert (found.duplicate, found.cost, found.audit) == (1999, 4 * 1999, "K" + "D" * 1999 + "K")
    assert found.repaired_sha256 == hashlib.sha256(("user:Hi.\nassistant:" + "word " * 200_000 + ".").encode()).hexdigest()
    assert repair.repair(spark.createDataFrame([], KIND)).count() == 0
    assert repair.repaired_turns(spark.createDataFrame([], KIND)).count() == 0
