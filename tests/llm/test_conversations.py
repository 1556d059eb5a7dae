"""Conversation repair against a search over all edits, turn by turn."""

import heapq
import random
import re
import zlib
from hashlib import sha256

import pytest

from sparkreef.llm import conversations
from sparkreef.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    kept = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [] if fault == 0 else [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return kept


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines), by cheapest-first search."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, list(lines)
        for role in ("user", "assistant"):
            if (state, role[0]) in after:
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*lines, f"{role}:")))
        if at == len(rows):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
        if faults[at] in ("b", "d"):
            continue
        _, _, role, text = rows[at]
        late = cost + (faults[at] == "t")
        if (state, role[:1]) in after:
            heapq.heappush(heap, (late, audit + "K", at + 1, after[state, role[:1]], (*lines, f"{role}:{text}")))
        for to in ("user", "assistant"):
            if (state, to[0]) in after:
                heapq.heappush(heap, (late + 2, audit + "R", at + 1, to[0], (*lines, f"{to}:{text}")))


def wanted(rows):
    by_id = {}
    for row in rows:
        by_id.setdefault(row[0], [])
    for row in damaged(rows):
        by_id[row[0]].append(row)
    return {k: repaired(v) for k, v in by_id.items()}


def cases():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "User", "", None, "tool", "use"]
    texts = ["Yes.", "No!", "why", " ", "", None, "end? \n", "a. ", "b.\x85", "\x00.", "Yes."]
    rows = []
    for conv in [None, *range(250)]:
        for turn in range(rng.randint(1, 9)):
            shown = rng.choice([turn, turn, turn, None, turn * 2, 1, -5])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, shown, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += [(1000, 2**63 - 1, "user", "Far."), (1000, -(2**63), "assistant", "Apart.")]
    return rows + rows[:20] + [(1001, i, ("user", "assistant")[i % 3 == 0], "x." * (i % 2) + str(i)) for i in range(400)]


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_odd_conversations(spark, tmp_path):
    rows = cases()
    extra = ", at long, fault string, copy int, cost string"
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA + extra)
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = wanted(rows)
    far = expected.pop(1000)
    mended = found(conversations.with_every(conversations.repair_conversations(conversations.damage(frame)), frame))
    assert mended.pop(1000)[1:] == far[1:]  # its gaps don't fit a long
    assert mended == expected
    hashed = found(QUERIES["op11_conversation_repair"](spark, str(tmp_path)))
    hashed.pop(1000)
    assert hashed == {k: (*v[:-1], sha256("\n".join(v[-1]).encode()).hexdigest()) for k, v in expected.items()}


def test_given_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hashed = found(QUERIES["op11_conversation_repair"](spark, small))
    assert hashed == {k: (*v[:-1], sha256("\n".join(v[-1]).encode()).hexdigest()) for k, v in wanted(rows).items()}


@pytest.mark.parametrize("audit, rows", [("", []), ("IIK", [("assistant", "Hm.")]), ("KI", [("user", "Hm.")])])
def test_edges(spark, audit, rows):
    frame = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = found(conversations.repair_conversations(frame))
    assert got == ({1: repaired([(1, i, *r) for i, r in enumerate(rows)])} if rows else {})


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.with_every(conversations.repair_conversations(none), none).collect() == []


def test_one_shuffle_in_the_jvm(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    plan = conversations.repair_conversations(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
