"""Conversation repair against a search over all edit scripts."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pageledger.llm import role_repair as R

LEGAL = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit) by Dijkstra over (rows read, initials written), without any grammar tables: every script is tried in the order of its price."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, at, initials, out = heapq.heappop(todo)
        if at == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        state = (at, initials[-2:] if len(initials) > 1 else initials, len(initials) > 1 and initials[0] == "s")
        if (state, audit) in done:
            continue
        done.add((state, audit))

        def go(price, letter, at, role, turn):
            now = initials + role[:1]
            if re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(todo, (cost + price, audit + letter, at, now, (*out, turn)))

        if len(audit) < 2 * len(rows) + 4:
            for role in ("user", "assistant"):
                go(2, "I", at, role, f"{role}:")
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(todo, (cost + 3, audit + "D", at + 1, initials, out))
            if fault in (None, "truncated"):
                extra = fault == "truncated"
                if role:
                    go(extra, "K", at + 1, role, f"{role}:{text}")
                for other in ("user", "assistant"):
                    go(2 + extra, "R", at + 1, other, f"{other}:{text}")


def faulty(rows):
    """Rows of one conversation with their first fault, and the counts."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    return out, (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(r[2] == f for r in out) for f in ("blank", "duplicate", "truncated")), pairs)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


ROLE = st.sampled_from(["user", "assistant", "system", "tool", "", "sys", "u"])
KIND = st.sampled_from([None, None, "blank", "duplicate", "truncated"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLE, KIND), max_size=6))
def test_parser_finds_the_cheapest_script(kinds):
    rows = [(role, f"text {k}", fault) for k, (role, fault) in enumerate(kinds)]
    repair = R.Repair()
    for role, text, fault in rows:
        repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    found = repair.end()
    assert found == cheapest(rows)
    assert len(repair.tops) <= 6
    turns = list(R.replay(found[1], iter([r[:2] for r in rows])))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in turns).encode()).hexdigest() == found[2]


def test_long_conversation_keeps_few_cells():
    repair = R.Repair()
    for k in range(50_000):
        repair.row("user", str(k), False, k % 7 == 0)
    cost, audit, _ = repair.end()
    assert len(repair.tops) <= 6 and len(audit.replace("I", "")) == 50_000 and cost == 50_000 + 7143


def conversations():
    rnd, rows = random.Random(5), []
    for conv in range(60):
        for turn in range(rnd.randrange(1, 6)):
            rows.append((conv, turn * rnd.choice((1, 1, 2)), rnd.choice(("user", "assistant", "system", None, "tool")), rnd.choice(("Hi.", "What", "", None, " \t\n", f"Text {turn}!", "end. \n"))))
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (70, None, "user", "no turn."), (70, None, "assistant", "no turn."), (71, 3, "user", "same."), (71, 3, "user", "same."), (72, 1, None, None)]
    rows += [(73, 0, "user", "long. " * 50_000), (73, 1, "assistant", "y" * 300_000), (74, -(1 << 62), "user", "a."), (74, 1 << 61, "assistant", "b.")]
    return rows


def test_conversations_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS)
    for name in ("there", "digest", "first", "_conv", "_digest", "copy", "later", "blank", "audit", "head"):
        df = df.withColumn(name, F.lit("clash"))
    found = R.repaired_conversations(df)
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    by = {}
    for conv, *rest in damaged(rows):
        by.setdefault(conv, []).append(tuple(rest))
    want = {}
    for conv in {r[0] for r in rows}:
        out, counts = faulty(by.get(conv, []))
        want[conv] = (*counts, *cheapest(out))
    assert got == want
    turns = {}
    for r in sorted(R.repaired_turns(R.damaged(df), found).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, result in want.items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == result[-1]


def test_empty_table(spark):
    assert R.repaired_conversations(spark.createDataFrame([], TURNS)).collect() == []


@pytest.mark.parametrize("roles, audit, cost", [("ua", "KK", 0), ("uu", "KR", 2), ("", "", 0), ("s", "D", 3), ("a", "IK", 2), ("sua", "KKK", 0), ("uus", "KIKR", 4)])
def test_known_repairs(roles, audit, cost):
    repair = R.Repair()
    for k, r in enumerate(roles):
        repair.row({"u": "user", "a": "assistant", "s": "system"}[r], f"{k}", False, False)
    assert repair.end()[:2] == (cost, audit)
