"""Conversation repair against a search for the cheapest edits, with pieces and buckets forced small."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rundiff.llm import conversations

TURNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", shown[3]) if fate == 2 else shown[3]
        row = (turn, "user" if fate == 4 else shown[2], text)
        out.append((conv, [row] * (0 if fate == 0 else 2 if fate == 3 else 1)))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit) and the lines; the search takes ways in the order of cost and audit."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        due = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 3, audit + "I", i, due[0], (*lines, ("I", due, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, lines))
        if found[i] in ("", "truncated"):
            more = 3 if found[i] else 0
            if role[:1] == due[0] or (role[:1] == "s" and state == ""):
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*lines, ("K", role, text))))
            heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, due[0], (*lines, ("R", due, text))))


def plain_report(rows):
    """{conversation: report} and {conversation: lines} of (conversation, turn rows)."""
    by = defaultdict(list)
    for conv, some in rows:
        by[conv] += some
    reports, lines = {}, {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        found = faults(turns)
        cost, audit, left = cheapest(turns, found)
        numbers = {t[0] for t in turns if t[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in left).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        reports[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)
        lines[conv] = [(i, *line) for i, line in enumerate(left)]
    return reports, lines


def fixture():
    rng = random.Random(13)
    roles = ["user", "assistant", "system", "tool", "", "User", "uncle", None]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.choice([1, 2, 4, 7, 30])):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = rng.choice(["a.", "b!", "c?", "yes. \n", "no", " ", "", None, "\x1c", f"t {rng.random()}.", f"u {rng.random()}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), role, text))
    rows += [(500, t, ("user", "assistant")[t % 2], "again.") for t in range(90)]
    rows += [(501, 3, "user", "same.")] * 70 + [(501, 4, "assistant", f"{i}.") for i in range(70)]
    rows += [(502, None, "system", "only.")] + [(503, t, "assistant", f"x{t}.") for t in range(60)] + [(504, 0, "system", "long " * 20000)]
    return rows


def clashing(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    for clash in ("conv", "late", "print", "copies", "fault", "edits", "tag", "place", "audit"):
        df = df.withColumn(clash, F.lit("x"))
    return df


@pytest.mark.parametrize("piece", [conversations._PIECE, 9])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "_PIECE", piece)
    monkeypatch.setattr(conversations, "_BUCKET", 200)
    rows = fixture()
    reports, _ = plain_report(damaged(rows))
    got = conversations.repair_report(conversations.damage(clashing(spark, rows)), copies=F.col("copies")).collect()
    assert len(got) == len(reports) and {r[0]: tuple(r)[1:] for r in got} == reports


@pytest.mark.parametrize("piece", [conversations._PIECE, 9])
def test_repaired_lines(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "_PIECE", piece)
    rows = fixture()
    _, lines = plain_report([(c, [(t, " " if r is None else r, " " if x is None else x)]) for c, t, r, x in rows])
    got = defaultdict(list)
    for r in conversations.repair_conversations(clashing(spark, rows)).collect():
        got[r.conv_id].append((r.place, r.edit, r.role, r.text))
        assert (r.edit == "I") <= (r.turn is None)
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c, v in lines.items() if v}


def test_repair_of_no_turns(spark):
    none = clashing(spark, fixture()).limit(0)
    assert conversations.repair_report(conversations.damage(none), copies=F.col("copies")).collect() == []
    assert conversations.repair_conversations(none).collect() == []
