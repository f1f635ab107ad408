"""Conversation repair: the edits against all possible ones and a plain table of audits, blocks against whole conversations."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import conversation_repair as c

KINDS = ["x", "s", "u", "a", "", "s.", "u.", "a.", "."]


def plain_edits(rows, start=c.START, end=None):
    """The least (cost, audit) by a table over all rows that keeps every state's whole audit."""
    best = {start: (0, "")}

    def inserts(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                best[c.NEXT[s]] = min(best.get(c.NEXT[s], (10**9, "")), (cost + 2, audit + "I"))
        return best

    for k in rows:
        after = {}
        for s, (cost, audit) in inserts(best).items():
            moves = [(s, 3, "D")]
            if k != "x":
                cut = k.endswith(".")
                moves.append((c.NEXT[s], 2 + cut, "R"))
                role = k.rstrip(".")
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, s))
                moves += [(to, int(cut), "K")] if to is not None else []
            for to, more, e in moves:
                after[to] = min(after.get(to, (10**9, "")), (cost + more, audit + e))
        best = after
    if end is not None:
        return best.get(end)
    best = inserts(best)
    return min(best[s] for s in (c.START, c.ASSISTANT) if s in best)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(KINDS), max_size=24))
def test_divide_and_conquer_finds_the_cheapest_least_audit(rows):
    cost, audit = plain_edits(rows)
    assert c.edits(rows) == audit
    roles = [{"s": "system", "u": "user", "a": "assistant", "": "tool"}.get(k.rstrip("."), "user") for k in rows]
    left, paid = c.replay(audit, roles, [str(k) for k in range(len(rows))], rows)
    assert paid == cost
    initials = "".join(t["role"][0] for t in left)
    assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(KINDS), max_size=7), min_size=1, max_size=6))
def test_blocks_compose_to_the_same_audit(blocks):
    ends = c.crossings([c.summary(b) for b in blocks])
    assert "".join(c.edits(b, s, e) for b, (s, e) in zip(blocks, ends, strict=True)) == plain_edits(sum(blocks, []))[1]


def test_a_hundred_thousand_rows_take_little_time():
    rows = [KINDS[(k * k + k // 7) % 9] for k in range(100_000)]
    halves = c.crossings([c.summary(rows[:40_000]), c.summary(rows[40_000:])])
    audit = c.edits(rows)
    assert audit == "".join(c.edits(r, s, e) for r, (s, e) in zip((rows[:40_000], rows[40_000:]), halves, strict=True))


BLANK = "\t\n\v\f\r "


def plain_report(rows):
    """The contract for all rows (conv, turn, role, text), damaged first."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else word(text).translate({ord(x): None for x in ".!?"}) if kind == 2 else word(text)
        convs[conv] += [(turn, "user" if kind == 4 else word(role), text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        classes = ["x" if f in ("blank", "duplicate") else (r[1][:1] if r[1][:1] in ("s", "u", "a") else "") + ("." if f == "truncated" else "") for r, f in zip(mine, faults, strict=True)]
        cost, audit = plain_edits(classes)
        left, _ = c.replay(audit, [r[1] for r in mine], [r[2] for r in mine], classes)
        turns = [r[0] for r in mine if r[0] is not None]
        starts = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in left).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def some_rows(n, hot):
    """Conversations of all lengths, a third of all rows in one, with nulls, repeats, ties and odd roles."""
    roles, texts = ["user", "assistant", "system", "tool", None, "", "unknown"], ["Fine.", "no end", " ", None, "", "é!\n", "Really? \t", "a.b"]
    rows = [(k % 97 if k % 3 else 1000, k // 5 if k % 11 else None, roles[(k * 7 + k // 3) % 7], texts[(k * 5 + k // 4) % 8] if k % 2 else f"text {k}.") for k in range(n)]
    rows += [(1000, k, "user", "x " * 50) for k in range(hot)] + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (5000, 0, None, None)] + rows[:20]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_the_contract_row_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK_ROWS", block)
    rows = some_rows(900, 200)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit(1)).withColumn("dropped", F.lit(2)).repartition(7)
    found = c.digest(c.repair(c.damage(df), dropped_col="dropped"))
    got = sorted((tuple(r) for r in found.select("conv_id", *c.STATS, "cost", "audit", "repaired_sha256").collect()), key=repr)
    assert got == plain_report(rows)


def test_very_long_texts_and_empty_tables(spark):
    kind = "conv_id string, turn int, role string, text string"
    long = spark.createDataFrame([("a", 0, "user", "x" * 6_000_000 + "."), ("a", 1, "assistant", "y" * 5_000_000), ("a", 2, "user", ". " * 1_000_000)], kind)
    whole = c.digest(c.repair(long)).first()
    assert whole["audit"] == "KKKI" and whole["truncated"] == 1 and whole["cost"] == 3
    assert c.digest(c.repair(spark.createDataFrame([], kind))).count() == 0
    left = c.repair(spark.createDataFrame([("a", 0, "assistant", "Hello."), ("a", 1, "assistant", "Bye.")], kind)).first()
    assert left["audit"] == "RK" and [tuple(t) for t in left["repaired"]] == [("user", "Hello."), ("assistant", "Bye.")]
