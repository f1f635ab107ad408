"""Repair of conversations to `(s?(ua)+)?` by the cheapest edits, reconstructed in linear space by divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: States: nothing yet, after system, after user, after assistant; and what each state still needs to end well (inserts).
START, SYSTEM, USER, ASSISTANT = range(4)
TAIL = (0, 2, 1, 0)
#: What an inserted or renamed turn leads to, and the states that a turn's own initial may follow.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of a deletion, an insertion, a new role, and of a truncated turn that stays.
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1
FAR = 1 << 30
#: A conversation is cut into blocks of so many rows or bytes of text; most are one block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Rows and bytes of an output batch.
OUT_ROWS, OUT_BYTES = 2000, 8 << 20

#: A row's class: "x" must go; else its role's initial if that can stay ("s", "u", "a" or ""), with "." if it is truncated.
Classes = list[str]


@cache
def step(kind: str) -> tuple:
    """4 x 4 (cost, edits) over a row of a class: the cheapest and then ASCII-least inserts and edit from state to state."""
    out = [[(FAR, "")] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for n in range(3):
            ends = {state: (DELETE, "D")}
            if kind != "x":
                cut = CUT if kind.endswith(".") else 0
                ends[state] = min(ends[state], (DELETE, "D"))
                for to, option in [(NEXT[state], (RENAME + cut, "R")), (KEPT[kind.rstrip(".")].get(state), (cut, "K"))]:
                    if to is not None:
                        ends[to] = min(ends.get(to, (FAR, "")), option)
            for to, (cost, edit) in ends.items():
                out[start][to] = min(out[start][to], (cost + n * INSERT, "I" * n + edit))
            state = NEXT[state]
    return tuple(map(tuple, out))


@cache
def _forward(costs: tuple, ranks: tuple, kind: str) -> tuple[tuple, tuple, int]:
    """Costs (less their least) and ranks of the four states after one more row, and that least cost.

    ranks order the states' best edits so far by ASCII. Edits up to the same row never are each other's beginnings, so
    that order settles whatever follows.
    """
    moves, found = step(kind), []
    for to in range(4):
        found.append(min((costs[s] + moves[s][to][0], ranks[s], moves[s][to][1]) for s in range(4)))
    least = min(f[0] for f in found)
    order = sorted((f[1:], to) for to, f in enumerate(found))
    places = {to: k for k, (_, to) in enumerate(order)}
    return tuple(min(f[0] - least, FAR) if f[0] < FAR else FAR for f in found), tuple(places[t] for t in range(4)), least


@cache
def _backward(costs: tuple, kind: str) -> tuple[tuple, int]:
    moves = step(kind)
    found = [min(moves[s][to][0] + costs[to] for to in range(4)) for s in range(4)]
    least = min(found)
    return tuple(f - least if f < FAR else FAR for f in found), least


def forward(rows: Classes, lo: int, hi: int, start: int) -> tuple[list[int], tuple]:
    """Costs of the four states after rows lo to hi from one state, and the ASCII order of their best edits."""
    costs, ranks, total = tuple(0 if s == start else FAR for s in range(4)), (0, 0, 0, 0), 0
    for k in range(lo, hi):
        costs, ranks, more = _forward(costs, ranks, rows[k])
        total += more
    return [c + total if c < FAR else FAR for c in costs], ranks


def backward(rows: Classes, lo: int, hi: int, end: tuple) -> list[int]:
    """Least cost from each state before row lo to the end, given the end's costs after row hi."""
    costs, total = end, 0
    for k in range(hi - 1, lo - 1, -1):
        costs, more = _backward(costs, rows[k])
        total += more
    return [c + total if c < FAR else FAR for c in costs]


def ending(state: int | None) -> tuple:
    """Costs after the last row: one state only, or None for the end of the conversation with its inserts."""
    return tuple(INSERT * n for n in TAIL) if state is None else tuple(0 if s == state else FAR for s in range(4))


def edits(rows: Classes, start: int = START, end: int | None = None) -> str:
    """The cheapest edits from one state to another, ASCII-least among equals: Hirschberg's divide and conquer.

    The forward costs of the first half and the backward costs of the second meet in the middle; of the states where
    their sum is least, the one with the ASCII-least edits before it is crossed, and both halves are solved alike. Space
    is linear in the rows, whose classes are all that is kept.
    """
    out: list[str] = []
    todo = [(0, len(rows), start, ending(end))]
    state = start
    while todo:
        lo, hi, state, last = todo.pop()
        if hi - lo == 1:
            moves = step(rows[lo])[state]
            _, edit, state = min((moves[t][0] + last[t], moves[t][1], t) for t in range(4))
            out.append(edit)
        elif hi > lo:
            mid = (lo + hi) // 2
            costs, ranks = forward(rows, lo, mid, state)
            rest = backward(rows, mid, hi, last)
            cross = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
            todo += [(mid, hi, cross, last), (lo, mid, state, ending(cross))]
    return "".join(out) + ("I" * TAIL[state] if end is None else "")


def replay(audit: str, roles: list[str], texts: list[str], rows: Classes, start: int = START) -> tuple[list[dict], int]:
    """Turns that the edits leave, and their cost."""
    state, at, cost, out = start, 0, 0, []
    for e in audit:
        if e == "I":
            state, cost = NEXT[state], cost + INSERT
            out.append({"role": ROLE[state], "text": ""})
            continue
        if e == "D":
            cost += DELETE
        else:
            state = NEXT[state] if e == "R" else KEPT[rows[at].rstrip(".")][state]
            cost += (RENAME if e == "R" else 0) + (CUT if rows[at].endswith(".") else 0)
            out.append({"role": ROLE[state] if e == "R" else roles[at], "text": texts[at]})
        at += 1
    return out, cost


def summary(rows: Classes) -> tuple[list[int], list[int]]:
    """A block's 16 costs from state to state, and for each start the ASCII order of the ends: blocks compose by these."""
    each = [forward(rows, 0, len(rows), s) for s in range(4)]
    return [c for costs, _ in each for c in costs], [r for _, ranks in each for r in ranks]


def crossings(blocks: list[tuple[list[int], list[int]]]) -> list[tuple[int, int | None]]:
    """Start and end state of every block of a conversation on its cheapest, ASCII-least edits; None ends the last."""
    rest = [list(ending(None))]
    for costs, _ in reversed(blocks):
        rest.append([min(costs[4 * s + t] + rest[-1][t] for t in range(4)) for s in range(4)])
    rest.reverse()
    state, out = START, []
    for k, (costs, ranks) in enumerate(blocks):
        to = min(range(4), key=lambda t: (min(costs[4 * state + t] + rest[k + 1][t], FAR), ranks[4 * state + t]))
        out.append((state, to if k < len(blocks) - 1 else None))
        state = to
    return out


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults planted by crc32("conv:turn") mod 20, and dropped for rows that are gone.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a
    user's. Null ids, turns, roles and texts count as one space.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))), F.lit(20))
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(word(text_col), ".!?", "")).otherwise(word(text_col))
    each = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(kind == 4, "user").otherwise(word(role_col)).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), kind.alias("kind"))
    return each.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


TURN_TYPE = "array<struct<role:string,text:string>>"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _classified(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column) -> DataFrame:
    """Rows with their class and faults. Repeats are numbered per role and text, whose groups spread over the tasks."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    each = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.coalesce(dropped, F.lit(False)).alias("dropped")
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")) > 1
    fault = F.when(F.col("dropped"), "-").when(blank, "b").when(F.col("again"), "d").when(cut, "t").otherwise("")
    return each.withColumn("again", seen).select("conv_id", "turn", "role", "text", "again", fault.alias("fault"))


class _Block:
    """Rows of one conversation as they come, in order."""

    def __init__(self, conv, first: int):
        self.conv, self.first = conv, first
        self.turns, self.roles, self.texts, self.faults, self.bytes = [], [], [], [], 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if fault != "-":
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.faults.append(fault)
            self.bytes += len(text)

    def full(self) -> bool:
        return len(self.turns) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES

    def classes(self) -> Classes:
        return ["x" if f in ("b", "d") else (r[:1] if r[:1] in KEPT else "") + ("." if f == "t" else "") for r, f in zip(self.roles, self.faults, strict=True)]

    def facts(self) -> dict:
        """Counts of the block, and what its neighbours need to count across."""
        known = [t for t in self.turns if t is not None]
        starts = [r[:1] for r in self.roles]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
        return {
            "n": len(self.turns), "blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"), "illegal": wrong,
            "low": known[0] if known else None, "high": known[-1] if known else None, "different": len(set(known)), "lead": starts[0] if starts else None, "trail": starts[-1] if starts else None,
        }


def _merged(facts: list[dict]) -> dict:
    """Counts of a conversation from those of its blocks, in order."""
    facts = [f for f in facts if f["n"]]
    known = [f for f in facts if f["low"] is not None]
    shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    across = sum(a["trail"] + b["lead"] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:], strict=False))
    total = lambda c: sum(f[c] for f in facts)
    gaps = known[-1]["high"] - known[0]["low"] + 1 - (sum(f["different"] for f in known) - shared) if known else 0
    return {"gaps": gaps, "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "illegal": total("illegal") + across}


_FACTS = {"n": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "low": pa.int64(), "high": pa.int64(), "different": pa.int64(), "lead": pa.string(), "trail": pa.string()}
_FACTS_SQL = "struct<n:long,blank:long,duplicate:long,truncated:long,illegal:long,low:long,high:long,different:long,lead:string,trail:string>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """Repaired conversations in pieces: conv_id, piece, whole, audit, repaired (array of role and text), cost, and counts.

    A conversation's rows are in order of turn (null first), role, text. The first fault of a row counts: blank, duplicate
    of an earlier row's role and text, truncated. Edits are those of the cheapest way to role initials `(s?(ua)+)?`: K keep,
    R new role, D delete, I insert, the ASCII-least audit of equal cost. gaps, blank, duplicate, truncated and illegal are
    given with a conversation's first piece and null in the others.

    Rows are dealt by ranges of (conversation, turn) and streamed in order. A conversation that lies within a task and is
    not long is solved there, as one whole piece. Others are cut into blocks (BLOCK_ROWS): small matrices of costs from
    state to state compose a conversation's blocks, which fixes the states where each begins and ends, and the blocks are
    solved apart. So no task gathers a conversation, however many rows it has; only rows of one turn of one conversation
    meet in one task, and are streamed there.

    Null roles and texts count as one space; null conversations form one of their own; a dropped row (dropped_col) only
    keeps its conversation in the result, whose audit is empty if nothing is left; repeated rows are duplicates; an empty
    table gives an empty result; other columns are not read.
    """
    dropped = F.col(dropped_col) if dropped_col else F.lit(False)
    rows = _classified(turns, conv_col, turn_col, role_col, text_col, dropped)
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, piece long, whole boolean, audit string, repaired {TURN_TYPE}, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
    raw = f", facts {_FACTS_SQL}, costs array<int>, ranks array<int>, turns_in {TURN_TYPE}, classes array<string>"

    def emit(out: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [("conv_id", conv_type), ("piece", pa.int64()), ("whole", pa.bool_()), ("audit", pa.string()), ("repaired", _TURNS), ("cost", pa.int64()), *((s, pa.int64()) for s in STATS)]
        kinds += [("facts", pa.struct(list(_FACTS.items()))), ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("turns_in", _TURNS), ("classes", pa.list_(pa.string()))]
        return pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    def finished(block: _Block) -> dict:
        classes = block.classes()
        audit = edits(classes)
        repaired, cost = replay(audit, block.roles, block.texts, classes)
        return {"conv_id": block.conv, "piece": block.first, "whole": True, "audit": audit, "repaired": repaired, "cost": cost, **_merged([block.facts()])}

    def waiting(block: _Block) -> dict:
        classes = block.classes()
        costs, ranks = summary(classes)
        kept = [{"role": r, "text": t} for r, t in zip(block.roles, block.texts, strict=True)]
        return {"conv_id": block.conv, "piece": block.first, "whole": False, "facts": block.facts(), "costs": costs, "ranks": ranks, "turns_in": kept, "classes": classes}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, alone, out, held, conv_type = TaskContext.get().partitionId() << 33, None, False, [], 0, None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for a in range(0, batch.num_rows, OUT_ROWS):
                for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.slice(a, OUT_ROWS).columns), strict=True):
                    if block is None or conv != block.conv:
                        if block is not None:
                            out.append(finished(block) if alone else waiting(block))
                        alone = block is not None  # the first conversation may have begun in another task
                        held += block.bytes if block is not None else 0
                        block = _Block(conv, at)
                    elif block.full():
                        out.append(waiting(block))
                        held += block.bytes
                        block, alone = _Block(conv, at), False
                    block.add(turn, role, text, fault)
                    at += 1
                    if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                        yield emit(out, conv_type)
                        out, held = [], 0
        if block is not None:
            yield emit([*out, waiting(block)], conv_type)  # the last one may go on in another task

    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text", "again").select("conv_id", "turn", "role", "text", "fault")
    cuts = staged(ordered.mapInArrow(cut, shape + raw), "conversation-blocks")
    done, open_ = cuts.where("whole"), cuts.where("not whole")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks in batch.column(0).to_pylist():
                total = _merged([b["facts"] for b in blocks])
                for k, (b, (start, end)) in enumerate(zip(blocks, crossings([(b["costs"], b["ranks"]) for b in blocks]), strict=True)):
                    out.append({"piece": b["piece"], "start": start, "end": end, **(total if k == 0 else {})})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("piece", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), *((s, pa.int64()) for s in STATS)]))

    per = open_.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "facts", "costs", "ranks"))).alias("blocks"))
    plan = per.select("blocks").mapInArrow(fold, "piece long, start int, end int, " + ", ".join(f"{s} long" for s in STATS))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                r = {n: c[a].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                audit = edits(r["classes"], r["start"], r["end"])
                repaired, cost = replay(audit, [t["role"] for t in r["turns_in"]], [t["text"] for t in r["turns_in"]], r["classes"], r["start"])
                row = {"conv_id": r["conv_id"], "piece": r["piece"], "whole": False, "audit": audit, "repaired": repaired, "cost": cost, **{s: r[s] for s in STATS}}
                yield emit([row], batch.schema.field("conv_id").type).select(range(11))

    solved = open_.select("conv_id", "piece", "turns_in", "classes").join(plan, "piece").select("conv_id", "piece", "turns_in", "classes", "start", "end", *STATS).mapInArrow(solve, shape)
    return done.select("conv_id", "piece", "whole", "audit", "repaired", "cost", *STATS).unionByName(solved)


def digest(pieces: DataFrame) -> DataFrame:
    """One row per conversation of repair(): conv_id, the counts, cost, audit and repaired_sha256 of its `role:text` lines.

    A whole conversation's row is made where it lies. Pieces of others are streamed in order and hashed as they pass.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    columns = ("conv_id", *STATS, "cost", "audit")
    whole = pieces.where("whole").select(*columns, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_type = None, None

        def row() -> pa.RecordBatch:
            kinds = [("conv_id", conv_type), *((s, pa.int64()) for s in STATS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
            return pa.RecordBatch.from_pylist([{**now["facts"], "conv_id": now["conv"], "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}], pa.schema(kinds))

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for a in range(batch.num_rows):
                r = {n: c[a].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if now is None or now["conv"] != r["conv_id"]:
                    if now is not None:
                        yield row()
                    now = {"conv": r["conv_id"], "facts": {s: r[s] for s in STATS}, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
                now["cost"] += r["cost"]
                now["audit"].append(r["audit"])
                if r["turns"]:
                    now["sha"].update((("\n" if now["any"] else "") + r["lines"]).encode())
                    now["any"] = True
        if now is not None:
            yield row()

    parts = pieces.where("not whole").select("conv_id", "piece", *STATS, "cost", "audit", F.size("repaired").alias("turns"), lines.alias("lines"))
    shape = f"conv_id {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", cost long, audit string, repaired_sha256 string"
    return whole.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(stream, shape))
