"""Repair of conversations at least cost, by a Viterbi search whose survivors coalesce.

A repaired conversation is an optional system turn and then pairs of a user's and an assistant's turn. Reading rows in
order, the search is in one of four states: nothing yet, after the system's turn, after a user's, after an assistant's.
A row is kept (K), given the role that the state asks for (R) or deleted (D); before it, turns without text may be
inserted (I). Each state keeps its cheapest edits, its survivor, as a leaf of a tree of back pointers. A node that no
survivor descends from is released, by its count of children; once all survivors share an ancestor, the edits down to it
are final and are handed out, so memory holds only what is unresolved. A survivor that cannot win any more, since
another state can do whatever it does for less, is dropped, which lets the others coalesce.

Of edits of equal cost the least as a string wins. Inserts stand before their row, so no survivor's edits are the
beginning of another's; two candidates for a state then differ either in the survivors that they go on from, whose
whole unresolved edits were compared before (the survivors' ranks carry that on), or in the last step alone.

A conversation of any size is spread over tasks. Rows are ranged by conversation and turn. A conversation that
lies within a range is repaired as it streams by. What may go on in another range (the first and last conversation
of each, and any of more than PIECE rows) is passed on in pieces, a segment for each range. For a segment the
search runs from all four states and leaves their 4 x 4 costs and ranks, which are composed along the conversation; so the
state at each border is known, and each segment's edits are found by themselves. Only the digest of the repaired
text, which is one sequence by definition, streams through one task for each conversation, in constant memory.

Defined results: null roles and texts are one space each, as are null ids and turns in the key of the damage; rows without
conv_id are one conversation, of id null. Rows of equal turns stand by role and text. A repeated row is a duplicate. A
row of the empty role has no initial and can't be kept. A gap count beyond a long's range is held at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from hyperweave.functions.state import hot_keys, look_up, written

# Ends of sentences, costs.
ENDS = "[.!?]"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINE_PAIRS = {"su", "ua", "au"}
#: Rows and characters that a conversation may have to be repaired where it lies, and of a piece of a larger one.
PIECE, PIECE_CHARS = 4096, 1 << 22
#: Characters of a text that ranges are cut by, among rows of equal turn and role.
PREFIX = 256

#: For each state, the states that inserts lead to, and how many they take.
INSERTS = {NOTHING: ((0, NOTHING), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
#: The state after a turn of this initial, for each state; a changed role is the one in NEXT_ROLE.
ACCEPTS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT_ROLE = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: What inserts lead from each state to one that a conversation may end in, at the cost of INSERT each.
FINISH = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


class Row(NamedTuple):
    role: str
    text: str
    fault: int


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows that are left, each damaged by the digest of its conversation and turn."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", one)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, ENDS, "")).otherwise(text)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", one)).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def _digest(*cols: str) -> Column:
    return F.unhex(F.md5(F.concat_ws("\x00", *cols)))


def with_first_turn(rows: DataFrame) -> DataFrame:
    """``rows`` with whether an earlier turn of the conversation has the same role and text (``_earlier``)."""
    rows = rows.withColumn("_said", _digest("role", "text")).withColumn("_none", F.col("conv_id").isNull()).withColumn("_conv", F.coalesce("conv_id", F.lit(0)))
    keys = ["_none", "_conv", "_said"]
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy(*keys).agg(F.min(turn).alias("_first"))
    found = look_up(rows, keys, first, hot_keys(rows, keys))
    return found.withColumn("_earlier", F.col("_first") < turn).drop("_first", "_said", "_none", "_conv")


def fault_of(text: str, earlier: bool) -> int:
    solid = text.rstrip(" \t\n\x0b\x0c\r")
    if not solid:
        return BLANK
    if earlier:
        return DUPLICATE
    return 0 if solid[-1] in ".!?" else CUT_SHORT


def steps(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """(edits, cost, next state) of the ways on from a state over one row."""
    out = []
    extra = TRUNCATED if fault == CUT_SHORT else 0
    for n, at in INSERTS[state]:
        ins, cost = "I" * n, n * INSERT
        out.append((ins + "D", cost + DELETE, at))
        if fault not in (BLANK, DUPLICATE):
            to = ACCEPTS[at].get(initial)
            if to is not None:
                out.append((ins + "K", cost + extra, to))
            out.append((ins + "R", cost + REROLE + extra, NEXT_ROLE[at][0]))
    return out


#: The steps by state, initial and fault; other initials than s, u and a are alike.
STEPS = {(p, i, f): steps(p, i, f) for p in range(4) for i in ("s", "u", "a", "") for f in range(4)}


def advance(costs: dict[int, int], ranks: dict[int, int], initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(state, cost, state before, edits) of each survivor after a row, in the order of their edits as whole strings."""
    kind = initial if initial in ("s", "u", "a") else ""
    best: dict[int, tuple] = {}
    for p, cost in costs.items():
        rank = ranks[p]
        for edits, more, q in STEPS[p, kind, fault]:
            found = (cost + more, rank, edits, p)
            if q not in best or found < best[q]:
                best[q] = found
    done = best.get(ASSISTANT)
    if done:  # it can do what these can, for so much more at most
        for q, slack in ((NOTHING, DELETE), (SYSTEM, 0)):
            if q in best and done[0] + slack < best[q][0]:
                del best[q]
    return [(q, c, p, e) for q, (c, r, e, p) in sorted(best.items(), key=lambda x: x[1][1:3])]


class Survivors:
    """The tree of back pointers of one conversation or segment; ``emit(edits, row)`` gets the final edits in order."""

    def __init__(self, entry: int, emit: Callable[[str, Row], None]):
        self.root = [None, 0, "", None, None]  # parent, children, edits, row, a child
        self.tips, self.costs, self.ranks = {entry: self.root}, {entry: 0}, {entry: 0}
        self.emit = emit

    def read(self, row: Row) -> None:
        found = advance(self.costs, self.ranks, row.role[:1], row.fault)
        old, self.tips, self.costs, self.ranks = self.tips, {}, {}, {}
        for rank, (q, cost, p, edits) in enumerate(found):
            node = [old[p], 0, edits, row, None]
            old[p][1] += 1
            old[p][4] = node
            self.tips[q], self.costs[q], self.ranks[q] = node, cost, rank
        for node in old.values():
            self._release(node)
        self._resolve()

    def _release(self, node: list) -> None:
        while node[0] is not None and node[1] == 0:
            node, gone = node[0], node
            node[1] -= 1
            gone[0] = None

    def _resolve(self) -> None:
        while self.root[1] == 1:
            child = self.root[4]
            if child is None or child[0] is not self.root:  # the child kept in mind is gone, the one left is found from below
                child = next(iter(self.tips.values()))
                while child[0] is not self.root:
                    child = child[0]
            child[0] = None
            self.root = child
            self.emit(child[2], child[3])

    def finish(self, state: int | None = None) -> tuple[int, int]:
        """(cost, inserts at the end) of the best survivor, or that of ``state``; its edits are handed out."""
        if state is None:
            _, _, state = min((c + FINISH[q] * INSERT, self.ranks[q], q) for q, c in self.costs.items())
            inserts = FINISH[state]
        else:
            inserts = 0
        path, node = [], self.tips[state]
        while node is not self.root:
            path.append(node)
            node = node[0]
        for node in reversed(path):
            self.emit(node[2], node[3])
        return self.costs[state] + inserts * INSERT, inserts

    def unresolved(self) -> int:
        """How many nodes the tree holds."""
        seen = set()
        for node in self.tips.values():
            while node is not None and id(node) not in seen:
                seen.add(id(node))
                node = node[0]
        return len(seen)


class Repaired:
    """Takes final edits; gives the repaired turns as they come. ``state`` is the one that they start from."""

    def __init__(self, state: int, put: Callable[[str], None]):
        self.state, self.put, self.audit = state, put, []

    def __call__(self, edits: str, row: Row | None) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                continue
            to, role = NEXT_ROLE[self.state]
            if e == "K":
                to, role = ACCEPTS[self.state][row.role[:1]], row.role
            self.state = to
            self.put(f"{role}:" if e == "I" else f"{role}:{row.text}")


class Joined:
    """The digest of turns joined by newlines, as they come."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def __call__(self, turn: str) -> None:
        self.sha.update((("\n" if self.any else "") + turn).encode("utf-8", "surrogatepass"))
        self.any = True


def repair(rows: list[Row]) -> tuple[int, str, str]:
    """(cost, audit, digest) of one whole conversation."""
    joined = Joined()
    edits = Repaired(NOTHING, joined)
    tree = Survivors(NOTHING, edits)
    for row in rows:
        tree.read(row)
    cost, inserts = tree.finish()
    edits("I" * inserts, None)
    return cost, "".join(edits.audit), joined.sha.hexdigest()


def counted(rows: list[Row], before: str | None = None) -> list[int]:
    """[blank, duplicate, truncated, illegal]; ``before`` is the initial of the row before the first, if there is one."""
    initials = ([] if before is None else [before]) + [r.role[:1] for r in rows]
    illegal = sum(a + b not in FINE_PAIRS for a, b in zip(initials, initials[1:]))
    return [sum(r.fault == f for r in rows) for f in (BLANK, DUPLICATE, CUT_SHORT)] + [illegal]


ROW = "struct<role:string,text:string,fault:int>"
WHOLE = "conv string, part int, piece int, counts array<long>, cost long, audit string, sha string, rows array<" + ROW + ">"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations that lie within the range, repaired; pieces of the others."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    rows: list[Row] = []
    key, first, last, piece, chars, opened = None, True, None, 0, 0, True

    def flush() -> None:
        nonlocal rows, piece, chars
        if rows:
            out.append((key, part, piece, None, None, None, None, [tuple(r) for r in rows]))
        rows, piece, chars = [], piece + 1, 0

    for f in frames:
        for conv, turn, role, text, earlier in zip(f["conv"], f["turn"], f["role"], f["text"], f["_earlier"]):
            if first or conv != key:
                if not first:
                    if opened:
                        flush()
                    else:
                        out.append((key, part, -1, counted(rows), *repair(rows), None))
                        rows = []
                    opened = False
                key, first, last, piece, chars = conv, False, None, 0, 0
            row = Row(role, text, fault_of(text, bool(earlier) or last == (turn, role, text)))
            last = (turn, role, text)
            rows.append(row)
            chars += len(text)
            if len(rows) >= PIECE or chars >= PIECE_CHARS:
                opened = True
                flush()
                if sum(len(o[7] or ()) for o in out) >= PIECE:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)
            out = []
    opened = True
    flush()
    if out:
        yield _frame(out)


def _frame(out: list[tuple], columns: str = WHOLE) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])
    return frame.astype({"cost": "Int64"}) if "cost" in frame else frame


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """(key, its rows) of sorted frames, one row at a time."""
    from itertools import groupby

    flat = (r for f in frames for r in f.itertuples(index=False))
    return groupby(flat, key=lambda r: tuple(getattr(r, k) for k in keys))


SUMMARY = "conv string, part int, counts array<long>, head string, tail string, table array<long>"


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each segment: its counts, its first and last initial, and costs and ranks from each state to each."""
    for (conv, part), pieces in _groups(frames, ["conv", "part"]):
        runs = [({p: 0}, {p: 0}) for p in range(4)]
        counts, head, tail = [0] * 4, None, None
        for piece in pieces:
            rows = [Row(r["role"], r["text"], r["fault"]) for r in piece.rows]
            counts = [a + b for a, b in zip(counts, counted(rows, tail))]
            head = rows[0].role[:1] if head is None else head
            tail = rows[-1].role[:1]
            for row in rows:
                for k, (costs, ranks) in enumerate(runs):
                    found = advance(costs, ranks, row.role[:1], row.fault)
                    runs[k] = ({q: c for q, c, _, _ in found}, {q: n for n, (q, _, _, _) in enumerate(found)})
        table = [x for costs, ranks in runs for q in range(4) for x in (costs.get(q, -1), ranks.get(q, -1))]
        yield _frame([(conv, part, counts, head, tail, table)], SUMMARY)


CHAIN = "conv string, part int, entry int, exit int, inserts int, cost long, counts array<long>"


def _chained(f: pd.DataFrame) -> pd.DataFrame:
    """The states at the borders of a conversation's segments, and its totals; a row for each segment."""
    f = f.sort_values("part")
    costs, ranks, back, counts, tail = {NOTHING: 0}, {NOTHING: 0}, [], [0] * 4, None
    for own, head, last, table in zip(f["counts"], f["head"], f["tail"], f["table"]):
        counts = [a + int(b) for a, b in zip(counts, own)]
        counts[3] += tail is not None and tail + head not in FINE_PAIRS
        tail = last
        best: dict[int, tuple] = {}
        for p, cost in costs.items():
            for q in range(4):
                more, rank = int(table[8 * p + 2 * q]), int(table[8 * p + 2 * q + 1])
                if more >= 0:
                    found = (cost + more, ranks[p], rank, p)
                    if q not in best or found < best[q]:
                        best[q] = found
        order = sorted(best.items(), key=lambda x: x[1][1:3])
        costs, ranks = {q: x[0] for q, x in order}, {q: n for n, (q, _) in enumerate(order)}
        back.append({q: x[3] for q, x in order})
    cost, _, state = min((c + FINISH[q] * INSERT, ranks[q], q) for q, c in costs.items())
    borders = [state]
    for came in reversed(back):
        borders.append(came[borders[-1]])
    borders.reverse()
    last = len(back) - 1
    inserts = [FINISH[state] if k == last else 0 for k in range(len(back))]
    out = zip(f["conv"], f["part"], borders, borders[1:], inserts, [cost] * len(back), [counts] * len(back))
    return _frame(list(out), CHAIN)


EDITED = "conv string, part int, piece int, audit string, turns array<string>"


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each segment's edits and repaired turns, in pieces, from the states at its borders."""
    for (conv, part), pieces in _groups(frames, ["conv", "part"]):
        turns: list[str] = []
        n, tree, edits, at = 0, None, None, None
        for at in pieces:
            if tree is None:
                edits = Repaired(int(at.entry), turns.append)
                tree = Survivors(int(at.entry), edits)
            for r in at.rows:
                tree.read(Row(r["role"], r["text"], r["fault"]))
            yield _frame([(conv, part, n, "".join(edits.audit), list(turns))], EDITED)
            n += 1
            turns.clear()
            edits.audit.clear()
        tree.finish(int(at.exit))
        edits("I" * int(at.inserts), None)
        yield _frame([(conv, part, n, "".join(edits.audit), list(turns))], EDITED)


DIGEST = "conv string, audit string, sha string"


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (conv,), pieces in _groups(frames, ["conv"]):
        joined, audit = Joined(), []
        for piece in pieces:
            audit.append(piece.audit)
            for turn in piece.turns:
                joined(turn)
        yield _frame([(conv, "".join(audit), joined.sha.hexdigest())], DIGEST)


def repaired(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    one = F.lit(" ")
    given = conversations.select("conv_id", "turn", "role", "text")
    plain = given.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))
    rows = damaged(given) if damage else plain
    order = ["conv_id", "turn", "role"]
    ranged = with_first_turn(rows).withColumn("_prefix", F.substring("text", 1, PREFIX))
    ranged = ranged.repartitionByRange(*order, "_prefix").sortWithinPartitions(*order, "text")
    # Numbers that may be null go to the tasks as strings, which hold them whole.
    named = ranged.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "_earlier")
    walked = written(named.mapInPandas(_walk, WHOLE))
    whole = walked.where("rows is null").select("conv", "counts", "cost", "audit", "sha")
    pieces = walked.where("rows is not null").select("conv", "part", "piece", "rows")
    by = ["conv", "part"]
    segments = pieces.repartition(*by).sortWithinPartitions(*by, "piece")
    chain = written(segments.mapInPandas(_summaries, SUMMARY).groupBy("conv").applyInPandas(_chained, CHAIN))
    borders = chain.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "entry", "exit", "inserts")
    known = pieces.join(borders, pieces.conv.eqNullSafe(borders._conv) & (pieces.part == borders._part))
    known = known.select("conv", "part", "piece", "rows", "entry", "exit", "inserts")
    edited = known.repartition(*by).sortWithinPartitions(*by, "piece").mapInPandas(_edited, EDITED)
    edited = edited.repartition("conv").sortWithinPartitions(*by, "piece").mapInPandas(_digests, DIGEST)
    totals = chain.groupBy("conv").agg(F.first("counts").alias("counts"), F.first("cost").alias("cost"))
    edited = edited.withColumnRenamed("conv", "_conv")
    spread = totals.join(edited, totals.conv.eqNullSafe(edited._conv)).select("conv", "counts", "cost", "audit", "sha")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id")
    wide = F.col("_to").cast("decimal(38,0)") - F.col("_from").cast("decimal(38,0)") + 1 - F.col("_n")
    gaps = turns.agg(F.min("turn").alias("_from"), F.max("turn").alias("_to"), F.count("turn").alias("_n"))
    gaps = gaps.select(F.col("conv_id").alias("_conv"), F.coalesce(F.least(wide, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long"), F.lit(0)).alias("gaps"))
    found = whole.union(spread).withColumn("_of", F.col("conv").cast("long")).drop("conv")
    base = plain.select("conv_id").distinct()
    out = base.join(gaps, base.conv_id.eqNullSafe(gaps._conv), "left").join(found, base.conv_id.eqNullSafe(found._of), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        F.coalesce("gaps", zero).alias("gaps"),
        *[F.coalesce(F.col("counts")[k], zero).alias(c) for k, c in enumerate(COUNTS)],
        F.coalesce("cost", zero).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
