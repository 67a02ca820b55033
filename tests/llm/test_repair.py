import hashlib
import itertools
import random
import re
import zlib

import pytest

from hyperweave.llm import repair
from hyperweave.llm.repair import ASSISTANT, NOTHING, Repaired, Row, Survivors

FORM = re.compile(r"(s?(ua)+)?\Z")
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def enumerated(rows):
    """The least (cost, audit) by trying all edits, with up to two inserts at every place."""
    best = None
    ways = []
    for r in rows:
        own = [("D", 2, None)]
        if r.fault not in (1, 2):
            more = 5 if r.fault == 3 else 0
            own += [("K", more, r.role[:1] or "?"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        ways.append([(i + e, c + 5 * len(i), said + ([x] if x else [])) for i, said in (("", []), ("I", ["u"]), ("I", ["a"]), ("II", ["u", "a"]), ("II", ["a", "u"])) for e, c, x in own])
    ends = [("", 0, []), ("I", 5, ["a"]), ("I", 5, ["u"]), ("II", 10, ["u", "a"])]
    for picked in itertools.product(*ways, ends):
        if FORM.match("".join(x for p in picked for x in p[2])):
            found = (sum(p[1] for p in picked), "".join(p[0] for p in picked))
            best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("seed", range(40))
def test_least_edits_equal_enumeration(seed):
    rng = random.Random(seed)
    rows = [Row(rng.choice(["user", "assistant", "system", "tool", ""]), "x.", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
    cost, audit, _ = repair.repair(rows)
    assert (cost, audit) == enumerated(rows)


def plain(rows):
    """(cost, audit, digest) by a search that keeps the whole edits of every state."""
    states = {NOTHING: (0, "")}
    for r in rows:
        new = {}
        kind = r.role[:1] if r.role[:1] in ("s", "u", "a") else ""
        for p, (c, edits) in states.items():
            for e, more, q in repair.STEPS[p, kind, r.fault]:
                new[q] = min(new.get(q, (10**9, "")), (c + more, edits + e))
        states = new
    cost, audit = min((c + 5 * repair.FINISH[q], e + "I" * repair.FINISH[q]) for q, (c, e) in states.items())
    out, n, state = [], 0, NOTHING
    for e in audit:
        row = None if e == "I" else rows[n]
        n += e != "I"
        if e != "D":
            to, role = repair.NEXT_ROLE[state]
            if e == "K":
                to, role = repair.ACCEPTS[state][row.role[:1]], row.role
            state = to
            out.append(f"{role}:{row.text if row else ''}")
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(rows):
    """All columns for (conv_id, turn, role, text) rows, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        hurt.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, own = set(), []
        for _, role, text in hurt:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            own.append(Row(role, text, 1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3))
            seen.add((role, text))
        turns = {t for t, _, _ in hurt if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r.role[:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, gaps, *[sum(r.fault == f for r in own) for f in (1, 2, 3)], illegal, *plain(own))
    return out


def found(df):
    return {r.conv_id: tuple(r[c] for c in COLS) for r in df.collect()}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 5, "tool", "x" * 300_000), (None, 3, "user", "Hi."), (None, None, "assistant", "Yes!")]
    rows += [(2, k, ("user", "assistant")[k % 2], f"text {k}.") for k in range(9)] + [(3, 1, "system", "\n\t ")] * 4
    rows += [(4, t, "user", "far.") for t in (-(1 << 62), 1 << 62)] + [(c, 0, "", "é?") for c in range(100, 160)] + [((1 << 62) + 1, 1, "user", "a?"), ((1 << 62) + 1, 2, "assistant", "b?")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    assert found(repair.repaired(df)) == brute(rows)
    assert repair.repaired(df.limit(0)).collect() == []


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(3)
    says = ["Yes.", "No!", "", "   ", "cut short", "Why?", "Go on.", "So it is."]
    rows = [(7, t // 2, rng.choice(["user", "user", "assistant", "assistant", "system"]), rng.choice(says) if rng.random() < 0.5 else f"{t}.") for t in range(700)]
    rows += [(c, t, "user", f"{t} and {c}.") for c in (6, 8) for t in range(5)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert found(repair.repaired(df)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeats_far_apart_are_duplicates_and_undamaged_rows_can_be_repaired(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "assistant", "Ho."), (1, 3, "user", "Hi."), (1, 4, "assistant", "Ha.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = repair.repaired(df, damage=False).collect()
    assert (r.duplicate, r.cost, r.audit) == (1, 4, "KDDK")


def test_memory_holds_the_unresolved_only():
    emitted = []
    tree = Survivors(NOTHING, lambda e, row: emitted.append(e))
    most = 0
    for k in range(20_000):
        tree.read(Row(("user", "assistant")[k % 2], "x.", 0))
        most = max(most, tree.unresolved())
    assert most < 12 and len(emitted) > 19_990


def test_all_deleted_coalesces_and_a_long_tie_is_compared_whole():
    tree = Survivors(NOTHING, lambda e, row: None)
    for _ in range(500):
        tree.read(Row("user", "", 1))
        assert tree.unresolved() < 12
    rows = [Row("user", f"{k}.", 0) for k in range(801)]
    assert repair.repair(rows) == plain(rows)


def test_final_edits_start_from_the_state_given():
    said = []
    edits = Repaired(ASSISTANT, said.append)
    for e, role in (("K", "user"), ("IR", "x")):
        edits(e, Row(role, "t", 0))
    assert said == ["user:t", "assistant:", "user:t"]
