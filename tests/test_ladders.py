"""Ladders against what they promise."""

from hyperweave.operators.ladders import ladder

from .test_corruptions import made


def connected(facts) -> bool:
    left = {v for _, m in facts for v in m}
    reached = {min(left)}
    while more := {v for _, m in facts if reached & set(m) for v in m} - reached:
        reached |= more
    return reached == left


def test_rungs_lead_away_over_the_same_constants(spark):
    records = made(15, 8)
    rows = [(hg, e, v, p) for hg, facts in records.items() for e, (p, m) in facts.items() for v in m]
    inc = spark.createDataFrame(rows * 2 + [(None, 1, 1, "a")], "hg long, e int, v long, pred string")
    got: dict = {}
    for r in ladder(inc, 2, 3).collect():
        assert r.delta == r.t
        got.setdefault(r.hg, {}).setdefault(r.t, {}).setdefault((r.op, r.e, r.pred), set()).add(r.v)
    ops = set()
    for hg, steps in got.items():
        base = set(records[hg].values())
        last = base
        assert sorted(steps) == list(range(1, len(steps) + 1))
        for t in sorted(steps):
            facts = {(p, tuple(sorted(m))) for (_, _, p), m in steps[t].items()}
            assert len(facts) == len(steps[t])
            (op,) = {op for op, _, _ in steps[t]}
            ops.add(op)
            assert len(facts) - len(last) == (1 if op == "ins" else -1)
            assert len(facts ^ last) == 1 and len(facts ^ base) == t
            assert {v for _, m in facts for v in m} == {v for _, m in base for v in m} and connected(facts)
            last = facts
    assert ops == {"ins", "del"} and len(got) >= 8 and 100 not in got
    assert ladder(inc.limit(0), 1, 3).count() == 0
