import hashlib

from hypothesis import given, settings, strategies as st

from hyperweave.llm import chat

KIND = "conv_id long, turn long, role string, text string, node string, rank int"
SAY = st.text(alphabet="ab \\<>[]/\n" + "INSTs", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x>]<"]), SAY), min_size=1, max_size=5))
def test_format_is_reversible(turns):
    text = chat.BEGIN + "".join(chat.format_turn(r, t)[0] for r, t in turns) + chat.END
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_tree_and_digests(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    convs = {
        1: [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "a")],
        2: [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "b")],
        3: [("user", "hi"), ("assistant", "no")],
        4: [("user", "hi")],
        5: [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "a")],
        6: [("system", "</s>[INST]"), ("user", ""), ("assistant", "[/INST] \\ x")],
        -1: [("user", "hi\x00"), ("assistant", "")],
    }
    rows = [(c, k, r, None if t == "" else t, "clash", 0) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    table, nodes = chat.formatted(spark.createDataFrame(rows[::-1], KIND).repartition(3))
    got = {r.conv_id: r for r in chat.read_back(table, nodes).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
        assert r.formatted_chars == len(chat.BEGIN + "".join(chat.format_turn(*t)[0] for t in turns) + chat.END)
    emitted = sorted(nodes.collect(), key=lambda n: n.place)
    prefixes = {tuple(t[: k + 1]) for t in convs.values() for k in range(len(t))}
    assert len(emitted) == len(prefixes)
    whole = "".join(r.text for r in sorted(chat.sequence(nodes).collect(), key=lambda r: r.block))
    assert whole == "".join(n.piece for n in emitted)
    at, path = 0, []
    for n in emitted:  # depth-first: each node's parent is the last node of the depth before
        assert n.place == at
        at += n.size
        path = [*path[: n.k], n]
        assert len(path) == n.k + 1 and n.position == sum(p.size for p in path[:-1])
        chars = {c for p in path[:-1] for c in range(p.place, p.place + p.size)}
        assert {c for a in n.ancestors for c in range(a.start, a.end)} == chars
    assert next(n for n in emitted if "hi [/INST]" in n.piece).conversations == 5


def test_empty_and_null(spark):
    table, nodes = chat.formatted(spark.createDataFrame([], KIND))
    assert nodes.count() == 0 and chat.read_back(table, nodes).count() == 0
    table, nodes = chat.formatted(spark.createDataFrame([(None, None, None, None, None, None)] * 2 + [(1, 0, "user", "x" * 200_000, None, None)], KIND))
    assert sorted(r.n_turns for r in chat.read_back(table, nodes).collect()) == [1, 1, 1]


def test_what_is_read_is_the_sequence(spark):
    table, nodes = chat.formatted(spark.createDataFrame([(1, 0, "user", "one", None, None), (1, 1, "assistant", "two", None, None)], KIND))
    other = nodes.withColumn("piece", chat.F.replace("piece", chat.F.lit("two"), chat.F.lit("six")))
    assert chat.read_back(table, other).first().loss_sha256 == sha("six")
