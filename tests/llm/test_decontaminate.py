import random

from hyperweave.llm import decontaminate as dc

from .helpers import empty, odd


def slow(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_recursion():
    r = random.Random(5)
    pairs = [([r.choice("abcd") for _ in range(r.randint(1, 12))], [r.choice("abcde") for _ in range(r.randint(1, 20))]) for _ in range(200)]
    assert dc.alignments(pairs) == [slow(a, b) for a, b in pairs]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_copies_are_found_and_clean_texts_left(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    item = say(40)
    edited = [w if k % 7 else "other" for k, w in enumerate(item)]
    docs = [
        (1, " ".join(say(300) + item + say(300))),
        (2, " ".join(say(50) + edited + say(50))),
        (3, " ".join(say(500))),
        (4, " ".join(item[:8] + say(200))),
        (5, None),
        (6, ""),
    ]
    docs += [(k, " ".join(item)) for k in range(10, 60)]  # a passage that is not rare at all
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, [(7, " ".join(item).upper(), 0), (8, None, 0), (9, "", 0), (7, " ".join(item), 1)]))
    got = {r.doc_id: r.score for r in found.collect()}
    assert set(got) == {1, 2, *range(10, 60)} and got[1] == 1.0 and got[2] < 1.0


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "beta alpha"), (3, "gamma")], "doc_id long, text string")
    found = dc.contaminated(docs, bench(spark, [(1, "Alpha beta", 0), (2, "gamma!", 0)]), threshold=1.0)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 2)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"p{k} q{k} r{k} s{k} t{k}") for k in range(20)], "doc_id long, text string")
    items = bench(spark, [(k, f"p{k} q{k} r{k} s{k} t{k}", 0) for k in range(20)])
    one = {tuple(r) for r in dc.contaminated(docs, items).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 800)
    assert {tuple(r) for r in dc.contaminated(docs, items).collect()} == one and len(one) == 20


def test_odd_rows(spark):
    items = bench(spark, [(1, "the same text here", 0)])
    assert sorted(r.doc_id for r in dc.contaminated(odd(spark), items).collect()) == [5, 6]
    left = dc.clean(odd(spark), items)
    assert left.columns == odd(spark).columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 4]
    assert dc.contaminated(empty(spark), items).count() == 0
    assert dc.contaminated(odd(spark), bench(spark, [])).count() == 0


def test_copies_count_however_many_documents_hold_them(spark):
    r = random.Random(8)
    item = [f"w{k}" for k in range(15)]
    edited = [w if k in (2, 3, 4, 7, 8, 11, 12, 14, 0, 6) else "other" for k, w in enumerate(item)]  # one trigram is left
    docs = [(k, "alpha beta gamma " + " ".join(f"n{r.randrange(999)}" for _ in range(20))) for k in range(60)]
    docs += [(k, " ".join(edited)) for k in range(60, 120)]
    docs += [(k, "w2 w3 w4 " + " ".join(f"n{r.randrange(999)}" for _ in range(20))) for k in range(120, 130)]
    items = bench(spark, [(1, "Alpha beta gamma", 0), (2, " ".join(item), 0)])
    found = {(x.doc_id, x.item_id): x.score for x in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items, threshold=0.4).collect()}
    whole, part = slow(["alpha", "beta", "gamma"], docs[0][1].split()) / 6, slow(item, edited) / 30
    assert whole == 1.0 and part >= 0.4
    assert found == {(k, 1): whole for k in range(60)} | {(k, 2): part for k in range(60, 120)}


def test_an_item_id_with_two_texts_is_matched_by_both(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight nine ten")], "doc_id long, text string")
    items = bench(spark, [(7, "one two three four five", 0), (7, "six seven eight nine ten", 0)])
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()} == {(1, 7), (2, 7)}


def test_no_alignment_beats_the_bound():
    r = random.Random(9)
    for _ in range(200):
        item, text = [r.choice("abcd") for _ in range(r.randint(1, 12))], [r.choice("abcde") for _ in range(r.randint(1, 20))]
        assert dc.Seeds([(1, " ".join(item))]).bound(0, text) >= slow(item, text) / (2 * len(item))


def test_pairs_equal_brute_force(spark):
    """Every pair that shares a trigram (or a short item's words) and scores enough, and no other."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    items = [(k, [r.choice(words) for _ in range(r.randint(1, 14))]) for k in range(40)]
    docs = []
    for d in range(120):
        text = [r.choice(words) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            _, own = r.choice(items)
            text += [w if r.random() < 0.8 else "x" for w in own if r.random() < 0.95] + [r.choice(words) for _ in range(4)]
        docs.append((d, text))
    runs = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    want = set()
    for d, text in docs:
        for i, own in items:
            n = min(3, len(own))
            if runs(text, n) & runs(own, n) and text and slow(own, text) / (2 * len(own)) >= dc.THRESHOLD:
                want.add((d, i))
    given = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(3)
    found = dc.contaminated(given, bench(spark, [(i, " ".join(t), 0) for i, t in items]))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    # A stretch of the document around the seeds is aligned, with the item's own length on both sides: what lies further adds nothing.
    assert got == want and len(want) > 40


def test_rows_without_an_id_or_with_a_shared_one(spark):
    item = "one two three four five six seven eight"
    rows = [(None, f"so it is {item}"), (4, item), (4, "something else that stays here"), (None, "clean text of its own")]
    left = dc.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, [(1, item, 0), (None, "clean text of its own", 0)]))
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == [(-1, rows[3][1]), (4, rows[2][1])]


def test_edited_copies_in_scripts_without_blanks(spark):
    r = random.Random(12)
    item = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(40))
    edited = "".join(c if k % 9 else "x" for k, c in enumerate(item))
    rows = [(1, "前" + edited + "后"), (2, item[::-1])]
    found = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, [(1, item, 0)]))
    assert [x.doc_id for x in found.collect()] == [1]
