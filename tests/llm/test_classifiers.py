import itertools
import zlib

import numpy as np
import pytest

from hyperweave.llm import common, langid, quality, toxicity

from .helpers import empty, odd

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held(doc_id, parts, which):
    return zlib.crc32(str(doc_id).encode()) % parts == which


def accuracy(rows, labels, parts, which, cut):
    both = [(r.score >= cut, labels[r.doc_id]) for r in rows if r.doc_id in labels and held(r.doc_id, parts, which)]
    assert len(both) > 50
    return np.mean([a == bool(b) for a, b in both])


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert accuracy(quality.scored(docs, quality.fit(docs, labels)).collect(), truth, 4, 2, quality.CUT) > 0.95


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert accuracy(toxicity.scored(docs, toxicity.fit(docs, labels)).collect(), truth, 5, 0, 0.5) > 0.9


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    model = langid.fit(langid.train_rows(docs))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    own = [(got[r.doc_id], r.lang) for r in docs.select("doc_id", "lang").collect() if held(r.doc_id, 4, 2)]
    assert np.mean([a == b for a, b in own]) > 0.98


def test_forward_backward_equals_enumeration():
    m = quality.QualityModel()
    r = np.random.default_rng(1)
    x, doc = r.normal(size=(9, 3)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    m.weights, m.moves = r.normal(size=3), r.normal(size=(2, 2))
    p, pairs = m.marginals(x, doc, 3)
    want, seen = np.zeros(9), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, good, moves = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(x[i] @ m.weights for i, k in zip(at, y) if k) + sum(m.moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        want[at] = good / total
        seen += moves / total
    assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 0, 2, 2, 3])
    scores = r.normal(size=(7, 3)) * 3
    got = langid.viterbi(scores, doc, 4, 1.5)
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        value = lambda y: sum(scores[i, k] for i, k in zip(at, y)) - 1.5 * sum(a != b for a, b in zip(y, y[1:]))
        assert tuple(got[at]) == max(itertools.product(range(3), repeat=len(at)), key=value)


def test_spans_of_mixed_text_and_scripts():
    rows = [("the cat and the dog with this that", "en"), ("der hund und die katze mit nicht", "de"), ("кот и собака это все", "ru")] * 5
    m = langid.LanguageModel(rows)
    text = "the dog and the cat with that this собака и кот это все the"
    spans = m.spans(text)
    assert [s[2] for s in spans][:2] == ["en", "ru"] and text[spans[0][0] : spans[0][1]] == "the dog and the cat with that this"
    texts = [None, "", "123 !!", "и", "\U0001f600 \U0001f44d", "\u0301\u0302 1", "e\u0301 the \U0001f600", "\U00010400 the"]
    assert m.predict(texts)[0] == ["und", "und", "und", "ru", "und", "und", "en", "en"]


def test_texts_score_alike_alone_and_together():
    texts = ["One line here.\nTwo!! BAD!! CAPS!!", "", "x", "a | b | c\n\n", "Fine text, with a stop.\n" * 50]
    m = quality.QualityModel()
    m.train([(t, k % 2) for k, t in enumerate(texts * 3)])
    assert np.allclose(m.score(texts), [m.score([t])[0] for t in texts])
    t = toxicity.ToxicityModel()
    assert np.allclose(t.score(texts), [t.score([x])[0] for x in texts], atol=1e-5)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (5, 1, 0), (5, 1, 0), (None, 1, 1), (6, None, None), (3, 0, 1)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for lab in (labels, none):
        q, t = quality.fit(odd(spark), lab), toxicity.fit(odd(spark), lab)
        for got in (quality.scored(odd(spark), q).collect(), toxicity.scored(odd(spark), t).collect()):
            assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.accepted(odd(spark), t).columns == odd(spark).columns
    assert quality.scored(empty(spark), quality.fit(empty(spark), none)).count() == 0
    m = langid.fit(odd(spark))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd(spark), m).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == ("en", 1.0)
    assert sorted(r.doc_id or -1 for r in langid.known(odd(spark), m).collect()) == [-1, 4, 5, 5, 6]
    assert langid.identify(odd(spark), langid.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0


def test_no_language_learned_keeps_all_documents(spark):
    assert langid.known(odd(spark), langid.fit(empty(spark))).count() == odd(spark).count() > 0


def test_more_languages_than_a_byte_counts():
    r = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 9)) for _ in range(200 * 12)]
    rows = [(" ".join(words[12 * k : 12 * k + 12] * 3), f"l{k:03d}") for k in range(200)]
    model = langid.LanguageModel(rows)
    assert model.predict([t for t, _ in rows])[0] == [lang for _, lang in rows]


def test_convolution_and_pooling_equal_naive_loops():
    m = toxicity.ToxicityModel()
    r = np.random.default_rng(3)
    for p in (m.emb, *m.conv, m.bias, m.top):
        p[...] = r.normal(size=p.shape) * 0.3
    m.emb[0] = 0
    texts = ["one", "a b c d e f g", "", "the quick brown fox jumps over the lazy dog " * 3]
    got = m.margin(texts)
    widest = max(toxicity.WIDTHS)
    for text, margin in zip(texts, got):
        words, windows = toxicity.padded(*toxicity.word_buckets([text]), 1)
        vectors = [sum(m.emb[b].astype(float) for b in word) for word in words]
        total = float(m.cut)
        for i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = [sum(float(vectors[p + j] @ m.conv[i][j][:, f]) for j in range(w)) for p in range(windows[0][0], min(windows[0][1], len(vectors) - widest + 1))]
                total += max(0.0, max(at) + float(m.bias[i * toxicity.FILTERS + f])) * float(m.top[i * toxicity.FILTERS + f])
        assert margin == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_a_long_text_is_labelled_alike_in_bounded_memory(monkeypatch):
    words = {"aa": "blau gelb rot haus", "bb": "house green river stone", "cc": "maison verte pierre eau"}
    m = langid.LanguageModel([(w * 5, k) for k, w in words.items()])
    r = np.random.default_rng(5)
    text = " ".join(" ".join(r.choice(list(words.values())).split()) for _ in range(400))
    whole = m._label([text])[0]
    assert len(set(whole)) == 3
    monkeypatch.setattr(langid, "SLICE", 100)
    assert (m._long(text)[0] == whole).all()
    monkeypatch.setattr(langid, "GROUP", 100)
    assert (m._label([text])[0] == whole).all()
    assert m.predict([text, "", None])[0][1:] == ["und", "und"]


def test_every_language_is_learned_however_small_or_long_its_texts(spark):
    rows = [(k, "the common language of most of the rows " * 20, "en") for k in range(300)]
    rows += [(1000, "ein kleiner satz", "de"), (1001, "une phrase tres longue " * 5000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).langs == ["de", "en", "fr"]


def clumsy(n, words=3):
    """(documents, labels) of n short and n long texts; those with an odd id are toxic by one word, far inside."""
    r = np.random.default_rng(4)
    calm = [f"calm{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8)]
    docs, labels = [], []
    for k in range(2 * n):
        own = list(r.choice(calm, words if k < n else 1500))
        own.insert(len(own) // 2, "vilest" if k % 2 else "gentle")
        docs.append((k, " ".join(own), "en" if k % 3 else "de"))
        labels.append((k, 1, k % 2))
    return docs, labels


def right(spark, docs, labels):
    truth = {k: y for k, _, y in labels}
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    return np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got])


def test_toxicity_learns_from_long_texts_too(spark):
    docs, labels = clumsy(60)
    assert min(len(t) for _, t, _ in docs[60:]) > 9000
    assert right(spark, docs[60:], labels[60:]) == 1.0


def test_toxicity_learns_from_all_labelled_rows_in_many_tasks(spark, monkeypatch):
    docs, labels = clumsy(200)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 80)
    for most in (common.BROADCAST_IDS, 0):  # labels are broadcast, or texts dealt out by id
        monkeypatch.setattr(common, "BROADCAST_IDS", most)
        frames = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)
        rows = common.labelled_rows(*frames, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.SHARD_ROWS)
        assert rows.rdd.getNumPartitions() > 3
        assert {(r._id, r.label, r.text) for r in rows.collect()} == {(k, k % 2, t) for k, t, _ in docs if not held(k, 5, 0)}
    assert right(spark, docs, labels) > 0.98


def test_thresholds_have_the_fewest_errors(spark):
    r = np.random.default_rng(6)
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]
    rows = [(k, int(r.random() < 0.4), " ".join(r.choice(words, 4))) for k in range(300)]
    m = toxicity.ToxicityModel()
    margin, y = m.margin([t for _, _, t in rows]), np.array([y for _, y, _ in rows])
    near = np.unique(margin.astype(float))
    tries = np.concatenate(([near[0] - 1], (near[1:] + near[:-1]) / 2, [near[-1] + 1]))
    wrong = np.array([((margin >= t) & (y == 0)).sum() + ((margin < t) & (y == 1)).sum() for t in tries])
    found = toxicity._thresholds(m, spark.createDataFrame(rows, "_id long, label int, text string").repartition(3))
    assert np.abs(found[0] - tries[wrong == wrong.min()]).min() < 1e-4
    one = toxicity._thresholds(m, spark.createDataFrame(rows[:1], "_id long, label int, text string"))
    assert one.tolist() == [0.0]


def test_windows_of_blocks_are_those_of_whole_texts(monkeypatch):
    m = toxicity.ToxicityModel()
    words, windows = toxicity.padded(*toxicity.word_buckets(["a b c d e f g h i j k", "", " ".join(f"w{chr(97 + k)}" for k in range(26)), "x"]), 4)
    best, where = m.places(words, windows)
    assert np.allclose(best, m.pooled(words, windows)) and (where >= windows[:, :1]).all() and (where < windows[:, 1:]).all()
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    again, there = m.places(words, windows)
    assert np.allclose(best, again, atol=1e-6) and (where == there).all()


def test_languages_of_all_rows_equal_those_of_one_list(spark):
    rows = [("the cat and the dog", "en"), ("der hund " * 10_000, "de"), ("\u043a\u043e\u0442 \u0438 \U0001f600", "ru"), ("this that", "en")]
    one = langid.LanguageModel(rows)
    all_rows = langid.fit_whole(spark.createDataFrame([*rows, (None, "fr"), ("who", None)], "text string, lang string").repartition(3))
    assert all_rows.langs == one.langs and (all_rows.may == one.may).all() and np.allclose(all_rows.logp, one.logp)
