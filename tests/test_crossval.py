"""Cross-validated neighbours against loops."""

import itertools
import random
from collections import Counter

import pytest

from hyperweave.operators import crossval as cv


def test_votes_and_scores(spark):
    rng = random.Random(2)
    label = {i: rng.choice("aab c".replace(" ", "")) for i in range(60)}
    fold = {i: i % 3 for i in label}
    d = {(i, j): rng.randrange(12) for i in range(0, 60, 2) for j in label if i != j}
    dist = spark.createDataFrame([(i, j, x, label[i], label[j]) for (i, j), x in d.items()], "i long, j long, d int, li string, lj string")
    folds = spark.createDataFrame(list(fold.items()), "id long, fold int")
    ks = [1, 4, 100]
    got = {r.k: r for r in cv.scores(cv.votes(dist, folds, ks)).collect()}
    for k in ks:
        share, told = {}, {}
        for i in range(0, 60, 2):
            near = sorted((d[i, j], j) for j in label if j != i and fold[j] != fold[i])[:k]
            count = Counter(label[j] for _, j in near)
            share[i] = {c: n / len(near) for c, n in count.items()}
            told[i] = min(count, key=lambda c: (-count[c], c))
        classes = sorted({label[i] for i in told})
        f1, auc = [], []
        for c in classes:
            tp = sum(told[i] == label[i] == c for i in told)
            f1.append(2 * tp / (sum(x == c for x in told.values()) + sum(label[i] == c for i in told)))
            pos, neg = ([share[i].get(c, 0) for i in told if (label[i] == c) == side] for side in (True, False))
            auc.append(sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg)))
        assert got[k].queries == 30
        assert got[k].accuracy == pytest.approx(sum(told[i] == label[i] for i in told) / 30)
        assert got[k].macro_f1 == pytest.approx(sum(f1) / len(f1)) and got[k].auc == pytest.approx(sum(auc) / len(auc))
    assert cv.scores(cv.votes(dist.limit(0), folds, ks)).count() == 0
