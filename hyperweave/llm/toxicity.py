"""Toxicity: a convolutional text classifier over hashed word embeddings, trained on all labelled rows by Spark tasks.

A word's embedding is the sum of the vectors of its own hash and those of its proper prefixes, so unseen forms
share what is known of their stems. Filters of one, two and three words slide over the whole text, each is
pooled by its maximum, and a logistic layer on top gives a margin. In a round each task goes through its share of
the rows from the same model on, and the moves of all tasks are averaged into the next one. For each language the
margin's threshold is calibrated on rows kept out of the fit; the language is told from the text itself. The score
is the logistic function of the margin above that threshold, so 0.5 is the calibrated cut.

Defined results: null and empty texts and texts without letters score as a text without any matching filter
(below 0.5 wherever such texts aren't toxic); repeated rows score alike.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hyperweave.functions.state import running_within

from .common import cut, give_back, labelled_rows, stable_order
from .langid import LanguageModel, _slices, _words, fit_whole as fit_languages, train_rows

BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 10
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows that one task of a round goes through, about; fewer rows than that and than the characters below
#: stay in one task for all epochs. Only the number of tasks depends on it, all rows are learned from.
SHARD_ROWS = 16_384
HELD_CHARS = 32_000_000
#: Epochs of few rows and of many; steps that small tables get by more epochs.
EPOCHS, LEAST_EPOCHS, STEPS = 12, 4, 600
#: Buckets in fewer labelled texts than this stay zero, so that single texts aren't learned by heart.
LEAST_TEXTS = 5
BATCH = 64
#: Windows whose filter values are held at once in training, and words of a mini-batch at most (or one text).
BLOCK = 1 << 16
#: Moves are summed as whole multiples of this, so that the sum depends on no order of the tasks.
UNIT = 2.0**-24
SLICE = 250_000
FOLDS, HELD_OUT = 5, 0
#: One labelled row in so many calibrates the thresholds, all others fit the classifier.
CALIBRATES = 5


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text) of every word: the bucket of the word and of each proper prefix, 0 where there is none."""
    low, starts, ends, doc = _words(texts)
    size = ends - starts
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), doc
    place = np.arange(len(low)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(low)]))))
    with np.errstate(over="ignore"):
        mult = (np.arange(256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mult ^= mult >> np.uint64(29)
        codes = low.astype(np.uint64)
        codes = (codes + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.cumsum((codes ^ (codes >> np.uint64(31))) * (mult[place & 255] | np.uint64(1)), dtype=np.uint64)

        def bucket(upto: np.ndarray, salt: int) -> np.ndarray:
            h = (total[upto] - total[starts - 1]) * np.uint64(0x94D049BB133111EB) + np.uint64(salt)
            return (1 + (h >> np.uint64(20)) % np.uint64(BUCKETS - 1)).astype(np.int32)

        cols = [bucket(ends - 1, 0)]
        for k in PREFIXES:
            cols.append(np.where(size > k, bucket(np.minimum(starts + k - 1, ends - 1), k * 0x1000003), 0))
    return np.stack(cols, axis=1), doc


def padded(buckets: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with empty words between texts, and the first window of each text and the one after its last.

    The last window of a text holds empty words only, so every text has one; none reaches into the next text.
    """
    gap = max(WIDTHS)
    counts = np.bincount(doc, minlength=n)
    start = np.cumsum(counts + gap) - counts - gap
    out = np.zeros((int(counts.sum()) + gap * n + gap, buckets.shape[1]), np.int32)
    out[np.arange(len(doc)) + gap * doc] = buckets
    return out, np.stack([start, start + counts + 1], axis=1)


class ToxicityModel:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.top = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.cut = np.float32(-2)
        self.languages = LanguageModel([])
        self.limits = np.zeros(1)
        self.scale = 1.0

    def values(self, words: np.ndarray) -> np.ndarray:
        """The value of every filter at every window (windows, filters)."""
        x = self.emb[words[:, 0]]
        for k in range(1, words.shape[1]):
            x = x + self.emb[words[:, k]]
        n, maps = len(words) - max(WIDTHS) + 1, []
        for w, filters in zip(WIDTHS, self.conv):
            y = x[:n] @ filters[0]
            for j in range(1, w):
                y += x[j : n + j] @ filters[j]
            maps.append(y)
        return np.concatenate(maps, axis=1)

    def pooled(self, words: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The maximum of every filter over every text (texts, filters)."""
        return np.maximum.reduceat(self.values(words), windows.ravel(), axis=0)[::2]

    def places(self, words: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pooled`` and the first window that has each maximum, from BLOCK windows at a time."""
        best = np.full((len(windows), len(self.bias)), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        filters = np.arange(best.shape[1])
        for a in range(0, windows[-1, 1], BLOCK):
            values = self.values(words[a : a + BLOCK + max(WIDTHS) - 1])
            upto = a + len(values)
            for k in range(np.searchsorted(windows[:, 1], a, "right"), np.searchsorted(windows[:, 0], upto, "left")):
                s, e = max(windows[k, 0], a), min(windows[k, 1], upto)
                at = s + values[s - a : e - a].argmax(axis=0)
                found = values[at - a, filters]
                more = found > best[k]
                best[k][more], where[k][more] = found[more], at[more]
        return best, where

    def margin(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        words, windows = padded(*word_buckets(texts), len(texts))
        return np.maximum(self.pooled(words, windows) + self.bias, 0) @ self.top + self.cut

    def packed(self) -> np.ndarray:
        """All parameters of the classifier, the word vectors first."""
        return np.concatenate([*(p.ravel() for p in (self.emb, *self.conv, self.bias, self.top)), [self.cut]]).astype(np.float64)

    def moved(self, sums: np.ndarray) -> None:
        """Go on by the average of the tasks' moves; a word vector by the average of the tasks that moved it."""
        tasks, touched = max(1, sums[-1]), np.maximum(1, sums[-1 - BUCKETS : -1])
        now = self.packed()
        move = sums[: len(now)] * UNIT
        vectors = BUCKETS * DIM
        now[:vectors] += move[:vectors] / np.repeat(touched, DIM)
        now[vectors:] += move[vectors:] / tasks
        at = 0
        for p in (self.emb, *self.conv, self.bias, self.top):
            p[...] = now[at : at + p.size].reshape(p.shape)
            at += p.size
        self.cut = np.float32(now[-1])

    def language(self, texts: list[str]) -> np.ndarray:
        return self.languages.guess(texts) if self.languages.langs else np.zeros(len(texts), np.int64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE):
                size += len(texts[to] or "")
                to += 1
            part = [t or "" for t in texts[at:to]]
            out[at:to] = 1 / (1 + np.exp(-np.clip(self.margin(part) - self.limits[self.language(part)], -30, 30)))
            at = to
        return out


class Descent:
    """Adam on the weighted logistic loss, from a model on; ``rare`` buckets stay, ``weight`` is by label."""

    def __init__(self, model: ToxicityModel, rare: np.ndarray, weight: np.ndarray):
        self.model, self.rare, self.weight = model, rare, weight
        self.before = model.packed()
        self.params = [model.emb, *model.conv, model.bias, model.top]
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.at, self.rate = 0, 0.01
        self.touched = np.zeros(BUCKETS, bool)

    def step(self, held: list[np.ndarray], labels: np.ndarray) -> None:
        """One mini-batch of texts, given by their words' buckets."""
        model, first, second = self.model, self.first, self.second
        words, windows = padded(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), len(held))
        best, where = model.places(words, windows)
        hidden = np.maximum(best + model.bias, 0)
        z = np.clip(hidden @ model.top + model.cut, -80, 80)
        slope = ((1 / (1 + np.exp(-z))) - labels) * self.weight[labels] / len(held)
        d_top, d_cut = hidden.T @ slope, slope.sum()
        d_best = (slope[:, None] * model.top) * (hidden > 0)
        d_conv = [np.zeros_like(c) for c in model.conv]
        grads: list[tuple[np.ndarray, np.ndarray]] = []
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            g, pos = d_best[:, cols], where[:, cols]
            for j in range(w):
                ids = words[pos + j]  # (texts, filters, buckets)
                x = model.emb[ids].sum(axis=2)
                d_conv[i][j] += np.einsum("tfd,tf->df", x, g)
                dx = g[:, :, None] * model.conv[i][j].T[None]
                grads.append((ids.reshape(-1, ids.shape[-1]), dx.reshape(-1, DIM)))
        some, d_rows = self._by_bucket(grads)
        d_rows[self.rare[some]] = 0
        d_rows[some == 0] = 0
        self.touched[some] = True
        self.at += 1
        fix = np.sqrt(1 - 0.999**self.at) / (1 - 0.9**self.at)
        first[0][some] = 0.9 * first[0][some] + 0.1 * d_rows
        second[0][some] = 0.999 * second[0][some] + 0.001 * d_rows**2
        model.emb[some] -= self.rate * fix * first[0][some] / (np.sqrt(second[0][some]) + 1e-7)
        for p, g, m, v in zip(self.params[1:], [*d_conv, d_best.sum(axis=0), d_top], first[1:], second[1:]):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * fix * m / (np.sqrt(v) + 1e-7)
        np.maximum(model.top, 0, out=model.top)  # a filter speaks for toxicity or not at all
        model.cut -= np.float32(self.rate * d_cut)

    def moves(self) -> np.ndarray:
        """What a task adds to the sums of a round: its moves in UNITs, whether it moved each bucket, and a one."""
        moved = np.rint((self.model.packed() - self.before) / UNIT)
        return np.concatenate([moved, self.touched & ~self.rare, [1 if self.at else 0]]).astype(np.int32)

    @staticmethod
    def _by_bucket(grads: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sum the gradients of word vectors over the buckets that made them up."""
        ids = np.concatenate([i[:, c] for i, _ in grads for c in range(i.shape[1])])
        dx = np.concatenate([d for i, d in grads for _ in range(i.shape[1])])
        own = ids > 0
        order = np.argsort(ids[own], kind="stable")
        ids, dx = ids[own][order], dx[own][order]
        if not len(ids):
            return np.zeros(1, np.int64), np.zeros((1, DIM), np.float32)
        some, first = np.unique(ids, return_index=True)
        return some, np.add.reduceat(dx, first, axis=0)


def encoded(texts: list[str]) -> list[np.ndarray]:
    """The buckets of the words of each text."""
    out: list[np.ndarray] = []
    for at, to in _slices(texts, SLICE):
        buckets, doc = word_buckets(texts[at:to])
        out += np.split(buckets, np.searchsorted(doc, np.arange(1, to - at)))
    return out


def batches(held: list[np.ndarray], order: np.ndarray) -> Iterator[np.ndarray]:
    """Mini-batches of rows in an order: BATCH of them, or fewer with BLOCK words together, or one row."""
    size = np.array([len(h) for h in held])
    part: list[int] = []
    for i in order:
        if part and (len(part) == BATCH or size[part].sum() + size[i] > BLOCK):
            yield np.array(part)
            part = []
        part.append(i)
    if part:
        yield np.array(part)


def _summed(rows: DataFrame, run) -> np.ndarray:
    """The sum of the whole numbers that ``run`` makes of each task's rows, by a tree in fours: five reach the driver at most."""
    made = rows.mapInPandas(run, "made binary").rdd
    depth = max(2, math.ceil(math.log(made.getNumPartitions(), 4)))
    return made.map(lambda r: np.frombuffer(r.made, np.int32)).treeReduce(lambda a, b: np.add(a, b, dtype=np.int64), depth)


def _texts_with_buckets(rows: DataFrame) -> np.ndarray:
    """How many texts hold each bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = np.zeros(BUCKETS, np.int32)
        for f in frames:
            for at, to in _slices(f["text"].tolist(), SLICE):
                buckets, doc = word_buckets(f["text"].iloc[at:to].tolist())
                pairs = np.unique(doc[:, None] * BUCKETS + buckets)
                texts += np.bincount(pairs % BUCKETS, minlength=BUCKETS).astype(np.int32)
        yield pd.DataFrame({"made": [texts.tobytes()]})
        give_back()

    return _summed(rows, run)


def _train(model: ToxicityModel, rows: DataFrame, n: int, chars: int, positive: int) -> None:
    """Rounds over all rows: each task goes through its own from the same model on, then the moves are averaged.

    Few rows, which one task holds, stay there for all epochs.
    """
    texts = _texts_with_buckets(rows)
    rare = texts < LEAST_TEXTS
    model.emb[rare] = 0
    share = positive / n
    weight = np.sqrt([0.5 / max(1e-6, 1 - share), 0.5 / max(1e-6, share)])
    few = rows.rdd.getNumPartitions() == 1 and chars <= HELD_CHARS
    epochs = EPOCHS * min(8, max(1, 2000 // n)) if few else max(LEAST_EPOCHS, min(EPOCHS, STEPS * BATCH // n))
    context = rows.sparkSession.sparkContext
    for k in range(1 if few else epochs):
        held = context.broadcast((model, rare, weight))

        def run(frames: Iterator[pd.DataFrame], held=held, k=k) -> Iterator[pd.DataFrame]:
            own, rare, weight = held.value
            descent = Descent(copy.deepcopy(own), rare, weight)
            r = np.random.default_rng(11 + k)
            for texts, labels in _parts(frames, few):
                words = encoded(texts)
                for _ in range(epochs if few else 1):
                    for part in batches(words, r.permutation(len(words))):
                        descent.step([words[i] for i in part], labels[part])
            yield pd.DataFrame({"made": [descent.moves().tobytes()]})
            give_back()

        model.moved(_summed(rows, run))
        held.destroy()


def _parts(frames: Iterator[pd.DataFrame], whole: bool) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels of a task: all together, or as they come, 8,000,000 characters (or a text) at a time."""
    if whole:
        kept = [f for f in frames if len(f)]
        frames = iter([pd.concat(kept, ignore_index=True)] if kept else [])
    for f in frames:
        texts, labels = f["text"].tolist(), f["label"].to_numpy(np.int64)
        for at, to in [(0, len(texts))] if whole else _slices(texts, 8_000_000):
            yield texts[at:to], labels[at:to]


def _thresholds(model: ToxicityModel, rows: DataFrame) -> np.ndarray:
    """For each language the threshold with the fewest errors on ``rows``, drawn to that of all rows together.

    A cut lies in the middle between two margins that follow each other; of several that are as good the one nearest
    to the middle of them is taken. Rows are counted by language and margin and summed up in order of the margins.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for at, to in _slices(texts, SLICE):
                part = texts[at:to]
                margin = held.value.margin(part).astype(np.float64)
                yield pd.DataFrame({"lang": held.value.language(part), "margin": margin, "label": f["label"].iloc[at:to].to_numpy()})
        give_back()

    own = rows.mapInPandas(run, "lang long, margin double, label int")
    own = own.select(F.explode(F.array("lang", F.lit(-1).cast("long"))).alias("lang"), "margin", "label")  # -1: all rows
    counts = cut(own.groupBy("lang", "margin").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
    total = counts.groupBy("lang").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.min("margin").alias("least"))
    total = cut(total.where("all_pos > 0 and all_neg > 0"))
    below = total.select("lang", F.col("least") - 2, F.lit(0).cast("long"), F.lit(0).cast("long"))
    upto = running_within(counts.union(below), ["lang"], ["margin"], {"pos_upto": "pos", "neg_upto": "neg"})
    wrong = upto.join(F.broadcast(total), "lang").withColumn("wrong", F.col("pos_upto") + F.col("all_neg") - F.col("neg_upto"))
    wrong = cut(wrong.select("lang", "margin", "wrong"))
    least = wrong.groupBy("lang").agg(F.min("wrong").alias("wrong"))
    least = wrong.join(F.broadcast(least), ["lang", "wrong"])
    middle = least.groupBy("lang").agg(((F.min("margin") + F.max("margin")) / 2).alias("middle"))
    nearest = F.min_by("margin", F.struct(F.abs(F.col("margin") - F.col("middle")), "margin"))
    found = least.join(F.broadcast(middle), "lang").groupBy("lang").agg(nearest.alias("found"))
    after = wrong.join(F.broadcast(found), "lang").groupBy("lang", "found").agg(F.min(F.when(F.col("margin") > F.col("found"), F.col("margin"))).alias("after"))
    cuts = {r.lang: r.found + 1 if r.after is None else (r.found + r.after) / 2 for r in after.collect()}
    common = cuts.get(-1, 0.0)
    limits = np.full(max(1, len(model.languages.langs)), common)
    for r in total.where("lang >= 0").collect():
        limits[r.lang] = (cuts[r.lang] * r.all_pos + common * 10) / (r.all_pos + 10)
    return limits


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on all labelled rows outside the held-out fold, whole texts; a fifth of them calibrates the thresholds."""
    rows = cut(labelled_rows(docs, labels, "toxic", FOLDS, HELD_OUT, SHARD_ROWS))
    calibrates = F.pmod(stable_order("_id"), F.lit(CALIBRATES)) == 0
    fits = rows.where(~calibrates)
    sizes = fits.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("label").alias("positive")).first()
    model = ToxicityModel()
    if sizes.n:
        _train(model, fits, sizes.n, sizes.chars, sizes.positive)
    model.languages = fit_languages(train_rows(docs, parts=FOLDS, held_out=HELD_OUT))
    model.limits = _thresholds(model, rows.where(calibrates))
    return model


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": held.value.score(f["text"].tolist())})
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(texts.tolist()) < 0.5)
        give_back()

    return docs.where(fine(F.col(text_col)))
