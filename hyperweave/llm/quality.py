"""Line quality by a linear-chain conditional random field.

Every line of a text has features of its own (length, shares of character classes, repeated words, repeated
line, ending) and those of the lines before and after it. A two-state chain over the lines, fitted in numpy by
maximum likelihood, gives each line's marginal probability of being good by the forward-backward algorithm;
the length-weighted mean of the marginals, calibrated on the sample, is the document's score.

Labels are known for documents only, so the fit starts from the document's label on every line and then twice
relabels the lines of bad documents by their marginals.

Defined results: null and empty texts are one empty line; lines without characters weigh nothing unless all
are empty, then all weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import labelled_sample

#: The sample that the chain is fitted on: labelled rows, and characters of the longest.
TRAIN_DOCS = 3000
MAX_CHARS = 20_000
ROUNDS = 2
STEPS = 120
CUT = 0.7
#: Where in the range of equally good cuts the cut lies; low keeps what little speaks against.
LEAN = 0.1
SLICE = 250_000
FOLDS, HELD_OUT = 4, 2
LOWER, UPPER, DIGIT, SPACE, STOP, BANG, SYMBOL, BREAK = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.int64)
    table[128:] = LOWER
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[[9, 11, 12, 13, 32]] = SPACE
    table[[ord(c) for c in ".,;:?'\"-()"]] = STOP
    table[ord("!")] = BANG
    table[10] = BREAK
    return table


CLASS = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, text of each line): the rows of the lines of all texts, in order."""
    data = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    counts = [1 + t.count("\n") for t in texts]
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    size, lines = ends - starts, len(ends)
    line = np.repeat(np.arange(lines), size + 1)
    kind = CLASS[data]
    held = np.bincount(line * 8 + kind, minlength=lines * 8).reshape(lines, 8)
    # Words, each with a hash of its bytes; a word equal to the one before counts as repeated.
    gap = (kind == SPACE) | (kind == BREAK)
    first = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    last = np.flatnonzero(~gap & np.append(gap[1:], True)) + 1
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(starts, size + 1)
        begin = np.zeros(len(data), np.int64)
        begin[first] = first
        begin = np.maximum.accumulate(begin)
        salt = (np.arange(64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        salt |= np.uint64(1)
        mixed = (data.astype(np.uint64) + np.uint64(3)) * np.uint64(0xBF58476D1CE4E5B9)
        within = np.minimum(np.arange(len(data)) - begin, 1 << 20)
        total = np.append(np.uint64(0), np.cumsum(mixed * salt[within & 63], dtype=np.uint64))
        whole = np.append(np.uint64(0), np.cumsum(mixed * salt[place & 63], dtype=np.uint64))
    word, owner = total[last] - total[first], line[first]
    again = np.append(False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) if len(word) else np.zeros(0, bool)
    words = np.bincount(owner, minlength=lines)
    repeats = np.bincount(owner[again], minlength=lines)
    # A line equal to an earlier one of the same text.
    same = np.stack([doc.astype(np.uint64), whole[ends] - whole[starts], size.astype(np.uint64)], axis=1)
    order = np.lexsort((np.arange(lines), same[:, 2], same[:, 1], same[:, 0]))
    twin = np.zeros(lines, bool)
    twin[order[1:]] = (same[order[1:]] == same[order[:-1]]).all(axis=1)
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    end = CLASS[data[np.maximum(ends - 1, starts)]]
    own = np.stack(
        [
            np.log1p(size) / 5,
            held[:, UPPER] / n,
            held[:, DIGIT] / n,
            held[:, STOP] / n * 10,
            held[:, BANG] / n * 5,
            held[:, SYMBOL] / n * 5,
            repeats / w,
            np.minimum(size / w / 10, 3),
            twin & (size > 0),
            (end == STOP) & (size > 0),
            size == 0,
        ],
        axis=1,
    ).astype(np.float64)
    near = own[:, [1, 4, 5, 6]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    if lines > 1:
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:] = near[:-1] * joined
        after[:-1] = near[1:] * joined
    return np.hstack([np.ones((lines, 1)), own, before, after]), size.astype(np.float64), doc


class QualityModel:
    def __init__(self) -> None:
        self.weights = np.zeros(0)
        self.moves = np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def marginals(self, x: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected moves between states, summed; all texts advance together."""
        lines = len(x)
        emit = np.zeros((lines, 2))
        emit[:, 1] = x @ self.weights
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        sizes, first = sizes[order], first[:-1][order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        ahead, behind = np.zeros((lines, 2)), np.zeros((lines, 2))
        for t, n in enumerate(live):
            at = first[:n] + t
            if t:
                p = ahead[at - 1]
                ahead[at] = np.stack([np.logaddexp(p[:, 0] + self.moves[0, j], p[:, 1] + self.moves[1, j]) for j in (0, 1)], 1)
            ahead[at] += emit[at]
        pairs = np.zeros((2, 2))
        for t in range(len(live) - 2, -1, -1):
            n = live[t + 1]
            at = first[:n] + t
            q = emit[at + 1] + behind[at + 1]
            behind[at] = np.stack([np.logaddexp(self.moves[i, 0] + q[:, 0], self.moves[i, 1] + q[:, 1]) for i in (0, 1)], 1)
            joint = ahead[at][:, :, None] + self.moves[None] + q[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
            pairs += np.exp(joint).sum(axis=0)
        both = ahead + behind
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50))), pairs

    def train(self, rows: list[tuple[str, int]]) -> None:
        texts, labels = [t for t, _ in rows], np.array([y for _, y in rows], np.float64)
        x, size, doc = line_features(texts)
        bad = labels[doc] == 0
        target = labels[doc].copy()
        self.weights, scale = np.zeros(x.shape[1]), 1.0
        share = np.maximum(1, np.bincount(doc))[doc]
        inside = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, int)
        for _ in range(ROUNDS + 1):
            first, second = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
            seen = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    a = target[inside] if i else 1 - target[inside]
                    b = target[inside + 1] if j else 1 - target[inside + 1]
                    seen[i, j] = (a * b).sum()
            for step in range(1, STEPS + 1):
                p, pairs = self.marginals(x, doc, len(texts))
                g = np.concatenate([x.T @ (target - p), (seen - pairs).ravel()]) / max(1, len(x))
                g -= 1e-4 * np.concatenate([self.weights, self.moves.ravel()])
                first = 0.9 * first + 0.1 * g
                second = 0.99 * second + 0.01 * g * g
                move = 0.15 * scale * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
                self.weights += move[: x.shape[1]]
                self.moves += move[x.shape[1] :].reshape(2, 2)
            p, _ = self.marginals(x, doc, len(texts))
            worst = np.ones(len(texts))
            np.minimum.at(worst, doc, p)
            target = np.where(bad, np.where(p <= np.maximum(0.5, worst[doc]), 0.0, 1.0), 1.0)
        self.calibrate(self.mean(p, size, doc, len(texts)), labels)

    @staticmethod
    def mean(p: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        weight = np.bincount(doc, size, n)
        plain = np.bincount(doc, p, n) / np.maximum(1, np.bincount(doc, minlength=n))
        return np.where(weight > 0, np.bincount(doc, size * p, n) / np.maximum(weight, 1), plain)

    def calibrate(self, mean: np.ndarray, labels: np.ndarray) -> None:
        """A logistic map whose value is CUT where the sample has the fewest errors."""
        z = self._logit(mean)
        if not (labels == 1).any() or not (labels == 0).any():
            return
        near = np.unique(z)
        tries = (near[1:] + near[:-1]) / 2 if len(near) > 1 else near
        good, bad = np.sort(z[labels == 1]), np.sort(z[labels == 0])
        wrong = np.searchsorted(good, tries) + len(bad) - np.searchsorted(bad, tries)
        least = tries[wrong == wrong.min()]
        best = float(least[0] + LEAN * (least[-1] - least[0]))
        self.slope = 1.0
        self.shift = np.log(CUT / (1 - CUT)) - self.slope * best

    @staticmethod
    def _logit(m: np.ndarray) -> np.ndarray:
        m = np.clip(m, 1e-6, 1 - 1e-6)
        return np.log(m / (1 - m))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.ones(len(texts)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE):
                size += len(texts[to] or "")
                to += 1
            x, weight, doc = line_features([t or "" for t in texts[at:to]])
            p, _ = self.marginals(x, doc, to - at)
            z = self._logit(self.mean(p, weight, doc, to - at))
            out[at:to] = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            at = to
        return out

    def lines(self, text: str | None) -> list[tuple[str, float]]:
        """The lines of a text with their probability of being good."""
        x, _, doc = line_features([text or ""])
        return list(zip((text or "").split("\n"), self.marginals(x, doc, 1)[0].tolist()))


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, TRAIN_DOCS, MAX_CHARS)
    model = QualityModel()
    if rows:
        model.train(rows)
    else:
        model.weights = np.zeros(line_features([""])[0].shape[1])
    return model


def scored(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": held.value.score(f["text"].tolist())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")
