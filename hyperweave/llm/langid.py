"""Language identification: script ranges, per-word scores and a Viterbi path with a switching penalty.

The model holds, for every learned language, the share of each script among its letters and hashed letter
trigram log-probabilities. A word's script narrows the languages that may label it; the word's score in a
language is the sum of its trigrams' log-probabilities. Viterbi over the words of a text, with a penalty for
every change of language, labels spans; the text's language is the one whose spans hold most letters.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language that
sorts first; a script that no language was learned with leaves all of them as candidates.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import give_back, in_fold, stable_order

#: First code points of the script ranges: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari to other
#: Indic, Thai to other South-East Asian, Georgian, Hangul letters, other, Latin extended, Greek extended, other,
#: kana, other, Han, other, Hangul, other. Fixed values of the Unicode code charts.
SCRIPT_FROM = [
    0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x10A0, 0x1100,
    0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7A4,
]
SCRIPT_OF = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0, 1, 10, 11, 10, 12, 10, 9, 10]
SCRIPTS = 13
BUCKETS = 1 << 16
SWITCH = 12.0
SCRIPT_SHARE = 1e-3
#: Languages that are learned at most, those with the most characters.
MAX_LANGS = 1000
#: Characters that the model is fitted on, and those that one text gives at most.
TRAIN_CHARS = 4_000_000
MAX_CHARS = 50_000
#: Characters times languages whose words are scored at once, and whose paths are searched together.
SLICE, GROUP = 1_000_000, 10_000_000


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane the lower-case letter (marks: themselves, else 0), and whether it is a letter."""
    table, letter = np.zeros(0x10000, np.uint32), np.zeros(0x10000, bool)
    for c in range(0x10000):
        table[c], letter[c] = _letter(c)
    return table, letter


@lru_cache(1 << 16)
def _letter(c: int) -> tuple[int, bool]:
    if 0xD800 <= c < 0xE000:
        return 0, False
    kind, low = unicodedata.category(chr(c))[0], chr(c).lower()
    return (ord(low) if len(low) == 1 else c) if kind in "LM" else 0, kind == "L"


def _slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters, or of one longer text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts with a 0 around each word; the words' starts and ends in them; the text of each word."""
    codes = _codes("\n" + "\n".join(texts) + "\n")
    table, letter = _letters()
    plain = np.minimum(codes, 0xFFFF)
    low, own = table[plain], letter[plain]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        some, back = np.unique(codes[high], return_inverse=True)
        found = np.array([_letter(int(c)) for c in some])
        low[high], own[high] = found[back, 0], found[back, 1] > 0
    edge = np.diff((low > 0).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    counts = np.append(0, np.cumsum(own))
    real = counts[ends] > counts[starts]  # marks alone make no word
    starts, ends = starts[real], ends[real]
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return low, starts, ends, np.searchsorted(first, starts, "right") - 1


def _grams(low: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around every position (inner positions only are meaningful)."""
    a = low.astype(np.uint64)
    h = a * np.uint64(0x9E3779B1)
    h[1:] += a[:-1] * np.uint64(0x85EBCA77)
    h[:-1] += a[1:] * np.uint64(0xC2B2AE3D)
    return ((h ^ (h >> np.uint64(15))) * np.uint64(0x27D4EB2F) >> np.uint64(11)).astype(np.int64) & (BUCKETS - 1)


def _script(codes: np.ndarray) -> np.ndarray:
    return np.array(SCRIPT_OF)[np.searchsorted(SCRIPT_FROM, codes, "right") - 1]


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float) -> np.ndarray:
    """The best label for each word: ``scores`` (words, labels) by text, ``doc`` the sorted text of each word.

    All texts advance one word at a time together, the long ones last, so no text is cut.
    """
    words, labels = scores.shape
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], first[:-1][order]
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # texts longer than t
    # Words by their place in the text, then by the text's rank: each step works on one slice.
    rank = np.empty(n_docs, np.int64)
    rank[order] = np.arange(n_docs)
    at = np.arange(words) - np.searchsorted(doc, doc, "left")
    offset = np.cumsum(live) - live
    to = offset[at] + rank[doc]
    lined = np.empty_like(scores)
    lined[to] = scores
    stay = np.ones((words, labels), bool)
    best_before = np.zeros(words, np.int16)
    total = np.zeros((n_docs, labels))
    for t, n in enumerate(live):
        before, s = total[:n], slice(offset[t], offset[t] + n)
        if t:
            jump = before.max(axis=1)[:, None] - switch
            np.greater_equal(before, jump, out=stay[s])
            best_before[s] = before.argmax(axis=1)
            np.maximum(before, jump, out=before)
        before += lined[s]
    found = np.zeros(words, np.int16)
    state = total.argmax(axis=1).astype(np.int16)
    rows = np.arange(n_docs)
    for t in range(len(live) - 1, -1, -1):
        n, s = live[t], slice(offset[t], offset[t] + live[t])
        now = state[:n]
        found[s] = now
        if t:
            leave = ~stay[s][rows[:n], now]
            if leave.any():
                now[leave] = best_before[s][leave]
    return found[to]


class LanguageModel:
    """Letter trigrams and scripts of languages, learned from (text, language) rows."""

    def __init__(self, rows: list[tuple[str, str]]):
        langs = sorted({lang for _, lang in rows})
        counts = np.zeros((BUCKETS, len(langs)))
        scripts = np.zeros((SCRIPTS, len(langs)))
        for text, lang in rows:
            low, _, _, _ = _words([text])
            inside = low > 0
            k = langs.index(lang)
            np.add.at(counts[:, k], _grams(low)[inside], 1)
            scripts[:, k] += np.bincount(_script(low[inside]), minlength=SCRIPTS)
        self.learn(langs, counts, scripts)

    def learn(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """From the counts of trigrams (buckets, languages) and scripts (scripts, languages); ``langs`` is sorted."""
        self.langs = langs
        total = counts.sum(axis=0) + 0.05 * BUCKETS
        counts += 0.05
        counts /= total
        self.logp = np.log(counts, out=counts).astype(np.float32)
        self.may = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
        self.may[~self.may.any(axis=1)] = True

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of every text and a score from 0 to 1."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        texts = [t or "" for t in texts]
        for at, to in _slices(texts, max(1, GROUP // len(self.langs))) if self.langs else ():
            for k, share in enumerate(self.shares(texts[at:to])):
                if share is not None:
                    best = int(share.argmax())
                    names[at + k], scores[at + k] = self.langs[best], float(share[best])
        return names, scores

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the spans of a text, from the first letter of a span's words to the last."""
        _, starts, ends, doc = _words([text or ""])
        out: list[tuple[int, int, str]] = []
        for s, e, k in zip(starts - 1, ends - 1, self._label([text or ""])[0]):
            if out and out[-1][2] == self.langs[k]:
                out[-1] = (out[-1][0], int(e), self.langs[k])
            else:
                out.append((int(s), int(e), self.langs[k]))
        return out

    def _scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, text, letters) of each word of a slice of texts."""
        low, starts, ends, doc = _words(texts)
        return self._points(low, _grams(low), starts, ends), doc, ends - starts

    def _points(self, low: np.ndarray, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The score of each word in each language, from the letters and trigrams around them."""
        if not len(starts):
            return np.zeros((0, len(self.langs)))
        first, last = starts[0], min(ends[-1] + 1, len(low))
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[0::2], bounds[1::2] = starts - first, ends - first
        bounds = np.minimum(bounds, last - first - 1)
        scores = np.add.reduceat(self.logp[grams[first:last]], bounds, axis=0)[0::2].astype(np.float64)
        scores[~self.may[_script(low[starts])]] -= 1e3
        return scores

    def _label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label, text, letters) of each word: scores slice by slice, one path search over all of them."""
        if len(texts) == 1 and len(texts[0]) * len(self.langs) > GROUP:
            return self._long(texts[0])
        parts = [(at, self._scored(texts[at:to])) for at, to in _slices(texts, max(1, SLICE // len(self.langs)))]
        scores, doc, size = (np.concatenate(x) for x in zip(*[(s, d + at, n) for at, (s, d, n) in parts]))
        return viterbi(scores, doc, len(texts), SWITCH), doc, size

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_label`` of one text too long for its scores to be held: they are made as the search goes on, which keeps a
        bit for each word and language (whether the path stays) and the best language before each word."""
        low, starts, ends, doc = _words([text])
        grams = _grams(low)
        n, labels = len(starts), len(self.langs)
        stay = np.zeros((n, -(-labels // 8)), np.uint8)
        best = np.zeros(n, np.int16)
        total = np.zeros(labels)
        edges = np.searchsorted(starts, np.arange(0, len(low) + 1, max(1, SLICE // labels)))
        for a, b in zip(edges, np.append(edges[1:], n)):
            for at in range(a, b, max(1, SLICE // labels)):
                to = min(b, at + max(1, SLICE // labels))
                scores = self._points(low, grams, starts[at:to], ends[at:to])
                kept = np.ones(scores.shape, bool)
                for t in range(at, to):
                    if t:
                        jump = total.max() - SWITCH
                        np.greater_equal(total, jump, out=kept[t - at])
                        best[t] = total.argmax()
                        np.maximum(total, jump, out=total)
                    total += scores[t - at]
                stay[at:to] = np.packbits(kept, axis=1)
        found = np.zeros(n, np.int16)
        now = int(total.argmax())
        for t in range(n - 1, -1, -1):
            found[t] = now
            if not stay[t, now >> 3] >> (7 - (now & 7)) & 1:
                now = int(best[t])
        return found, doc, ends - starts

    def guess(self, texts: list[str]) -> np.ndarray:
        """The best language of each text as a whole, by number (0 without letters)."""
        low, starts, _, doc = _words(texts)
        out = np.zeros(len(texts), np.int64)
        if len(starts):
            points = np.where((low > 0)[:, None], self.logp[_grams(low)], 0)
            some, first = np.unique(doc, return_index=True)
            out[some] = np.add.reduceat(points, starts[first], axis=0).argmax(axis=1)
        return out

    def shares(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text the share of its letters under each language's spans, None without letters."""
        label, doc, size = self._label(texts)
        held = np.zeros((len(texts), len(self.langs)))
        np.add.at(held, (doc, label), size)
        total = held.sum(axis=1)
        return [held[k] / total[k] if total[k] else None for k in range(len(texts))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit a model on a bounded sample: about TRAIN_CHARS characters, shared evenly by the languages.

    A hash of the id picks the rows, so the sample is the same on every run; of each language its first row by that
    hash is always taken. A longer text teaches by its first MAX_CHARS characters. Only counts for MAX_LANGS languages,
    those with the most characters, and the sample itself reach the driver.
    """
    excerpt = F.substring(F.col(text_col), 1, MAX_CHARS)
    rows = docs.select(F.col(id_col).alias("id"), excerpt.alias("text"), F.col(lang_col).alias("lang"), F.length(excerpt).alias("n"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("n") > 0))
    most = rows.groupBy("lang").agg(F.sum("n").alias("chars")).orderBy(F.desc("chars"), "lang").limit(MAX_LANGS)
    sizes = {r.lang: r.chars for r in most.collect()}
    if not sizes:
        return LanguageModel([])
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, TRAIN_CHARS / len(sizes) / v)])
    chance = F.pmod(stable_order("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    picked = [(r.text, r.lang) for r in rows.where(chance < share[F.col("lang")]).select("text", "lang").collect()]
    missed = sorted(set(sizes) - {lang for _, lang in picked})
    if missed:
        first = rows.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min_by("text", F.struct(stable_order("id"), "text")).alias("text"))
        picked += [(r.text, r.lang) for r in first.collect()]
    return LanguageModel(picked)


def fit_whole(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit a model on all rows with a language, whole texts: tasks count, their counts are summed by language.

    Only the sums of MAX_LANGS languages, those with the most characters, reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    most = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "lang").limit(MAX_LANGS)
    langs = sorted(r.lang for r in most.collect())
    if not langs:
        return LanguageModel([])
    taken = set(langs)

    def pieces(found: dict[str, np.ndarray]) -> pd.DataFrame:
        cells = [(lang, np.flatnonzero(c)) for lang, c in found.items()]
        return pd.DataFrame({"lang": [lang for lang, _ in cells], "cell": [w for _, w in cells], "n": [found[lang][w] for lang, w in cells]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, own in f[f["lang"].isin(taken)].groupby("lang")["text"]:
                if lang not in found and len(found) == 100:  # memory for so many languages at once
                    yield pieces(found)
                    found = {}
                counts = found.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                texts = own.tolist()
                for at, to in _slices(texts, SLICE):
                    low = _words(texts[at:to])[0]
                    inside = low > 0
                    counts[:BUCKETS] += np.bincount(_grams(low)[inside], minlength=BUCKETS)
                    counts[BUCKETS:] += np.bincount(_script(low[inside]), minlength=SCRIPTS)
        if found:
            yield pieces(found)
        give_back()

    counted = rows.mapInPandas(run, "lang string, cell array<long>, n array<long>")
    counted = counted.select("lang", F.explode(F.arrays_zip("cell", "n")).alias("x")).groupBy("lang", "x.cell").agg(F.sum("x.n").alias("n"))
    counts = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    at = {lang: k for k, lang in enumerate(langs)}
    for r in counted.toLocalIterator():
        counts[r.cell, at[r.lang]] = r.n
    model = LanguageModel([])
    model.learn(langs, counts[:BUCKETS], counts[BUCKETS:])
    return model


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names, scores = held.value.predict(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": names, "score": scores})
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language can't be told (null texts and texts without a letter).

    A model that has learned no language can't tell any, so all rows stay.
    """
    if not model.langs:
        return docs
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([name != "und" for name in held.value.predict(texts.tolist())[0]])
        give_back()

    return docs.where(told(F.col(text_col)))


def train_rows(docs: DataFrame, id_col: str = "doc_id", parts: int = 4, held_out: int = 2) -> DataFrame:
    """The rows outside the held-out fold."""
    return docs.where(~in_fold(id_col, parts, held_out))
