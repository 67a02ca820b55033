"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are the word trigrams of the benchmark items. One pass over the corpus finds, for each document and
item that share seeds, the stretch of the document around them. An alignment scores 2 at most for each word
that stretch and item have in common (counted as often as both have it), so a stretch whose common words are
too few for the threshold is left out without loss. Every other one is aligned with its item word by word
(match 2, mismatch and gap -1), and the score is the best local alignment as a share of the item's own. How
many other documents hold a passage decides nothing.

The benchmark is met in blocks of a bounded size, one pass over the corpus for each, so what is broadcast
never grows beyond a block.

Words are runs of letters and digits; of scripts written without blanks (Han, kana, Thai, Lao, Khmer, Burmese) each
character is a word, so that their copies and edits are seen too.

Defined results: null, empty or word-free texts and items match nothing, nor do items without an item_id; items of fewer than three words use
their whole word sequence as the seed; repeated rows give the same (doc_id, item_id) once, with the best score, and an
item_id with several texts is matched by each of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, row_key

#: Scripts written without blanks. Fixed values of the Unicode code charts.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, ONE = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")
MIXED = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
SEED_WORDS = 3
BLOCK_BYTES = 8 << 20
THRESHOLD = 0.5
#: Pairs of stretch and item that are aligned at once.
ALIGN_PAIRS = 4096
FOUND = "doc_id long, item_id long, score double, seeds long, _hash long"


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (WORD if text.isascii() or not ONE.search(text) else MIXED).findall(text)


class Seeds:
    """The seeds of a block of items: a vocabulary, sorted seed keys and the items (by position) of each key."""

    def __init__(self, items: list[tuple[int, str | None]]):
        known = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in known]
        self.words = dict(enumerate(w for _, w in known))
        self.counts = {i: Counter(w) for i, w in self.words.items()}
        self.vocab: dict[str, int] = {}
        found = []
        for i, words in self.words.items():
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            ids += [-1] * (SEED_WORDS - len(ids))  # a short item's seed starts with its own words only
            found += [(self.key(ids[k : k + SEED_WORDS]), i) for k in range(len(ids) - SEED_WORDS + 1)]
        found = sorted(set(found))
        self.short = sorted({len(w) for w in self.words.values() if len(w) < SEED_WORDS})
        self.keys = np.array([k for k, _ in found], np.int64)
        self.items = np.array([i for _, i in found], np.int64)

    @staticmethod
    def key(ids: list[int]) -> int:
        return ((ids[0] + 1) << 42) | ((ids[1] + 1) << 21) | (ids[2] + 1)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seed keys) of the seeds in a document's words."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words)) + 1
        at, keys = [], []
        if len(ids) >= SEED_WORDS:
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            pos = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            at.append(pos)
            keys.append((a[pos] << 42) | (b[pos] << 21) | c[pos])
        for size in self.short:
            pos = np.flatnonzero(ids[: len(ids) - size + 1] > 0)
            at.append(pos)
            keys.append((ids[pos] << 42) | ((ids[pos + 1] << 21) if size == 2 else 0))
        if not at or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, key = np.concatenate(at), np.concatenate(keys)
        there = np.searchsorted(self.keys, key)
        ok = self.keys[np.minimum(there, len(self.keys) - 1)] == key
        return pos[ok], key[ok]

    def bound(self, item: int, words: list[str]) -> float:
        """No alignment of the item with these words scores more: the words in common as a share of the item's."""
        own = self.counts[item]
        there = Counter(w for w in words if w in own)
        return sum(min(n, own[w]) for w, n in there.items()) / len(self.words[item])

    def stretches(self, words: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        """(item, number of its seeds, the words around them) for each stretch of a document that shares seeds with an item."""
        pos, key = self.hits(words)
        by_item: dict[int, list[tuple[int, int]]] = {}
        for p, k in zip(pos.tolist(), key.tolist()):
            lo, hi = np.searchsorted(self.keys, [k, k + 1])
            for i in self.items[lo:hi].tolist():
                by_item.setdefault(i, []).append((p, k))
        for i, found in by_item.items():
            found.sort()
            size, group = len(self.words[i]), [found[0]]
            for hit in [*found[1:], (1 << 62, 0)]:
                if hit[0] - group[-1][0] <= size:
                    group.append(hit)
                    continue
                lo, hi = max(0, group[0][0] - size), group[-1][0] + size + SEED_WORDS
                yield i, len({k for _, k in group}), words[lo:hi]
                group = [hit]


def alignments(pairs: list[tuple[list[str], list[str]]]) -> list[int]:
    """Best Smith-Waterman local scores (match 2, mismatch -1, gap -1) of pairs of word lists, many at once."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 256 and len(pairs[order[to]][1]) * (to - at + 1) <= 1 << 17:
            to += 1
        part, ids = order[at:to], {}
        a = [[ids.setdefault(w, len(ids)) for w in pairs[k][0]] for k in part]
        b = [[ids.setdefault(w, len(ids)) for w in pairs[k][1]] for k in part]
        rows, cols = max(map(len, a)), max(map(len, b))
        x = np.array([r + [-1] * (rows - len(r)) for r in a], np.int32)
        y = np.array([r + [-2] * (cols - len(r)) for r in b], np.int32)
        above = np.zeros((len(part), cols + 1), np.int32)
        ramp, best = np.arange(cols + 1, dtype=np.int32), np.zeros(len(part), np.int32)
        for r in range(rows):
            here = np.zeros_like(above)
            here[:, 1:] = np.maximum(above[:, :-1] + np.where(y == x[:, r : r + 1], 2, -1), above[:, 1:] - 1)
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps along the row
            best = np.maximum(best, here.max(axis=1))
            above = here
        out[part] = best
        at = to
    return out.tolist()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, score, seeds) of the documents that hold an edited or whole copy of an item.

    score is 0 to 1, 1 for a whole copy; seeds counts the different seeds of the best stretch.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text, threshold)
    best = F.max(F.struct("score", "seeds")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.seeds")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, threshold: float) -> DataFrame:
    """(doc_id, item_id, score, seeds, hash of the text) of every stretch that scores enough."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_hash"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = items.where("item_id is not null").groupBy("item_id", "text").count().drop("count")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        one = _block(spark, texts, Seeds([(r.item_id, r.text) for r in part.collect()]), threshold)
        found = one if found is None else found.union(one)
    return found


def _block(spark, texts: DataFrame, seeds: Seeds, threshold: float) -> DataFrame:
    held = spark.sparkContext.broadcast(seeds)

    def aligned(some: list[tuple[int, int, int, list[str], int]]) -> pa.RecordBatch:
        """What scores enough of (doc_id, item, seeds, words, hash)."""
        items = held.value
        pairs = [(items.words[i], words) for _, i, _, words, _ in some]
        rows = [
            (doc, items.ids[i], score, n, h)
            for (doc, i, n, _, h), own, (item, _) in zip(some, alignments(pairs), pairs)
            if (score := own / (2 * len(item))) >= threshold
        ]
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        names = ["doc_id", "item_id", "score", "seeds", "_hash"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for batch in batches:
            for d, t, h in zip(*batch.columns):
                for i, n, words in held.value.stretches(words_of(t.as_py())):
                    if held.value.bound(i, words) >= threshold:
                        some.append((d.as_py(), i, n, words, h.as_py()))
                if len(some) >= ALIGN_PAIRS:
                    yield aligned(some)
                    some = []
        yield aligned(some)
        give_back()

    return texts.mapInArrow(scan, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item; rows are told apart by id and text."""
    bad = _found(docs, benchmark, id_col, text_col, "item_id", "text", THRESHOLD)
    number = F.col("doc_id")
    bad = bad.select(number.isNull().alias("_none"), F.coalesce(number, F.lit(0)).alias("_id"), "_hash").distinct()
    key = ["_none", "_id", "_hash"]
    return docs.select("*", *row_key(id_col, text_col)).join(bad, key, "left_anti").drop(*key)
