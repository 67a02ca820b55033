"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

The merge table holds every pair of vocabulary entries whose bytes join to another entry, with that entry's
rank. A recursive query starts from one row for each byte of each distinct word, joins neighbouring tokens with
the merge table, contracts each word's leftmost pair of least rank and goes on until no word has a pair (a pair's
rank is looked up again only where a contraction made a new pair). The query is keyed by word and position, so
only the newest row of each token is held, whatever the number of rounds. An ordered aggregate turns the rows
into token ids, another one joins them with the vocabulary's bytes and decodes. Each partition encodes a word
once for a stretch of documents; words never leave the partition.

Words are cut first where no vocabulary entry spans the cut: no contraction can cross there. That leaves pieces
of a few bytes of a long run of letters in any script. A piece stays long only where it repeats itself; of those
over WIDE bytes one round contracts all pairs that leftmost-first order would contract one after the other.

Texts are cut into pieces before the pattern is applied, only where the pattern can't match across the cut: at
a single blank or line end between other characters. Texts with runs of blanks or line ends or other white
space take the pattern as a whole.

Defined results: null and empty texts have no ids, the digest of the empty string twice and n_tokens 0.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import give_back

#: Bytes that one recursive query takes (a longer word is taken alone), and characters of documents that wait for it.
BYTES_AT_ONCE = 150_000
CHARS_AT_ONCE = 4_000_000
#: Blank-separated pieces that a worker keeps from one stretch to the next, and a quarter more pieces of words; fewer
#: take less memory and more time.
KEPT_PIECES = 250_000
#: What the database may hold, and bytes of it for each byte of a word that is taken alone.
MEMORY, MEMORY_PER_BYTE = 200_000_000, 1200
#: Longer pieces contract several pairs in one round.
WIDE = 64
#: The ids of a word, joined by commas, their number, and the bytes they decode to.
Encoded = tuple[str, int, bytes]
ODD_SPACE = regex.compile(r"[^\S \n]")

#: The recursion around one of the two steps below: it finds what a round contracts and gives the changed rows.
ENCODE = """
WITH RECURSIVE state(word, pos, after, id, next_id, rk) USING KEY (word, pos) AS (
  SELECT a.word, a.pos, a.pos + 1, a.id, a.next_id, m.merged
  FROM start a LEFT JOIN merges m ON m.pair = a.id::BIGINT * 4294967296 + a.next_id
  UNION ALL
  (
  WITH {step}
  SELECT n.word, n.pos, n.after, n.id, n.next_id, CASE WHEN fresh THEN m.merged ELSE n.rk END
  FROM next n LEFT JOIN merges m ON m.pair = CASE WHEN fresh THEN n.id::BIGINT * 4294967296 + n.next_id END
  )
)
SELECT s.word, string_agg(s.id, ',' ORDER BY s.pos) AS ids, count(*) AS n, string_agg(v.hex, '' ORDER BY s.pos) AS hex
FROM state s JOIN vocabulary v ON v.id = s.id
GROUP BY s.word
"""

#: Each word's leftmost pair of least rank; rank, place and length are compared as one number.
LEFTMOST = """
  least_rank AS (
    SELECT word, min(rk::BIGINT * 65536 + pos * 256 + after) AS k FROM state WHERE rk IS NOT NULL GROUP BY word
  ), chosen AS (
    SELECT r.word, (k // 256 % 256)::INTEGER AS pos, (k % 256)::INTEGER AS gone, (k // 65536)::INTEGER AS merged, g.after, g.next_id
    FROM least_rank r JOIN state g ON g.word = r.word AND g.pos = r.k % 256
  ), next AS (
    SELECT s.word, s.pos,
      CASE WHEN s.pos = c.pos THEN c.after ELSE s.after END AS after,
      CASE WHEN s.pos = c.pos THEN c.merged WHEN s.pos = c.gone THEN -1 ELSE s.id END AS id,
      CASE WHEN s.pos = c.pos THEN c.next_id WHEN s.after = c.pos THEN c.merged ELSE s.next_id END AS next_id,
      s.pos = c.pos OR s.after = c.pos AS fresh, CASE WHEN s.pos = c.gone THEN NULL ELSE s.rk END AS rk
    FROM state s JOIN chosen c ON c.word = s.word WHERE s.id >= 0
  )
"""

#: All pairs of a word's least rank that leftmost-first order contracts before any other: of overlapping ones every
#: other from the left, up to the first whose contraction makes a pair of a lower rank.
ALIKE = """
  least_rank AS (
    SELECT word, min(rk) AS rk FROM state WHERE rk IS NOT NULL GROUP BY word
  ), alike AS (
    SELECT s.word, s.pos, s.after AS gone, s.rk AS merged, g.after, g.next_id, b.id AS left_id,
      lag(s.after) OVER (PARTITION BY s.word ORDER BY s.pos) AS before
    FROM least_rank r JOIN state s ON s.word = r.word AND s.rk = r.rk
      JOIN state g ON g.word = s.word AND g.pos = s.after
      LEFT JOIN state b ON b.word = s.word AND b.after = s.pos AND b.id >= 0
  ), runs AS (
    SELECT *, sum(CASE WHEN before = pos THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run FROM alike
  ), apart AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS nth FROM runs) WHERE nth % 2 = 1
  ), stirring AS (
    SELECT a.*, coalesce(least(x.merged, y.merged, z.merged) < a.merged, false) AS stirs
    FROM apart a LEFT JOIN merges x ON x.pair = a.left_id::BIGINT * 4294967296 + a.merged
      LEFT JOIN merges y ON y.pair = a.merged::BIGINT * 4294967296 + a.next_id
      LEFT JOIN merges z ON z.pair = a.merged::BIGINT * 4294967296 + a.merged
  ), chosen AS (
    SELECT * FROM (SELECT *, sum(stirs::INTEGER) OVER (
      PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM stirring)
    WHERE coalesce(earlier, 0) = 0
  ), next AS (
    SELECT s.word, s.pos, coalesce(a.after, s.after) AS after,
      CASE WHEN b.pos IS NOT NULL THEN -1 ELSE coalesce(a.merged, s.id) END AS id,
      CASE WHEN d.pos IS NOT NULL THEN d.merged WHEN a.pos IS NOT NULL THEN a.next_id WHEN c.pos IS NOT NULL THEN c.merged ELSE s.next_id END AS next_id,
      a.pos IS NOT NULL OR c.pos IS NOT NULL AS fresh, CASE WHEN b.pos IS NULL THEN s.rk END AS rk
    FROM state s SEMI JOIN chosen w ON w.word = s.word
      LEFT JOIN chosen a ON a.word = s.word AND a.pos = s.pos
      LEFT JOIN chosen b ON b.word = s.word AND b.gone = s.pos
      LEFT JOIN chosen c ON c.word = s.word AND c.pos = s.after
      LEFT JOIN chosen d ON d.word = a.word AND d.pos = a.after
    WHERE s.id >= 0
  )
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _packed(token: bytes) -> int:
    return int.from_bytes(token, "big")


class Cuts:
    """Where words can be cut: boundaries that no vocabulary entry spans.

    Entries of two and three bytes are looked up themselves, longer ones by the four-byte parts that they are made of,
    which may leave a cut unused but never makes a wrong one.
    """

    def __init__(self, tokens: Iterator[bytes]):
        two, three, four = set(), set(), set()
        for t in tokens:
            if len(t) == 2:
                two.add(_packed(t))
            elif len(t) == 3:
                three.add(_packed(t))
            four.update(_packed(t[k : k + 4]) for k in range(len(t) - 3))
        self.parts = [(n, np.array(sorted(p), np.uint32)) for n, p in ((2, two), (3, three), (4, four))]

    def starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The starts of the pieces of the words that start at ``first`` in the bytes of all words."""
        word = np.zeros(len(data), np.int64)
        word[first[1:]] = 1
        word = np.cumsum(word)
        spanned = np.zeros(len(data), bool)
        code = data.astype(np.uint32)
        for n, known in self.parts:
            code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
            if not len(code) or not len(known):
                continue
            at = np.searchsorted(known, code)
            hit = known[np.minimum(at, len(known) - 1)] == code
            hit = np.flatnonzero(hit & (word[: len(code)] == word[n - 1 :]))
            for k in range(1, n):
                spanned[hit + k] = True
        spanned[first] = False
        return np.flatnonzero(~spanned)


class Encoder:
    """The merge table in a DuckDB database of its own, and the pieces that were encoded last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_PIECES):
        self.kept = kept
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})
        rows = [
            (ranks[t[:k]], ranks[t[k:]], r)
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cuts = Cuts(iter(ranks))
        merges = pa.table(
            {"pair": pa.array([(a << 32) + b for a, b, _ in rows], pa.int64()), "merged": pa.array([r for _, _, r in rows], pa.int32())}
        )
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("given_merges", merges)
        self.db.register("given_vocabulary", vocabulary)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given_vocabulary")
        self.db.unregister("given_merges")
        self.db.unregister("given_vocabulary")
        self.parts: dict[bytes | tuple[bytes, None], Encoded] = {}
        self.known: dict[str, Encoded | None] = {}

    # Pieces: \x01 starts the first piece of a text, \x00 one that a line end began; any other follows a blank.

    @staticmethod
    def cuttable(text: str) -> bool:
        """Whether its single blanks and line ends are safe cuts: no runs of them, and no mark of a piece."""
        return not ("  " in text or "\n\n" in text or " \n" in text or "\x00" in text or "\x01" in text)

    @staticmethod
    def spelled(piece: str) -> str:
        mark = piece[:1]
        return piece[1:] if mark == "\x01" else "\n" + piece[1:] if mark == "\x00" else " " + piece

    def words(self, words: list[str]) -> dict[str, Encoded]:
        """(ids, their number, decoded bytes) of distinct words of the pattern."""
        out: dict[str, Encoded] = {}
        at = 0
        while at < len(words):
            raws, size, to = [], 0, at
            while to < len(words):
                raw = words[to].encode("utf-8", "surrogatepass")
                if raws and size + len(raw) > BYTES_AT_ONCE:
                    break
                raws.append(raw)
                size += len(raw)
                to += 1
            out.update(zip(words[at:to], self._contract(raws)))
            at = to
        return out

    def _contract(self, raws: list[bytes]) -> list[Encoded]:
        """The encoded words; words that are vocabulary entries are one token from the start."""
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        first = np.cumsum(size) - size
        joined = b"".join(raws)
        data = np.frombuffer(joined, np.uint8)
        starts = self.cuts.starts(data, first)
        ends = np.append(starts[1:], len(data))
        # Words that are entries keep one piece.
        entry = [self.ranks.get(raw, -1) for raw in raws]
        of = np.searchsorted(first, starts, "right") - 1
        whole = np.array(entry)[of] >= 0
        keep = ~whole | (starts == first[of])
        starts, of, whole = starts[keep], of[keep], whole[keep]
        ends = np.where(whole, first[of] + size[of], ends[keep])
        pieces = [joined[s:e] if not w else (joined[s:e], None) for s, e, w in zip(starts.tolist(), ends.tolist(), whole.tolist())]
        if len(self.parts) > self.kept * 5 // 4:
            self.parts.clear()
        parts = self.parts
        new = list(dict.fromkeys([p for p in pieces if p not in parts]))
        parts.update(zip(new, self._query(new)))
        out, at = [], 0
        for n in np.bincount(of, minlength=len(raws)).tolist():
            if n == 1:
                out.append(parts[pieces[at]])
            else:
                some = [parts[p] for p in pieces[at : at + n]]
                out.append((",".join([p[0] for p in some]), sum([p[1] for p in some]), b"".join([p[2] for p in some])))
            at += n
        return out

    def _query(self, pieces: list[bytes | tuple[bytes, None]]) -> list[Encoded]:
        """Contracts and decodes pieces; a tuple holds a vocabulary entry, which is one token."""
        out: list[Encoded] = [("", 0, b"")] * len(pieces)
        raws = [p if type(p) is bytes else b"\0" for p in pieces]
        long = [k for k, raw in enumerate(raws) if len(raw) > WIDE]
        for step, some in ((LEFTMOST, [k for k, raw in enumerate(raws) if len(raw) <= WIDE]), (ALIKE, long)):
            if not some:
                continue
            own = [raws[k] for k in some]
            size = np.fromiter(map(len, own), np.int64, len(own))
            first = np.cumsum(size) - size
            ids = self.byte_ids[np.frombuffer(b"".join(own), np.uint8)]
            entries = [(n, self.ranks[pieces[k][0]]) for n, k in enumerate(some) if type(pieces[k]) is tuple]
            if entries:
                which, given = zip(*entries)
                ids[first[list(which)]] = given
            after = np.append(ids[1:], -1).astype(np.int32)
            after[first + size - 1] = -1  # a piece's last token has no neighbour
            place = (np.arange(len(ids)) - np.repeat(first, size)).astype(np.int32)
            start = pa.table({"word": np.repeat(np.arange(len(own), dtype=np.int32), size), "pos": place, "id": ids, "next_id": after})
            large = len(ids) > 2 * BYTES_AT_ONCE
            if large:
                self.db.execute(f"SET memory_limit = '{MEMORY + MEMORY_PER_BYTE * len(ids)}B'")
            self.db.register("start", start)
            for word, named, n, text in self.db.execute(ENCODE.format(step=step)).fetchall():
                out[some[word]] = (named, n, bytes.fromhex(text))
            self.db.unregister("start")
            if large:
                self.db.execute(f"SET memory_limit = '{MEMORY}B'")
        return out

    def learn(self, pieces: list[str]) -> list[Encoded | None]:
        """The encoded pieces, None for those with other white space, where cuts at blanks aren't safe."""
        known = self.known
        if len(known) > self.kept:
            known.clear()
        new = [p for p in pieces if p not in known]
        spelled = [" " + p if p.isalpha() else self.spelled(p) for p in new]
        if ODD_SPACE.search("".join(spelled)):
            known.update((p, None) for p, s in zip(new, spelled) if ODD_SPACE.search(s))
        # A blank and letters are one word of the pattern.
        cut = {p: self.find(s) for p, s in zip(new, spelled) if not p.isalpha() and p not in known}
        words = dict.fromkeys([s for p, s in zip(new, spelled) if p not in cut and p not in known])
        words.update(dict.fromkeys(itertools.chain.from_iterable(cut.values())))
        found = self.words(list(words))
        for p, s in zip(new, spelled):
            if p not in known:
                known[p] = self._joined([found[w] for w in cut[p]]) if p in cut else found[s]
        return [known[p] for p in pieces]

    @staticmethod
    def _joined(parts: list[Encoded]) -> Encoded:
        if len(parts) == 1:
            return parts[0]
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(n_tokens, ids joined by commas, decoded bytes) of every text."""
        own = [k for k, t in enumerate(texts) if self.cuttable(t)]
        pieces = pc.split_pattern(pa.array(["\x01" + texts[k].replace("\n", " \x00") for k in own], pa.string()), " ")
        coded = pieces.values.dictionary_encode()
        codes, first = coded.indices.to_numpy(), pieces.offsets.to_numpy()[:-1]
        found = self.learn(coded.dictionary.to_pylist())
        odd = np.array([e is None for e in found], bool)
        if odd.any():
            found = [e or ("", 0, b"") for e in found]
            bad = np.logical_or.reduceat(odd[codes], first)
        else:
            bad = np.zeros(len(own), bool)
        fine = {k: n for n, k in enumerate(own) if not bad[n]}
        # The rest take the pattern as a whole.
        whole = {k: self.find(t) for k, t in enumerate(texts) if k not in fine}
        words = self.words(list(dict.fromkeys(itertools.chain.from_iterable(whole.values()))))
        if own:
            counts = np.add.reduceat(np.array([e[1] for e in found])[codes], first)
            ids = pa.array([e[0].encode() for e in found], pa.binary()).take(coded.indices)
            ids = pc.binary_join(pa.ListArray.from_arrays(pieces.offsets, ids), b",")
            raws = pa.array([e[2] for e in found], pa.binary()).take(coded.indices)
            raws = pc.binary_join(pa.ListArray.from_arrays(pieces.offsets, raws), b"")
        for k in range(len(texts)):
            if k in fine:
                n = fine[k]
                # A text's first piece may be empty.
                yield int(counts[n]), ids[n].as_py().removeprefix(b","), raws[n].as_py()
            else:
                named, n, raw = self._joined([words[w] for w in whole[k]]) if whole[k] else ("", 0, b"")
                yield n, named.encode(), raw

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(n_tokens, digest of the ids, digest of the decoded bytes) of every text."""
        return [(n, hashlib.sha256(named).hexdigest(), hashlib.sha256(raw).hexdigest()) for n, named, raw in self.encoded(texts)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text."""
        words = self.find(text or "")
        found = self.words(list(dict.fromkeys(words)))
        return [int(i) for w in words for i in found[w][0].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids, by one ordered aggregate over them and the vocabulary."""
        if not ids:
            return b""
        given = pa.table({"pos": pa.array(range(len(ids)), pa.int64()), "id": pa.array(ids, pa.int64())})
        self.db.register("given_ids", given)
        sql = "SELECT string_agg(v.hex, '' ORDER BY g.pos) FROM given_ids g JOIN vocabulary v ON v.id = g.id"
        ((text,),) = self.db.execute(sql).fetchall()
        self.db.unregister("given_ids")
        return bytes.fromhex(text)


_ENCODERS: dict[tuple[str, str, int], Encoder] = {}


def encoder(path: str, pattern: str, kept: int = KEPT_PIECES) -> Encoder:
    """The worker's own encoder for a rank file; its tables are built once in each worker."""
    if (path, pattern, kept) not in _ENCODERS:
        _ENCODERS[path, pattern, kept] = Encoder(read_ranks(path), pattern, kept)
    return _ENCODERS[path, pattern, kept]


def forget() -> None:
    """Close the databases of this worker: other stages may run in it next."""
    for own in _ENCODERS.values():
        own.db.close()
    _ENCODERS.clear()
    give_back()


IDS = "ids array<int>, "
DIGESTS = "doc_id long, n_tokens long, {}ids_sha256 string, decoded_sha256 string"


def encoded(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, kept: int = KEPT_PIECES
) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row: its ids, and the digests of the ids (decimal,
    joined by commas) and of what they decode to. ``kept`` bounds the pieces that a worker keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, kept)
        docs: list[int | None] = []
        texts: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts, ids, first, second = [], [], [], []
            for n, named, raw in own.encoded(texts):
                counts.append(n)
                if with_ids:
                    ids.append(np.fromstring(named, np.int32, sep=",") if n else np.zeros(0, np.int32))
                first.append(hashlib.sha256(named).hexdigest())
                second.append(hashlib.sha256(raw).hexdigest())
            cols = {"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(counts, pa.int64())}
            if with_ids:
                ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))
            return pa.RecordBatch.from_pydict(cols | {"ids_sha256": pa.array(first), "decoded_sha256": pa.array(second)})

        gc.disable()  # what a stretch makes holds no cycles; looking for them takes an eighth of the time
        try:
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    docs.append(d)
                    texts.append(t.as_py() or "")
                    size += len(texts[-1])
                    if size >= CHARS_AT_ONCE:
                        yield flush()
                        docs, texts, size = [], [], 0
            if docs:
                yield flush()
        finally:
            gc.enable()
            forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, DIGESTS.format(IDS if with_ids else ""))


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    return encoded(docs, path, pattern, id_col, text_col, with_ids=False)
