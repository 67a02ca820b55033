"""Token-id output as wavelet matrices, one compressed file for each shard.

Documents are dealt out by ranges of their ids, encoded, and written shard by shard in ascending order of the
ids. A shard's file holds one bit-plane for each bit of a token id, from the highest down; below each plane
the tokens are ordered by that bit, stably, so that a token's place on the next plane follows from the rank of
its bit. That supports access, counting and finding occurrences without unpacking the tokens, and reading the
whole sequence back plane by plane.

Ranks come from two small tables for each plane, ones before every superblock and within it before every block;
the bits of one block are counted. All parts of a file are compressed apart, planes in pieces, so a token, a count
or an occurrence is read by unpacking the tables and the pieces that it touches, not the shard.

File format: the magic ``WVM2``, the header's length (4 bytes, little endian), a JSON header, then zstd frames end
to end: for each plane its pieces (packed, eight tokens a byte, lowest first) and its two rank tables (superblocks
as 64-bit, blocks as 16-bit numbers), and last the document table (ids, starts and a null flag). The header holds
the number of tokens and of documents, the zeros of each plane and the length of every frame.

Defined results: null and empty texts hold the end id alone; repeated rows are separate documents, ordered by the
hash of their text among rows of one id; rows without an id come first and keep a null id.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .common import cut, give_back, shared_dir

MAGIC = b"WVM2"
END_ID = 1
#: Characters of documents that make up a shard at least, unless its range of ids holds fewer.
SHARD_CHARS = 12_000_000
KEPT_UNITS = 300_000
#: Bits of a superblock, of a block and of a separately compressed piece of a plane.
SUPER, BLOCK, PIECE = 1 << 16, 1 << 9, 1 << 19
#: A Latin word of letters, perhaps with other ASCII signs at its end: its parts are encoded apart.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


class Plane:
    """The bits of one level with their rank tables, unpacked piece by piece as they are needed."""

    def __init__(self, size: int, zeros: int, pieces: list, tables):
        self.size, self.zeros, self._pieces, self._tables = size, zeros, pieces, tables

    @staticmethod
    def tables_of(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before every superblock, and within it before every block; one entry more than there are blocks."""
        words = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
        words[: len(packed)] = packed
        ones = np.bitwise_count(words.view(np.uint64)).astype(np.int64)
        ends = np.append(0, np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 64)))) if len(ones) else np.zeros(1, np.int64)
        supers = ends[:: SUPER // BLOCK]
        blocks = ends - np.repeat(supers, SUPER // BLOCK)[: len(ends)]
        return supers, blocks.astype(np.uint16)

    def _piece(self, k: int) -> bytes:
        if callable(self._pieces[k]):
            self._pieces[k] = self._pieces[k]()
        return self._pieces[k]

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if callable(self._tables):
            self._tables = self._tables()
        return self._tables

    def packed(self) -> np.ndarray:
        return np.frombuffer(b"".join(self._piece(k) for k in range(len(self._pieces))), np.uint8)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed(), count=self.size, bitorder="little").view(bool)

    def bit(self, pos: int) -> int:
        k, rest = divmod(pos, PIECE)
        return self._piece(k)[rest >> 3] >> (rest & 7) & 1

    def _block(self, k: int) -> int:
        """The bits of a block as one number."""
        piece, at = divmod(k * BLOCK, PIECE)
        return int.from_bytes(self._piece(piece)[at >> 3 : (at + BLOCK) >> 3], "little")

    def _before(self, k: int) -> int:
        supers, blocks = self.tables
        return int(supers[k // (SUPER // BLOCK)]) + int(blocks[k])

    def rank1(self, pos: int) -> int:
        """Ones before a position."""
        k, rest = divmod(pos, BLOCK)
        return self._before(k) + ((self._block(k) & ((1 << rest) - 1)).bit_count() if rest else 0)

    def select(self, one: int, k: int) -> int:
        """The position of the bit number ``k`` of that kind: by the tables to a block, then within it."""
        lo, hi = 0, -(-self.size // BLOCK)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            ones = self._before(mid)
            if (ones if one else mid * BLOCK - ones) <= k:
                lo = mid
            else:
                hi = mid
        ones = self._before(lo)
        left, bits = k - (ones if one else lo * BLOCK - ones), self._block(lo)
        if not one:
            bits ^= (1 << BLOCK) - 1
        for _ in range(left):
            bits &= bits - 1
        return lo * BLOCK + (bits & -bits).bit_length() - 1


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes with rank support."""

    def __init__(self, planes: list[Plane], size: int):
        self.planes, self.size = planes, size

    @classmethod
    def build(cls, values: np.ndarray, depth: int = 16) -> WaveletMatrix:
        planes = []
        here = values
        for b in range(depth - 1, -1, -1):
            bit = (here >> here.dtype.type(b)) & here.dtype.type(1) == 1
            packed = np.packbits(bit, bitorder="little")
            low = here[~bit]
            pieces = [packed[k : k + PIECE // 8].tobytes() for k in range(0, len(packed), PIECE // 8)]
            planes.append(Plane(len(values), len(low), pieces, Plane.tables_of(packed)))
            here = np.concatenate((low, here[bit]))
        return cls(planes, len(values))

    def values(self) -> np.ndarray:
        """The whole sequence, put back in order plane by plane from the lowest."""
        here = np.zeros(self.size, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            bit, z = self.planes[level].bits(), self.planes[level].zeros
            above = np.empty_like(here)
            above[~bit] = here[:z]
            above[bit] = here[z:] | here.dtype.type(1 << (len(self.planes) - 1 - level))
            here = above
        return here

    def access(self, pos: int) -> int:
        value = 0
        for plane in self.planes:
            ones, bit = plane.rank1(pos), plane.bit(pos)
            value = value << 1 | bit
            pos = plane.zeros + ones if bit else pos - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a value in [lo, hi) stand below the last plane."""
        if value >> len(self.planes):
            return 0, 0
        for level, plane in enumerate(self.planes):
            a, b = plane.rank1(lo), plane.rank1(hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = plane.zeros + a, plane.zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        hi = self.size if hi is None else min(hi, self.size)
        a, b = self._range(value, min(lo, hi), hi)
        return b - a

    def select(self, value: int, k: int) -> int:
        """The position of the occurrence number ``k`` (from 0) of a value, -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.size)
        if not 0 <= k < hi - lo:
            return -1
        pos = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one, plane = value >> (len(self.planes) - 1 - level) & 1, self.planes[level]
            pos = plane.select(one, pos - plane.zeros if one else pos)
        return pos

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def pack(tokens: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """A shard's file."""
    depth = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    matrix = WaveletMatrix.build(tokens, depth)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames = []
    for plane in matrix.planes:
        supers, blocks = plane.tables
        frames += [squeeze(p) for p in plane._pieces] + [squeeze(supers.astype("<i8").tobytes() + blocks.astype("<u2").tobytes())]
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    frames.append(squeeze(ids.tobytes() + starts.astype("<i8").tobytes() + null.tobytes()))
    header = {"tokens": len(tokens), "docs": len(doc_ids), "zeros": [p.zeros for p in matrix.planes], "frames": [len(f) for f in frames]}
    header = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames])


class Shard:
    """A shard's file, read frame by frame as they are needed: ``matrix`` answers access, count, select and occurrences."""

    def __init__(self, file: BinaryIO):
        self._file = file
        if file.read(4) != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", file.read(4))
        header = json.loads(file.read(size))
        n, self._docs = header["tokens"], header["docs"]
        self._ends = [8 + size + e for e in itertools.accumulate(header["frames"], initial=0)]
        self.unpacked = 0
        pieces = -(-n // PIECE)
        planes = []
        for level, zeros in enumerate(header["zeros"]):
            first = level * (pieces + 1)
            parts = [lambda k=first + p: self._frame(k) for p in range(pieces)]
            planes.append(Plane(n, zeros, parts, lambda k=first + pieces: self._ranks(k, n)))
        self.matrix = WaveletMatrix(planes, n)

    def _frame(self, k: int) -> bytes:
        self._file.seek(self._ends[k])
        self.unpacked += 1
        return zstandard.ZstdDecompressor().decompress(self._file.read(self._ends[k + 1] - self._ends[k]))

    def _ranks(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        data, entries = self._frame(k), -(-n // BLOCK) + 1
        supers = -(-entries // (SUPER // BLOCK))
        return np.frombuffer(data[: 8 * supers], "<i8"), np.frombuffer(data[8 * supers :], "<u2")

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(ids, starts) of the documents."""
        data, docs = self._frame(len(self._ends) - 2), self._docs
        ids = np.frombuffer(data[: 8 * docs], "<i8")
        starts = np.frombuffer(data[8 * docs : 16 * docs], "<i8")
        null = np.frombuffer(data[16 * docs :], np.uint8)
        return [None if x else int(d) for d, x in zip(ids, null)], starts


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """The ids of white-space separated pieces by the tokenizers library, each distinct one encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.units: dict[str, tuple[int, ...]] = {}

    def _plain(self, unit: str) -> tuple[int, ...]:
        """A run of letters, or of other signs, straight through the vocabulary's merges."""
        low = unit.lower()
        found = self.units.get(low)
        if found is None:
            text = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            found = self.units[low] = tuple(t.id for t in self.tokenizer.model.tokenize(text))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; where each text starts)."""
        if len(self.units) > KEPT_UNITS:
            self.units.clear()
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # The tokenizer drops white space, and no id spans it: texts are cut at blanks and line ends.
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = cut.values.dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy()
        parts = pc.extract_regex(pieces, PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(pc.struct_field(parts, "word").filter(pa.array(plain))).dictionary_encode()
        signs = pc.struct_field(parts, "signs").filter(pa.array(plain)).dictionary_encode()
        hard = pieces.filter(pa.array(~plain)).to_pylist()
        ids = [(END_ID,), *map(self._plain, words.dictionary.to_pylist())]
        first_sign = len(ids)
        ids += [self._plain(s) if s else () for s in signs.dictionary.to_pylist()]
        first_hard = len(ids)
        ids += [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)]
        # Each piece is a word and signs, or a hard piece and nothing; number 0 is the end of a text.
        unit, second = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1)
        unit[plain], second[plain] = words.indices.to_numpy() + 1, signs.indices.to_numpy() + first_sign
        unit[~plain] = np.arange(len(hard)) + first_hard
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        second[(second >= 0) & (size[second] == 0)] = -1
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, size.sum())
        flat = flat.astype(np.uint16) if self.tokenizer.get_vocab_size() <= 1 << 16 else flat
        start = np.cumsum(size) - size
        last = cut.offsets.to_numpy()[1:] - 1
        which = np.full((len(codes), 3), -1, np.int64)
        which[:, 0], which[:, 1] = unit[codes], second[codes]
        which[last, 2] = 0
        which = which[which >= 0]
        n = size[which]
        to = np.cumsum(n)
        tokens = flat[np.repeat(start[which] - (to - n), n) + np.arange(to[-1])]
        return tokens, np.append(0, to[which == 0])[:-1]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the shards' files into ``folder`` and return (part, shard, path, tokens, docs) of each.

    A task writes to a name of its own and then moves the file into place, so a repeated task does no harm.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        gc.disable()  # what a shard makes holds no cycles
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own, part, shard = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[str] = []
        size = 0

        def flush() -> pd.DataFrame:
            tokens, starts = own.encode(texts)
            name = f"part-{part:06d}-{shard:05d}.wvm"
            with fs.open_output_stream(spare := f"{root}/.{name}-{uuid.uuid4().hex}") as out:
                out.write(pack(tokens, ids, starts))
            fs.move(spare, f"{root}/{name}")
            return pd.DataFrame([(part, shard, f"{folder}/{name}", len(tokens), len(ids))], columns=COLUMNS)

        for f in frames:
            for d, t in zip(f["doc_id"].astype("Int64"), f["text"]):
                ids.append(None if d is pd.NA else int(d))
                texts.append(t or "")
                size += len(t or "")
                if size >= SHARD_CHARS:
                    yield flush()
                    ids, texts, size, shard = [], [], 0, shard + 1
        if ids:
            yield flush()
        gc.enable()
        _ENCODERS.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return cut(ordered.select("doc_id", "text").mapInPandas(run, "part int, shard int, path string, tokens long, docs long"))


COLUMNS = ["part", "shard", "path", "tokens", "docs"]


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards' files.

    ``start`` counts the ids of all documents before; the running sum is over one row for each shard.
    """
    before = F.sum("tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.select("path", F.coalesce(before, F.lit(0)).alias("before"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, offset in zip(f["path"], f["before"]):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    shard = Shard(file)
                    (ids, starts), values = shard.documents(), shard.matrix.values()
                ends = np.append(starts[1:], len(values))
                crc = [zlib.crc32(values[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends)]
                yield pd.DataFrame(
                    {"doc_id": pd.array(ids, "Int64"), "start": starts + offset, "n_tokens": ends - starts, "ids_crc32": crc}
                )

    width = max(1, shards.count())
    spread = placed.repartition(min(width, 1 << 14))
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_folder(spark) -> str:
    return f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
