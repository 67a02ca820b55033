import io
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hyperweave.llm import wavelet as wv

from .helpers import empty, odd

PATH = P.path("word_bpe_49k.json")
TEXTS = [
    "", "  a  b\n\n c", "x\ty  z", "don't we'll\n", "日本語 テキスト\r\nok", "é́x 12345 !!\n", "\x00a b", "<|endoftext|> X<|ENDOFTEXT|>",
    "J̌ ΑΣ ΣΑΣ İ", "a b\x1cc\x85d", "ÀÉ... ß!! Ÿ", "The THE the. the, (the) 'the' it's",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=80))
def test_matrix(values):
    data = np.array(values, np.uint32)
    shard = wv.Shard(io.BytesIO(wv.pack(data, [3, None], np.array([0, len(values)]))))
    m, (ids, starts) = shard.matrix, shard.documents()
    assert m.values().tolist() == values and ids == [3, None] and starts.tolist() == [0, len(values)]
    for i, v in enumerate(values):
        assert m.access(i) == v
    for v in set(values[:5]) | {1}:
        assert m.count(v) == values.count(v)
        assert m.occurrences(v) == [i for i, x in enumerate(values) if x == v]
        assert m.select(v, values.count(v)) == -1
        assert m.count(v, 2, max(2, len(values) - 1)) == values[2 : max(2, len(values) - 1)].count(v)


def test_large_matrix_reads_parts_only():
    data = np.random.default_rng(1).integers(0, 50_000, 1_500_000).astype(np.uint16) ** 2 % 49_000
    shard = wv.Shard(io.BytesIO(wv.pack(data, [1], np.array([0]))))
    m, frames = shard.matrix, len(shard._ends) - 1
    for pos in (0, 511, 512, 65_535, 65_536, 524_288, 1_499_999):
        assert m.access(pos) == data[pos]
    value = int(data[700_000])
    where = np.flatnonzero(data == value)
    assert m.count(value) == len(where) and m.occurrences(value) == where.tolist()
    assert m.count(value, 1000, 900_000) == ((where >= 1000) & (where < 900_000)).sum()
    fresh = wv.Shard(io.BytesIO(wv.pack(data, [1], np.array([0]))))
    assert fresh.matrix.access(9) == data[9] and fresh.unpacked <= 3 * len(m.planes) < frames


def test_ids_equal_the_library():
    own, lib = wv.word_encoder(PATH), Tokenizer.from_file(PATH)
    tokens, starts = own.encode(TEXTS)
    for text, s, e in zip(TEXTS, starts, np.append(starts[1:], len(tokens))):
        assert tokens[s:e].tolist() == [*lib.encode(text, add_special_tokens=False).ids, wv.END_ID], text


def check(spark, docs, tmp_path):
    shards = wv.write_shards(docs, f"file://{tmp_path}/w", PATH)
    rows = sorted(wv.read_shards(shards).collect(), key=lambda r: r.start)
    lib, at = Tokenizer.from_file(PATH), 0
    left = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(rows) == len(left)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        own = [t for d, t in left if d == r.doc_id]
        want = [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in own]
        assert (r.n_tokens, r.ids_crc32) in [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_whole_table(spark, sf_dir, tmp_path):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), tmp_path)


def test_odd_rows(spark, tmp_path):
    check(spark, odd(spark), tmp_path)
    assert wv.read_shards(wv.write_shards(empty(spark), f"file://{tmp_path}/e", PATH)).count() == 0


def test_small_shards(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(wv, "SHARD_CHARS", 5000)
    check(spark, docs, tmp_path)
