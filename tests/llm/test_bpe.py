import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from hyperweave.llm import bpe

from .helpers import empty, odd

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "  a  b\n\n c", "a \n b", "x\ty  z", " lead", "trail ", "trail  ", "don't we'll\n", "a" * 3000, "ab" * 90, "日本語 テキスト\r\nok",
    "é́x 12345 !!\n", "\x00a b", "\x01", "one\n\ntwo\n three four five", "Ünïcode straße ÇA 😀😀 ok", "anea.\nThe and, of!! the | pipe\n",
]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_ids_equal_the_library(tik):
    own = bpe.encoder(PATH, P.PATTERN)
    for text, (n, ids, raw) in zip(TEXTS, own.digests(TEXTS)):
        want = tik.encode_ordinary(text)
        assert (n, ids, raw) == (len(want), digest(want), hashlib.sha256(text.encode()).hexdigest()), text
        assert own.encode(text) == want and own.decode(want) == text.encode()


def test_a_kept_piece_gives_the_same_again():
    own = bpe.encoder(PATH, P.PATTERN)
    assert own.digests(TEXTS) == own.digests(TEXTS)


def test_long_runs_of_letters(tik):
    own = bpe.encoder(PATH, P.PATTERN)
    rnd = random.Random(3)
    han = ["".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(64)) for _ in range(10_000)]
    latin = "".join(rnd.choice("etaoinshrdlu") for _ in range(100_000))
    same = [s * (100_000 // len(s)) for s in ("a", "ab", "the", "lol", "AAAAB", "ACGT", "anandsoare")]
    texts = [" ".join(han), "".join(han[:600]), latin, *same]
    for text, (n, ids, raw) in zip(texts, own.encoded(texts)):
        want = tik.encode_ordinary(text)
        assert n == len(want) and ids == ",".join(map(str, want)).encode() and raw == text.encode(), text[:40]


def test_texts_of_vocabulary_entries(tik):
    own = bpe.encoder(PATH, P.PATTERN)
    rnd = random.Random(4)
    entries = [t.decode("utf-8", "ignore") for t in own.ranks]
    texts = ["".join(rnd.choice(entries) for _ in range(rnd.randrange(1, 40))) for _ in range(2000)]
    assert [ids for _, ids, _ in own.encoded(texts)] == [",".join(map(str, tik.encode_ordinary(t))).encode() for t in texts]


def test_decoding_reads_the_ids(tik):
    own = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    own.db.execute("UPDATE vocabulary SET hex = '2a' WHERE id = ?", [own.ranks[b" cat"]])
    assert [raw for _, _, raw in own.encoded(["the cat the"])] == [b"the* the"]


def test_whole_table(spark, sf_dir, tik):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encoded_digests(docs, PATH, P.PATTERN).collect()}
    for d in docs.collect():
        want = tik.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), digest(want), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_odd_rows(spark):
    got = sorted((r.doc_id or -1, r.n_tokens) for r in bpe.encoded_digests(odd(spark), PATH, P.PATTERN).collect())
    assert len(got) == 8 and got[1] == (1, 0) and got[2] == (2, 0)
    assert bpe.encoded_digests(empty(spark), PATH, P.PATTERN).count() == 0
    whole = bpe.encoded(odd(spark), PATH, P.PATTERN).collect()
    assert len(whole) == 8 and all(len(r.ids) == r.n_tokens and digest(r.ids) == r.ids_sha256 for r in whole)
