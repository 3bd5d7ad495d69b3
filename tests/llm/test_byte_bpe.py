"""Byte-level BPE against the tiktoken library, and decoding as its inverse."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def texts():
    rng = random.Random(3)
    scripts = [range(32, 127), range(0x80, 0x3000), range(0x4E00, 0x9FFF), range(0x10000, 0x32000)]
    mixed = ["".join(chr(rng.choice(rng.choice(scripts))) for _ in range(rng.randrange(300))) for _ in range(150)]
    letters = ["".join(rng.choices("etaoinsh", k=rng.randrange(1, 60))) for _ in range(400)]
    hand = ["\x00", "\x00\x01\x02 a\x00b a\x00c", "", " ", "\n\n  x 's don't  I'LL  ", "<|endoftext|>", "\x00\x01   é 　 ", "a" * 3000, "=" * 700, "日本語" * 200, "  \t\r\n", "1234567890" * 30]
    bounds = ["".join(rng.choices("abcdefgh+/09", k=n)) for n in (1, 2, 3, 511, 512, 513, 514, 2000)]
    return hand + bounds + mixed + [" ".join(letters)]


def split(flat, count):
    return [part.tolist() for part in np.split(flat, np.cumsum(count)[:-1])]


@pytest.mark.parametrize("limit", [1, 512])
def test_same_ids_as_the_library(library, words, monkeypatch, limit):
    monkeypatch.setattr(byte_bpe, "WIDEST", limit)
    given = texts()
    got = split(*byte_bpe.Encoder(words).texts(given))
    assert got == [library.encode_ordinary(t) for t in given]


def test_every_code_point(library, words):
    """Both engines cut alike, also where their Unicode tables differ."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    given = ["".join(map(chr, every[k : k + 997])) for k in range(0, len(every), 997)]
    assert split(*byte_bpe.Encoder(words).texts(given)) == [library.encode_ordinary(t) for t in given]


def test_blocks_and_forgetting(library, words, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_PIECES", 7)
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 20)
    given = texts()[:60] + [" ".join(map(str, range(500)))]
    encoder = byte_bpe.Encoder(words)
    assert split(*encoder.texts(given)) == [library.encode_ordinary(t) for t in given]


def test_pair_table():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 3000, (4000, 2)), axis=0)
    table = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    want = {(a, b): k for k, (a, b) in enumerate(pairs.tolist())}
    ask = np.concatenate([pairs, rng.integers(-1, 3000, (20000, 2))]).astype(np.int32)
    none = int(byte_bpe.NO_PAIR)
    assert table.rank(ask[:, 0], ask[:, 1]).tolist() == [want.get((a, b), none) for a, b in ask.tolist()]
    assert [table.rank_of(a, b) for a, b in ask[:5000].tolist() if min(a, b) >= 0] == [want.get((a, b), none) for a, b in ask[:5000].tolist() if min(a, b) >= 0]


def test_small_vocabulary():
    """A vocabulary of bytes alone, and one whose ranks are neither dense nor in order of length."""
    single = {bytes([b]): 255 - b for b in range(256)}
    some = single | {b"ab": 900, b"bc": 700, b"abc": 800, b"cc": 1000, b"bcc": 650}
    rng = random.Random(8)
    given = ["".join(rng.choices("abc ", k=30)) for _ in range(200)]
    for ranks in (single, some):
        engine = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        got = split(*byte_bpe.Encoder(byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)).texts(given))
        assert got == [engine.encode_ordinary(t) for t in given]


def test_rows(spark, library):
    """Nulls, empties, bad bytes, repeated rows, clashing names, a null id; decoding gives the bytes back."""
    given = [(1, "a text", "x"), (1, "a text", "x"), (2, None, None), (3, "", "y"), (None, "ünïcode  日本", "z"), (4, "word " * 20000, "w")]
    docs = spark.createDataFrame(given, "doc_id long, text string, ids string").repartition(3)
    vocabulary = byte_bpe.vocabulary(docs, PATH, public_tokenizers.PATTERN)
    coded = byte_bpe.encode(docs.withColumn("__t", F.lit(1)), vocabulary)
    assert sorted(coded.columns) == ["__t", "doc_id", "ids"]
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in given), key=str)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == want
    back = byte_bpe.decode(coded, vocabulary).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=str) == sorted(((i, (t or "").encode()) for i, t, _ in given), key=str)
    bad = docs.limit(1).select(F.unhex(F.lit("61FF62")).cast("string").alias("text"))
    assert byte_bpe.encode(bad, vocabulary).first().ids == library.encode_ordinary("a�b")
    odd = spark.createDataFrame([([], ), (None,), ([None, 1, 10**6],)], "ids array<int>")
    assert sorted(len(r.decoded) for r in byte_bpe.decode(odd, vocabulary).collect()) == [0, 0, 1]
    assert byte_bpe.encode(docs.where("doc_id > 99"), vocabulary).count() == 0


def test_vocabulary_file(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="byte"):
        byte_bpe.read_ranks(str(path))


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = set()
    for doc in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(doc.text or "")
        digest = [hashlib.sha256(b).hexdigest() for b in (",".join(map(str, ids)).encode(), (doc.text or "").encode())]
        want.add((doc.doc_id, len(ids), *digest))
    assert {tuple(r) for r in queries.op11_byte_bpe(spark, sf).collect()} == want
