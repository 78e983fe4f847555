"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL, same_rows

from pyspark.sql import functions as F

from lectern.llm import byte_bpe
from lectern.llm.queries import QUERIES, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "  \n\t x", "Hello world", "it's we'll I'M don't", "\u00e9t\u00e9 \u65e5\u672c\u8a9e \U0001f600\u200d\U0001f525", "<|endoftext|> <|x|>", "a" * 5000, "ab" * 3001 + "c", " " * 3000 + "x",
    "x\x1cy\x1f z\x85 \u3000\u200b", "12345678901234567890", "....!!!??? ---", "zq" * 40, "\r\n\r\n a \r\n", "\x00\x01 \x7f", "e\u0301 \ufb01 \u2460 \u0660\u0661", "sk0123456789abcdefghijAB",
]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(FILE, public_tokenizers.PATTERN)


def test_the_hash_is_minimal_and_perfect(vocabulary):
    own = vocabulary.hash
    keys = [base64.b64decode(line.split()[0]) for line in open(FILE, "rb")]
    assert sorted(own.find(keys).tolist()) == list(range(len(keys)))
    strangers = [k + b"\0" for k in keys[:500]] + [b"", b"\0", b"no such token", b"x" * 500]
    assert (own.find([k for k in strangers if k not in set(keys)]) == -1).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_hashes_of_few_keys(n):
    keys = [b"\0" * k if k < 20 else str(k).encode() + b"x" * (k % 9) for k in range(n)]
    own = byte_bpe.PerfectHash(keys)
    assert sorted(own.find(keys).tolist()) == list(range(n)) and own.find([b"never"]).tolist() == [-1]
    with pytest.raises(ValueError, match="distinct"):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_ids_are_the_librarys(vocabulary, library, monkeypatch):
    rng = random.Random(7)
    letters = "abcdefgh '\u00e9\u00df\n\t.1\u0663\u4e2d\U0001f600"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2000)]
    coder = vocabulary.coder()
    want = library.encode_ordinary_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want
    monkeypatch.setattr(byte_bpe, "LONG", 20)
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want
    assert [coder.decode(x).decode() for x in coder.encode(texts)] == texts


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError, match="byte 7"):
        byte_bpe.Vocabulary({bytes([b]): b for b in range(256) if b != 7}, "x")


def test_rows(spark, vocabulary, library):
    rows = [(k % 15 if k != 4 else None, x, 1, "d") for k, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    for packed in (False, True):
        got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids, bytes(r.decoded)) for r in byte_bpe.encode_bytes(docs, vocabulary, packed=packed).collect()]
        want = [(i, library.encode_ordinary(x or ""), (x or "").encode()) for i, x, *_ in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert byte_bpe.encode_bytes(docs.limit(0), vocabulary).count() == 0


def test_query(spark, library):
    got = QUERIES["op13_byte_bpe"](spark, SMALL).toPandas()
    want = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toPandas()
    ids = library.encode_ordinary_batch(want.text.tolist())
    want["n_tokens"] = [len(x) for x in ids]
    want["ids_sha256"] = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]
    want["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in want.text]
    same_rows(got, want.drop(columns="text"))
