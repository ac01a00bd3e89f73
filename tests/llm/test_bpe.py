import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tabtwin.llm.bpe import decode_ids, encode_texts, encoder, fold_merges, read_ranks
from tabtwin.llm.queries import QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizer()[0]), special_tokens={})


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op5_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_texts(spark, library):
    texts = [None, "", " ", "\n\n  a", "x" * 3000, "it's  we'll\t\t<|endoftext|>", "日本語 текст 🎈🎈   x", "\x00\x1c\x85 é", "1²३ ⅷ"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    out = decode_ids(encode_texts(df, *tokenizer()), tokenizer()[0]).collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert encode_texts(df.limit(0), *tokenizer()).count() == 0


def test_fold_equals_library(spark, library):
    words = [" thorreou", "retitioning", "éèô", "a", " the", "zzzzzzzz", "日本"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    ranks = read_ranks(tokenizer()[0])
    for r in df.select("word", fold_merges(F.encode("word", "utf-8"), ranks).alias("ids")).collect():
        assert r.ids == library.encode_ordinary(r.word)


def test_long_pre_tokens(spark, library):
    rng = random.Random(4)
    coder = encoder(*tokenizer())
    for n in (257, 1000, 4000):
        for raw in (bytes(rng.choices(b"etaoin", k=n)), b"a" * n, "é日x".encode() * (n // 6)):
            assert coder._fold_long(raw) == coder._fold_one(raw)
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (300, 300, 20_000)] + ["zq" * 15_000]
    out = decode_ids(encode_texts(spark.createDataFrame([(w,) for w in words], "text string"), *tokenizer()), tokenizer()[0]).collect()
    assert [r.ids for r in out] == [library.encode_ordinary(r.text) for r in out]
    assert [bytes(r.decoded).decode() for r in out] == [r.text for r in out]
    huge = coder._fold_long(bytes(rng.choices(b"etaoinshrdlu", k=300_000)))       # n log n: a square would take hours
    assert 0 < len(huge) // 4 < 300_000


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    pieces = {rank: token for token, rank in read_ranks(tokenizer()[0]).items()}
    assert [bytes(r.decoded) for r in decode_ids(df, tokenizer()[0]).collect()] == [b"", b"", pieces[0] + pieces[1]]
    for bad in (-1, 10**7):
        with pytest.raises(Exception, match="no such token"):
            decode_ids(spark.createDataFrame([([0, bad],)], "ids array<int>"), tokenizer()[0]).collect()
