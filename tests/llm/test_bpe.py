import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ratewise.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), PATTERN)


def texts(seed):
    r = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n ", "\t", " ", " ", "\x1c", "word", "Été", "'s", "'ll", "don't", "12", "3.5", "!?", "...", "日本", "🙂", "<|endoftext|>", "\x85"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 400))) for _ in range(60)]


def test_pieces_give_the_ids_of_the_whole(codec, monkeypatch):
    for piece in (1, 2, 7, 50):
        monkeypatch.setattr(bpe, "PIECE_CHARS", piece)
        for t in texts(piece):
            assert "".join(codec.pieces(t)) == t
            assert codec.encode(t) == codec.encoding.encode_ordinary(t)


def digests(codec, text):
    ids = codec.encoding.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_round_trip(spark, codec):
    rows = [(i, t, 1) for i, t in enumerate([*texts(99), None, "", " ", "a" * 100_000, "a b " * 60_000, "é́\n" * 30_000, "x", "x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH, PATTERN).collect()}
    assert got == {i: digests(codec, t) for i, t, _ in rows}
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0
    ids = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    assert ids.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert ids.where(F.col("doc_id") == len(rows) - 1).first().ids == codec.encode("x")


def test_bytes_that_are_not_utf8(spark, codec):
    df = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    r = bpe.round_trip(df, PATH, PATTERN).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(codec, "ok ��")


def test_raw_bytes_decode(codec):
    whole = codec.encode("日本語🙂")
    assert b"".join(codec.decode([i]) for i in whole) == "日本語🙂".encode()     # ids that cut characters too
    assert isinstance(codec.encoding, tiktoken.Encoding)
