"""Subword counts against another library's encoder of the same vocabulary, and round trips."""

import base64

import pytest
from pyspark.sql import functions as F

from textquarry.functions import tokens
from textquarry.operators import embed

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def other():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_all_documents(spark, other):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in docs.select("text", tokens.subword_count(PATH)("text").alias("n")).collect():
        assert r.n == (None if r.text is None else len(other.encode_ordinary(r.text)))
        if r.text:
            assert tokens.loaded(PATH).decode(tokens.loaded(PATH).encode(r.text).ids) == r.text


def test_odd_texts(spark, other):
    texts = ["", " ", "\n\n x", "😀é", "a" * 20_000, "don't  stop", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.n for r in df.select("i", tokens.subword_count(PATH)(F.col("text")).alias("n")).collect()}
    assert got == {i: None if t is None else len(other.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_counts_go_with_the_vectors(spark, other):
    df = spark.createDataFrame([(1, "some unusual words", None), (2, "kept", [1.0])], "id long, text string, embedding array<float>")
    got = embed.embed_pending(df, lambda: embed.HashingEmbedder(8), tokens.subword_count(PATH)).collect()
    assert [(r.id, r.token_count, len(r.embedding)) for r in got] == [(1, len(other.encode_ordinary("some unusual words")), 8)]


def test_few_texts_are_encoded_together():
    import pyarrow as pa

    texts = ["a" * 90_000, None, "b" * 90_000, "c" * 90_000, "", "d" * 500_000, "e", None]
    runs = list(tokens.together(pa.array(texts, pa.string())))
    assert [at for at, _ in runs] == [[0, 2, 3], [4, 5], [6]] and all(some == [texts[i] for i in at] for at, some in runs)
    assert list(tokens.together(pa.array([None], pa.string()))) == []
