"""Pieces of token files: few texts for the library, starts on odd characters, and the coder's words."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from textquarry.llm import rangecoder, tokenids

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_library_gets_new_pieces_joined(monkeypatch):
    """5,000 new words are a few texts for the library, each of which costs it more than a word, and have the ids of the whole text."""
    whole, given = tokenids.tokenizer(PATH), []

    class Counting:
        def __getattr__(self, name):
            return getattr(whole, name)

        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(tokenids, "tokenizer", lambda path: Counting())
    tokenids.remembered.cache_clear()
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(5000)]
    text = " ".join(words)
    got = tokenids.encode([text], PATH, "<u2")
    tokenids.remembered.cache_clear()
    assert np.frombuffer(got[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(given) < 50


ODD = [" ", "  ", "\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", " ", " ", " ", "　", "、", "​", "﻿", "×", "÷", "ª", "µ", "é", "ɏ", "ʰ", "слово", "中", "한", "😀", "a", "B", "don't", "'", "'s", "'ll", "'é", "12", "²", "٣", "<|endoftext|>", "<|", "endoftext", "|>", "--", "_", ".", "word", "́", "\x00", "\x7f", "@"]


@pytest.mark.parametrize("most", [tokenids.REMEMBERED, 100])
def test_arrays_of_odd_texts_have_the_ids_of_whole_texts(most):
    rng = random.Random(3)
    texts = [None, "left out"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 14))) for _ in range(6000)] + [None, "", "x" * 5000]
    known, whole = tokenids.Pieces(PATH, "<u2", 2), tokenids.tokenizer(PATH)
    array = pa.concat_arrays([pa.array(texts[:1], pa.string()), pa.array(texts).slice(2)])
    for part in (array, array.slice(17), array.slice(0, 0), array.slice(5000, 40)):
        want = [e.ids + [2] for e in whole.encode_batch_fast([t or "" for t in part.to_pylist()], add_special_tokens=False)]
        assert [np.frombuffer(i, "<u2").tolist() for i in tokenids.encoded_array(part, known, most=most).to_pylist()] == want
        uncut = tokenids.Pieces(PATH, "<u2", 2)
        assert [np.frombuffer(i, "<u2").tolist() for i in tokenids.encoded_array(part, uncut, cut=False).to_pylist()] == want


def test_coder_keeps_its_words():
    """Files written before are read as they were: the words are those of the first version of the coder."""
    ids = np.minimum(np.random.RandomState(1).geometric(0.003, 20_000), 60_000)
    ids[5000:9000] = np.tile(ids[:40], 100)
    made = rangecoder.encode(ids, 1024)
    assert hashlib.sha256(made[4].tobytes()).hexdigest() == "0a9ed2d82a6433ba855f1d56ba809d3821841265c42542a741d91d2d0e4219d0"
    assert (rangecoder.decode(*made) == ids).all()
