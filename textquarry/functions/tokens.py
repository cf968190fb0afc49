"""Token counts by a model's own tokenizer, from a tokenizer file that the caller names."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of texts that are encoded together; what the tokenizer makes of them takes some hundred times that in bytes.
TOGETHER = 200_000


def together(batch: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """(places, texts) of the texts that aren't null, in runs of about TOGETHER characters."""
    at, texts, size = [], [], 0
    for i, x in enumerate(batch):
        if not x.is_valid:
            continue
        at.append(i)
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= TOGETHER:
            yield at, texts
            at, texts, size = [], [], 0
    if at:
        yield at, texts


@lru_cache(maxsize=4)
def loaded(path: str):
    """The tokenizer of a file; a worker process loads it once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def subword_count(path: str, specials: bool = True) -> Callable[[Column | str], Column]:
    """How many tokens a text has, whole, with what the tokenizer adds around it or without. Null where the text is null.

    The form that `embed_pending` and `embed_in_place` take for `tokens`. The file lies at the same path on all machines.
    """

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = loaded(path)
        for batch in batches:
            out: list[int | None] = [None] * len(batch)
            for at, texts in together(batch):
                for i, made in zip(at, tokenizer.encode_batch_fast(texts, add_special_tokens=specials)):
                    out[i] = len(made)
            yield pa.array(out, pa.int32())

    return lambda text: count(F.col(text) if isinstance(text, str) else text)
