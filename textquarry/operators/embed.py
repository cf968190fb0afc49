"""Embeddings of pending rows through a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

# What is put before a passage and a query, and the size of a vector.
PASSAGE, QUERY, DIMENSION = "passage: ", "query: ", 1024


class Embedder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> list[list[float] | None]:
        """A vector of length 1 for each text; None where a text can't be encoded."""


class HashingEmbedder:
    """Words counted by bucket, the first 16 bits of a digest modulo the dimension. A text without words has no direction and stays pending."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        known: dict[str, int] = {}  # a batch's words are digested once
        for text in texts:
            words = text.split()
            for word in words:
                if word not in known:
                    known[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dimension
            v = np.bincount([known[w] for w in words], minlength=self.dimension).astype(np.float64)
            size = np.sqrt((v * v).sum())
            out.append((v / size).tolist() if size else None)
        return out


def embedded(text: Column | str, make: Callable[[], Embedder], prefix: str = PASSAGE) -> Column:
    """The vector of each text; `make` runs once for each worker task, and a batch goes to the model at once."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in batches:
            texts = batch.to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            try:
                found = model.encode([prefix + texts[i] for i in at])
            except Exception:  # one at a time, so that only the text that fails stays without a vector
                found = []
                for i in at:
                    try:
                        found += model.encode([prefix + texts[i]])
                    except Exception:
                        found.append(None)
            for i, v in zip(at, found):
                out[i] = v
            yield pa.array(out, pa.list_(pa.float32()))

    return run(F.col(text) if isinstance(text, str) else text)


def of_size(vector: Column, dimension: int | None) -> Column:
    """vector; an error where it hasn't `dimension` elements."""
    if dimension is None:
        return vector
    told = F.raise_error(F.concat(F.lit("a vector of "), F.size(vector).cast("string"), F.lit(f" elements where {dimension} are stored"))).cast("array<float>")
    return F.when(vector.isNull() | (F.size(vector) == dimension), vector).otherwise(told)


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding is null").select("id", "text")


def embed_pending(chunks: DataFrame, make: Callable[[], Embedder], tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """(id, embedding, token_count) of the rows without a vector that could be encoded. Tokens are counted without the prefix."""
    rows = pending(chunks)
    return rows.select("id", embedded("text", make).alias("embedding"), tokens(F.col("text")).cast("int").alias("token_count")).where("embedding is not null")


def apply_embeddings(chunks: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """chunks with the new vectors and token counts written in, by id."""
    now = F.current_timestamp() if now is None else now
    new = new.select("id", F.col("embedding").alias("n_embedding"), F.col("token_count").alias("n_tokens"))
    changed = {"embedding": F.coalesce("n_embedding", "embedding"), "token_count": F.coalesce("n_tokens", "token_count"), "updated_at": F.when(F.col("n_embedding").isNotNull(), now).otherwise(F.col("updated_at")) if "updated_at" in chunks.columns else None}
    return chunks.join(new, "id", "left").select(*(changed[c].alias(c) if changed.get(c) is not None else F.col(c) for c in chunks.columns))


def embed_in_place(chunks: DataFrame, make: Callable[[], Embedder], tokens: Callable[[Column], Column] = word_count, now: Column | None = None, dimension: int | None = None) -> DataFrame:
    """chunks with vectors where they had none, in one pass: the model sees only the texts without one. A vector of another size than `dimension` is an error."""
    now = F.current_timestamp() if now is None else now
    new, rows = F.col("tq_new"), chunks.withColumn("tq_new", embedded(F.when(F.col("embedding").isNull(), F.col("text")), make))
    changed = {"embedding": F.coalesce(F.col("embedding"), of_size(new, dimension)), "token_count": F.when(new.isNotNull(), tokens(F.col("text")).cast("int")).otherwise(F.col("token_count")), "updated_at": F.when(new.isNotNull(), now).otherwise(F.col("updated_at"))}
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in chunks.columns))
