"""Toxicity by a factorization machine over hashed terms.

Terms are a text's different words and the prefixes of its longer words, hashed
to BUCKETS. Training takes a bounded sample of the labelled rows (MAX_TRAIN, by
digest of the id). From it the buckets whose share differs most between the two
labels are kept (a two-proportion z of at least MIN_Z, MAX_TERMS at most), and
further those of pairs of terms that tell nothing alone but together; on
them the machine learns a bias, a weight for each term and a factor vector for
each term, whose inner products are the weights of pairs. So two terms that are
harmless alone can count together. Terms count once a text, and a term that tells
nothing has no weight, so a long text isn't drowned.

Null and empty texts have no terms and get the bias's score. Labels that are null
are not trained on. Without labelled rows of both kinds, every score is the share
of label 1 among them, or 0. Repeated rows are scored alike; labels, language,
source and id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free, read, remainder, written

BUCKETS = 1 << 20
#: Of the commonest PAIR_TERMS terms that tell nothing alone, those in at least PAIR_ROWS rows: pairs from PAIR_Z on, MAX_PAIRS at most.
PAIR_TERMS, PAIR_ROWS, PAIR_Z, MAX_PAIRS = 1000, 20, 6.0, 128
MAX_TRAIN, MAX_TERMS, MIN_Z = 16_000, 1024, 4.0
FACTORS, EPOCHS, BATCH, RATE, L2 = 8, 40, 256, 0.1, 1e-5
THRESHOLD = 0.7
#: Everything but digits, a-z and what isn't ASCII separates words.
SEPARATE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PREFIXES = (4, 5, 6, 7)
#: A worker forgets its words when it knows so many.
MAX_CACHE = 200_000


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").lower().translate(SEPARATE).split())


def buckets_of(word: bytes) -> tuple[int, ...]:
    return (zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"^" + word[:n]) % BUCKETS for n in PREFIXES if len(word) > n))


def terms(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((b for w in words_of(text) for b in buckets_of(w)), np.int32))


@dataclass
class Machine:
    buckets: np.ndarray  # sorted; column i of the model is buckets[i]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, columns: np.ndarray) -> float:
        y = self.bias
        if len(columns):
            v = self.factors[columns]
            y += self.weights[columns].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def chosen(rows: DataFrame, min_z: float = MIN_Z, most: int = MAX_TERMS) -> np.ndarray:
    """The buckets whose share differs most between the labels, from counts that are summed up in the tasks. rows: (tq_label, tq_terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for y, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[y][np.frombuffer(packed, np.int32)] += 1  # a text's terms are different ones
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some].astype(np.int64)), pa.array(total[1][some].astype(np.int64))], ["bucket", "n0", "n1"])

    n = {r.tq_label: r.n for r in rows.groupBy("tq_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not (n0 and n1):
        return np.zeros(0, np.int32)
    sums = rows.select("tq_label", "tq_terms").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    sums = sums.where("n0 + n1 >= 3").withColumn("z", z)
    best = {r.bucket for r in sums.where(F.col("z") >= min_z).orderBy(F.desc("z"), "bucket").limit(most).collect()}
    plain = sums.where((F.col("z") < min_z) & (F.col("n0") + F.col("n1") >= PAIR_ROWS)).orderBy(F.desc(F.col("n0") + F.col("n1")), "bucket").limit(PAIR_TERMS).collect()
    plain = np.array(sorted(r.bucket for r in plain), np.int32)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros((2, len(plain), len(plain)), np.float32)  # exact up to 2 ** 24 rows
        for batch in batches:
            x = np.zeros((batch.num_rows, len(plain)), np.float32)
            for i, packed in enumerate(batch.column(1).to_pylist()):
                x[i, np.flatnonzero(np.isin(plain, np.frombuffer(packed, np.int32), assume_unique=True))] = 1
            labels = batch.column(0).to_numpy()
            for y in (0, 1):
                together[y] += x[labels == y].T @ x[labels == y]
        a, b = np.triu_indices(len(plain), 1)
        c0, c1 = together[0][a, b], together[1][a, b]
        share = np.clip((c0 + c1) / (n0 + n1), 1e-12, 1 - 1e-12)
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
        z[c0 + c1 < PAIR_ROWS] = 0
        top = np.argsort(-z, kind="stable")[:MAX_PAIRS]
        top = top[z[top] >= PAIR_Z]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.append(plain[a[top]], plain[b[top]])).astype(np.int64))], ["bucket"])

    # The sample is bounded, so one task can hold it; of the pairs only their terms come to the driver.
    if len(plain) > 1:
        best |= {r.bucket for r in rows.select("tq_label", "tq_terms").coalesce(1).mapInArrow(pairs, "bucket long").collect()}
    return np.array(sorted(best), np.int32)


def trained(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over small batches. rows: the terms of each text, of which those in buckets count."""
    rate = float(labels.mean()) if len(labels) else 0.0
    prior = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    d, rng = len(buckets), np.random.default_rng(seed)
    m = Machine(buckets, prior, np.zeros(d), rng.normal(0, 0.02, (d, FACTORS)))
    if not d:
        return m
    x = np.zeros((len(rows), d), np.uint8)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(buckets, r[np.isin(r, buckets, assume_unique=True)])] = 1
    gw, gv, gb = np.full(d, 1e-8), np.full((d, FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            xs, y = x[order[at : at + BATCH]].astype(np.float64), labels[order[at : at + BATCH]]
            sums = xs @ m.factors
            out = m.bias + xs @ m.weights + 0.5 * ((sums**2).sum(1) - (xs @ m.factors**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
            dw = xs.T @ error + L2 * m.weights
            dv = xs.T @ (error[:, None] * sums) - (xs.T @ error)[:, None] * m.factors + L2 * m.factors
            db = error.sum()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            m.weights -= RATE * dw / np.sqrt(gw)
            m.factors -= 0.3 * RATE * dv / np.sqrt(gv)
            m.bias -= RATE * db / np.sqrt(gb)
    return m


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN) -> Machine:
    """The machine for labelled rows outside the held-out third. Of the bounded sample, the chosen terms come to the driver."""
    bounded_batches(docs.sparkSession)
    sample = labels.select(F.col(doc_id).alias("tq_id"), F.col(label).cast("int").alias("tq_label")).where("tq_label in (0, 1) and tq_id is not null")
    sample = sample.where(remainder("tq_id", 3) != 1).orderBy(F.xxhash64("tq_id"), "tq_label").limit(most)
    # At most MAX_TRAIN rows of two numbers.
    joined = docs.select(F.col(doc_id).alias("tq_id"), F.col(text).alias("tq_text")).join(F.broadcast(sample), "tq_id")

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([terms(t).tobytes() for t in batch.to_pylist()], pa.binary())

    rows = written(joined.select("tq_id", "tq_label", packed("tq_text").alias("tq_terms")), "terms")
    buckets = chosen(rows)

    @F.arrow_udf("binary")
    def selected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.intersect1d(np.frombuffer(t, np.int32), buckets, assume_unique=True).tobytes() for t in batch.to_pylist()], pa.binary())

    # A few of MAX_TERMS terms of each text; in one order, whatever order they come in, so that reruns agree.
    got = sorted((r.tq_id, r.tq_label, bytes(r.terms)) for r in rows.select("tq_id", "tq_label", selected("tq_terms").alias("terms")).orderBy("tq_id", "tq_label", "terms").limit(2 * most).collect())
    return trained([np.frombuffer(t, np.int32) for _, _, t in got], np.array([y for _, y, _ in got], np.float64), buckets)


def toxicity(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text as `out` (or free(docs, out)). The machine has at most MAX_TERMS terms."""
    spark, out = docs.sparkSession, free(docs, out)
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast((machine.buckets, machine.bias, machine.weights, machine.factors))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Machine(*shipped.value)
        column = {int(b): i for i, b in enumerate(m.buckets)}
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for t in batch.to_pylist():
                found: set[int] = set()
                for w in words_of(t):
                    if (c := known.get(w)) is None:
                        if len(known) >= MAX_CACHE:
                            known.clear()
                        c = known[w] = tuple(column[b] for b in buckets_of(w) if b in column)
                    if c:
                        found.update(c)
                scores.append(m.score(np.array(sorted(found), np.int64)))
            yield pa.array(scores, pa.float64())

    return docs.withColumn(out, score(docs[text]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learned(docs, read(spark, sf_dir, "labels"))
    scored = toxicity(docs, machine)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
