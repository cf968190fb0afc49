"""Language-model scores from a hierarchical Pitman-Yor model.

A token is a word or the end of its text. The word before it chooses its context
restaurant, one of CONTEXTS by digest: the common words have one nearly to
themselves, and rare ones share it. All of them share one parent restaurant, whose own parent is uniform over the V known
tokens and one unknown. In the context restaurant u a token's customers are its
occurrences after u in the training texts, its tables are customers of the
parent restaurant there. The predictive probability is

    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + C_u)

and P(w) likewise from the parent's customers and tables and 1 / (V + 1).

Seating is sampled by Gibbs sweeps: in each sweep all customers of a dish are
taken out and seated again one after another by the Chinese restaurant process,
given what the rest of the model was after the sweep before. Probabilities are
averaged over the sweeps after the first BURN_IN. Arrivals after the first EXACT
of a dish are seated in runs that grow in proportion to those already seated.

How it is spread out: texts are read in blocks of at most BLOCK_BYTES of one
file split. A block tells each shard of the vocabulary which tokens and pairs it
needs, with their counts in its training texts; a shard is a range of token
digests, so that a frequent token is one entry for each block. Shards merge their
counts, sample their seating, and answer each block. What is asked is shuffled
once, to the shards' folders, and answers once, to the blocks' folders. A sweep needs of the other
shards only the restaurants' totals, which are CONTEXTS numbers and recorded;
a seating is a function of counts, totals and seed, and is sampled again where
it is needed instead of being stored, so a lost executor changes nothing.
What comes to the driver is totals; what a task holds is a block or a shard.

Null and empty texts have one token, the end. Null ids train (the digest is that
of the empty text). Repeated rows count as often as they occur. Other columns are
not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, read, remainder, scratch
from .warc import opened

CONTEXTS = 1 << 16
SWEEPS, BURN_IN, EXACT, SEED = 4, 1, 64, 11
STRENGTH = 1.0
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 3 << 20

CONTEXT_BITS = np.uint64(16)
LOW = np.uint64(CONTEXTS - 1)
#: Folders of a table at most; more blocks or shards than that share them.
MAX_FOLDERS = 20_000
END = xxhash.xxh3_64_intdigest(b"\n")  # no word has a line end


class Block:
    """The tokens of some texts, each with its context, its text, and whether that trains."""

    def __init__(self, name: str):
        self.name, self.size = name, 0
        self.ids: list = []
        self.train: list[bool] = []
        self.tokens: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.lengths: list[int] = []

    def add(self, doc_id, text: str | None, train: bool) -> None:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.lower().split()
        h = np.empty(len(words) + 2, np.uint64)
        h[0] = h[-1] = END
        h[1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.tokens.append(h[1:])
        self.contexts.append((h[:-1] >> np.uint64(48)).astype(np.uint16))
        self.ids.append(doc_id)
        self.train.append(train)
        self.lengths.append(len(words) + 1)
        self.size += len(data)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different tokens in order; different pairs in order, as keys of a token's place and a context; the place of each token's pair; training counts."""
        tokens, contexts = np.concatenate(self.tokens), np.concatenate(self.contexts)
        self.tokens, self.contexts = [], []
        tokens, keys = keyed(tokens, contexts)
        keys, place = np.unique(keys, return_inverse=True)
        trains = np.repeat(np.array(self.train, bool), self.lengths)
        return tokens, keys, place, np.bincount(place[trains], minlength=len(keys))


def keyed(tokens: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens in order, and a key for each pair: the token's place among them, then the context."""
    different, place = np.unique(tokens, return_inverse=True)
    keys = place.view(np.uint64)  # in place, since a block's arrays are most of a worker's memory
    keys <<= CONTEXT_BITS
    keys |= contexts
    return different, keys


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Batches have columns id, text, train and split. Rows of a split stand in the same order in each run."""
    block, split, number = None, None, 0
    for batch in batches:
        for doc_id, text, train, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if block is None or own != split or block.size >= BLOCK_BYTES:
                if block is not None:
                    yield block
                number = number + 1 if own == split and block is not None else 0
                split, block = own, Block(f"{own:x}-{number}")
            block.add(doc_id, text, train)
    if block is not None:
        yield block


def source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start()).bitwiseAND(F.lit((1 << 62) - 1))
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), (remainder(doc_id, 5) != 1).alias("train"), split.alias("split"))


def shard_count(docs: DataFrame) -> int:
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1 << max(3, (size // SHARD_BYTES).bit_length())


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each different token begins among keys in order."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] >> CONTEXT_BITS) != (keys[:-1] >> CONTEXT_BITS)])) if len(keys) else np.zeros(0, np.int64)


def seated(customers: np.ndarray, attraction: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers came one after another; a new table draws with `attraction`."""
    order = np.argsort(-customers, kind="stable")
    c, a, t = customers[order], attraction[order], np.ones(len(customers))
    n, most = 1, int(c[0]) if len(c) else 0
    while n < most:
        k = int(np.searchsorted(-c, -n, side="left"))  # those with more than n customers
        p = a[:k] / (a[:k] + n - discount * t[:k])
        if n < EXACT:
            t[:k] += rng.random(k) < p
            n += 1
        else:
            run = np.minimum(max(1, n // 8), c[:k] - n)
            t[:k] += np.minimum(rng.poisson(run * p), run)
            n += max(1, n // 8)
    out = np.empty(len(customers))
    out[order] = np.minimum(t, c)
    return out


class Shard:
    """Merged counts of a range of tokens, and their seating."""

    def __init__(self, tokens: np.ndarray, keys: np.ndarray, counts: np.ndarray, number: int):
        self.tokens, self.keys, self.counts, self.number = tokens, keys, counts, number
        self.first = starts(keys)
        self.token = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        self.context = (keys & LOW).astype(np.int64)

    def sampled(self, model: dict, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of each key, customers and tables of each token in the parent) after each sweep; model["totals"] has what sweep k starts from."""
        m = model
        t, s = np.ones(len(self.keys)), np.ones(len(self.first))
        for k in range(sweeps):
            tables, parent_tables = m["totals"][k]
            rng = np.random.default_rng([SEED, k, self.number])
            up = np.add.reduceat(t, self.first) if len(self.first) else s
            below = (STRENGTH + m["d0"] * parent_tables) / (m["types"] + 1)
            p = (up - m["d0"] * s + below) / (STRENGTH + tables.sum())
            t = seated(self.counts, (STRENGTH + m["d1"] * tables[self.context]) * p[self.token], m["d1"], rng)
            up = np.add.reduceat(t, self.first) if len(self.first) else s
            s = seated(up, np.full(len(up), below), m["d0"], rng)
            yield t, up, s


def parent_probability(m: dict, k: int, up: np.ndarray, s: np.ndarray) -> np.ndarray:
    tables, parent_tables = m["totals"][k + 1]
    return (up - m["d0"] * s + (STRENGTH + m["d0"] * parent_tables) / (m["types"] + 1)) / (STRENGTH + tables.sum())


def _ints(rows: list, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _shard(row: dict) -> Shard:
    return Shard(np.frombuffer(row["tokens"], np.uint64), np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64), row["shard"])


REQUEST = "shard int, block string, tokens binary, each binary, contexts binary, counts binary"


def requests(docs: DataFrame, shards: int) -> DataFrame:
    """What each block needs of each shard."""
    shift = np.uint64(64 - shards.bit_length() + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            tokens, keys, _, counts = block.pairs()
            at = np.append(starts(keys), len(keys))
            edges = np.append(np.searchsorted(tokens, np.arange(shards, dtype=np.uint64) << shift), len(tokens))
            rows = []
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    own = slice(at[a], at[b])
                    rows.append((i, block.name, tokens[a:b].tobytes(), np.diff(at[a : b + 1]).astype(np.uint32).tobytes(), (keys[own] & LOW).astype(np.uint16).tobytes(), counts[own].astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.string(), *[pa.binary()] * 4])], [x.split()[0] for x in REQUEST.split(", ")])

    return docs.mapInArrow(cut, REQUEST)


def pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token and context of each pair that a block asks for."""
    tokens = np.repeat(np.frombuffer(row["tokens"], np.uint64), np.frombuffer(row["each"], np.uint32))
    return tokens, np.frombuffer(row["contexts"], np.uint16)


MERGED = "shard int, tokens binary, keys binary, counts binary, types long, customers array<long>, pairs array<long>, once array<long>, twice array<long>"


class Stored:
    """A table in the shared folder whose tasks fetch the rows of one value of a column: some values share a folder, in their order."""

    def __init__(self, path: str, column: str, folders: int):
        self.path, self.column, self.folders = path, column, folders

    def write(self, df: DataFrame) -> "Stored":
        folder = F.pmod(F.crc32(F.col(self.column).cast("string").cast("binary")), F.lit(self.folders))
        rows = df.withColumn("folder", folder).repartition("folder").sortWithinPartitions("folder", self.column)
        rows.write.option("parquet.block.size", 8 << 20).option("compression", "zstd").partitionBy("folder").parquet(self.path)
        return self

    def fetch(self, value, columns: list[str]) -> list[dict]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, top = opened(self.path)
        out = []
        for f in files.get_file_info(fs.FileSelector(f"{top}/folder={zlib.crc32(str(value).encode()) % self.folders}", allow_not_found=True)):
            if f.base_name.endswith(".parquet"):
                out += pq.read_table(f.path, filesystem=files, columns=columns, filters=[(self.column, "=", value)], partitioning=None).to_pylist()
        return out


def merged(spark: SparkSession, asked: Stored, shards: int) -> DataFrame:
    """A row for each shard: its keys that occur in training, and what it adds to the totals."""
    names = [x.split()[0] for x in MERGED.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 4]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                tokens, contexts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
                for row in asked.fetch(number, ["tokens", "each", "contexts", "counts"]):
                    n = np.frombuffer(row["counts"], np.uint32)
                    for to, part in zip((tokens, contexts), pairs_of(row)):
                        to.append(part[n > 0])
                    counts.append(n[n > 0])
                tokens, keys = keyed(np.concatenate(tokens), np.concatenate(contexts))
                keys, place = np.unique(keys, return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
                s = Shard(tokens, keys, counts, number)
                per = lambda x=None: np.bincount(s.context, weights=x, minlength=CONTEXTS).astype(np.int64).tolist()
                kinds_up = np.add.reduceat(np.ones(len(keys), np.int64), s.first) if len(keys) else np.zeros(0, np.int64)
                row = (number, tokens.tobytes(), keys.tobytes(), counts.tobytes(), len(s.first), per(counts), per(), [int((counts == 1).sum()), int((kinds_up == 1).sum())], [int((counts == 2).sum()), int((kinds_up == 2).sum())])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    # Some shards a task where there are very many.
    return spark.range(0, shards, 1, min(shards, 20_000)).mapInArrow(merge, MERGED)


def _sums(df: DataFrame, column: str) -> np.ndarray:
    """Sums by place of the arrays of all shards."""
    # As many sums as there are contexts at most.
    table = df.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).toArrow().sort_by("pos")
    return table.column("n").to_numpy().astype(np.float64)


def fitted(shards: DataFrame) -> dict:
    """Discounts from how many dishes come once and twice; then the restaurants' totals before and after each sweep."""
    once, twice = _sums(shards, "once"), _sums(shards, "twice")
    discount = lambda a, b: float(min(0.95, max(0.05, a / (a + 2 * b)))) if a + b else 0.5
    pairs = _sums(shards, "pairs")
    types = int(shards.agg(F.sum("types")).first()[0] or 0)
    model = {"d0": discount(once[1], twice[1]) if len(once) else 0.5, "d1": discount(once[0], twice[0]) if len(once) else 0.5, "types": types, "customers": _sums(shards, "customers"), "totals": [(pairs, float(types))]}

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _shard(row)
                for t, _, tables in s.sampled(model, len(model["totals"])):
                    pass
                sums = np.append(np.bincount(s.context, weights=t, minlength=CONTEXTS), tables.sum()).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"tables": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    for _ in range(SWEEPS):
        sums = _sums(shards.select("shard", "tokens", "keys", "counts").mapInArrow(swept, "tables array<long>"), "tables")
        model["totals"].append((sums[:CONTEXTS], float(sums[CONTEXTS])))
    return model


ANSWER = "block string, shard int, scores binary, counts binary"


def answers(asked: Stored, shards: DataFrame, model: dict) -> DataFrame:
    """For each block and shard: log10 of the averaged probability of each pair asked for, and the count of each token."""
    names, kinds = [x.split()[0] for x in ANSWER.split(", ")], [pa.string(), pa.int32(), pa.binary(), pa.binary()]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from of_shard(_shard(row))

    def of_shard(s: Shard) -> Iterator[pa.RecordBatch]:
        total = np.add.reduceat(s.counts, s.first) if len(s.keys) else s.counts
        samples = []
        for k, (t, up, tables) in enumerate(s.sampled(model, SWEEPS)):
            if k >= BURN_IN:
                samples.append((k, t, parent_probability(model, k, up, tables)))
        room = STRENGTH + model["customers"]
        for row in asked.fetch(s.number, ["block", "tokens", "each", "contexts"]):
            token, context = pairs_of(row)
            asked_tokens = np.frombuffer(row["tokens"], np.uint64)
            count = np.zeros(len(asked_tokens), np.int64)
            if len(s.keys):
                i = np.minimum(np.searchsorted(s.tokens, token), len(s.tokens) - 1)
                known = s.tokens[i] == token
                keys = (i.astype(np.uint64) << CONTEXT_BITS) | context.astype(np.uint64)
                j = np.minimum(np.searchsorted(s.keys, keys), len(s.keys) - 1)
                seen = known & (s.keys[j] == keys)
                at = np.minimum(np.searchsorted(s.tokens, asked_tokens), len(s.tokens) - 1)
                count = np.where(s.tokens[at] == asked_tokens, total[at], 0)
            context = context.astype(np.int64)
            p = np.zeros(len(token))
            for k, t, up in samples:
                nothing = float(parent_probability(model, k, np.zeros(1), np.zeros(1))[0])
                above = np.where(known, up[i], nothing) if len(s.keys) else np.full(len(token), nothing)
                here = np.where(seen, s.counts[j] - model["d1"] * t[j], 0.0) if len(s.keys) else 0.0
                p += (here + (STRENGTH + model["d1"] * model["totals"][k + 1][0][context]) * above) / room[context]
            out = [[row["block"]], [s.number], [np.log10(p / len(samples)).astype(np.float32).tobytes()], [count.astype(np.int64).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return shards.select("shard", "tokens", "keys", "counts").mapInArrow(answer, ANSWER)


SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). docs must come straight from files; `written` makes others so."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = source(docs, doc_id, text)
    shards = shard_count(docs.select(doc_id, text))
    with Scratch(spark) as temp:
        asked = Stored(temp.folder("lm-asked"), "shard", min(MAX_FOLDERS, shards)).write(requests(rows, shards))
        state = temp.written(merged(spark, asked, shards), "lm-shards")
        model = fitted(state)
        # As many folders as there are blocks, about: a block's texts come back for its answers.
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        found = Stored(scratch(spark, "lm-answers"), "block", min(MAX_FOLDERS, max(8, size // BLOCK_BYTES))).write(answers(asked, state, model))
    n, v = float(model["customers"].sum()), model["types"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in SCORED.split(", "))]
        for block in blocks(batches):
            parts = {r["shard"]: r for r in found.fetch(block.name, ["shard", "scores", "counts"])}
            order = [parts[k] for k in sorted(parts)]
            _, keys, place, _ = block.pairs()
            of_pair = _ints([r["scores"] for r in order], np.float32).astype(np.float64)
            at = starts(keys)
            count = np.repeat(_ints([r["counts"] for r in order], np.int64), np.diff(np.append(at, len(keys))))
            begin = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
            out = [block.ids, [not x for x in block.train], block.lengths, np.add.reduceat((count > 0).astype(np.int64)[place], begin), [int(n)] * len(block.ids), np.add.reduceat(base[place], begin), np.add.reduceat(of_pair[place], begin)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()])], names)

    return rows.select(F.col("id").cast("long").alias("id"), "text", "train", "split").mapInArrow(score, f"doc_id long, {SCORED}")


def op9_pitmanyor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
