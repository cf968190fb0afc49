"""Token ids of a corpus in binary files, by the range coder of `rangecoder`.

Texts are encoded with a public tokenizer and end with an end id. Texts are cut
before white space that follows something else, and between letters (ASCII, or Latin
before an ASCII character), digits and other ASCII signs, though not after an
apostrophe: a byte-level tokenizer's own pattern ends a piece there whatever stands
around, so ids of pieces joined are ids of the text. An Arrow batch's different pieces
are looked up among those met before, and new ones encoded, joined where the rule
holds (`pieces=False` for tokenizers of which that isn't true). Rows go to files by ranges of ids, each
sorted; files by number hold the corpus in ascending order of ids, null ids first.
Rows with equal ids are separate documents, ordered by a digest of what they hold.

A file is a run of groups of about GROUP ids. A group is

    "TQI1", length of head (u32), crc32 of head (u32), number of words (u64), head, words (u16)

and its head an Arrow stream, compressed, of one row: doc (ids of its documents),
size (how many of the group's ids each has), open (whether the last document goes on
in the next group), the order-0 shares, and of each block its number of ids, of
words, and its crc32. All numbers are little-endian. A group is decoded without the
others, and a block without the others of its group.

A task holds a group at a time, whatever the length of a text. The ids of a text
have to fit one Arrow value, 2 GB. Each file is written under a temporary name and
renamed when it is whole, so that a task that runs again leaves one file. The
driver holds names and sizes of files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rangecoder
from .common import Scratch, bounded_batches, read, scratch
from .warc import opened

MAGIC = b"TQI1"
END = 2
GROUP = 2048 * rangecoder.BLOCK
#: Ids of a file, about.
FILE = 2 * GROUP
#: Pieces that a worker process remembers, and ids of theirs.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 1 << 24
#: Bytes of texts whose pieces are looked up together, about: they share more of them.
RUN = 10 << 20
#: Pieces whose ids are put in their places at once, so that these lie in a core's cache.
PLACED = 1 << 15
#: New pieces that the library gets as one text; it takes long for each text, and for long ones.
TOGETHER = 500
#: Classes of bytes: 1 white space, 2 letters, 3 digits, 4 other ASCII signs, 5 apostrophes, 6 bytes of longer characters, 0 all else.
CLASS = np.array([6 if b > 127 else 1 if b == 32 or 9 <= b <= 13 else 2 if chr(b).isalpha() else 3 if chr(b).isdigit() else 5 if b == 39 else 4 if 32 < b < 127 else 0 for b in range(256)], np.uint8)
#: By 8 * class before + class: 1 where a piece starts, 2 where it may, by the character before.
START = np.zeros(64, np.uint8)
START[[8 * i + j for i, after in {2: (1, 3, 4, 5), 3: (1, 2, 4, 5), 4: (1, 2, 3), 5: (1, 3)}.items() for j in after]] = 1
START[[8 * 6 + j for j in (1, 3, 4, 5)]] = 2


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def starts(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8 after the first, whether a piece of the tokenizer starts there in any case."""
    kind = CLASS.take(data)
    cut = START.take((kind[:-1] << 3) | kind[1:])
    doubtful = np.flatnonzero(cut == 2)
    if len(doubtful):
        one, two, three = (data.take(np.maximum(doubtful - i, 0)) for i in range(3))  # from the last byte of the character before backwards
        pair = (two >= 0xC3) & (two <= 0xDF)
        letter = pair & (two <= 0xC9) & ((two != 0xC3) | ((one != 0x97) & (one != 0xB7)))
        # No white space is among these; U+1680, U+180E, U+2000 to U+207F and U+3000 to U+303F are left out.
        longer = (two < 0xC0) & ~((three == 0xE1) & ((two == 0x9A) | (two == 0xA0)) | (three == 0xE2) & (two < 0x82) | (three == 0xE3) & (two == 0x80))
        cut[doubtful] = letter | ((kind.take(doubtful + 1) == 1) & (pair | longer))
    return cut.view(bool)


class Pieces:
    """Ids of pieces that a worker process has met, one after the other; the end id is number 0."""

    def __init__(self, path: str, kind: str, end: int | None):
        self.of = tokenizer(path)
        added = self.of.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values() if t.content]
        # A byte-level token has a character for each byte.
        self.bytes = np.zeros(1 + max(self.of.get_vocab().values(), default=0), np.int64)
        for token, i in self.of.get_vocab().items():
            self.bytes[i] = len(added[i].content.encode() if i in added else token)
        self.first = np.array([] if end is None else [end], kind)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.at, self.length = self.first, np.zeros(1, np.int64), np.array([len(self.first)])

    def made(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each piece has, the ids of all). They are joined where the joint is a start by the rule."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = b"".join(pieces)
        at, data = np.cumsum(size), np.frombuffer(raw, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[pieces_at(data, np.zeros(0, np.int64), self.added)] = True
        broken = ~cut[at]
        broken[TOGETHER - 1 :: TOGETHER] = broken[-1] = True
        breaks = at[broken].tolist()
        texts = [raw[i:j].decode() for i, j in zip([0] + breaks, breaks)]
        each = [e.ids for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(each), self.ids.dtype, sum(map(len, each)))
        ends = np.searchsorted(done := np.cumsum(self.bytes.take(ids)), at, "right")
        if len(done) == 0 or done[-1] != len(raw) or (done.take(ends - 1) != at).any():
            raise ValueError("the tokenizer's tokens aren't the bytes of the text: use pieces=False")
        return np.diff(ends, prepend=0), ids

    def numbered(self, pieces: list[bytes], most: int, joined: bool) -> np.ndarray:
        """The number of each piece; new ones are encoded."""
        if not joined or len(self.numbers) > most or len(self.ids) > REMEMBERED_IDS:
            self.clear()
        numbers = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            if joined:
                # Most start with white space, and can be joined.
                order = np.argsort(np.fromiter((p[0] > 32 for p in new), bool, len(new)), kind="stable")
                new, unknown = [new[i] for i in order.tolist()], unknown.take(order)
                length, ids = self.made(new)
            else:
                each = [e.ids for e in self.of.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)]
                length = np.fromiter(map(len, each), np.int64, len(each))
                ids = np.fromiter(chain.from_iterable(each), self.ids.dtype, int(length.sum()))
            numbers[unknown] = np.arange(len(self.at), len(self.at) + len(new))
            self.numbers.update(zip(new, numbers[unknown].tolist()))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, ids])
        return numbers


@lru_cache(maxsize=2)
def remembered(path: str, kind: str, end: int | None) -> Pieces:
    """A worker process keeps its pieces for its next tasks."""
    return Pieces(path, kind, end)


def pieces_at(data: np.ndarray, ends: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Where pieces start in data, texts that end at ends."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = starts(data) if len(data) else False
    raw = data.tobytes() if added else b""
    for token in added:
        at = raw.find(token)
        while at >= 0:
            cut[at + 1 : at + len(token)] = False  # the tokenizer takes it whole before it looks for pieces
            at = raw.find(token, at + 1)
    cut[0] = True
    cut[ends] = True
    return np.flatnonzero(cut[:-1])


def encoded_array(texts: pa.Array, known: Pieces, cut: bool = True, most: int = REMEMBERED) -> pa.BinaryArray:
    """Ids of texts as bytes, each with the end id. Each different piece is encoded once as long as it is remembered."""
    texts = pa.array(texts, pa.string()).fill_null("")
    n, edges = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = (edges - edges[0]).astype(np.int64)
    at = pieces_at(data, edges[1:], known.added) if cut and len(data) else np.unique(edges[:-1][np.diff(edges) > 0])
    bounds = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
    listed = pa.Array.from_buffers(pa.binary(), len(at), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    _, edge, raw = listed.dictionary.buffers()
    edge, raw = np.frombuffer(edge, np.int32)[: len(listed.dictionary) + 1].tolist(), raw.to_pybytes() if raw else b""
    number = known.numbered([raw[i:j] for i, j in zip(edge, edge[1:])], most, cut).take(listed.indices.to_numpy())
    number = np.insert(number, np.searchsorted(at, edges[1:]), 0)  # each text's end
    after = np.cumsum(known.length.take(number))
    ids = np.empty(after[-1] if n else 0, known.ids.dtype)
    for i in range(0, len(number), PLACED):
        own, begun = number[i : i + PLACED], after[i - 1] if i else 0
        length, done = known.length.take(own), after[i : i + PLACED] - begun
        ids[begun : begun + done[-1]] = known.ids.take(np.repeat(known.at.take(own) - done + length, length) + np.arange(done[-1]))
    last = np.searchsorted(at, edges[1:]) + np.arange(n)
    sizes = np.append(0, after.take(last)) * ids.itemsize
    if sizes[-1] >= 1 << 31:
        raise ValueError("a batch's ids don't fit one Arrow array of 2 GB")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(ids)])


def pieces_of(text: str) -> list[str]:
    """text cut where a piece of the tokenizer's ends in any case."""
    data = text.encode()
    at = pieces_at(np.frombuffer(data, np.uint8), np.array([len(data)]), []).tolist() if data else []
    return [data[a:b].decode() for a, b in zip(at, at[1:] + [len(data)])]


def encode(texts: list[str], path: str, kind: str, cut: bool = True, most: int = REMEMBERED) -> list[bytes]:
    """Ids of texts as bytes, without an end id."""
    return encoded_array(pa.array(texts, pa.string()), remembered(path, kind, None), cut, most).to_pylist()


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int | None = END, pieces: bool = True) -> tuple[DataFrame, str]:
    """((doc_id, ids) of each row, numpy type of the ids): ids as bytes, with the end id; null texts are empty."""
    kind = "<u2" if max(tokenizer(path).get_vocab_size(), end or 0) <= 1 << 16 else "<u4"
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = remembered(path, kind, end), [], 0

        def flush() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
            return pa.RecordBatch.from_arrays([ids, encoded_array(texts, known, pieces)], ["doc_id", "ids"])

        for batch in batches:
            if held and size + batch.nbytes > RUN:
                yield flush()
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield flush()

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema), kind


def packed(docs: pa.Array, sizes: list[int], open_: bool, ids: np.ndarray) -> bytes:
    """A group as bytes."""
    shares, lengths, used, crc, words = rangecoder.encode(ids)
    lists = {"doc": docs, "size": pa.array(sizes, pa.int64()), "ids": pa.array(shares.ids), "share": pa.array(shares.share), "sizes": pa.array(shares.sizes), "length": pa.array(lengths), "words": pa.array(used), "crc": pa.array(crc)}
    row = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in lists.items()} | {"open": pa.array([open_])}
    batch = pa.RecordBatch.from_pydict(row)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    head = sink.getvalue().to_pybytes()
    return MAGIC + struct.pack("<IIQ", len(head), zlib.crc32(head), len(words)) + head + words.astype("<u2").tobytes()


def unpacked(file) -> Iterator[tuple[pa.Array, list[int], bool, np.ndarray]]:
    """(documents, sizes, open, ids) of each group of a file."""
    while top := file.read(20):
        if len(top) < 20 or top[:4] != MAGIC:
            raise ValueError("no group starts here")
        length, crc, n = struct.unpack("<IIQ", top[4:])
        head = file.read(length)
        if zlib.crc32(head) != crc:
            raise ValueError("a group's head doesn't have its checksum")
        words = file.read(2 * n)
        if len(words) < 2 * n:
            raise ValueError("the file ends within a group")
        batch = pa.ipc.open_stream(head).read_next_batch()
        own = {k: batch.column(k)[0].values for k in batch.schema.names if k != "open"}
        array = {k: own[k].to_numpy() for k in ("ids", "share", "sizes", "length", "words", "crc")}
        shares = rangecoder.Shares(array["ids"], array["share"], array["sizes"])
        ids = rangecoder.decode(shares, array["length"], array["words"], array["crc"], np.frombuffer(words, "<u2"))
        yield own["doc"], own["size"].to_pylist(), batch.column("open")[0].as_py(), ids


def write(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int | None = END, pieces: bool = True, group: int = GROUP, file: int = FILE) -> list[tuple[str, int]]:
    """Files of all rows under folder; (file, ids) of each in ascending order."""
    spark = docs.sparkSession
    rows, kind = encoded(docs, path, doc_id, text, end, pieces)
    width = np.dtype(kind).itemsize
    with Scratch(spark) as temp:
        rows = temp.written(rows.withColumn("digest", F.xxhash64("ids")), "ids")
        # Rows of the written table have numbers that don't change, so that rows alike in all else still have one place.
        order = ["doc_id", "digest", "number"]
        total = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
        tasks = max(1, -(-total // (width * file)))
        ranged = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "ids")
        bounded_batches(spark)

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            files, at = opened(folder)
            files.create_dir(at)
            name = f"part-{context.partitionId():06d}.tqi"
            temporary = f"{at}/.{name}.{context.taskAttemptId()}"
            docs, sizes, parts, held, total = [], [], [], 0, 0
            with files.open_output_stream(temporary, compression=None) as to:

                def flush(open_: bool) -> None:
                    to.write(packed(pa.concat_arrays(docs), sizes, open_, np.concatenate(parts).astype(np.int64)))

                for batch in batches:
                    for i, raw in enumerate(batch.column(1)):
                        ids = np.frombuffer(raw.as_buffer(), kind)
                        total += len(ids)
                        while True:
                            take = min(len(ids), group - held)
                            docs.append(batch.column(0).slice(i, 1))
                            sizes.append(take)
                            parts.append(ids[:take])
                            held, ids = held + take, ids[take:]
                            if held < group:
                                break
                            flush(len(ids) > 0)
                            docs, sizes, parts, held = [], [], [], 0
                            if not len(ids):
                                break
                if docs:
                    flush(False)
            if total or sizes:
                files.move(temporary, f"{at}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name], "ids": [total]})
            else:
                files.delete_file(temporary)

        return sorted((f"{folder}/{r.name}", r.ids) for r in ranged.mapInArrow(save, "name string, ids long").collect())


def read_back(spark: SparkSession, files: list[tuple[str, int]], id_type: T.DataType | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files, with `ids` its ids too (little-endian, 32 bits each)."""
    bounded_batches(spark)
    first = np.concatenate([[0], np.cumsum([n for _, n in files])]).astype(np.int64)
    shipped = spark.sparkContext.broadcast((files, first))
    schema = T.StructType([T.StructField("doc_id", id_type or T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.BinaryType())] if ids else []))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                listed, first = shipped.value
                at = int(first[number])
                storage, path = opened(listed[number][0])
                crc, length, held, begun = 0, 0, [], at  # of a document that goes on
                with storage.open_input_stream(path, compression=None) as file:
                    for docs, sizes, open_, own in unpacked(file):
                        raw, place, out, last = np.ascontiguousarray(own, "<u4"), 0, [], len(sizes) - 1
                        for i, size in enumerate(sizes):
                            part = raw[place : place + size]
                            place += size
                            crc, length = zlib.crc32(part, crc), length + size
                            if ids:
                                held.append(part.tobytes())
                            if i == last and open_:
                                break
                            out.append((begun, length, crc, *([b"".join(held)] if ids else [])))
                            begun, crc, length, held = begun + length, 0, 0, []
                        step = max(1, min(len(out), (4 << 20) * max(len(out), 1) // max(4 * place, 1))) if ids else 10_000
                        for b in range(0, len(out), step):
                            columns = list(zip(*out[b : b + step]))
                            types = [pa.int64()] * 3 + [pa.binary()] * ids
                            yield pa.RecordBatch.from_arrays([docs.slice(b, len(columns[0])), *(pa.array(c, t) for c, t in zip(columns, types))], schema.fieldNames())

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(load, schema)


def op12_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    files = write(docs, scratch(spark, "token-ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, files, docs.schema["doc_id"].dataType)
