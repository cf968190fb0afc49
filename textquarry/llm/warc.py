"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each task writes one archive, a gzip member for each record, to a
temporary name that is renamed when it is whole, so that a task that runs again
leaves one archive. Of records with equal payloads of at least `least` bytes the
one with the largest id carries the payload and the others revisit it.

Reader: archives are cut into byte ranges without looking into them. A task
searches its range for the gzip magic, validates each candidate by decoding the
member's WARC header, and owns the records whose members start inside the range;
the last one may end beyond it. Our own members carry their offset in a gzip
extra field, so that an archive stored inside a payload can't pass for records;
for archives without the field (stamped=False) the decoded header decides.

Null payloads count as empty, null ids are written as an empty id and never
win over others; rows that share both payload and the largest id are all
responses. Any number of copies of one payload is counted before it is shuffled,
and payloads are never brought together by digest.
Paths are opened by pyarrow's file systems; the folder must be shared.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, read, scratch

MAGIC = b"\x1f\x8b\x08"
ID = "urn:x-record:"
SPLIT = 16 << 20
#: Bytes of archives that a task of the reader goes through.
TASK_BYTES = 128 << 20
CHUNK = 1 << 20


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, offset: int, level: int = 5) -> bytes:
    """A gzip member whose extra field tells where it starts."""
    extra = b"TQ" + struct.pack("<HQ", 8, offset)
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    return MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(rid: str, uri: str, payload: bytes, date: str, refers_to: str | None) -> bytes:
    """One record; with refers_to a revisit, whose block keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{rid}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {uri}"] if uri else []
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, rid: str, uri: str, payload: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> list[tuple[str, int]]:
    """Archives of all rows under path; (archive, bytes) of each."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(rid).cast("string").alias("id"), F.col(rid).alias("rank"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "utf-8"))))
    with Scratch(spark) as temp:
        # Ids and digests alone find the revisits; payloads meet them by id and digest, which no two different rows share.
        keys = temp.written(rows.where(F.octet_length("payload") >= least).select("rank", "digest"), "digests")
        largest = keys.groupBy("digest").agg(F.max("rank").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 and largest is not null").drop("n")
        revisits = keys.join(largest, "digest").where(~F.col("rank").eqNullSafe(F.col("largest"))).distinct()
        revisits = temp.written(revisits.select(F.col("rank").alias("r"), F.col("digest").alias("d"), F.col("largest").cast("string").alias("refers_to")), "revisits")
        rows = rows.join(revisits, F.col("rank").eqNullSafe(F.col("r")) & (F.col("digest") == F.col("d")), "left").select("id", "uri", "payload", "refers_to")
        return archived(rows, path, date)


def archived(rows: DataFrame, path: str, date: str) -> list[tuple[str, int]]:
    """Archives of rows (id, uri, payload, refers_to): one of each task."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, at = opened(path)
        files.create_dir(at)
        name = f"part-{context.partitionId():06d}.warc.gz"
        temporary, offset = f"{at}/.{name}.{context.taskAttemptId()}", 0
        with files.open_output_stream(temporary, compression=None) as to:
            for batch in batches:
                for i, u, p, r in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "payload", "refers_to"))):
                    clean = "".join(c for c in u or "" if c not in "\r\n")
                    data = member(record(i or "", clean, p.encode("utf-8", "replace"), date, r), offset)
                    to.write(data)
                    offset += len(data)
        if offset:
            files.move(temporary, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [offset]})
        else:
            files.delete_file(temporary)

    return [(f"{path}/{r.name}", r.bytes) for r in rows.mapInArrow(archive, "name string, bytes long").collect()]


def _header(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


class Members:
    """The records of one archive whose members start in [start, end)."""

    def __init__(self, file, start: int, end: int, size: int, stamped: bool):
        self.file, self.at, self.end, self.size, self.stamped = file, start, end, size, stamped
        self.buffer, self.base = b"", start

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to n bytes from at; the buffer goes on from there."""
        if not (self.base <= at and at + n <= self.base + len(self.buffer)):
            self.file.seek(at)
            self.buffer, self.base = self.file.read(max(n, CHUNK)), at
        return self.buffer[at - self.base : at - self.base + n]

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        while self.at < self.end:
            got = self.decoded(self.at)
            if got is None:
                self.at = self.next_magic(self.at + 1) if self.bytes_at(self.at, 3) == MAGIC else self.next_magic(self.at)
                continue
            after, header, block = got
            yield self.at, header, block
            self.at = after

    def next_magic(self, at: int) -> int:
        while at < self.end:
            data = self.bytes_at(at, min(CHUNK, self.size - at))
            found = data.find(MAGIC)
            if found >= 0:
                return at + found
            if at + len(data) >= self.size:
                return self.size
            at += max(1, len(data) - 2)
        return at

    def decoded(self, at: int) -> tuple[int, dict[str, str], bytes] | None:
        """(end, header, block) of the member at `at`, or None where none with a WARC header starts."""
        first = self.bytes_at(at, min(CHUNK, self.size - at))
        if first[:3] != MAGIC:
            return None
        if self.stamped and (len(first) < 24 or not first[3] & 4 or first[12:14] != b"TQ" or struct.unpack("<Q", first[16:24])[0] != at):
            return None
        inflate, out, pos, checked = zlib.decompressobj(zlib.MAX_WBITS | 16), [], at, False
        try:
            while not inflate.eof:
                data = first if pos == at else self.bytes_at(pos, min(CHUNK, self.size - pos))
                if not data:
                    return None
                out.append(inflate.decompress(data))
                pos += len(data)
                if not checked and sum(map(len, out)) >= 7:
                    if not b"".join(out)[:7].startswith(b"WARC/1."):
                        return None
                    checked = True
        except zlib.error:
            return None
        data = b"".join(out)
        head, gap, block = data.partition(b"\r\n\r\n")
        if not data.startswith(b"WARC/1.") or not gap:
            return None
        header = _header(head)
        length = header.get("content-length", "")
        if not length.isdigit() or int(length) > len(block):
            return None
        return pos - len(inflate.unused_data), header, block[: int(length)]


OUT = "archive string, at long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_back(spark: SparkSession, archives: list[tuple[str, int]], split: int = SPLIT, stamped: bool = True, payload: bool = True) -> DataFrame:
    """A row for each record. Size and digest are those of the full payload; a revisit's come from its headers, and it has no payload."""
    bounded_batches(spark)
    # A list of archives, no longer than the tasks that wrote them. Ranges are numbered over all archives and found again by number.
    first = np.concatenate([[0], np.cumsum([-(-n // split) for _, n in archives])]).astype(np.int64)
    total = int(first[-1])
    per = max(1, TASK_BYTES // split)  # ranges of a task, fewer where cores would be idle
    tasks = min(total, max(-(-total // per), 4 * spark.sparkContext.defaultParallelism))
    shipped = spark.sparkContext.broadcast((archives, first))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in OUT.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for number in batch.column(0).to_pylist():
                listed, first = shipped.value
                k = int(np.searchsorted(first, number, side="right")) - 1
                path, size = listed[k]
                start = (number - int(first[k])) * split
                stop = min(start + split, size)
                files, at = opened(path)
                rows, held = [], 0
                with files.open_input_file(at) as file:
                    for offset, h, block in Members(file, start, stop, size, stamped):
                        kind, http = h.get("warc-type", ""), b""
                        body = block
                        if h.get("content-type", "").startswith("application/http"):
                            http, _, body = block.partition(b"\r\n\r\n")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "revisit":
                            length, body = int(_header(http).get("content-length", "0")), None
                        else:
                            length, own = len(body), digest_of(body)
                            if digest and digest != own:
                                raise ValueError(f"{path} at {offset}: the payload doesn't have the digest {digest}")
                            digest = own
                        rows.append((path, offset, kind, h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, length, digest, body if payload else None))
                        held += len(body or b"") if payload else 1000
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.range(0, total, 1, max(1, tasks)).mapInArrow(records, OUT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    archives = write(pages, scratch(spark, "warc"), "page_id", "url", "html", least=0)
    got = read_back(spark, archives, payload=False)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) as bigint)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as largest from p),
b as (select *, list_reduce(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::int), 4, '0')), lambda x, y: x || y) as bits from h)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(range(1, 6), lambda j: substr(bits, i * 5 + j, 1)::int), lambda x, y: x * 2 + y)::int + 1, 1)), '') as payload_digest,
  case when page_id is not distinct from largest then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from largest then largest end as refers_to
from b
"""
