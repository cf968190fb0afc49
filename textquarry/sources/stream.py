"""A streaming source of JSON-lines records whose offsets are bytes.

    spark.dataSource.register(RecordStream)
    spark.readStream.format("record_stream").option("path", folder).option("progress", own_folder).load()

Rows are the record's columns, `_corrupt_record` (the line, where it isn't an object
of JSON), `file` and `at`, the byte at which the line starts; so lines that can't be
parsed are counted instead of lost, and every row has a name of its own.

What was seen stands in a log of segments (file, first byte, end) in the order in
which they were found; an offset is a number of bytes along that log. A line belongs
to the range in which it starts, so a batch may end at any byte. The log and the last
offset given out are written to `progress` before Spark sees the offset, and renamed
into place: a query that is killed anywhere goes on at its checkpoint's offset, and
neither loses a line nor reads one twice. Ranges are read again by an executor's
successor as they were.

Options: maxBytes (of a batch, none by default; with the availableNow trigger Spark
asks for one offset, so there a run takes one such batch), perTask (32 MB),
growing ("true": files get longer, and a line without its end isn't read yet; else a
file is whole when it is listed). Files are opened by pyarrow's file systems. Names
that start with . or _ are left out.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .records import CORRUPT, RECORD

COLUMNS = [f.name for f in RECORD]
ROW = pa.schema([(c, pa.string()) for c in [*COLUMNS, CORRUPT, "file"]] + [("at", pa.int64())])
BATCH = 4 << 20


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    """The lines of a file that start in [start, end)."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def lines_of(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in [start, end), without their ends."""
    at = start
    if start:
        # The line before may reach into the range; it starts outside.
        file.seek(start - 1)
        at = start - 1
        while True:
            data = file.read(1 << 16)
            if not data:
                return
            found = data.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(data)
    file.seek(at)
    rest = b""
    while at < end:
        data = file.read(1 << 20)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1
        if not data:
            if rest and at < end:
                yield at, rest
            return


def parsed(line: bytes) -> tuple[list[str | None], str | None]:
    """(values, line where it can't be used)."""
    try:
        record = json.loads(line)
        if isinstance(record, dict):
            return [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in map(record.get, COLUMNS)], None
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError):
        pass
    return [None] * len(COLUMNS), line.decode("utf-8", "replace")


class RecordStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_stream"

    def schema(self) -> str:
        return ", ".join(f"`{f.name}` {'long' if f.name == 'at' else 'string'}" for f in ROW)

    def streamReader(self, schema) -> "RecordReader":
        return RecordReader(dict(self.options))


class RecordReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        get = lambda k, d=None: options.get(k, options.get(k.lower(), d))
        self.path, self.progress = get("path"), get("progress")
        if not self.path or not self.progress:
            raise ValueError("record_stream needs the options path and progress")
        self.most, self.per_task = int(get("maxBytes", 0)), int(get("perTask", 32 << 20))
        self.growing = str(get("growing", "false")).lower() == "true"
        self.segments: list[tuple[str, int, int]] | None = None

    # The log

    def _load(self) -> None:
        """The log and the last offset as they were left."""
        if self.segments is not None:
            return
        from pyarrow import fs

        files, top = opened(self.progress)
        files.create_dir(top, recursive=True)
        found = {f.base_name: f.path for f in files.get_file_info(fs.FileSelector(top)) if f.is_file and not f.base_name.startswith(".")}
        read = lambda name: json.loads(files.open_input_stream(found[name]).read())
        self.segments = [tuple(s) for name in sorted(n for n in found if n.startswith("log-")) for s in read(name)]
        self.parts = sum(n.startswith("log-") for n in found)
        self.given = max((int(n.removeprefix("given-")) for n in found if n.startswith("given-")), default=0)
        self._index()

    def _index(self) -> None:
        self.ends = list(accumulate(end - start for _, start, end in self.segments))
        self.taken = {}
        for file, _, end in self.segments:
            self.taken[file] = max(end, self.taken.get(file, 0))

    def _save(self, name: str, value) -> None:
        files, top = opened(self.progress)
        part = f"{top}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(json.dumps(value).encode())
        files.move(part, f"{top}/{name}")

    def _look(self) -> None:
        """New files and what files have gained, as further segments."""
        from pyarrow import fs

        files, top = opened(self.path)
        listed = sorted((f for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: (f.mtime_ns or 0, f.path))
        new = []
        for f in listed:
            end, start = f.size, self.taken.get(f.path, 0)
            if self.growing and end > start:
                end = self._last_line(files, f.path, start, end)
            if end > start and (self.growing or f.path not in self.taken):
                new.append((f.path, start, end))
        if new:
            self._save(f"log-{self.parts:09d}", new)
            self.segments, self.parts = self.segments + new, self.parts + 1
            self._index()

    @staticmethod
    def _last_line(files, path: str, start: int, end: int) -> int:
        """The end of the last whole line in [start, end)."""
        with files.open_input_file(path) as file:
            at = end
            while at > start:
                step = min(1 << 16, at - start)
                file.seek(at - step)
                found = file.read(step).rfind(b"\n")
                if found >= 0:
                    return at - step + found + 1
                at -= step
        return start

    # What Spark calls

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        self._load()
        self._look()
        total = self.ends[-1] if self.ends else 0
        after = min(total, self.given + self.most) if self.most else total
        if after > self.given:
            self._save(f"given-{after:020d}", after)
            self.given = after
        return {"bytes": self.given}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        self._load()
        at, stop, out = start["bytes"], end["bytes"], []
        k = bisect_right(self.ends, at)
        while at < stop:
            file, first, _ = self.segments[k]
            before = self.ends[k - 1] if k else 0
            until = min(stop, self.ends[k], at + self.per_task)
            out.append(Range(file, first + at - before, first + until - before))
            at = until
            k += at == self.ends[k]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        rows, held = [], 0
        with files.open_input_file(partition.file) as file:
            for at, line in lines_of(file, partition.start, partition.end):
                if line.strip():
                    values, bad = parsed(line)
                    rows.append((*values, bad, partition.file, at))
                    held += len(line) + 100
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROW)], schema=ROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROW)], schema=ROW)

    def commit(self, end: dict) -> None:
        """Older marks of what was given out go; the last one stays."""
        from pyarrow import fs

        files, top = opened(self.progress)
        for f in files.get_file_info(fs.FileSelector(top)):
            if f.base_name.startswith("given-") and int(f.base_name.removeprefix("given-")) < self.given:
                files.delete_file(f.path)
