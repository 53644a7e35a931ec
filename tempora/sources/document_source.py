"""Documents of locations, and their changes, as data sources of Spark.

``tempora_document`` reads and writes one JSON document as rows of locations. Tasks write their locations, one a line,
to parts beside the document; the commit joins the parts in order, without looking into them, and renames the whole
over the old one. At the document's end stands where which location begins, so that tasks can read parts of it side by
side; documents that others have written are read by one task, location by location. No row, group or process holds
the document.

``tempora_snapshots`` is a stream of a document's changes: (poll_ts, lastUpdated), whenever the latter differs from the
poll before. Changes are numbered in a log folder, and the numbers are the stream's offsets: what has been seen once is
emitted once, whichever query or failure comes between.

Paths are whatever pyarrow opens: folders that all machines mount, or addresses of its file systems.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import LOCATIONS

VERSION = "1.0.0"
#: Bytes of a document that one task reads, about; and bytes and rows that are held at once.
SHARE, BUFFER, ROWS = 4 << 20, 1 << 16, 1000
#: Digits of the number that a document ends with.
DIGITS = 20
_TAIL = re.compile(rb'"begins":"(\d{%d})"\}\}\n' % DIGITS)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def _list(value, of) -> list | None:
    return [of(x) for x in value] if isinstance(value, list) else None


def _event(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    return {k: _text(value.get(k)) for k in ("id", "title", "description", "date", "imageUrl", "source")} | {"tags": _list(value.get("tags"), _text)}


def _location(value, place: int) -> dict:
    own = value if isinstance(value, dict) else {}
    return {"loc_ord": place, "id": _text(own.get("id")), "name": _text(own.get("name")), "coordinates": _list(own.get("coordinates"), _number), "events": _list(own.get("events"), _event)}


def _present(value):
    """A value without its null fields."""
    if isinstance(value, dict):
        return {k: _present(v) for k, v in value.items() if v is not None}
    return [_present(x) for x in value] if isinstance(value, list) else value


class _Pull:
    """JSON values of a stream of text, one after the other."""

    def __init__(self, stream):
        self.stream, self.text, self.at, self.ended = stream, "", 0, False
        self.decoder, self.utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()

    def _more(self) -> None:
        """Twice as much text, so that a long value is looked at few times."""
        bytes_ = self.stream.read(max(BUFFER, len(self.text) - self.at))
        self.ended = not bytes_
        self.text, self.at = self.text[self.at :] + self.utf8.decode(bytes_, final=self.ended), 0

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self._more()

    def expect(self, *marks: str) -> str:
        found = self.peek()
        if found not in marks or not found:
            raise ValueError(f"{found!r} where one of {marks} should be")
        self.at += 1
        return found

    def value(self):
        self.peek()
        while True:
            try:
                value, end = self.decoder.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return value
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self._more()


def _items(pull: _Pull) -> Iterator:
    """The items of an array."""
    pull.expect("[")
    if pull.peek() == "]":
        pull.expect("]")
        return
    while True:
        yield pull.value()
        if pull.expect(",", "]") == "]":
            return


def fields_of(stream, wanted: str | None = None) -> Iterator[tuple[str, object]]:
    """(key, value) of a JSON object; of the array ``wanted`` a pair for each item. ValueError where it is none."""
    pull = _Pull(stream)
    pull.expect("{")
    if pull.peek() == "}":
        pull.expect("}")
    else:
        while True:
            key = pull.value()
            pull.expect(":")
            if key == wanted and pull.peek() == "[":
                for item in _items(pull):
                    yield key, item
            elif key == wanted:
                raise ValueError(f"{key} is no array")
            else:
                yield key, pull.value()
            if pull.expect(",", "}") == "}":
                break
    if pull.peek():
        raise ValueError("text behind the document")


@dataclass
class Share(InputPartition):
    """Bytes of a document and the place of its first location; without bytes the whole of a document of others."""

    start: int | None = None
    end: int | None = None
    place: int = 0


def shares(path: str) -> list[Share]:
    """What tasks may read side by side: one share for a document without a list of its own, none where there is none."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        return []
    size, length = info.size, DIGITS + len('"begins":""}}\n')
    with system.open_input_file(inner) as file:
        file.seek(max(0, size - length))
        tail = _TAIL.fullmatch(file.read())
        if not tail:
            return [Share()]
        file.seek(int(tail[1]))
        try:
            listed = json.loads(b"{" + file.read()[3:])["parts"]
        except (ValueError, KeyError):
            return [Share()]
    at = listed["at"] + [[int(tail[1]), None]]
    return [Share(a, b, place) for (a, place), (b, _) in zip(at, at[1:])] if listed["size"] == int(tail[1]) else [Share()]


class DocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Share]:
        return shares(self.path) or [Share(0, 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows, kinds = [], to_arrow_schema(LOCATIONS)
        for row in self._rows(share):
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    def _rows(self, share: Share) -> Iterator[dict]:
        if share.start is not None and share.start == share.end:
            return
        system, inner = _opened(self.path)
        if share.start is None:
            try:  # a document that is broken anywhere has no locations
                with system.open_input_stream(inner) as stream:
                    for _ in fields_of(stream, "locations"):
                        pass
            except ValueError:
                return
            with system.open_input_stream(inner) as stream:
                items = (value for key, value in fields_of(stream, "locations") if key == "locations")
                yield from (_location(value, i) for i, value in enumerate(items))
            return
        with system.open_input_file(inner) as file:
            file.seek(share.start)
            left, rest, place = share.end - share.start, b"", share.place
            while left:
                bytes_ = file.read(min(left, BUFFER * 16))
                if not bytes_:
                    raise OSError(f"{self.path} ends early")
                left -= len(bytes_)
                *lines, rest = (rest + bytes_).split(b"\n")
                for line in (*lines, rest) if not left else lines:
                    if line:
                        yield _location(json.loads(line.removesuffix(b",")), place)
                        place += 1


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its number, file, bytes and rows, and (byte, row) where shares begin."""

    task: int
    file: str | None = None
    size: int = 0
    rows: int = 0
    begins: list[tuple[int, int]] = field(default_factory=list)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str, updated: str):
        self.path, self.version, self.updated = path, version, updated
        self.beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        part, out = Part(TaskContext.get().partitionId()), None
        system, folder = _opened(self.beside)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(folder)
                    part.file = f"{folder}/{uuid.uuid4().hex}"  # another one for each attempt
                    out = system.open_output_stream(part.file)
                for row in batch.select([f.name for f in LOCATIONS[1:]]).to_pylist():
                    line = json.dumps(_present(row), ensure_ascii=False, separators=(",", ":")).encode()
                    start = part.size + (2 if part.rows else 0)
                    if not part.begins or start - part.begins[-1][0] >= SHARE:
                        part.begins.append((start, part.rows))
                    out.write(b",\n" + line if part.rows else line)
                    part.size, part.rows = start + len(line), part.rows + 1
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.task)
        system, folder = _opened(self.beside)
        system.create_dir(folder)
        begins, rows, size = [], 0, 0
        with system.open_output_stream(f"{folder}/whole") as out:

            def put(bytes_: bytes) -> None:
                nonlocal size
                out.write(bytes_)
                size += len(bytes_)

            put(json.dumps({"version": self.version, "lastUpdated": self.updated}, ensure_ascii=False)[:-1].encode() + b', "locations":[\n')
            for part in parts:
                if rows:
                    put(b",\n")
                begins += [[size + a, rows + b] for a, b in part.begins]
                with system.open_input_stream(part.file) as file:
                    while chunk := file.read(BUFFER * 16):
                        put(chunk)
                rows += part.rows
            out.write(f'\n],"parts":{{"size":{size},"at":{json.dumps(begins)},"begins":"{size:0{DIGITS}d}"}}}}\n'.encode())
        system.move(f"{folder}/whole", _opened(self.path)[1])
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = _opened(self.beside)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tempora_document"

    def schema(self):
        return LOCATIONS

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if not overwrite:
            raise ValueError("a document is overwritten as a whole")
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        return DocumentWriter(self.options["path"], self.options.get("version", VERSION), self.options.get("updated", now))


@dataclass
class Change(InputPartition):
    poll_ts: datetime
    updated: str | None


class SnapshotReader(DataSourceStreamReader):
    """Offsets are numbers of changes; the log has a file for each number that a query may still ask for."""

    def __init__(self, path: str, log: str):
        self.path, self.log = path, log

    def _numbers(self) -> list[int]:
        system, folder = _opened(self.log)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def _change(self, number: int) -> dict:
        system, folder = _opened(self.log)
        with system.open_input_stream(f"{folder}/{number:0{DIGITS}d}") as file:
            return json.loads(file.read())

    def _polled(self) -> str | None:
        system, inner = _opened(self.path)
        with system.open_input_stream(inner) as stream:
            for key, value in fields_of(stream, "locations"):
                if key == "lastUpdated":
                    return _text(value)
        return None

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        try:
            updated = self._polled()
        except (OSError, ValueError):  # a poll that fails is left out
            return {"number": last}
        if not last or self._change(last)["updated"] != updated:
            system, folder = _opened(self.log)
            system.create_dir(folder)
            last += 1
            with system.open_output_stream(f"{folder}/new-{last}") as file:
                file.write(json.dumps({"poll_ts": datetime.now(UTC).timestamp(), "updated": updated}).encode())
            system.move(f"{folder}/new-{last}", f"{folder}/{last:0{DIGITS}d}")
        return {"number": last}

    def partitions(self, start: dict, end: dict) -> list[Change]:
        changes = [self._change(n) for n in range(start["number"] + 1, end["number"] + 1)]
        return [Change(datetime.fromtimestamp(c["poll_ts"], UTC), c["updated"]) for c in changes]

    def read(self, change: Change) -> Iterator[tuple]:
        yield change.poll_ts, change.updated

    def commit(self, end: dict) -> None:
        system, folder = _opened(self.log)
        for number in self._numbers():
            if number < end["number"]:  # the last one is what the next poll is held against
                system.delete_file(f"{folder}/{number:0{DIGITS}d}")


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tempora_snapshots"

    def schema(self) -> str:
        return "poll_ts timestamp, lastUpdated string"

    def streamReader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"], self.options["log"])


def register(spark: SparkSession) -> SparkSession:
    """``spark``, which then knows both sources."""
    spark.dataSource.register(DocumentSource)
    spark.dataSource.register(SnapshotSource)
    return spark
