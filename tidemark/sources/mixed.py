"""A folder of mixed files as one Spark source that reads every file's contents by a handler.

Handlers are registered by extension, with a priority and capabilities. ``source`` makes a Python data source of them, so
``spark.read.format("mixed").load(path)`` gives the records of all files: small files share a partition, large files of a line format are
split into ranges of bytes, and filters on the extension or the handler leave files out before any is opened. Files are listed and
opened through pyarrow's file systems. A file without a handler is one record without text; so is a file that its handler
cannot read, with the error among its attributes.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, extension string, handler string, position long, text string, attributes map<string, string>"
ARROW = pa.schema([("path", pa.string()), ("extension", pa.string()), ("handler", pa.string()), ("position", pa.int64()), ("text", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
#: A record of a handler: place in the file, text, attributes.
Record = tuple[int, str, dict[str, str]]
UNSUPPORTED = "unsupported"


@dataclass(frozen=True)
class Handler:
    """How files of some extensions are read: ``read(stream)`` gives the records of a file, or where it is ``by_line``, ``read(line, position)`` those of a line."""

    name: str
    extensions: tuple[str, ...]
    read: Callable
    priority: int = 0
    by_line: bool = False
    capabilities: frozenset[str] = frozenset()


@dataclass
class Handlers:
    """A registry of handlers."""

    known: dict[str, Handler] = field(default_factory=dict)

    def register(self, name: str, *extensions: str, priority: int = 0, by_line: bool = False, capabilities: tuple[str, ...] = ()) -> Callable:
        """Decorator: the function becomes the handler of a name; a name that is there already is replaced."""

        def add(read: Callable) -> Callable:
            self.known[name] = Handler(name, tuple(e.lower().lstrip(".") for e in extensions), read, priority, by_line, frozenset(capabilities))
            return read

        return add

    def of(self, extension: str) -> Handler | None:
        """The handler of highest priority for an extension; of equal ones the first by name."""
        able = [h for h in self.known.values() if extension in h.extensions]
        return min(able, key=lambda h: (-h.priority, h.name), default=None)

    def able_to(self, capability: str) -> list[Handler]:
        return sorted((h for h in self.known.values() if capability in h.capabilities), key=lambda h: (-h.priority, h.name))

    def copy(self) -> Handlers:
        return Handlers(dict(self.known))


STANDARD = Handlers()


@STANDARD.register("text", "txt", "log", capabilities=("text",))
def read_text(stream: io.BufferedIOBase) -> Iterator[Record]:
    yield 0, stream.read().decode(errors="replace"), {}


@STANDARD.register("markdown", "md", capabilities=("text", "structure"))
def read_markdown(stream: io.BufferedIOBase) -> Iterator[Record]:
    """One record; its headings, a line each, are an attribute."""
    text = stream.read().decode(errors="replace")
    yield 0, text, {"headings": "\n".join(re.findall(r"(?m)^#{1,6}\s+(.*)$", text))}


@STANDARD.register("xml", "xml", capabilities=("text", "structure"))
@STANDARD.register("html", "html", "htm", capabilities=("text", "structure"))
def read_html(stream: io.BufferedIOBase) -> Iterator[Record]:
    """One record: the text without tags, scripts and styles, its white space made single blanks; the title is an attribute."""
    page = stream.read().decode(errors="replace")
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    body = re.sub(r"(?is)<(script|style|title)\b.*?</\1\s*>", " ", page)
    yield 0, re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", body))).strip(" "), {"title": html.unescape(title.group(1)).strip()} if title else {}


@STANDARD.register("csv", "csv", capabilities=("tables",))
def read_csv(stream: io.BufferedIOBase) -> Iterator[Record]:
    """A record a row below the header: the column ``text``, or else all columns, and the others as attributes."""
    rows = csv.reader(io.TextIOWrapper(stream, "utf-8", errors="replace", newline=""))
    header = next(rows, [])
    csv.field_size_limit(1 << 30)
    for n, row in enumerate(rows):
        own = dict(zip(header, row, strict=False))
        yield n, own.pop("text") if "text" in own else ",".join(row), own


@STANDARD.register("json", "json", "jsonl", "ndjson", by_line=True, capabilities=("records",))
def read_json_line(line: bytes, position: int) -> Iterator[Record]:
    """A record a line: the field ``text``, or else the line, and the other fields as attributes."""
    value = json.loads(line)
    own = value if isinstance(value, dict) else {}
    text = own.get("text") if isinstance(own.get("text"), str) else line.decode()
    yield position, text, {k: v if isinstance(v, str) else json.dumps(v) for k, v in own.items() if k != "text"}


@dataclass
class Files(InputPartition):
    """Parts of files: path, extension, handler's name, first byte, and the byte behind the last or None for the whole."""

    parts: tuple[tuple[str, str, str, int, int | None], ...]

    def __init__(self, parts: list) -> None:
        self.parts = tuple(parts)


def lines(stream: io.BufferedIOBase, start: int, stop: int | None) -> Iterator[tuple[bytes, int]]:
    """The lines that start inside a range of bytes, with their places."""
    at = start
    if start:
        stream.seek(start - 1)
        at += len(stream.readline()) - 1
    while stop is None or at < stop:
        line = stream.readline()
        if not line:
            return
        if line.strip():
            yield line.rstrip(b"\r\n"), at
        at += len(line)


class MixedReader(DataSourceReader):
    def __init__(self, path: str, handlers: Handlers, partition_bytes: int) -> None:
        self.path, self.handlers, self.partition_bytes = path, handlers, partition_bytes
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of extension and handler; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("extension", "handler") and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[column] = self.allowed.get(column, wanted) & wanted
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            hidden = any(part[:1] in ("_", ".") for part in info.path[len(root) :].split("/"))
            if info.type != fs.FileType.File or hidden:
                continue
            extension = info.extension.lower()
            handler = self.handlers.of(extension)
            name = handler.name if handler else UNSUPPORTED
            if all(value in self.allowed.get(column, {value}) for column, value in (("extension", extension), ("handler", name))):
                found.append((info.path, extension, name, info.size, bool(handler and handler.by_line)))
        out: list[list] = []
        room = 0
        for path, extension, name, size, splits in sorted(found):
            pieces = [(a, min(size, a + self.partition_bytes)) for a in range(0, size, self.partition_bytes)] if splits and size > self.partition_bytes else [(0, None)]
            for start, stop in pieces:
                own = (stop - start) if stop else size
                if not out or own > room:
                    out.append([])
                    room = self.partition_bytes
                out[-1].append((path, extension, name, start, stop))
                room -= max(own, 1)
        return [Files(parts) for parts in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        held: list[tuple] = []
        size = 0
        for path, extension, name, start, stop in partition.parts:
            for position, text, attributes in self._records(system, path, name, start, stop):
                held.append((path, extension, name, position, text, list(attributes.items())))
                size += len(text or "")
                if len(held) >= 1000 or size > 4_000_000:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _records(self, system: fs.FileSystem, path: str, name: str, start: int, stop: int | None) -> Iterator[tuple]:
        handler = self.handlers.known.get(name)
        if handler is None:
            yield 0, None, {}
            return
        with io.BufferedReader(system.open_input_file(path)) as stream:
            if not handler.by_line:
                try:
                    yield from handler.read(stream)
                except Exception as error:  # noqa: BLE001 a broken file is a record of its own
                    yield 0, None, {"error": f"{type(error).__name__}: {error}"}
                return
            for line, at in lines(stream, start, stop):
                try:
                    yield from handler.read(line, at)
                except Exception as error:  # noqa: BLE001
                    yield at, None, {"error": f"{type(error).__name__}: {error}"}

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def source(handlers: Handlers = STANDARD, name: str = "mixed") -> type[DataSource]:
    """A data source class for a registry as it is now. Options: path, and partitionBytes (64 MB)."""
    held, short = handlers.copy(), name

    class Mixed(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return MixedReader(self.options["path"], held, int(self.options.get("partitionBytes", 64 << 20)))

    return Mixed


def register(spark: SparkSession, handlers: Handlers = STANDARD, name: str = "mixed") -> None:
    """Make ``spark.read.format(name)`` read by these handlers, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(handlers, name))
