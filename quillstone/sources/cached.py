"""A Python data source for cached downloads: bytes that are verified where they are read, and a writer that publishes all or nothing.

A cache folder holds, for each address, `<sha256 of the address>` with its bytes and `<sha256 of the address>.meta.json` with format version, address, byte count
and checksum. Reading lists the folder once and cuts it into partitions of about ``PART_BYTES``; an executor reads the bytes and compares them with what
is stated. By default only entries that hold are rows; with option `all` every entry is a row, with the reason why it must not be used.

Writing takes rows (source_url, content). Tasks put their files into a pending folder of the job; once all have succeeded the driver moves them, bytes
before statement, so that a reader in between rejects an entry and never takes half of it. If a task fails, the pending folder goes and nothing
is published. Paths are those of pyarrow's file systems, so that a cluster names a store that all executors reach.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow.fs as fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillstone.functions.shipping import ship
from quillstone.sources.filings import allowed

FORMAT_VERSION, META, PART_BYTES = 1, ".meta.json", 64_000_000
SCHEMA = "source_url string, content binary, byte_count long, content_sha256 string, retrieved_at string, reason string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _bytes(system: fs.FileSystem, path: str) -> bytes | None:
    try:
        with system.open_input_stream(path) as found:
            return found.read()
    except FileNotFoundError:
        return None


def verified(name: str, meta: bytes | None, content: bytes | None) -> tuple:
    """A row of SCHEMA: what the statement says of the bytes, and the first reason for which they must not be used."""
    try:
        stated = json.loads(meta or b"")
    except ValueError:
        return None, content, None, None, None, "statement is not JSON"
    if not isinstance(stated, dict):
        return None, content, None, None, None, "statement is no object"
    url = stated.get("source_url")
    row = (url if isinstance(url, str) else None, content, stated.get("byte_count"), stated.get("content_sha256"), stated.get("retrieved_at"))
    row = tuple(x if isinstance(x, t) and not isinstance(x, bool) else None for x, t in zip(row, (str, bytes, int, str, str), strict=True))
    if stated.get("format_version") != FORMAT_VERSION:
        return *row, "other format version"
    if row[0] is None or hashlib.sha256(row[0].encode()).hexdigest() != name:
        return *row, "statement of another address"
    if not content:
        return *row, "no content"
    if stated.get("byte_count") != len(content):
        return *row, "byte count differs"
    return *row, None if stated.get("content_sha256") == hashlib.sha256(content).hexdigest() else "checksum differs"


@dataclass
class Entries(InputPartition):
    """Names of some entries of a cache."""

    names: tuple[str, ...]


class CachedReader(DataSourceReader):
    def __init__(self, path: str, every: bool) -> None:
        self.path, self.every = path, every

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File]
        size = {i.base_name: i.size for i in found}
        parts: list[list[str]] = [[]]
        held = 0
        for name in sorted(n.removesuffix(META) for n in size if n.endswith(META)):
            held += size.get(name, 0)
            if parts[-1] and held > PART_BYTES:
                parts.append([])
                held = size.get(name, 0)
            parts[-1].append(name)
        return [Entries(tuple(p)) for p in parts if p] or [Entries(())]

    def read(self, partition: Entries) -> Iterator[tuple]:
        system, root = opened(self.path)
        for name in partition.names:
            row = verified(name, _bytes(system, f"{root}/{name}{META}"), _bytes(system, f"{root}/{name}"))
            if self.every or row[-1] is None:
                yield row


@dataclass
class Written(WriterCommitMessage):
    """Names of the entries that a task has put into the pending folder."""

    names: tuple[str, ...]


class CachedWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = opened(self.path)
        pending, names = f"{root}/_pending-{self.job}", {}
        system.create_dir(pending)
        for row in rows:
            url, content = row["source_url"], bytes(row["content"] or b"")
            if not url or not allowed(url):
                raise ValueError("address is not allowed")
            if not content:
                raise ValueError("no content")
            name = hashlib.sha256(url.encode()).hexdigest()
            own = f"{name}-{uuid.uuid4().hex}"
            meta = {"format_version": FORMAT_VERSION, "source_url": url, "retrieved_at": datetime.now(UTC).isoformat(), "byte_count": len(content), "content_sha256": hashlib.sha256(content).hexdigest()}
            for end, data in (("", content), (META, json.dumps(meta).encode())):
                with system.open_output_stream(f"{pending}/{own}{end}") as out:
                    out.write(data)
            names[name] = own
        return Written(tuple(names.values()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        pending = f"{root}/_pending-{self.job}"
        entries = {own.split("-")[0]: own for m in messages if m is not None for own in m.names}
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if i.type == fs.FileType.File and i.base_name.removesuffix(META) not in entries:
                    system.delete_file(i.path)
        for name, own in entries.items():
            for end in ("", META):
                system.move(f"{pending}/{own}{end}", f"{root}/{name}{end}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/_pending-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_pending-{self.job}")


class Cached(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillstone_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return CachedReader(self.options["path"], self.options.get("all", "false").lower() == "true")

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return CachedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `quillstone_cache` known to a session."""
    ship(spark)
    spark.dataSource.register(Cached)
