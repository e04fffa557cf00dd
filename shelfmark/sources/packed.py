"""Packed captures: archive files of many pages each, as a Spark data source.

An archive is a run of records and an index. A record is a line of JSON with a page's metadata, and the bytes of its body. The index, at
the end of the file, holds the offset and the two lengths of each record as 64-bit numbers, then their number and the mark ``MAGIC``; so a
reader of any byte range knows the records that begin in it without a search, and one that needs no body reads metadata alone.

    register(spark)
    df.select("id", "url", "html").write.format("packed-pages").mode("append").save(path)
    spark.read.format("packed-pages").load(path)                             # metadata and bodies
    spark.read.format("packed-pages").schema("id string").load(path)         # metadata alone: bodies are skipped

Each writing task makes one archive, under a name that is hidden until the job commits; the files of a failed task or job are deleted. So
the number of files follows the tasks, not the pages. Reading, a file is split by ``splitBytes``. Values are strings;
null values are kept. Paths are those of a mounted file system or of any that pyarrow knows by its scheme. An absent or empty folder gives no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BODY = "html"
MAGIC = b"PKPAGES1"
SPLIT_BYTES = 64 << 20
_ENTRY = struct.Struct("<qqq")
_TAIL = struct.Struct("<q8s")


def _files(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    shown: str | None
    pages: int


class PackedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed-pages"

    def schema(self) -> str:
        return f"id string, url string, kind string, {BODY} string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PackedWriter(self.options, schema, overwrite)


class PackedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, root = _files(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        archives = [f for f in found if f.is_file and f.base_name.endswith(".pages") and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(at + self.split, f.size)) for f in archives for at in range(0, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        files, _ = _files(self.path)
        with files.open_input_file(partition.file) as f:
            size = f.size()
            f.seek(size - _TAIL.size)
            many, magic = _TAIL.unpack(f.read(_TAIL.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.file} is no packed capture")
            f.seek(size - _TAIL.size - many * _ENTRY.size)
            index = f.read(many * _ENTRY.size)
            bodies = BODY in self.names
            for at, head, body in _ENTRY.iter_unpack(index):
                if not partition.begin <= at < partition.end:
                    continue
                f.seek(at)
                page = json.loads(f.read(head))
                if bodies:
                    page[BODY] = None if body < 0 else f.read(body).decode("utf-8", "surrogatepass")
                yield tuple(page.get(n) for n in self.names)


class PackedWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, root = _files(self.path)
        name = f"{self.job}-{uuid.uuid4().hex}.pages"
        out, index, at = None, [], 0
        for row in iterator:
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/.{name}")
            page = dict(zip(self.names, row, strict=True))
            html = page.pop(BODY, None)
            body = None if html is None else html.encode("utf-8", "surrogatepass")
            head = json.dumps(page, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n"
            out.write(head)
            if body:
                out.write(body)
            index.append((at, len(head), -1 if body is None else len(body)))
            at += len(head) + len(body or b"")
        if out is None:
            return Written(None, None, 0)
        for entry in index:
            out.write(_ENTRY.pack(*entry))
        out.write(_TAIL.pack(len(index), MAGIC))
        out.close()
        return Written(f"{root}/.{name}", f"{root}/{name}", len(index))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        done = [m for m in messages if m and m.hidden]
        for m in done:
            files.move(m.hidden, m.shown)
        kept = {m.shown.rsplit("/", 1)[-1] for m in done}
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            attempt = f.base_name.startswith(f".{self.job}")  # of a task that did not end
            if f.is_file and (attempt or (self.overwrite and f.base_name.endswith(".pages") and f.base_name not in kept)):
                files.delete_file(f.path)

    def abort(self, messages: list) -> None:
        files, _ = _files(self.path)
        for m in messages:
            if m and m.hidden:
                files.delete_file(m.hidden)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedPages)
