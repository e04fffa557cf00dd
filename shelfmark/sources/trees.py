"""Trees of many small files, which tasks list, read and write.

Spark's reader keeps the list of a tree's files in the driver (about 1 KB a file), its writer makes folders and files twice and, on a local disk without Hadoop's
native library, starts a process for each to set its mode. Here a tree is listed level by level into a table, bodies are added to rows after all joins,
and a file is written by one call. Paths are those of a mounted file system or of any that pyarrow knows by its scheme.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import _files

_ENTRIES = "file string, folder boolean, size long"
_ROWS, _BYTES = 4096, 8 << 20  # of a batch
#: Bytes that a task reads where a tree has many.
TASK_BYTES = 128 << 20


def located(spark: SparkSession, path: str, make: bool = False) -> str:
    """``path`` as tasks open it, made on request: Spark's default file system holds for a path without a scheme, mounts are resolved, a local path has no scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if make:
        files.mkdirs(at)
    uri = (files.resolvePath(at) if files.exists(at) else files.makeQualified(at)).toUri()
    return uri.getPath() if uri.getScheme() == "file" else uri.toString()


def is_folder(path: str) -> bool:
    """Whether pyarrow knows a located path's file system and finds a folder there."""
    from pyarrow import fs

    try:
        files, top = _files(path)
        return files.get_file_info(top).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def shown(name: str) -> bool:
    """Whether Spark's readers see files and folders of this name."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def _entries(path: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folders are replaced by what stands in them, or in the whole of them; files stay."""

    schema = pa.schema([("file", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = _files(path)
        top, rows = top.rstrip("/"), []
        for given in (x for batch in batches for x in batch.to_pylist()):
            todo = [given["file"]] if given["folder"] else []
            if not todo:  # a file stays
                rows.append(given)
            while todo:
                at = todo.pop()
                for found in files.get_file_info(fs.FileSelector(f"{top}/{at}")):
                    if not shown(found.base_name):
                        continue
                    name, folder = f"{at}/{found.base_name}" if at else found.base_name, found.type == fs.FileType.Directory
                    if folder and deep:
                        todo.append(name)
                    else:
                        rows.append({"file": name, "folder": folder, "size": found.size or 0})
                    if len(rows) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return listed


@dataclass
class Tree:
    """A listed tree: files has the path of each file below the root that is not hidden, nor empty."""

    path: str
    files: DataFrame
    tasks: int

    def named(self, glob: str) -> DataFrame:
        """Those whose name matches a pattern of ``*`` and ``?``."""
        name = "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c) for c in glob)
        return self.files.where(F.col("file").rlike(f"(^|/){name}\\z"))

    def with_bodies(self, rows: DataFrame, at: str, body: str) -> DataFrame:
        """``rows`` with the whole file whose path stands in ``at``, read by as many tasks as the tree asks for; null without a path."""
        path = self.path

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, top = _files(path)
            top = top.rstrip("/")
            for batch in batches:
                first, size, found = 0, 0, []
                names = batch.column(at).to_pylist()
                for i, name in enumerate(names, 1):
                    if name is None:
                        found.append(None)
                    else:
                        with files.open_input_file(f"{top}/{name}") as f:
                            found.append(f.read())
                        size += len(found[-1])
                    if size >= _BYTES or i == len(names):
                        yield pa.RecordBatch.from_arrays([*batch.slice(first, i - first).columns, pa.array(found, pa.binary())], names=[*batch.schema.names, body])
                        first, size, found = i, 0, []

        schema = T.StructType([*rows.schema.fields, T.StructField(body, T.BinaryType())])
        return rows.repartition(self.tasks).mapInArrow(read, schema).withColumn(body, F.col(body).cast("string"))


def listed(spark: SparkSession, path: str, table: str) -> Tree:
    """The tree of a located path, its list kept in ``table``: the root and its folders are listed by a task each, all that stands in those by all cores."""
    cores = spark.sparkContext.defaultParallelism
    first = spark.range(0, 1, 1, 1).select(F.lit("").alias("file"), F.lit(True).alias("folder"), F.lit(0).cast("long").alias("size"))
    level = first.mapInArrow(_entries(path, False), _ENTRIES)
    for deep in (False, True):
        level = level.repartition(2 * cores).mapInArrow(_entries(path, deep), _ENTRIES)
    level.where("size > 0").select("file", "size").write.parquet(table)
    files = spark.read.schema("file string, size long").parquet(table)
    size = files.agg(F.sum("size")).first()[0] or 0
    return Tree(path, files.select("file"), max(4 * cores, size // TASK_BYTES))


def with_files(rows: DataFrame, root: str, file: str = "file", content: str = "html") -> DataFrame:
    """``rows`` without their content, which the tasks that make them write as files below the root; null content makes no file.

    A file appears whole, under a hidden name before, so a task can run again."""
    path = located(rows.sparkSession, root, make=True)
    _files(path)  # an unknown file system is told before any task runs

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _files(path)
        top, made = top.rstrip("/"), None
        for batch in batches:
            at = batch.schema.get_field_index(content)
            for name, body in zip(batch.column(file), batch.column(at), strict=True):
                if not body.is_valid:
                    continue
                folder, _, own = f"{top}/{name.as_py()}".rpartition("/")
                if folder != made:
                    files.create_dir(folder, recursive=True)
                    made = folder
                hidden = f"{folder}/.{own}-{uuid.uuid4().hex}"
                with files.open_output_stream(hidden) as out:
                    out.write(body.as_buffer())
                files.move(hidden, f"{folder}/{own}")
            yield batch.remove_column(at)

    kept = T.StructType([f for f in rows.schema.fields if f.name != content])
    return rows.withColumn(content, F.col(content).cast("binary")).mapInArrow(put, kept)
