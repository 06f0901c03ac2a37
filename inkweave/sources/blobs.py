"""Blobs as a data source: files of any store that every executor reaches, read and written by their own tasks."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes that a partition should get.
PARTITION = 64 << 20
#: The end of the names of blobs that are being written.
HALF = ".half-"


def _store(folder: str):
    """(file system, folder in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class Some(InputPartition):
    """The blobs of one task: (key, path, length) of each."""

    blobs: list[tuple[str, str, int]]


@dataclass
class Written(WriterCommitMessage):
    count: int


class BlobSource(DataSource):
    """``blobs``: rows (key, length, content) of the files below a folder; keys are paths from there.

    Options: ``path``; ``fallback``, a folder that is read where ``path`` isn't there; ``pattern`` for names of files;
    ``partition_bytes``. Written rows need key and content. A blob is written beside its place and moved there, so a task
    that runs again leaves whole files and readers never see half of one.
    """

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "key string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return BlobReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("blobs are added or replaced one by one: use mode('append')")
        return BlobWriter(self.options["path"], [f.name for f in schema.fields])


class BlobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.fallback = options["path"], options.get("fallback")
        self.pattern, self.most = options.get("pattern", "*"), int(options.get("partition_bytes", PARTITION))

    def _listed(self) -> tuple[str, list]:
        from pyarrow import fs

        for folder in [self.folder, *([self.fallback] if self.fallback else [])]:
            store, base = _store(folder)
            if store.get_file_info(base).type == fs.FileType.Directory:
                return folder, [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
        raise FileNotFoundError(self.folder)

    def partitions(self) -> list[Some]:
        folder, found = self._listed()
        self.folder = folder
        base = _store(folder)[1].rstrip("/")
        parts, held, size = [], [], 0
        for path, length in sorted(found):
            name = path.rpartition("/")[2]
            if HALF in name or not fnmatch.fnmatch(name, self.pattern):
                continue
            if held and size + length > self.most:
                parts.append(Some(held))
                held, size = [], 0
            held.append((path[len(base) + 1 :], path, length))
            size += length
        return [*parts, Some(held)] if held or not parts else parts

    def read(self, partition: Some) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        for key, path, length in partition.blobs:
            with store.open_input_stream(path) as file:
                yield key, length, file.read()


class BlobWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.key, self.content = folder, columns.index("key"), columns.index("content")

    def write(self, rows: Iterator) -> Written:
        store, base = _store(self.folder)
        count, made = 0, set()
        for row in rows:
            path = f"{base.rstrip('/')}/{row[self.key]}"
            parent = path.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            half = f"{path}{HALF}{uuid.uuid4().hex}"
            with store.open_output_stream(half) as out:
                out.write(row[self.content] or b"")
            store.move(half, path)
            count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        """Blobs are in place when their tasks end."""

    def abort(self, messages: list) -> None:
        """Whole blobs stay: writing them again replaces them."""


def read_blobs(spark: SparkSession, folder: str, fallback: str | None = None, pattern: str = "*") -> DataFrame:
    """(key, length, content) of the blobs of a folder, or of the fallback where the folder isn't there."""
    spark.dataSource.register(BlobSource)
    reader = spark.read.format("blobs").option("path", folder).option("pattern", pattern)
    return (reader.option("fallback", fallback) if fallback else reader).load()


def write_blobs(blobs: DataFrame, folder: str) -> None:
    """Write blobs (key, content) to a folder: one action, not a lazy frame."""
    blobs.sparkSession.dataSource.register(BlobSource)
    blobs.select("key", "content").write.format("blobs").option("path", folder).mode("append").save()


def unread(blobs: DataFrame, done: DataFrame) -> DataFrame:
    """The blobs whose keys aren't among those of done (key)."""
    return blobs.join(done.select("key"), "key", "left_anti")
