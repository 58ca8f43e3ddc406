"""A Python data source over Parquet row groups, and how such sources are registered.

``spark.read.format("row_groups")`` reads a file or folder with a partition per row group,
as Arrow batches; as a stream it takes in files as they come, by their number in order of
arrival; written to, it stages a file per task and shows them when all tasks are done.
It is a working source for stores that ``pyarrow`` reaches, and a pattern for others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

STAGED = ".staged"


def register(spark: SparkSession, *kinds: type[DataSource]) -> None:
    """Make Python data sources known to the session, by their names, for reading and writing."""
    for kind in kinds or (RowGroups,):
        spark.dataSource.register(kind)


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Complete Parquet files in order of arrival."""
    from pyarrow import fs

    store, inside = _store(path)
    found = store.get_file_info(inside)
    if found.type == fs.FileType.File:
        return [inside]
    if found.type == fs.FileType.NotFound:
        return []
    below = store.get_file_info(fs.FileSelector(inside, recursive=True))
    names = [(f.mtime_ns, f.path) for f in below if f.type == fs.FileType.File and f.path.endswith(".parquet")]
    return [p for _, p in sorted(names) if not p.rsplit("/", 1)[-1].startswith(("_", "."))]


@dataclass
class RowGroup(InputPartition):
    file: str
    number: int


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int


class _Groups:
    """What batch and stream readers share."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def groups(self, files: Sequence[str]) -> list[RowGroup]:
        import pyarrow.parquet as pq

        store, _ = _store(self.path)
        counts = [(f, pq.ParquetFile(store.open_input_file(f)).num_row_groups) for f in files]
        return [RowGroup(f, i) for f, n in counts for i in range(n)]

    def batches(self, group: RowGroup) -> Iterator:
        import pyarrow.parquet as pq

        store, _ = _store(self.path)
        with store.open_input_file(group.file) as opened:
            yield from pq.ParquetFile(opened).iter_batches(row_groups=[group.number], columns=self.names)


class GroupsReader(_Groups, DataSourceReader):
    def partitions(self) -> list[RowGroup]:
        # an empty table still needs a partition
        return self.groups(_files(self.path)) or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator:
        return self.batches(partition) if partition.number >= 0 else iter(())


class GroupsStream(_Groups, DataSourceStreamReader):
    """Offsets are numbers of files; files that come later must sort after those there."""

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return self.groups(_files(self.path)[start["files"] : end["files"]])

    def read(self, partition: RowGroup) -> Iterator:
        return self.batches(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class _Staging:
    """A file per task, out of readers' sight until it is moved to its name."""

    def __init__(self, path: str) -> None:
        self.path = path

    def stage(self, batches: Iterator) -> Staged:
        import pyarrow.parquet as pq

        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        name, writer, rows = f"{inside}/{uuid.uuid4().hex}.parquet{STAGED}", None, 0
        for batch in batches:
            writer = writer or pq.ParquetWriter(store.open_output_stream(name), batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Staged(None, 0)
        writer.close()
        writer.file_handle and writer.file_handle.close()
        return Staged(name, rows)

    def show(self, messages: Sequence[Staged | None], prefix: str) -> None:
        store, inside = _store(self.path)
        for number, message in enumerate(m for m in messages if m is not None and m.file):
            store.move(message.file, f"{inside}/{prefix}-{number:05d}.parquet")

    def remove(self, files: Sequence[str]) -> None:
        store, _ = _store(self.path)
        for file in files:
            store.delete_file(file)


class GroupsWriter(_Staging, DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        super().__init__(path)
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: Sequence[Staged | None]) -> None:
        before = _files(self.path) if self.overwrite else []
        self.show(messages, f"part-{uuid.uuid4().hex[:12]}")
        self.remove(before)

    def abort(self, messages: Sequence[Staged | None]) -> None:
        self.remove([m.file for m in messages if m is not None and m.file])


class GroupsSink(_Staging, DataSourceStreamArrowWriter):
    """A micro-batch that is repeated replaces its files."""

    def write(self, iterator: Iterator) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: Sequence[Staged | None], batchId: int) -> None:
        prefix = f"batch-{batchId:010d}"
        self.remove([f for f in _files(self.path) if f.rsplit("/", 1)[-1].startswith(f"{prefix}-")])
        self.show(messages, prefix)

    def abort(self, messages: Sequence[Staged | None], batchId: int) -> None:
        self.remove([m.file for m in messages if m is not None and m.file])


class RowGroups(DataSource):
    """``path``: a Parquet file or a folder of them; a schema must be given where there is no file yet."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("row_groups needs the option path")
        return path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self._path())
        if not files:
            raise ValueError("no Parquet file to take the schema from; give a schema")
        store, _ = _store(self._path())
        with store.open_input_file(files[0]) as opened:
            return from_arrow_schema(pq.read_schema(opened), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> GroupsReader:
        return GroupsReader(self._path(), schema)

    def streamReader(self, schema: StructType) -> GroupsStream:
        return GroupsStream(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> GroupsWriter:
        return GroupsWriter(self._path(), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> GroupsSink:
        return GroupsSink(self._path())
