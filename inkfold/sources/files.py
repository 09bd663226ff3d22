"""A sink for files, which Spark lacks: rows (name, content) become files of a folder, in a batch or a stream. And their reading:
Spark's file source keeps every file's name on the driver, `listed` and `contents` keep names in tables.

A task writes into a folder of its own beside the target and reports it; only a commit of the whole write moves files to their
names, a folder that the target lacks as a whole. A failed task deletes what it wrote, an aborted write what its tasks left. Names decide the targets, so a write that is
run again gives the same files. Register the source with `spark.dataSource.register(FileSink)`, then
`df.write.format("file_sink").mode("append").save(folder)` or `df.writeStream.format("file_sink")...start(folder)`.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, Row, StringType, StructField, StructType

SCHEMA = StructType([StructField("name", StringType()), StructField("content", BinaryType())])
LISTED = "path string, modificationTime timestamp, length long"
FILES = f"{LISTED}, content binary"
FILES_A_TASK, BATCH_BYTES = 8192, 16 << 20


def contained(name: str) -> str:
    """A name that stays inside its folder, or an error."""
    path = posixpath.normpath(name)
    if not name or path.startswith(("/", "..")) or path == ".":
        raise ValueError(f"a file's name must lie inside the folder: {name!r}")
    return path


def opened(folder: str) -> tuple[object, str]:
    """The file system and path of a folder: a URI of a store that pyarrow reaches (hdfs, s3, gs), or a local one, taken as it is."""
    from pyarrow import fs

    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), posixpath.abspath("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)


@dataclass
class Written(WriterCommitMessage):
    """What a task reports: its folder and the number of its files, not their names."""

    folder: str
    files: int


class _Files:
    """One write, in tasks and on the driver. `attempt` names its folder beside the files."""

    def __init__(self, folder: str, attempt: str):
        self.folder, self.beside = folder, f".writing-{attempt}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = opened(self.folder)
        mine = f"{root}/{self.beside}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        try:
            n, made = 0, {mine}
            for row in rows:
                if row.name is None or row.content is None:
                    continue
                path = f"{mine}/{contained(row.name)}"
                if (parent := posixpath.dirname(path)) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(path, compression=None) as out:  # else a name in .gz would decide what is written
                    out.write(bytes(row.content))
                n += 1
            return Written(mine, n)
        except BaseException:
            store.delete_dir(mine)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        """Move every task's files to their names: one rename for a folder that the target does not have, one a file elsewhere."""
        store, root = opened(self.folder)
        for message in messages:
            if message is not None and message.files:
                self._move(store, message.folder, root)
        self.clean()

    def _move(self, store: object, source: str, target: str) -> None:
        """What source holds, into the folder target, which exists."""
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(source))
        folders = [f for f in found if f.type == fs.FileType.Directory]
        for f in found:
            if f.is_file:
                store.move(f.path, f"{target}/{f.base_name}")
        there = store.get_file_info([f"{target}/{f.base_name}" for f in folders])
        for f, at in zip(folders, there, strict=True):
            if at.type == fs.FileType.NotFound:
                store.move(f.path, at.path)
            else:
                self._move(store, f.path, at.path)

    def clean(self) -> None:
        from pyarrow import fs

        store, root = opened(self.folder)
        if store.get_file_info(f"{root}/{self.beside}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.beside}")


class _Batch(DataSourceWriter):
    def __init__(self, folder: str):
        self.files = _Files(folder, uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.files.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.files.clean()


class _Stream(DataSourceStreamWriter):
    """A batch that Spark runs again after a crash is written to the same names again."""

    def __init__(self, folder: str):
        self.files = _Files(folder, uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.files.commit(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.files.clean()


class FileSink(DataSource):
    """Rows (name string, content binary) as files; a row without name or content gives none; of rows with one name one stays."""

    @classmethod
    def name(cls) -> str:
        return "file_sink"

    def schema(self) -> StructType:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("file_sink only adds files: use mode append")
        return _Batch(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self.options["path"])


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of its file system, as paths of Spark's file source begin."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _shown(name: str) -> bool:
    """Spark's readers pass over the other names."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def listed(spark: SparkSession, folder: str, into: str) -> DataFrame:
    """(path, modificationTime, length) of the files in a folder and below it, empty ones too, in tables of the new folder `into`.
    Tasks list the folders, one level after the other; the driver sees no names. One task lists a folder's own entries."""
    import pyarrow as pa
    from pyarrow import fs

    top, tasks = qualified(spark, folder), spark.sparkContext.defaultParallelism
    store, root = opened(top)
    if store.get_file_info(root).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder: {folder}")
    entry = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("folder", pa.bool_())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(top)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = store.get_file_info(fs.FileSelector(root + path.removeprefix(top), allow_not_found=True))
                found = [f for f in found if _shown(f.base_name) and (f.is_file or f.type == fs.FileType.Directory)]
                for k in range(0, len(found), FILES_A_TASK):
                    some = found[k : k + FILES_A_TASK]
                    times = [f.mtime_ns and f.mtime_ns // 1000 for f in some]
                    columns = [[f"{path}/{f.base_name}" for f in some], times, [f.size for f in some], [not f.is_file for f in some]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, entry.types, strict=True)], schema=entry)

    levels, folders = [], spark.createDataFrame([(top,)], "path string")
    while not levels or not folders.isEmpty():
        levels.append(f"{into}/{len(levels)}")
        folders.repartition(tasks, "path").mapInArrow(entries, f"{LISTED}, folder boolean").write.parquet(levels[-1])
        folders = spark.read.schema(f"{LISTED}, folder boolean").parquet(levels[-1]).where("folder").select("path")
    return spark.read.schema(f"{LISTED}, folder boolean").parquet(*levels).where("not folder").drop("folder")


def contents(files: DataFrame, folder: str) -> DataFrame:
    """Rows of listed() of a folder, with the content of each file, read in tasks of some thousands of files."""
    import pyarrow as pa

    spark = files.sparkSession
    top, tasks = qualified(spark, folder), max(spark.sparkContext.defaultParallelism, math.ceil(files.count() / FILES_A_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(top)
        for batch in batches:
            begin, held, size = 0, [], 0
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(root + path.removeprefix(top), compression=None) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or begin + len(held) == batch.num_rows:
                    yield batch.slice(begin, len(held)).append_column("content", pa.array(held, pa.binary()))
                    begin, held, size = begin + len(held), [], 0

    return files.select("path", "modificationTime", "length").repartition(tasks, "path").mapInArrow(read, FILES)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """For reads and streams of Spark's own file source over many small files that run inside, to their end: a task reads some
    thousands of them, not 31, and a few tasks list them, not one for each path. The driver holds their names; see listed()."""
    wanted = {"spark.sql.files.openCostInBytes": "64KB", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
