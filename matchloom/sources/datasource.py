"""Catalogue texts as a data source: spark.read.format("catalogue") and df.write.format("catalogue").

A text is a folder of parts and a manifest, which names the parts in their order. It is written by many tasks,
each a part, and there from the moment the manifest is; parts that no manifest names are those of lost writers. Reading
splits parts by bytes. A folder without a manifest is a folder of texts, each file by itself.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a split.
SPLIT_BYTES = 32 << 20
MANIFEST = "_catalogue.json"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it: anything pyarrow knows by its scheme, or a local path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Split(InputPartition):
    """Bytes start to end of a part, which begins at byte base of text file."""

    file: int
    path: str
    base: int
    start: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: int | None
    size: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        system, root = _at(self.path)
        if system.get_file_info(posixpath.join(root, MANIFEST)).type == fs.FileType.File:
            with system.open_input_stream(posixpath.join(root, MANIFEST)) as f:
                parts = json.loads(f.read())["parts"]
            texts, base = [], 0
            for name, size in parts:
                texts.append((0, posixpath.join(root, name), base, size))
                base += size
        else:
            info = system.get_file_info(root)
            files = [info] if info.type == fs.FileType.File else sorted((x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name[0] not in "._"), key=lambda x: x.path)
            texts = [(k, x.path, 0, x.size) for k, x in enumerate(files)]
        return [Split(file, path, base, at, min(at + self.split, size)) for file, path, base, size in texts for at in range(0, size, self.split)] or [Split(0, "", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple[int, int, str]]:
        """The lines that begin in a split; line_no is the byte of the text at which a line begins."""
        if not partition.path:
            return
        system, _ = _at(self.path)
        with system.open_input_file(partition.path) as f:
            at = max(0, partition.start - 1)
            f.seek(at)
            lines = _lines(f)
            if partition.start:  # the line that the byte before belongs to is another split's
                at += len(next(lines, b""))
            for raw in lines:
                if at >= partition.end:
                    return
                inner = at
                for line in raw.decode("utf-8", "replace").splitlines(keepends=True):
                    yield partition.file, partition.base + inner, line.splitlines()[0]
                    inner += len(line.encode())
                at += len(raw)


def _lines(f) -> Iterator[bytes]:
    """Lines of a file from where it stands, each with its line feed."""
    held = b""
    while block := f.read(1 << 20):
        *whole, held = (held + block).split(b"\n")
        yield from (x + b"\n" for x in whole)
    if held:
        yield held


class Writer(DataSourceWriter):
    """Rows of line_no and line, dealt by ranges of line_no and sorted within them (write_catalogue does so)."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _at(self.path)
        system.create_dir(root, recursive=True)
        name = f"{self.run}-{context.partitionId()}-{context.taskAttemptId()}.part"
        first, size = None, 0
        with system.open_output_stream(posixpath.join(root, name)) as f:
            for row in iterator:
                first = row["line_no"] if first is None else first
                raw = ((row["line"] or "") + "\n").encode()
                f.write(raw)
                size += len(raw)
        return Part(name, first, size)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = _at(self.path)
        system.create_dir(root, recursive=True)
        manifest = posixpath.join(root, MANIFEST)
        there = system.get_file_info(manifest).type == fs.FileType.File
        if there and not self.overwrite:
            raise FileExistsError(f"{self.path} is there already")
        kept = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.first)
        held = posixpath.join(root, f".{self.run}.json")
        with system.open_output_stream(held) as f:
            f.write(json.dumps({"parts": [[m.name, m.size] for m in kept]}).encode())
        system.move(held, manifest)  # from here on the text is the new one
        for x in system.get_file_info(fs.FileSelector(root)):
            if x.base_name.endswith(".part") and x.base_name not in {m.name for m in kept}:
                system.delete_file(x.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, root = _at(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(posixpath.join(root, m.name))


class CatalogueSource(DataSource):
    """Options: path; split_bytes. Columns: file, line_no, line, as parse() takes them."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "file long, line_no long, line string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register_source(spark: SparkSession) -> None:
    """Make the format "catalogue" known to a session; tasks need not have this package installed."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CatalogueSource)


def write_catalogue(lines, path: str, parts: int | None = None) -> None:
    """Write lines (line_no, line) as one text of many parts."""
    from pyspark.sql import functions as F

    spark = lines.sparkSession
    register_source(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select(F.lit(0).cast("long").alias("file"), F.col("line_no").cast("long").alias("line_no"), "line")
    rows.repartitionByRange(n, "line_no").sortWithinPartitions("line_no").write.format("catalogue").mode("overwrite").save(path)


def read_catalogue(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES):
    """file, line_no and line of a text that write_catalogue() has written, or of a folder of texts: what parse() takes."""
    register_source(spark)
    return spark.read.format("catalogue").option("split_bytes", split_bytes).load(path)
