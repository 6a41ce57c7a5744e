"""A sink for streams and batches of lines in which each epoch is there once, however often it was tried.

`writeStream.format("epochs")` lets tasks write files under names of their own; an epoch happens when the driver moves
a manifest with its files' names into place. A task or driver that dies before leaves files that nothing names, and an
epoch that is done again finds its manifest and gives up its own files, or fails if it has another number of lines. Both sides go through pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

PARTS, MANIFESTS = "parts", "epochs"


def _paths(root: str):
    return pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _manifest(epoch: int) -> str:
    return f"{epoch:012d}.json"


@dataclass
class Written(WriterCommitMessage):
    """A task's file, or none if it had no rows, and its lines."""

    name: str | None
    lines: int


class _Tasks:
    """What writers of streams and of batches have in common."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        """One file; a null line is left out, and line breaks inside of a line are refused."""
        system, base = _paths(self.root)
        name, out, n = f"{uuid.uuid4().hex}.jsonl", None, 0
        try:
            for row in rows:
                line = row[0]
                if line is None:
                    continue
                if "\n" in line or "\r" in line:
                    raise ValueError("a line has a line break")
                if out is None:
                    system.create_dir(f"{base}/{PARTS}", recursive=True)
                    out = system.open_output_stream(f"{base}/{PARTS}/{name}", compression=None)
                out.write(line.encode() + b"\n")
                n += 1
        finally:
            if out is not None:
                out.close()
        return Written(name if n else None, n)

    def _drop(self, messages: list) -> None:
        system, base = _paths(self.root)
        for m in messages:
            if m is not None and m.name and system.get_file_info(f"{base}/{PARTS}/{m.name}").type != pafs.FileType.NotFound:
                system.delete_file(f"{base}/{PARTS}/{m.name}")

    def _commit(self, messages: list, epoch: int) -> None:
        system, base = _paths(self.root)
        place = f"{base}/{MANIFESTS}/{_manifest(epoch)}"
        lines = sum(m.lines for m in messages if m)
        if system.get_file_info(place).type != pafs.FileType.NotFound:
            self._drop(messages)
            with system.open_input_stream(place) as f:
                if json.loads(f.read())["lines"] != lines:
                    raise ValueError(f"epoch {epoch} of {self.root} is there with other lines: does its checkpoint belong to it?")
            return
        system.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        aside = f"{base}/{MANIFESTS}/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside, compression=None) as out:
            out.write(json.dumps({"files": sorted(m.name for m in messages if m and m.name), "lines": lines}).encode())
        system.move(aside, place)


class _Stream(_Tasks, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class _Batch(_Tasks, DataSourceWriter):
    def __init__(self, root: str, epoch: int):
        super().__init__(root)
        self.epoch = epoch

    def commit(self, messages: list) -> None:
        self._commit(messages, self.epoch)

    def abort(self, messages: list) -> None:
        self._drop(messages)


class EpochSink(DataSource):
    """Options: path; for a batch also epoch, the number by which it is known when it is tried again."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self._root(schema))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Batch(self._root(schema), int(self.options["epoch"]))

    def _root(self, schema) -> str:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("the sink takes one column of lines")
        return self.options["path"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpochSink)


def append_once(df: DataFrame, root: str, epoch: int) -> None:
    """Write df's rows as JSON lines, unless this epoch is there already."""
    register(df.sparkSession)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.format("epochs").option("path", root).option("epoch", str(epoch)).mode("append").save()


def start(df: DataFrame, root: str, checkpoint: str, **trigger):
    """The stream's rows as JSON lines, each epoch once."""
    register(df.sparkSession)
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return lines.writeStream.format("epochs").option("path", root).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def happened(root: str, after: int = -1) -> dict[int, dict]:
    """The manifests of the epochs after one, by number."""
    system, base = _paths(root)
    found = system.get_file_info(pafs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True))
    out = {}
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json") and int(info.base_name[:-5]) > after:
            with system.open_input_stream(info.path) as f:
                out[int(info.base_name[:-5])] = json.loads(f.read())
    return out


def read(spark: SparkSession, root: str, schema: str, after: int = -1) -> DataFrame:
    """The rows of the epochs that have happened after one: only files that a manifest names."""
    root = root.rstrip("/")
    files = [f"{root}/{PARTS}/{f}" for m in happened(root, after).values() for f in m["files"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def sweep(root: str) -> int:
    """Remove files that no manifest names; only while nothing writes. How many there were."""
    system, base = _paths(root)
    named = {f for m in happened(root).values() for f in m["files"]}
    gone = [i.path for i in system.get_file_info(pafs.FileSelector(f"{base}/{PARTS}", allow_not_found=True)) if i.base_name not in named]
    for path in gone:
        system.delete_file(path)
    return len(gone)
