"""Folders of JSON lines as a data source: spark.read.format("evidence").option("path", uri).load().

A row a line: the folder and file it is in (paths from the top), its number from 1, and the record as text or, for a line that is
no JSON object, what is wrong with it. Empty lines are left out. Options: include, a glob that file names must fit (*.jsonl), and
files, how many files are read at most, in order of their paths (all; a feature for trying things out). Each file is a partition;
filters on folder or file are decided while files are planned, so others aren't opened. Paths are those that Arrow's file systems
take, and must be reached from all executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "folder string, file string, line bigint, record string, error string"
BATCH_LINES = 4096
_ARROW = pa.schema([("folder", pa.string()), ("file", pa.string()), ("line", pa.int64()), ("record", pa.string()), ("error", pa.string())])


class FilePartition(InputPartition):
    def __init__(self, folder: str, file: str, path: str):
        self.folder, self.file, self.path = folder, file, path


def _fault(line: str) -> str | None:
    try:
        return None if isinstance(json.loads(line), dict) else "not an object"
    except ValueError as e:
        return str(e)


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.include, self.most = options["path"], options.get("include", "*.jsonl"), options.get("files")
        self.wanted: dict[str, list[set]] = {"folder": [], "file": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.wanted:
                self.wanted[f.attribute[0]].append(set(f.value) if isinstance(f, In) else {f.value})
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.uri)
        found = []
        for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
            inside = info.path[len(top) :].lstrip("/")
            folder, _, name = inside.rpartition("/")
            if info.type == fs.FileType.File and fnmatch(name, self.include) and not name.startswith(("_", ".")):
                found.append(FilePartition(folder, inside, info.path))
        found.sort(key=lambda p: p.file)
        found = found[: int(self.most)] if self.most else found
        return [p for p in found if all(getattr(p, c) in allowed for c, sets in self.wanted.items() for allowed in sets)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(partition.path) as stream:
            rows, rest, number = [], b"", 0
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    number += 1
                    rows += self._row(partition, number, line)
                if len(rows) >= BATCH_LINES:
                    yield self._batch(rows)
                    rows = []
            rows += self._row(partition, number + 1, rest)
            yield self._batch(rows)

    @staticmethod
    def _row(partition: FilePartition, number: int, line: bytes) -> list[tuple]:
        text = line.decode("utf-8", "replace").strip("\ufeff\r ")
        if not text:
            return []
        fault = _fault(text)
        return [(partition.folder, partition.file, number, None if fault else text, fault)]

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvidenceReader:
        if "path" not in self.options:
            raise ValueError("evidence needs a path")
        return EvidenceReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EvidenceSource)
