"""A sink for records that must be whole: attempts, patches, decisions. What is written appears on commit only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class LedgerSink(DataSource):
    """``df.write.format("ledger").option("path", p).mode("append").save()``: JSON lines, committed as a whole.

    Tasks write files that nothing names; the driver's commit writes one manifest that names those of the tasks that
    succeeded, under a temporary name, and moves it into place. Until then, and for ever if the job fails, readers see
    nothing of them. A task that is tried again writes another file, and only one of the two is named. An abort deletes
    what the tasks reported. ``read_ledger`` reads what manifests name.

    The path is any that Arrow's file systems know (a mounted folder, ``hdfs://``, ``s3://``), reached by all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("a ledger only grows")
        return _LedgerWriter(self.options["path"], [f.name for f in schema.fields])


class _LedgerWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.job = path, names, uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, rows: Iterator) -> _Written:
        store, root = self._fs()
        store.create_dir(f"{root}/data", recursive=True)
        name, n = f"{self.job}-{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(f"{root}/data/{name}") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
                n += 1
        return _Written(name, n)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = self._fs()
        store.create_dir(f"{root}/manifests", recursive=True)
        done = [m for m in messages if m is not None]
        with store.open_output_stream(f"{root}/manifests/_{self.job}.json") as out:
            out.write(json.dumps({"files": [m.name for m in done if m.rows], "rows": sum(m.rows for m in done)}).encode())
        store.move(f"{root}/manifests/_{self.job}.json", f"{root}/manifests/{self.job}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = self._fs()
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/data/{m.name}")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed jobs."""
    root = path.rstrip("/")
    try:
        named = spark.read.schema("files array<string>, rows bigint").json(f"{root}/manifests")  # names with an underscore are hidden
        files = [f"{root}/data/{f}" for r in named.select("files").toLocalIterator() for f in r.files or ()]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = []
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
