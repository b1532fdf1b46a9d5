"""Tables on disk as immutable snapshots that one small manifest switches.

Every commit writes its tables into a folder of its own and, when all of them
are complete, a manifest that names them; it appears by a rename, whole or not
at all.  A reader follows the manifest of the greatest number.  So a table may
be written to the path that it was read from, a commit that fails between two
tables leaves the last snapshot as it was, and a reader keeps the snapshot that
it began with.  Writers that commit at the same time each make a whole
snapshot; the one with the greater name is read.  Snapshots older than the last
few are deleted, manifest first; folders without a manifest are those of a
commit under way or of one that failed, and stay until ``sweep``.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEPT = 2


class _Files:
    """The file system that holds a path, whatever it is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(n for s in self.fs.listStatus(self.path(folder)) if not (n := s.getPath().getName()).startswith((".", "_")))

    def written_at(self, name: str) -> float:
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        folder, _, last = name.rpartition("/")
        part = self.path(f"{folder}/_{last}")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(part, self.path(name)):
            raise OSError(f"{name} could not be put in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], version: int, by: str | None = None, kept: int = KEPT) -> str:
    """Write a snapshot and switch to it; returns its name.  Tables that have the column ``by`` are partitioned by it."""
    path, name = path.rstrip("/"), uuid.uuid4().hex
    files = _Files(spark, path)
    told = {}
    for table, df in tables.items():
        writer = df.write.partitionBy(by) if by in df.columns and len(df.columns) > 1 else df.write
        writer.parquet(f"{path}/data/{name}/{table}")
        told[table] = df.schema.json()
    last = files.names(f"{path}/manifests")
    number = int(last[-1].split("-")[0]) + 1 if last else 1
    files.put(f"{path}/manifests/{number:012d}-{name}.json", json.dumps({"version": version, "tables": told}))
    _expire(files, path, kept)
    return name


def _expire(files: _Files, path: str, kept: int) -> None:
    for old in files.names(f"{path}/manifests")[: -max(kept, 1)]:
        files.delete(f"{path}/manifests/{old}")
        files.delete(f"{path}/data/{_snapshot(old)}")


def _snapshot(manifest: str) -> str:
    return manifest.split("-")[1].removesuffix(".json")


def sweep(spark: SparkSession, path: str, older: float = 24 * 3600) -> int:
    """Delete what commits that failed have left and nobody has written to for ``older`` seconds; how many."""
    files, gone = _Files(spark, path), 0
    live = {_snapshot(m) for m in files.names(f"{path}/manifests")}
    for name in files.names(f"{path}/data"):
        if name not in live and files.written_at(f"{path}/data/{name}") <= time.time() - older:
            files.delete(f"{path}/data/{name}")
            gone += 1
    return gone


def newest(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]] | None:
    """Version and tables of the snapshot that the last manifest names; nothing if there is none."""
    path = path.rstrip("/")
    files = _Files(spark, path)
    manifests = files.names(f"{path}/manifests")
    if not manifests:
        return None
    last = json.loads(files.read(f"{path}/manifests/{manifests[-1]}"))
    folder = f"{path}/data/{_snapshot(manifests[-1])}"
    read = {}
    for table, schema in last["tables"].items():
        kind = T.StructType.fromJson(json.loads(schema))
        for f in kind.fields:
            f.nullable = True
        read[table] = spark.read.schema(kind).parquet(f"{folder}/{table}").select(*kind.names)  # the schema, for ids in folder names may look like numbers
    return last["version"], read
