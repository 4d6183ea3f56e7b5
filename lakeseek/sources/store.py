"""Versioned snapshots with numbered pointers, CSV export, and a run lock; all through Hadoop file systems."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Versions of a table that stay: the current one and those that readers may still hold.
KEEP = 3


class Store:
    """Named tables under a base path. A publish writes a new version folder, then swaps the table's pointer; readers see the old or the new version, never a part.

    A version is one folder or, after appends, several. Folders that none of the last ``keep`` versions has are deleted.
    """

    def __init__(self, spark: SparkSession, base: str, keep: int = KEEP) -> None:
        self.spark, self.base, self.keep = spark, base.rstrip("/"), keep
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(f"{self.base}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """The numbers of a value's files, oldest first."""
        found = self._fs.globStatus(self._path(f"{name}.*")) or []
        ends = (status.getPath().getName().rsplit(".", 1)[1] for status in found)
        return sorted(int(end) for end in ends if end.isdigit())

    def _read(self, name: str) -> dict:
        numbers = self._numbers(name)
        if not numbers:
            return {}
        try:
            return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.base}/{name}.{numbers[-1]:08d}").collect()))
        except ValueError:
            return {}

    def _write(self, name: str, value: dict) -> None:
        """A new file with the next number, complete before it has its name. Readers take the highest number, so at every moment they find the old value or the new one."""
        numbers = self._numbers(name)
        part = self._path(f"_{name}.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"{name}.{(numbers[-1] if numbers else 0) + 1:08d}")):
            raise OSError(f"{name} was replaced by another writer")
        for old in numbers[:-1]:  # the one before stays for readers that have just looked
            self._fs.delete(self._path(f"{name}.{old:08d}"), False)

    def state(self, name: str = "state") -> dict:
        """A small JSON state; unreadable or missing: empty."""
        return self._read(f"{name}.json")

    def set_state(self, name: str = "state", **values) -> None:
        self._write(f"{name}.json", self.state(name) | values)

    def version(self, table: str) -> str | None:
        return self._read(f"{table}.current.json").get("version")

    def _parts(self, table: str) -> list[str]:
        pointer = self._read(f"{table}.current.json")
        return pointer.get("parts") or ([pointer["version"]] if pointer.get("version") else [])

    def read(self, table: str) -> DataFrame | None:
        parts = self._parts(table)
        return self.spark.read.parquet(*[f"{self.base}/{table}/{p}" for p in parts]) if parts else None

    def _commit(self, table: str, parts: list[str]) -> str:
        """Point to the folders, then delete those of versions that have had their time."""
        pointer = self._read(f"{table}.current.json")
        earlier = [old for old in (self._parts(table), *pointer.get("earlier", [])) if old][: self.keep - 1]
        self._write(f"{table}.current.json", {"version": parts[-1], "parts": parts, "earlier": earlier})
        held = {p for version in (parts, *earlier) for p in version}
        for status in self._fs.listStatus(self._path(table)):
            if status.getPath().getName() not in held:
                self._fs.delete(status.getPath(), True)
        return parts[-1]

    def publish(self, table: str, rows: DataFrame, *partition_by: str) -> str:
        version = uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(f"{self.base}/{table}/{version}")
        return self._commit(table, [version])

    def append(self, table: str, rows: DataFrame) -> str:
        """A version with more rows; what is there isn't written again."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.base}/{table}/{version}")
        return self._commit(table, [*self._parts(table), version])

    def drop(self, table: str) -> None:
        """Reset: readers find no version from here on; the version folders go."""
        self._write(f"{table}.current.json", {})
        self._fs.delete(self._path(table), True)

    def remove(self, folder: str) -> None:
        """Delete a folder of the store that nothing points to."""
        self._fs.delete(self._path(folder), True)

    @contextmanager
    def lock(self, name: str = "run"):
        """Held by creating a file that must not exist; a stale one says so by its age."""
        path = self._path(f"{name}.lock")
        try:
            self._fs.create(path, False).close()
        except Exception as error:
            age = (self.spark._jvm.System.currentTimeMillis() - self._fs.getFileStatus(path).getModificationTime()) / 1000
            raise RuntimeError(f"another run holds {name}.lock, for {age:.0f} s") from error
        try:
            yield
        finally:
            self._fs.delete(path, False)


def write_csv(rows: DataFrame, path: str, position: str | None = None) -> None:
    """One CSV file with a header that starts with a byte-order mark, rows by position. For exports of a bounded number of rows."""
    if position:
        rows = rows.orderBy(position).drop(position)
    names = rows.columns
    rows.select(*[F.col(f"`{c}`").alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(names)]).coalesce(1).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("quoteAll", "false").csv(path)
