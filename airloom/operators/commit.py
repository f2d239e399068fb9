"""Atomic publication of several tables: a new version directory, then one pointer file.

Pointers are numbered and never replaced: the highest one holds. A new one appears by a single rename, so readers, who
resolve it once, see either the old or the new world and never none. Only one writer may publish at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> tuple[int, int]:
        """(number, version) of the pointer that holds; zeros where nothing was published."""
        folder = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(folder):
            return 0, 0
        last = max((f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=None)
        return (int(last), int(self.spark.read.text(f"{self.root}/CURRENT/{last}").first()[0])) if last else (0, 0)

    def _point(self, version: int) -> None:
        number = self._pointer()[0] + 1
        self._fs.mkdirs(self._path(f"{self.root}/CURRENT"))
        self._text(f"{self.root}/_next", str(version))
        if not self._fs.rename(self._path(f"{self.root}/_next"), self._path(f"{self.root}/CURRENT/{number:012d}")):
            raise OSError("the pointer could not be set")

    def version(self) -> int:
        return self._pointer()[1]

    def _newest(self) -> int:
        """The highest version that was ever published, also where readers were pointed back behind it."""
        if not self._pointer()[0]:
            return 0
        return max(int(r[0]) for r in self.spark.read.text(f"{self.root}/CURRENT").collect())  # one number a publication

    def table(self, name: str, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.root}/v={v}/{name}")

    def publish(self, tables: dict[str, DataFrame], before_swap: Callable[[], None] | None = None) -> int:
        """Write all tables as the next version and swap the pointer; a failure before the swap leaves the old world."""
        new = self._newest() + 1
        base = f"{self.root}/v={new}"
        self._fs.delete(self._path(base), True)
        for name, df in tables.items():
            df.write.parquet(f"{base}/{name}")
        self._text(f"{base}/_manifest.json", json.dumps({"version": new, "tables": sorted(tables)}))
        if before_swap:
            before_swap()
        self._point(new)
        return new

    def rollback(self, version: int) -> None:
        """Point readers at an earlier version."""
        if not self._fs.exists(self._path(f"{self.root}/v={version}/_manifest.json")):
            raise ValueError(f"no version {version}")
        self._point(version)

    def backup(self, to: str) -> None:
        """A copy of the current version directory."""
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self._fs, self._path(f"{self.root}/v={self.version()}"), self._fs, self._path(to), False, self.spark._jsc.hadoopConfiguration())

    def _text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()
