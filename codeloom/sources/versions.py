"""Tables kept in a folder as numbered versions, for state that goes on from run to run.

A version is written whole before a marker makes it the current one, so a reader never sees half of it and a run that
is lost half-way leaves the version before it as it was. The folder has to be one that all executors share.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARKER = "_CURRENT"


class Versions:
    """keep: how many versions stay, the current one among them; older ones are removed when a new one is current."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 1):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def all(self) -> list[int]:
        """The numbers of the versions that are whole, the current one last."""
        path, files = self._path()
        if not files.exists(path):
            return []
        names = (s.getPath().getName() for s in files.listStatus(path))
        numbers = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return [n for n in numbers if files.exists(self._path(f"v{n}", MARKER)[0])]

    def current(self) -> int:
        """The number of the current version; 0 if there is none."""
        found = self.all()
        return found[-1] if found else 0

    def read(self, name: str, schema: T.StructType | str) -> DataFrame | None:
        """A table of the current version; None if there is no version or it lacks the table."""
        n = self.current()
        path, files = self._path(f"v{n}", name)
        return self.spark.read.schema(schema).parquet(str(path)) if n and files.exists(path) else None

    def write(self, tables: Mapping[str, DataFrame], partitions: Mapping[str, list[str]] | None = None) -> int:
        """Write a next version, make it current and remove the old ones."""
        n = self.current() + 1
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            if by := (partitions or {}).get(name):
                writer = writer.partitionBy(*by)
            writer.parquet(f"{self.folder}/v{n}/{name}")
        path, files = self._path(f"v{n}", MARKER)
        files.create(path, True).close()
        for old in self.all()[: -self.keep]:
            files.delete(self._path(f"v{old}")[0], True)
        return n
