"""Writing into tables: create, insert, reload, and versions that readers switch to.

Catalog tables take CREATE OR REPLACE, INSERT ... SELECT and TRUNCATE with reload. A :class:`Versioned` table is a folder of
data and of numbered lists of it: every change writes its data and then the next list, so a change may read what it replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import upsert
from millrace.plans.checkpoints import cut


def create_or_replace(df: DataFrame, name: str) -> None:
    """A catalog table with the rows of ``df``, which may be read from the table that is replaced."""
    cut(df).write.mode("overwrite").saveAsTable(name)


def insert_select(df: DataFrame, name: str) -> None:
    """Append rows; columns go by name, and those that ``df`` lacks are null."""
    df.sparkSession.table(name).limit(0).unionByName(df, allowMissingColumns=True).write.insertInto(name)


def reload(df: DataFrame, name: str) -> None:
    """Truncate and fill: afterwards the table has the rows of ``df`` alone."""
    rows = cut(df.sparkSession.table(name).limit(0).unionByName(df, allowMissingColumns=True))
    rows.write.insertInto(name, overwrite=True)


class Versioned:
    """A table under ``root``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[str]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder))

    def _files(self) -> list[str]:
        """The folders that make up the table: those that the version of the highest number lists."""
        numbers = self._numbers()
        return [r.value for r in self.spark.read.text(f"{self.root}/versions/{numbers[-1]}").collect()] if numbers else []

    def _switch(self, files: list[str]) -> None:
        """List ``files`` as the next version. The list is written aside and renamed, so readers see all of it or the one before,
        and no list is ever taken away; of two writers of one number the second fails."""
        numbers = self._numbers()
        fresh, version = f"{self.root}/list-{uuid.uuid4().hex}", f"{self.root}/versions/{int(numbers[-1]) + 1 if numbers else 0:012d}"
        self.spark.createDataFrame([(f,) for f in files], "value string").coalesce(1).write.text(fresh)
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        if self._fs.exists(self._path(version)) or not self._fs.rename(self._path(fresh), self._path(version)):
            raise OSError(f"cannot switch {self.root} to {version}")

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(f"{self.root} has no version yet")
        return self.spark.read.option("mergeSchema", "true").parquet(*self._files())

    def replace(self, df: DataFrame) -> None:
        """Write a version and point readers to it; a reader that has begun still has the old one."""
        self._switch([upsert.write_version(df, self.root)])

    def insert(self, df: DataFrame) -> None:
        """Add rows: only these are written, and the next version lists them beside what there is. Columns that either side lacks
        are null."""
        files = self._files()
        rows = self.read().limit(0).unionByName(df, allowMissingColumns=True) if files else df
        self._switch([*files, upsert.write_version(rows, self.root)])

    def truncate(self) -> None:
        self.replace(self.read().limit(0))

    def merge(self, source: DataFrame, keys: Sequence[str], **how) -> None:
        self.replace(upsert.merge(self.read(), source, keys, **how))

    def update(self, source: DataFrame, keys: Sequence[str], column: str) -> None:
        self.replace(upsert.update_column(self.read(), source, keys, column))
