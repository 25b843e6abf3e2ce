"""Versioned catalog of the indexes over vector tables.

The catalog is a folder.  ``log/version=N`` holds the whole list of indexes as
it was after commit N, one row per index; the greatest N is the current one.
Commits write version N + 1 as one file with Spark's job commit, so a reader
sees the old list or the new one and nothing between.  A table has one active
index at most: a build replaces the active one, a drop ends it.  An index is
written in a folder of its own and checked before the commit, so a build that
fails leaves the old index active and the log unchanged; the folders of ended
indexes stay for readers of older versions.

The log is bounded by the number of builds and drops, not by the tables' rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from nearfold.operators.tables import size_bytes
from nearfold.session import path_exists

ENTRY = (
    "index_id string, table string, index_type string, params map<string,int>, path string, n_rows long, "
    "size_bytes long, build_time_sec double, status string, since long, until long"
)


class ConcurrentCommit(RuntimeError):
    """Another commit took the next version; read the catalog again and retry."""


class IndexCatalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The current version; 0 for a catalog without commits."""
        log = f"{self.root}/log"
        if not path_exists(self.spark, f"{log}/version=1"):
            return 0
        return self.spark.read.parquet(log).agg(F.max("version")).first()[0]

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The indexes as of ``version`` (current by default)."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/log/version={version}")

    def history(self) -> DataFrame:
        """All versions' lists, with their ``version``."""
        if self.version() == 0:
            return self.spark.createDataFrame([], f"{ENTRY}, version int")
        return self.spark.read.schema(f"{ENTRY}, version int").parquet(f"{self.root}/log")

    def active(self, table: str, version: int | None = None) -> Row | None:
        """The active index of ``table``, or None."""
        found = self.snapshot(version).where((F.col("table") == table) & (F.col("status") == "active")).collect()
        return found[0] if found else None

    def build(self, table: str, index_type: str, params: dict[str, int], write: Callable[[str], int], expected_rows: int | None = None) -> Row:
        """Write an index with ``write(path) -> rows`` and make it the active one of ``table``.

        Raises, without a commit, if the writer fails or wrote another number of rows than expected."""
        base = self.version()
        index_id = uuid.uuid4().hex[:12]
        path = f"{self.root}/data/{index_id}"
        begin = time.perf_counter()
        n_rows = write(path)
        seconds = round(time.perf_counter() - begin, 3)
        if expected_rows is not None and n_rows != expected_rows:
            raise AssertionError(f"index {index_id} of {table} holds {n_rows} rows instead of {expected_rows}")
        entry = (index_id, table, index_type, {k: int(v) for k, v in params.items()}, path, n_rows, size_bytes(self.spark, path), seconds, "active", base + 1, None)
        self._commit(base, self._ended(base, table, "replaced").unionByName(self.spark.createDataFrame([entry], ENTRY)))
        return self.active(table)

    def drop(self, table: str) -> bool:
        """End the active index of ``table``; False (and no commit) if it has none."""
        base = self.version()
        if self.active(table, base) is None:
            return False
        self._commit(base, self._ended(base, table, "dropped"))
        return True

    def _ended(self, base: int, table: str, status: str) -> DataFrame:
        """The list of version ``base`` with the active index of ``table`` ended."""
        mine = (F.col("table") == table) & (F.col("status") == "active")
        return self.snapshot(base).withColumns(
            {"until": F.when(mine, F.lit(base + 1)).otherwise(F.col("until")).cast("long"), "status": F.when(mine, F.lit(status)).otherwise(F.col("status"))}
        )

    def _commit(self, base: int, entries: DataFrame) -> None:
        path = f"{self.root}/log/version={base + 1}"
        if path_exists(self.spark, path):
            raise ConcurrentCommit(path)
        entries.coalesce(1).write.mode("errorifexists").parquet(path)
