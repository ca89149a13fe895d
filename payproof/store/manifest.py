"""Which files make up a dataset: versions of a small table, of which the latest counts.

A commit is one row file that appears by one rename, so readers see the entries of one commit or of the one before, never
a mixture. Data is written to a directory of its own first and named by a commit afterwards; what no commit names is as if
it had not been written. There is one writer at a time; of two that commit at once, all readers see the same one win.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "version BIGINT, commit STRING, name STRING, path STRING"


class Manifest:
    """Entries by name, each the path of a directory. ``root`` holds the commits and the directories."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root.rstrip("/")
        self._log = posixpath.join(self._root, "commits")

    def _latest(self) -> tuple[int, dict[str, str]]:
        """Version and entries of the latest commit; 0 and none before the first."""
        try:
            log = self._spark.read.schema(SCHEMA).parquet(self._log)
            last = log.selectExpr("max(struct(version, commit)) AS last").first().last
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        entries = log.where((log.version == last.version) & (log.commit == last.commit)).collect()
        return last.version, {e.name: e.path for e in entries if e.name is not None}

    def entries(self) -> dict[str, str]:
        """The entries of the latest commit. They name directories, and are few."""
        return self._latest()[1]

    def new_folder(self) -> str:
        """A directory that no commit names yet."""
        return posixpath.join(self._root, "data", uuid.uuid4().hex)

    def commit(self, changed: Mapping[str, str], removed: Iterable[str] = ()) -> None:
        """The entries of the latest commit with some set and some taken out, as the new latest."""
        version, entries = self._latest()
        gone = set(removed)
        entries = {name: path for name, path in entries.items() if name not in gone} | dict(changed)
        mark = uuid.uuid4().hex
        # A commit without entries is one row without name.
        rows = [(version + 1, mark, name, path) for name, path in entries.items()] or [(version + 1, mark, None, None)]
        self._spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self._log)

    def read(self, names: Iterable[str], schema: str) -> DataFrame:
        """The rows of several entries; no rows if there are none."""
        entries = self.entries()
        paths = [entries[name] for name in names if name in entries]
        if not paths:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*paths)
