"""Tables that are written in numbered commits: a commit that is repeated adds nothing, and a new version is made of the one it has read or not at all.

A commit's rows lie in a folder of their own, with a name that no other attempt has; a marker with the commit's number names the folder and is created only if it is not there (which is one step where the file system makes it so, as on HDFS). Rows without a marker are of attempts that failed and are never read. The markers are a line each: a table of very many commits is rewritten as one version now and then (`compacted`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer made the version first."""


@dataclass
class Log:
    """A table of commits in a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _fs(self, name: str) -> tuple:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """The commits that are there, in order."""
        fs, path = self._fs("commits")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdecimal())

    def latest(self) -> int:
        """The last commit's number, -1 if there is none."""
        return max(self.numbers(), default=-1)

    def has(self, number: int) -> bool:
        fs, path = self._fs(f"commits/{number}")
        return bool(fs.exists(path))

    def append(self, number: int, rows: DataFrame) -> bool:
        """Add the rows as a commit; False if it is there already, and then nothing is written."""
        if self.has(number):
            return False
        attempt = f"{number}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/rows/{attempt}")
        return self._mark(number, attempt)

    def _mark(self, number: int, attempt: str) -> bool:
        fs, path = self._fs(f"commits/{number}")
        try:
            out = fs.create(path, False)
        except Exception as e:  # the only refusal of a file that is there; anything else is a fault of its own
            if fs.exists(path):
                return False
            raise e
        out.write(bytearray(attempt.encode()))
        out.close()
        return True

    def _attempt(self, number: int) -> str:
        fs, path = self._fs(f"commits/{number}")
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def read(self, schema: StructType | str, since: int = -1) -> DataFrame:
        """The rows of all commits after `since`; of none, an empty table."""
        wanted = [n for n in self.numbers() if n > since]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/rows/{self._attempt(n)}" for n in wanted))

    def version(self, schema: StructType | str) -> tuple[int, DataFrame]:
        """(number, rows) of the last commit alone, for tables whose commits are whole versions."""
        n = self.latest()
        return n, self.read(schema, n - 1)

    def put(self, expected: int, rows: DataFrame) -> int:
        """Make the version after `expected`, the last one that the writer has read; Conflict if there is one already."""
        if self.latest() != expected or not self.append(expected + 1, rows):
            raise Conflict(f"{self.folder}: version {expected + 1} is there")
        return expected + 1

    def update(self, schema: StructType | str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Make a new version of what `change` makes of the last one, read anew when another writer comes first."""
        for _ in range(tries):
            n, rows = self.version(schema)
            try:
                return self.put(n, change(rows))
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: {tries} attempts came second")
