"""A library's folders as a table: a data source that lists years, events and clips, with what could not be read as rows instead of errors.

    folders.register(spark)
    rows = spark.read.format("library_folders").option("layout", "year").load("/mnt/library")
    events = library.list_events(folders.events(rows), ["2019"])

The folder has to be mounted at one path on the driver and on all executors. Each year (or, in a flat library, each run of folders) is a partition, so a filter on `year` leaves the other years unread; with the option `parts` a year is dealt out over so many partitions by the names of its events.
"""

from __future__ import annotations

import errno
import os
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.library import ORIGINALS, VIDEOS

#: Fixed value: the file that says that a folder is to be ignored.
MARKER = ".reelignore"
NAME = "library_folders"
#: Folders of a flat library in a partition.
RUN = 500
SCHEMA = "kind string, year string, event string, real string, linked boolean, marked boolean, pos long, chapter string, clip string, size long, mtime_ns long, status string, reason string"
#: What a missing entry, a parent that is no folder and a circle of links have in common: nothing is there.
_ABSENT = (errno.ENOENT, errno.ENOTDIR, errno.ELOOP)


def looked_at(path: str) -> tuple[str, str | None, os.stat_result | None]:
    """(status, reason, stat): present, absent or fault; a fault's reason is its name."""
    try:
        return "present", None, os.stat(path)
    except OSError as e:
        if e.errno in _ABSENT:
            return "absent", None, None
        return "fault", errno.errorcode.get(e.errno or 0, "EUNKNOWN"), None
    except ValueError:  # a name that no file can have
        return "absent", None, None


def stats(df: DataFrame, path: str = "path") -> DataFrame:
    """df with status, reason, is_file, size and mtime_ns of the paths; those that cannot be looked at keep their row."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [("absent", None, None) if p is None else looked_at(p) for p in batch.column(names.index(path)).to_pylist()]
            s = [x[2] for x in seen]
            more = [
                pa.array([x[0] for x in seen], pa.string()),
                pa.array([x[1] for x in seen], pa.string()),
                pa.array([None if x is None else stat.S_ISREG(x.st_mode) for x in s], pa.bool_()),
                pa.array([None if x is None else x.st_size for x in s], pa.int64()),
                pa.array([None if x is None else x.st_mtime_ns for x in s], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "status", "reason", "is_file", "size", "mtime_ns"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, status string, reason string, is_file boolean, size long, mtime_ns long")


def _listed(folder: str) -> tuple[list[str], str | None]:
    """(names in order, reason): what is in a folder, or why it cannot be listed."""
    try:
        return sorted(os.listdir(folder)), None
    except OSError as e:
        return [], errno.errorcode.get(e.errno or 0, "EUNKNOWN")


def _row(kind: str, year: str | None, event: str | None, **more: object) -> tuple:
    base = {"kind": kind, "year": year, "event": event, "real": None, "linked": None, "marked": None, "pos": None, "chapter": None, "clip": None, "size": None, "mtime_ns": None, "status": "present", "reason": None}
    return tuple((base | more).values())


@dataclass
class Part(InputPartition):
    """Some events of a library: those below a year whose names fall to a part of it, or a run of a flat library's folders."""

    year: str | None
    first: int
    names: list[str] | None
    part: int = 0


class Reader(DataSourceReader):
    def __init__(self, root: str, layout: str, suffixes: list[str], parts: int = 1):
        self.root, self.layout, self.suffixes, self.parts = root, layout, suffixes, parts
        self.years: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if self.layout == "year" and column == ("year",) and isinstance(f, EqualTo):
                wanted = {str(f.value)}
            elif self.layout == "year" and column == ("year",) and isinstance(f, In):
                wanted = {str(v) for v in f.value}
            else:
                yield f  # left to Spark
                continue
            self.years = wanted if self.years is None else self.years & wanted

    def partitions(self) -> list[InputPartition]:
        names, reason = _listed(self.root)
        if reason:
            raise OSError(f"{self.root}: {reason}")
        if self.layout == "flat":
            return [Part(None, at, names[at : at + RUN]) for at in range(0, len(names), RUN)]
        return [Part(name, at, None, part) for at, name in enumerate(names) if self.years is None or name in self.years for part in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Part)
        if partition.names is not None:
            for k, name in enumerate(partition.names):
                yield from self._event(None, name, partition.first + k)
            return
        status, reason, s = looked_at(os.path.join(self.root, partition.year or ""))
        if status == "fault" and not partition.part:
            yield _row("year", partition.year, None, status=status, reason=reason)
        if s is None or not stat.S_ISDIR(s.st_mode):
            return
        names, reason = _listed(os.path.join(self.root, partition.year or ""))
        if reason and not partition.part:
            yield _row("year", partition.year, None, status="fault", reason=reason)
        for k, name in enumerate(names):
            # by its name, not its place, which another task may see differently
            if zlib.crc32(os.fsencode(name)) % self.parts == partition.part:
                yield from self._event(partition.year, f"{partition.year}/{name}", (partition.first << 32) + k)

    def _event(self, year: str | None, event: str, pos: int) -> Iterator[tuple]:
        path = os.path.join(self.root, event)
        status, reason, s = looked_at(path)
        if s is None or not stat.S_ISDIR(s.st_mode):
            if status == "fault":
                yield _row("event", year, event, pos=pos, status=status, reason=reason)
            return
        real = os.path.realpath(path)
        marker = looked_at(os.path.join(path, MARKER))[2]
        marked = marker is not None and stat.S_ISREG(marker.st_mode)
        names, reason = _listed(path)
        yield _row("event", year, event, real=real, linked=real != os.path.join(os.path.realpath(self.root), event), marked=marked, pos=pos, status="fault" if reason else "present", reason=reason)
        yield from self._clips(year, event, path, "", names, pos)
        for name in names:
            below = os.path.join(path, name)
            status, reason, s = looked_at(below)
            if status == "fault":
                yield _row("chapter", year, event, chapter=name, pos=pos, status=status, reason=reason)
            if s is None or not stat.S_ISDIR(s.st_mode) or name.casefold() == ORIGINALS:
                continue
            status, reason, marker = looked_at(os.path.join(below, MARKER))
            inside, fault = _listed(below)
            if status == "fault" or fault:
                yield _row("chapter", year, event, chapter=name, pos=pos, status="fault", reason=reason or fault)
            elif marker is None or not stat.S_ISREG(marker.st_mode):
                yield from self._clips(year, event, below, name, inside, pos)

    def _clips(self, year: str | None, event: str, folder: str, chapter: str, names: list[str], pos: int) -> Iterator[tuple]:
        for name in names:
            if os.path.splitext(name)[1].lower() not in self.suffixes:
                continue
            status, reason, s = looked_at(os.path.join(folder, name))
            if s is not None and not stat.S_ISREG(s.st_mode):
                continue
            clip = f"{chapter}/{name}" if chapter else name
            yield _row("clip", year, event, pos=pos, chapter=chapter, clip=clip, size=None if s is None else s.st_size, mtime_ns=None if s is None else s.st_mtime_ns, status=status, reason=reason)


class FolderSource(DataSource):
    """Options: path, the library's folder; layout, `year` (folders of years hold events) or `flat`; suffixes, of clips, separated by commas; parts, the partitions of a year (1), each of which lists the year and looks at its own events."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        layout = self.options.get("layout", "year")
        if layout not in ("year", "flat"):
            raise ValueError(f"layout {layout!r} is neither year nor flat")
        root = self.options.get("path")
        if not root:
            raise ValueError("a path is needed")
        parts = int(self.options.get("parts", "1"))
        if parts < 1:
            raise ValueError(f"{parts} parts are too few")
        suffixes = self.options.get("suffixes")
        return Reader(root.removeprefix("file://"), layout, suffixes.split(",") if suffixes else VIDEOS, parts)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)


def events(rows: DataFrame, root: str = "") -> DataFrame:
    """(root, path, year, real, linked, marked, pos): folders that can be read, for `library.list_events`."""
    return rows.filter("kind = 'event' and real is not null").select(F.lit(root).alias("root"), F.col("event").alias("path"), "year", "real", "linked", "marked", "pos")


def clips(rows: DataFrame) -> DataFrame:
    """(year, event, chapter, clip, size, mtime_ns): clips that are there."""
    return rows.filter("kind = 'clip' and status = 'present'").select("year", "event", "chapter", "clip", "size", "mtime_ns")


def faults(rows: DataFrame) -> DataFrame:
    """(kind, year, event, chapter, clip, reason): what could not be looked at."""
    return rows.filter("status = 'fault'").select("kind", "year", "event", "chapter", "clip", "reason")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes files (path, content; a path that ends in a slash is a folder, content that begins with '-> ' a link) below a folder that all tasks see, and returns how many each task wrote. A task that runs again writes the same.

    With a column `shared`, files so marked that a task writes with equal content are names of one file (hard links), so a large tree takes inodes and blocks for its folders only: for trees in which no file is changed later. Where a file can have no more names, another one is written.
    """
    base = root.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        held: dict[str, str] = {}
        for batch in batches:
            for path, content, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = os.path.join(base, path)
                os.makedirs(full if path.endswith("/") else os.path.dirname(full), exist_ok=True)
                if path.endswith("/"):
                    continue
                if content.startswith("-> "):
                    if not os.path.lexists(full):
                        os.symlink(content[3:], full)
                elif not shared or content not in held or not _named(held[content], full):
                    with open(full, "w", encoding="utf-8") as f:
                        f.write(content)
                    if shared:
                        held[content] = full
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    shared = F.col("shared") if "shared" in files.columns else F.lit(False)
    return files.select("path", "content", shared.alias("shared")).mapInArrow(run, "n long")


def _named(file: str, name: str) -> bool:
    """Gives a file another name, unless there are too many, the file system has no such links, or the name is there from a task's first run."""
    try:
        os.link(file, name)
    except OSError:
        return False
    return True
