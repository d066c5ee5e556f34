"""A tree of files as a Spark data source whose partitions are subtrees and which never enters skipped directories.

``spark.read.format("source_tree").load(root)`` gives path (below the root), size and content. The driver lists
directories only until there are enough subtrees to deal out; executors list and read the rest. Filters on the path
(equal, one of, starting or ending with something) and on the size are taken over by the source: a directory that no
wanted path can lie below isn't entered, and a file that isn't wanted isn't read. If only paths and sizes are selected
by ``option("content", "false")``, nothing is read at all.

The root must be a folder that driver and executors see under the same name. Links to directories aren't followed.
A file that goes while the tree is read, or can't be read, has a null content. Bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from sparkweave.functions.paths import SKIPPED_DIRS

SCHEMA = "path string, size bigint, content string"


def is_skipped(name: str) -> bool:
    return name in SKIPPED_DIRS or name.startswith(".")


@dataclass
class Wanted:
    """What filters leave: each of the sets is None where no filter asks for it."""

    paths: frozenset[str] | None = None
    prefixes: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    most_bytes: int | None = None

    def file(self, path: str, size: int) -> bool:
        if self.paths is not None and path not in self.paths or self.most_bytes is not None and size > self.most_bytes:
            return False
        return all(path.startswith(p) for p in self.prefixes) and all(path.endswith(s) for s in self.suffixes)

    def folder(self, path: str) -> bool:
        """Whether some wanted path can lie below a directory."""
        inside = path + "/"
        if self.paths is not None and not any(p.startswith(inside) for p in self.paths):
            return False
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def take(self, f: Filter) -> bool:
        """Whether a filter is taken over; others stay with Spark."""
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if column == ("path",) and isinstance(f, EqualTo):
            self.paths = frozenset([value]) & (self.paths if self.paths is not None else {value})
        elif column == ("path",) and isinstance(f, In):
            self.paths = frozenset(f.value) & (self.paths if self.paths is not None else frozenset(f.value))
        elif column == ("path",) and isinstance(f, StringStartsWith):
            self.prefixes.append(value)
        elif column == ("path",) and isinstance(f, StringEndsWith):
            self.suffixes.append(value)
        elif column == ("size",) and isinstance(f, LessThan | LessThanOrEqual):
            limit = value - isinstance(f, LessThan)
            self.most_bytes = limit if self.most_bytes is None else min(limit, self.most_bytes)
        else:
            return False
        return True


def listed(root: str, folder: str, wanted: Wanted, seen: list[str] | None = None) -> tuple[list[tuple[str, int]], list[str]]:
    """Wanted files of a directory (path below the root, size) and the directories to enter, both in order of names; ``seen`` notes what is listed."""
    files, folders = [], []
    if seen is not None:
        seen.append(folder)
    try:
        with os.scandir(os.path.join(root, folder) if folder else root) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if not is_skipped(e.name) and wanted.folder(path):
                        folders.append(path)
                elif e.is_file() and wanted.file(path, size := e.stat().st_size):
                    files.append((path, size))
    except OSError:
        pass
    return sorted(files), sorted(folders)


def below(root: str, folder: str, wanted: Wanted, seen: list[str] | None = None) -> Iterator[tuple[str, int]]:
    """All wanted files below a directory."""
    files, folders = listed(root, folder, wanted, seen)
    yield from files
    for f in folders:
        yield from below(root, f, wanted, seen)


@dataclass
class Subtree(InputPartition):
    """A directory with all below it, or some files."""

    folder: str | None
    files: tuple[tuple[str, int], ...] = ()


class TreeReader(DataSourceReader):
    def __init__(self, root: str, parts: int, content: bool):
        self.root, self.parts, self.content, self.wanted = root, parts, content, Wanted()

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Subtree]:
        """Level by level, until there are enough directories."""
        level, done = [""], []
        while level and len(level) + len(done) < self.parts:
            following = []
            for folder in level:
                files, folders = listed(self.root, folder, self.wanted)
                done += [Subtree(None, tuple(files[i : i + 512])) for i in range(0, len(files), 512)]
                following += folders
            level = following
        return done + [Subtree(f) for f in level] or [Subtree(None)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        files = partition.files if partition.folder is None else below(self.root, partition.folder, self.wanted)
        for path, size in files:
            content = None
            if self.content:
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as f:
                        content = f.read()
                except OSError:
                    pass
            yield path, size, content


class TreeSource(DataSource):
    """Options: path, parts (how many subtrees at least, where there are so many; 64) and content (true)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        root = self.options["path"].removeprefix("file://")
        return TreeReader(root.rstrip("/") or "/", int(self.options.get("parts", "64")), self.options.get("content", "true") == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
