"""A file tree as a partitioned table: names, sizes and times of files and folders, empty ones too.

Spark's own file sources skip files of zero bytes and know no folders.  This source plans from
folder names alone: from the roots down, level by level, until there are ``partitions`` folders to
share out.  A folder that was opened on the way is one partition with its own entries, one that
was not is a partition with its whole tree.  A folder with more than ``WIDE`` folders in it is not
opened by the planner; it becomes ``SLICES`` partitions that each take the names of one hash
value.  So the driver never holds file rows, and of folder names at most about ``WIDE`` more than
it shares out.  A task streams what it finds in batches.

Links are listed as files and not followed.  An entry that vanishes while it is read is left out.
"""

from __future__ import annotations

import json
import os
import stat
import sys
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

FORMAT = "capsift_tree"
COLUMNS = "path string, uri string, root string, is_dir boolean, size long, modified timestamp"
WIDE, SLICES = 4096, 64
BATCH = 4096
#: Characters of a path that stay as they are in its URI.
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/_-!.~'()*,;:$&+=@")


def encoded(path: str) -> str:
    """A path as the path part of a URI, letters beyond ASCII unchanged."""
    return "".join(c if c in _PLAIN or (ord(c) > 159 and not c.isspace()) else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogateescape"))
                   for c in path)


class Entry:
    """One name in a folder; ``modified`` in microseconds."""

    __slots__ = ("name", "is_dir", "size", "modified")

    def __init__(self, name: str, is_dir: bool, size: int, modified: int):
        self.name, self.is_dir, self.size, self.modified = name, is_dir, size, modified


class Files:
    """What a root's file system holds; local paths by the operating system, others through Arrow."""

    def __init__(self, root: str):
        parts = urlsplit(root)
        self.local = parts.scheme in ("", "file")
        self.prefix = root[:len(root) - len(self.path_of(root))]
        if not self.local:
            from pyarrow import fs

            self.system, self.top = fs.FileSystem.from_uri(root)
            self.above = self.path_of(root)[:len(self.path_of(root)) - len(self.top)] if self.path_of(root).endswith(self.top) else ""

    @staticmethod
    def path_of(root: str) -> str:
        """The path of a qualified name, without scheme and authority."""
        scheme, colon, rest = root.partition(":")
        if not colon or "/" in scheme:
            return root
        return rest if not rest.startswith("//") else rest[2:][rest[2:].find("/"):] if "/" in rest[2:] else "/"

    def entries(self, folder: str) -> Iterator[Entry]:
        if self.local:
            with os.scandir(folder) as found:
                for item in found:
                    try:
                        about = item.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue
                    yield _entry(item.name, about)
            return
        from pyarrow import fs

        inner = folder[len(self.above):] if self.above else folder
        for info in self.system.get_file_info(fs.FileSelector(inner)):
            yield _remote(info)

    def one(self, path: str) -> Entry | None:
        """The entry of a root itself; None where nothing is there."""
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if self.local:
            try:
                return _entry(name, os.stat(path))
            except FileNotFoundError:
                return None
        info = self.system.get_file_info(self.top)
        return _remote(info) if info.type.name != "NotFound" else None


def _entry(name: str, about: os.stat_result) -> Entry:
    is_dir = stat.S_ISDIR(about.st_mode)
    return Entry(name, is_dir, 0 if is_dir else about.st_size, about.st_mtime_ns // 1000)


def _remote(info) -> Entry:
    is_dir = info.type.name == "Directory"
    return Entry(info.base_name, is_dir, 0 if is_dir else info.size or 0, (info.mtime_ns or 0) // 1000)


class Part(InputPartition):
    """A folder to read: ``deep`` with all below it, and of its names those of one hash value."""

    def __init__(self, root: str, folder: str, deep: bool, piece: int = 0, pieces: int = 1):
        self.root, self.folder, self.deep, self.piece, self.pieces = root, folder, deep, piece, pieces

    def takes(self, name: str) -> bool:
        return self.pieces == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.pieces == self.piece


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.skip = frozenset(json.loads(options.get("skip", "[]")))
        self.wanted = int(options.get("partitions", 256))

    def partitions(self) -> list[Part]:
        """Opens folders from the top until there are enough to share out."""
        closed: deque[tuple[str, str]] = deque()
        parts: list[Part] = []
        for root in self.roots:
            files, path = Files(root), Files.path_of(root)
            found = files.one(path)
            if found is None:
                raise FileNotFoundError(root)
            if found.is_dir:
                closed.append((root, path.rstrip("/") or "/"))
            else:
                parts.append(Part(root, path, False))
        while closed and len(closed) + len(parts) < self.wanted:
            root, folder = closed.popleft()
            inside = []
            for entry in Files(root).entries(folder):
                if entry.is_dir and entry.name not in self.skip:
                    inside.append((root, f"{folder.rstrip('/')}/{entry.name}"))
                    if len(inside) > WIDE:
                        break
            if len(inside) > WIDE:
                parts += [Part(root, folder, True, i, SLICES) for i in range(SLICES)]
            else:
                parts.append(Part(root, folder, False))
                closed.extend(inside)
        return parts + [Part(root, folder, True) for root, folder in closed]

    def read(self, partition: Part):
        files = Files(partition.root)
        batch: list[tuple] = []
        for path, entry in self._rows(files, partition):
            full = files.prefix + path
            batch.append((full, files.prefix + encoded(path), partition.root, entry.is_dir, entry.size, entry.modified))
            if len(batch) == BATCH:
                yield _batch(batch)
                batch = []
        if batch:
            yield _batch(batch)

    def _rows(self, files: Files, part: Part) -> Iterator[tuple[str, Entry]]:
        if part.folder == Files.path_of(part.root) and not part.deep:
            itself = files.one(part.folder)
            if itself is not None and not itself.is_dir:  # a root that is a file
                yield part.folder, itself
                return
        pending = [part.folder]
        while pending:
            folder = pending.pop()
            try:
                for entry in files.entries(folder):
                    if entry.name in self.skip or (folder == part.folder and not part.takes(entry.name)):
                        continue
                    path = f"{folder.rstrip('/')}/{entry.name}"
                    yield path, entry
                    if entry.is_dir and part.deep:
                        pending.append(path)
            except FileNotFoundError:
                continue


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
    names = ("path", "uri", "root", "is_dir", "size", "modified")
    readable = [tuple(v.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if isinstance(v, str) else v for v in row) for row in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*readable), kinds)], names)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def roots_of(spark: SparkSession, path: str) -> list[str]:
    """The qualified names that ``path`` stands for; it may be a pattern of the file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath().toString() for s in system.globStatus(at) or []]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def tree(spark: SparkSession, path: str, skip: tuple[str, ...] = (), partitions: int = 256) -> DataFrame:
    """``path, uri, root, is_dir, size, modified`` of everything below ``path``; names in ``skip`` and what is below them are left out."""
    spark.dataSource.register(TreeSource)
    return (spark.read.format(FORMAT).option("roots", json.dumps(roots_of(spark, path))).option("skip", json.dumps(list(skip)))
            .option("partitions", str(partitions)).load())
