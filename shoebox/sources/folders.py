"""Folders as a source: what is in a tree, and, as a stream, what was added, changed and removed.

Folders down to ``depth`` are listed while planning and become partitions;
a task lists its folder (the deepest ones with all below them).  Folders of
previews, versions and deleted files are not entered; one that can't be
listed is passed over.

As a stream, offsets are times.  For each trigger a partition compares its
folder with the listing that the trigger before kept in ``state``, and
keeps the new one there under the trigger's offset.  A trigger that is
repeated after a failure finds that listing and gives the same rows.
Folders that are gone have a listing, too, so their files are removed.
Between triggers nothing is held but those listings; a task holds those of
its folder.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shoebox.functions.paths import SKIPPED_FOLDERS

from .stores import opened

SCHEMA = "path string, length long, modified long, change string"
LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])
DEPTH = 2
#: Folders of a partition, at most so many partitions.
PARTITIONS = 10_000
ROWS = 8192


def listed(fs: FileSystem, folder: str) -> tuple[list, list[str]]:
    """Files (path, length, time in microseconds) and folders right below one; none if it can't be listed."""
    try:
        found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
    except OSError:
        return [], []
    files = [(f.path, f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == FileType.File]
    return files, sorted(f.path for f in found if f.type == FileType.Directory and f.base_name not in SKIPPED_FOLDERS)


def walked(fs: FileSystem, folder: str, deep: bool) -> Iterator[tuple]:
    """The files of a folder, with ``deep`` of all folders below."""
    waiting = [folder]
    while waiting:
        files, folders = listed(fs, waiting.pop())
        yield from files
        if deep:
            waiting.extend(folders)


def planned(fs: FileSystem, root: str, depth: int) -> list[tuple[str, bool]]:
    """Folders to list, and whether with all below: those above ``depth`` by themselves."""
    out, level = [], [root]
    for k in range(depth + 1):
        out += [(folder, k == depth) for folder in level]
        if k < depth:
            level = [x for folder in level for x in listed(fs, folder)[1]]
    return out


@dataclass
class Folders(InputPartition):
    folders: list[tuple[str, bool]]
    start: int = 0
    end: int = 0


def dealt(folders: list[tuple[str, bool]], start: int = 0, end: int = 0) -> list[Folders]:
    n = min(len(folders), PARTITIONS)
    return [Folders(folders[k::n], start, end) for k in range(n)]


def rows_of(files: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of path, length, modified and change."""
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "length", "modified", "change"])

    for f in files:
        held.append(f)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


class Tree:
    """A root as the user spelled it, and paths below it spelled alike."""

    def __init__(self, options: dict):
        option = {k.lower(): v for k, v in options.items()}
        self.root, self.depth, self.state = option["path"].rstrip("/"), int(option.get("depth", DEPTH)), option.get("state", "").rstrip("/")

    def opened(self) -> tuple[FileSystem, str]:
        fs, place = opened(self.root)
        return fs, place.rstrip("/")

    def spelled(self, place: str, path: str) -> str:
        return f"{self.root}{path[len(place) :]}"


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Folders]:
        fs, place = self.tree.opened()
        return dealt(planned(fs, place, self.tree.depth))

    def read(self, part: Folders) -> Iterator[pa.RecordBatch]:
        fs, place = self.tree.opened()
        yield from rows_of((self.tree.spelled(place, path), length, at, "added") for folder, deep in part.folders for path, length, at in walked(fs, folder, deep))


class TreeStream(DataSourceStreamReader):
    def __init__(self, tree: Tree):
        if not tree.state:
            raise ValueError("a stream of folders needs the option state: a shared folder for its listings")
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        if start["at"] >= end["at"]:
            return []
        fs, place = self.tree.opened()
        folders = dict(planned(fs, place, self.tree.depth))
        # Folders that have a listing and are gone.
        store, kept = opened(self.tree.state)
        for f in store.get_file_info(FileSelector(kept, allow_not_found=True)):
            if f.type == FileType.Directory:
                with store.open_input_stream(f"{f.path}/folder") as x:
                    deep, _, name = x.read().decode().partition("\n")
                folders.setdefault(name, deep == "1")
        return dealt(list(folders.items()), start["at"], end["at"])

    def read(self, part: Folders) -> Iterator[pa.RecordBatch]:
        fs, place = self.tree.opened()
        for folder, deep in part.folders:
            yield from rows_of((self.tree.spelled(place, path), length, at, change) for path, length, at, change in self.changes(fs, folder, deep, part.start, part.end))

    def changes(self, fs: FileSystem, folder: str, deep: bool, start: int, end: int) -> list[tuple]:
        store, kept = opened(self.tree.state)
        own = f"{kept}/{hashlib.sha256(f'{int(deep)}{folder}'.encode()).hexdigest()[:32]}"
        known = sorted(int(f.base_name) for f in store.get_file_info(FileSelector(own, allow_not_found=True)) if f.base_name.isdigit())
        before = next((k for k in reversed(known) if k <= start), None)

        def stored(k: int) -> dict:
            with store.open_input_file(f"{own}/{k}") as f:
                t = pq.read_table(f)
            return {p: (n, at) for p, n, at in zip(*(c.to_pylist() for c in t.columns))}

        old = stored(before) if before is not None else {}
        new = stored(end) if end in known else {path: (n, at) for path, n, at in walked(fs, folder, deep)}
        out = [(p, *new[p], "added" if p not in old else "changed") for p in new if old.get(p) != new[p]]
        out += [(p, *old[p], "removed") for p in old if p not in new]
        if out and end not in known:
            store.create_dir(own, recursive=True)
            with store.open_output_stream(f"{own}/folder") as f:
                f.write(f"{int(deep)}\n{folder}".encode())
            with store.open_output_stream(f"{own}/.{end}") as f:
                pq.write_table(pa.table([pa.array(c, kind) for c, kind in zip(zip(*((p, *v) for p, v in new.items())), LISTED.types)] if new else [pa.array([], k) for k in LISTED.types], schema=LISTED), f)
            store.move(f"{own}/.{end}", f"{own}/{end}")
        for k in known:  # the one that a repeated trigger compares with, and later ones, stay
            if before is not None and k < before:
                store.delete_file(f"{own}/{k}")
        return out


class MediaFolders(DataSource):
    """Format ``mediafolders``; options path, depth and, for streams, state."""

    @classmethod
    def name(cls) -> str:
        return "mediafolders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(Tree(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Tree(self.options))


def read_folders(spark: SparkSession, path: str, depth: int = DEPTH) -> DataFrame:
    """path, length, modified (microseconds) and change (``added``) of each file below a folder."""
    spark.dataSource.register(MediaFolders)
    return spark.read.format("mediafolders").option("path", path).option("depth", str(depth)).load()


def stream_folders(spark: SparkSession, path: str, state: str, depth: int = DEPTH) -> DataFrame:
    """A stream of what is added, changed and removed; ``state`` is a folder that all tasks share."""
    spark.dataSource.register(MediaFolders)
    return spark.readStream.format("mediafolders").option("path", path).option("depth", str(depth)).option("state", state).load()
