"""Contents of files, read by ranges and hashed as they stream.

A file is never a value of a row: a task opens it, reads ``CHUNK`` bytes at
a time and keeps only the state of the digest, so files of any size cost
the same memory.  A read that fails is taken up again at its offset, with
the digest as it was.  Files over a cap are told by their length and not
opened.  As a SHA-256 runs from the first byte to the last, one file is
one task's work at most; files are spread over tasks by their bytes.

Files may also be planned as partitions of a data source (``filehashes``),
for a table of paths that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shoebox.plans.config import MIB

from .stores import opened

#: Bytes of a range.
CHUNK = 8 * MIB
#: Bytes of a task.
SPLIT = 1024 * MIB
RETRIES = 2
SCHEMA = "path string, length long, content_hash string, outcome string"
#: Rows that a task gives at once.
ROWS = 512


def digest_of(path: str, chunk: int = CHUNK, retries: int = RETRIES) -> tuple[str, int]:
    """SHA-256 in hex and number of bytes of a file; OSError if it can't be read to its end."""
    state, at, failed, file = hashlib.sha256(), 0, 0, None
    while True:
        try:
            if file is None:
                fs, place = opened(path)
                file = fs.open_input_file(place)
                file.seek(at)
            part = file.read(chunk)
        except OSError:
            failed += 1
            if failed > retries:
                raise
            file = None
            continue
        if not part:
            file.close()
            return state.hexdigest(), at
        state.update(part)
        at += len(part)


def outcome(path: str, length: int | None, most: int | None, chunk: int) -> tuple[str, int | None, str | None, str]:
    """A row of ``SCHEMA``."""
    if most is not None and length is not None and length > most:
        return path, length, None, "error"
    try:
        found, n = digest_of(path, chunk)
    except OSError:
        return path, length, None, "error"
    return (path, n, None, "error") if most is not None and n > most else (path, n, found, "done")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "length": pa.int64(), "content_hash": pa.string(), "outcome": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def hashed(files: DataFrame, most: int | None = None, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """path, length, content_hash and outcome (done or error) of files (path, length).

    ``tasks``: how many tasks to spread them over (see ``tasks_for``);
    without it they stay in the partitions that they are in.
    """
    rows = files.select("path", F.col("length").cast("long").alias("length"))
    if tasks:
        rows = rows.repartition(tasks, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                done.append(outcome(path, length, most, chunk))
                if len(done) == ROWS:
                    yield batch_of(done)
                    done = []
        yield batch_of(done)

    return rows.mapInArrow(run, SCHEMA)


def heads(files: DataFrame, most: int) -> DataFrame:
    """path and content: the first bytes of each file, as many as are asked for; null for one that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():  # one file's bytes at a time
                try:
                    fs, place = opened(path)
                    with fs.open_input_file(place) as f:
                        found = f.read(most)
                except OSError:
                    found = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([found], pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")


def tasks_for(files: DataFrame, split: int = SPLIT) -> int:
    """Tasks that read about ``split`` bytes each."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return max(1, -(-int(total) // split))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class HashReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], most: int | None, chunk: int, split: int):
        self.files, self.most, self.chunk, self.split = files, most, chunk, split

    def partitions(self) -> list[Files]:
        """Runs of files of about ``split`` bytes; a larger file is alone."""
        out, held, size = [], [], 0
        for path, length in sorted(self.files, key=lambda f: (-f[1], f[0])):
            if held and size + length > self.split:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += length
        return [*out, Files(held)]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(part.files), ROWS):
            yield batch_of([outcome(path, length, self.most, self.chunk) for path, length in part.files[at : at + ROWS]])


class FileHashes(DataSource):
    """Format ``filehashes``: the files right below a folder (option path); options chunkBytes, splitBytes and maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "filehashes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HashReader:
        from pyarrow.fs import FileSelector, FileType

        option = {k.lower(): v for k, v in self.options.items()}
        fs, root = opened(option["path"])
        prefix = option["path"].rstrip("/")
        files = [(f"{prefix}/{f.base_name}", f.size) for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File]
        most = option.get("maxbytes")
        return HashReader(files, int(most) if most else None, int(option.get("chunkbytes", CHUNK)), int(option.get("splitbytes", SPLIT)))


def hashed_folder(spark: SparkSession, path: str, most: int | None = None, chunk: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """The same of the files right below a folder, planned by their sizes."""
    spark.dataSource.register(FileHashes)
    reader = spark.read.format("filehashes").option("path", path).option("chunkBytes", str(chunk)).option("splitBytes", str(split))
    return (reader if most is None else reader.option("maxBytes", str(most))).load()


def write_contents(rows: DataFrame, folder: str) -> DataFrame:
    """Store ``content`` of each row as the file ``name`` in a folder; gives path, length and modified (as they are then)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(content or b"")
                paths.append(f"{folder}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return rows.select("name", "content").mapInArrow(run, "path string, length long")
