"""Media columns: a Spark data source over archive directories.

``mediaarchive`` stores binary members in archives of tar blocks.  Each
write task puts its members into files of its own and reports them; the
driver's commit lists just those files in a manifest, so a retried or
lost task leaves nothing that a reader sees.  Beside each archive lies
an index of its members' offsets.

Reading plans byte ranges over the archives named in the manifest: a
range holds the members that begin in it, found by binary search in the
index.  Payloads stream through Arrow in batches of bounded bytes.  A
member that can't be read whole, or whose checksum is off, is read again
by its offset, alone, a few times before the task fails.

Paths may be of any file system that pyarrow opens (file, hdfs, s3).

Edge cases: null or empty payloads are stored as empty members and read
back as empty; null names as an empty name, and names of any length are
kept whole; repeated rows are repeated members; an empty table gives an archive directory without archives,
which reads as no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import map_slices

#: Bytes after which a writer begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that one reading task takes.
RANGE_BYTES = 16 << 20
#: Bytes of payload in one Arrow batch.
BATCH_BYTES = 2 << 20
RETRIES = 3
SCHEMA = "name string, archive string, offset long, payload binary"


def opened(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# --- members: a tar header block, then the payload up to a whole block ---


def header(name: str, payload: bytes) -> bytes:
    """A ustar header; the checksum of the payload goes into the field of the link's name.

    A name over 100 bytes stands in a member of its own before it, as tar programs write it.
    """
    raw = name.encode("utf-8", "surrogatepass")
    if len(raw) > 100 or b"\0" in raw:
        return _header(LONG_NAME, raw, b"L") + raw + bytes(-len(raw) % 512) + _header(b"long", payload, b"0")
    return _header(raw, payload, b"0")


LONG_NAME = b"././@LongLink"


def _header(raw: bytes, payload: bytes, kind: bytes) -> bytes:
    if len(payload) >= 8**11:
        raise ValueError("a payload over 8 GiB")
    head = bytearray(512)
    head[0:100] = raw.ljust(100, b"\0")
    head[100:136] = b"0000644\0" + b"0000000\0" + b"0000000\0" + b"%011o\0" % len(payload)
    head[136:148] = b"%011o\0" % 0
    head[156:157] = kind
    head[157:257] = (b"crc32:%08x" % zlib.crc32(payload)).ljust(100, b"\0")
    head[257:265] = b"ustar\x0000"
    head[148:156] = b" " * 8
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def member(read, offset: int) -> tuple[str, bytes]:
    """The name and the checked payload at an offset; ``read(offset, size)`` may give fewer bytes.  Whatever is damaged raises OSError."""
    name, payload, kind, end = _one(read, offset)
    if kind == b"L":
        long, (_, payload, kind, _) = payload, _one(read, end)
        name = long
    try:
        return name.decode("utf-8", "surrogatepass"), payload
    except UnicodeDecodeError as e:
        raise OSError(f"the name at {offset} is damaged") from e


def _one(read, offset: int) -> tuple[bytes, bytes, bytes, int]:
    """Name, checked payload and kind of one header, and the offset after it."""
    head = read(offset, 512)
    if len(head) < 512 or head[257:262] != b"ustar":
        raise OSError(f"no member at {offset}")
    try:
        size = int(head[124:135], 8)
    except ValueError as e:
        raise OSError(f"the size at {offset} is damaged") from e
    payload = read(offset + 512, size)
    if b"%08x" % zlib.crc32(payload) != head[163:171]:
        raise OSError(f"the member at {offset} is damaged")
    return head[:100].rstrip(b"\0"), payload, head[156:157], offset + 512 + size + -size % 512


def retried(open_archive, offset: int, retries: int = RETRIES) -> tuple[str, bytes]:
    """Read one member, and on an error it alone, over a new handle."""
    for attempt in range(retries + 1):
        try:
            with open_archive() as f:
                return member(lambda at, n: (f.seek(at), f.read(n))[1], offset)
        except OSError:
            if attempt == retries:
                raise
            time.sleep(0.1 * (attempt + 1))
    raise AssertionError


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


def manifests(fs, root: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(f.path for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".manifest"))


def read_manifest(fs, path: str) -> list[tuple[str, int]]:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, int]] = []
        fs, root = opened(self.path)
        out, offsets, at, name = None, [], 0, ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                with fs.open_output_stream(f"{root}/{name}.idx") as index:
                    index.write(np.array(offsets, "<i8").tobytes())
                files.append((name, at))
                out = None

        for batch in iterator:
            for title, payload in zip(batch.column("name").to_pylist(), batch.column("payload")):
                data = payload.as_py() or b""
                if out is None:
                    name, at, offsets = f"{uuid.uuid4().hex}.tar", 0, []
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                offsets.append(at)
                whole = header(title or "", data) + data + bytes(-len(data) % 512)
                out.write(whole)
                at += len(whole)
                if at >= ARCHIVE_BYTES:
                    close()
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """A manifest of its own for each commit, so that appending keeps what is there; overwriting takes the others away once it is written."""
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        old = manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for path in old:
            gone = [name for name, _ in read_manifest(fs, path)]
            fs.delete_file(path)
            for name in gone:
                for part in (f"{root}/{name}", f"{root}/{name}.idx"):
                    if fs.get_file_info(part).type.name == "File":
                        fs.delete_file(part)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                for path in (f"{root}/{name}", f"{root}/{name}.idx"):
                    if fs.get_file_info(path).type.name == "File":
                        fs.delete_file(path)


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        fs, root = opened(self.path)
        files = [x for path in manifests(fs, root) for x in read_manifest(fs, path)]
        return [Range(name, at, min(size, at + self.range_bytes)) for name, size in files for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{part.archive}.idx") as f:
            offsets = np.frombuffer(f.read(), "<i8")
        mine = offsets[np.searchsorted(offsets, part.start) : np.searchsorted(offsets, part.end)].tolist()

        def open_archive():
            return fs.open_input_file(f"{root}/{part.archive}")

        names, places, payloads, held = [], [], [], 0
        with open_archive() as f:

            def chunked(at: int, n: int) -> bytes:
                nonlocal window, base
                if at < base or at + n > base + len(window):
                    f.seek(at)
                    window, base = f.read(max(n, 1 << 20)), at
                return window[at - base : at - base + n]

            window, base = b"", 0
            for offset in mine:
                try:
                    name, payload = member(chunked, offset)
                except OSError:
                    window, base = b"", 0
                    name, payload = retried(open_archive, offset)
                names.append(name)
                places.append(offset)
                payloads.append(payload)
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield self._batch(part, names, places, payloads)
                    names, places, payloads, held = [], [], [], 0
        if names:
            yield self._batch(part, names, places, payloads)

    @staticmethod
    def _batch(part: Range, names: list, places: list, payloads: list) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(names, pa.string()), pa.array([part.archive] * len(names), pa.string()), pa.array(places, pa.int64()), pa.array(payloads, pa.binary())],
            ["name", "archive", "offset", "payload"],
        )


class MediaArchive(DataSource):
    """Format ``mediaarchive``; option rangeBytes sets the size of a reading task."""

    @classmethod
    def name(cls) -> str:
        return "mediaarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"].rstrip("/"), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"].rstrip("/"), overwrite)


def write_archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store name and payload of each row, beside what is there or (``overwrite``) in its place."""
    df.sparkSession.dataSource.register(MediaArchive)
    df.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("payload", F.lit(b"")).alias("payload")).write.format("mediaarchive").mode(mode).option("path", path).save()


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """name, archive, offset and payload of each member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("mediaarchive").option("path", path).option("rangeBytes", str(range_bytes)).load()


# --- payloads as images: 8-bit grey PNG, 192 samples a row ---

ROW = 192
MAGIC = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    """Bytes as the samples of a grey image, filled up with spaces to whole rows; the true length goes into a text chunk."""
    rows = max(1, -(-len(raw) // ROW))
    samples = np.frombuffer(raw.ljust(rows * ROW, b" "), np.uint8).reshape(rows, ROW)
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each row begins with filter 0
    lines[:, 1:] = samples
    return (
        MAGIC
        + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0))
        + chunk(b"tEXt", b"n_bytes\0%d" % len(raw))
        + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1))
        + chunk(b"IEND", b"")
    )


def from_png(data: bytes) -> tuple[np.ndarray, int]:
    """The samples, by row, and the length before filling; raises ValueError for anything but what ``to_png`` makes."""
    if data[:8] != MAGIC:
        raise ValueError("no PNG")
    at, parts, n, rows = 8, [], None, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("not an 8-bit grey image of 192 samples a row")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n = int(body[8:])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, ROW + 1)
    if n is None or lines[:, 0].any():
        raise ValueError("not written here")
    return np.ascontiguousarray(lines[:, 1:]), n


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of the samples and a 64-bit average hash over an 8 by 8 grid of bands."""
    flat = samples.reshape(-1)
    bands = np.add.reduceat(flat, np.arange(64) * len(flat) // 64, dtype=np.int64) * 64 / len(flat)
    bits = int("".join("1" if b else "0" for b in bands >= bands.mean()), 2)
    return f"{flat.mean():.4f}:{flat.std():.4f}:{bits:016x}"


def texts_to_images(docs: DataFrame) -> DataFrame:
    """doc_id, text -> name (the id, empty for null) and payload (the image)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["" if d is None else str(d) for d in batch.column(0).to_pylist()]
        images = [to_png(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.binary())]
        return pa.record_batch([pa.array(names, pa.string()), pa.array(images, pa.binary())], ["name", "payload"])

    return map_slices(docs, work, "name string, payload binary")


def image_columns(members: DataFrame) -> DataFrame:
    """name, payload (images) -> what was read back of each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            samples, n = from_png(image)
            raw = samples.tobytes()
            rows.append(
                {
                    "doc_id": int(name) if name else None, "n_bytes": n, "payload_bytes": len(raw),
                    "payload_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-16:]),
                    "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": feature(samples),
                }
            )
        return pa.RecordBatch.from_pylist(rows, IMAGE_COLUMNS)

    return map_slices(members.select("name", "payload"), work, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in IMAGE_COLUMNS))


IMAGE_COLUMNS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
