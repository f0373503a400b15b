"""Files as a source: listings, contents, and what image headers say.

Listing and hashing stay in the JVM; only the parsing of image headers
runs in Python, over Arrow batches of at most ``header_bytes`` a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.paths import SUPPORTED, mime_type, visible
from shoebox.functions.scalars import gps
from shoebox.plans.config import KIB, EngineConfig

HEADER_BYTES = 64 * KIB


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def listing(files: DataFrame, root: Column, user: Column, images_only: bool = False) -> DataFrame:
    """user_id, file_id (a hash of the path), relative path, size, MIME type and time of each file outside hidden folders.

    Only metadata columns are read, so no content is loaded.
    """
    path = F.substring(F.col("path"), F.length(root) + 1, F.length("path"))
    path = F.ltrim(path, F.lit("/"))
    rows = files.select(
        user.alias("user_id"), F.xxhash64("path").alias("file_id"), path.alias("file_path"), F.col("length").alias("file_size"),
        mime_type(path).alias("mime_type"), F.unix_timestamp("modificationTime").alias("file_mtime"),
    ).where(visible(F.col("file_path")))
    return rows.where(F.col("mime_type").isin(*SUPPORTED)) if images_only else rows


def hashed(files: DataFrame, most: int | None = None) -> DataFrame:
    """path and content_hash; files over a size limit are left out before they are loaded."""
    rows = files if most is None else files.where(F.col("length") <= most)
    return rows.select("path", F.sha2("content", 256).alias("content_hash"))


def capped(files: DataFrame, most: int) -> DataFrame:
    """path, content_hash and outcome of each file: over the limit it fails, and its content isn't read."""
    fits = F.col("length") <= most
    read = files.where(fits).select("path", F.sha2("content", 256).alias("content_hash"), F.lit("done").alias("outcome"))
    return read.unionByName(files.where(~fits).select("path", F.lit(None).cast("string").alias("content_hash"), F.lit("error").alias("outcome")))


def header_locations(headers: DataFrame, *more: str) -> DataFrame:
    """path, has_location, lat and lng from the tags of ``image_headers``, and columns that are kept."""
    at = gps(F.col("lat"), F.col("lat_ref"), F.col("lng"), F.col("lng_ref"))
    rows = headers.withColumn("_at", at)
    return rows.select("path", F.col("_at").isNotNull().alias("has_location"), F.col("_at.lat").alias("lat"), F.col("_at.lng").alias("lng"), *more)


def located(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Locations from the first bytes of each file, as many as the settings say."""
    return header_locations(image_headers(files, config.exif_read_bytes))


# --- image headers ---

TAGS = {0x010F: "make", 0x0110: "model", 0x8769: "_exif", 0x8825: "_gps", 0x9209: "flash", 0x920A: "focal_length", 0xA405: "focal_35mm", 0x9003: "date_original"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lng_ref", 4: "lng"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
HEADER = (
    "path string, width int, height int, make string, model string, flash int, focal_length string, focal_35mm string, date_original string, "
    "lat array<string>, lat_ref string, lng array<string>, lng_ref string"
)


def directory(data: bytes, at: int, order: str, names: dict[int, str]) -> dict:
    """The known tags of one directory; whatever lies beyond the data is skipped."""
    found = {}
    if at + 2 > len(data):
        return found
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        where = at + 2 + 12 * k
        if where + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, where)
        size = SIZES.get(kind, 0) * count
        if tag not in names or not size:
            continue
        start = where + 8 if size <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
        if start + size > len(data):
            continue
        if kind == 2:
            value = data[start : start + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            value = ["%d/%d" % struct.unpack_from(order + ("II" if kind == 5 else "ii"), data, start + 8 * j) for j in range(count)]
        elif kind in (3, 4, 9):
            value = struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind], data, start)[0]
        else:
            continue
        found[names[tag]] = value
    return found


def exif(data: bytes) -> dict:
    """Tags of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    out = directory(data, struct.unpack_from(order + "I", data, 4)[0], order, TAGS)
    for link, names in (("_exif", TAGS), ("_gps", GPS_TAGS)):
        if isinstance(at := out.pop(link, None), int):
            out |= directory(data, at, order, names)
    return {k: v for k, v in out.items() if not k.startswith("_")}


def header(data: bytes) -> dict:
    """Dimensions and tags of a JPEG, PNG, GIF or WebP image, as far as the bytes go."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        width, height = struct.unpack_from(">II", data, 16)
        return {"width": width, "height": height}
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        width, height = struct.unpack_from("<HH", data, 6)
        return {"width": width, "height": height}
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return {"width": int.from_bytes(data[24:27], "little") + 1, "height": int.from_bytes(data[27:30], "little") + 1}
    out: dict = {}
    if data[:2] != b"\xff\xd8":
        return out
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            out |= exif(data[at + 10 : at + 2 + size])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
            out["height"], out["width"] = struct.unpack_from(">HH", data, at + 5)
        elif mark == 0xDA:
            break
        at += 2 + size
    return out


def image_headers(files: DataFrame, most: int = HEADER_BYTES) -> DataFrame:
    """Dimensions and tags from the first bytes of each file; what can't be read is null, dimensions 0."""
    names = [c.split()[0] for c in HEADER.split(", ")]

    def text(v):
        return v[0] if isinstance(v, list) else None if v is None else str(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    h = header(data or b"")
                except (struct.error, ValueError):
                    h = {}
                row = {"path": path, "width": h.get("width", 0), "height": h.get("height", 0), "flash": h.get("flash")}
                row |= {k: text(h.get(k)) for k in ("make", "model", "focal_length", "focal_35mm", "date_original", "lat_ref", "lng_ref")}
                row |= {k: h[k] if isinstance(h.get(k), list) else None for k in ("lat", "lng")}
                rows.append(row)
            kinds = {"width": pa.int32(), "height": pa.int32(), "flash": pa.int32(), "lat": pa.list_(pa.string()), "lng": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.string())) for c in names]))

    return files.select("path", F.substring("content", 1, most).alias("content")).mapInArrow(run, HEADER)
