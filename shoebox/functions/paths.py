"""Columns about paths and MIME types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.plans.config import normal_scope

# Fixed values.
SUPPORTED = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/heic", "image/heif", "image/tiff", "image/bmp", "image/svg+xml", "image/x-dcraw")
ML_SUPPORTED = ("image/jpeg", "image/png", "image/webp", "image/gif")
FACE_SUPPORTED = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/bmp", "image/tiff")
SKIPPED_FOLDERS = (".thumbnails", ".versions", ".trash")
MIME_BY_EXTENSION = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif",
    "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "svg": "image/svg+xml", "dng": "image/x-dcraw", "cr2": "image/x-dcraw", "nef": "image/x-dcraw",
    "arw": "image/x-dcraw", "txt": "text/plain", "pdf": "application/pdf", "mp4": "video/mp4",
}
BLANKS = " \t\n\r\x00\x0b"


def trimmed(text: Column) -> Column:
    """Without the blanks, line ends, tabs and NULs around it; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def in_scope(path: Column, scope: str | None) -> Column | None:
    """The filter of a scope, None for all.  Only prefixes that Parquet readers can push down."""
    if normal_scope(scope) == "all":
        return None
    return path.isin("Photos", "photos") | path.startswith("Photos/") | path.startswith("photos/")


def scoped(df, scope: str | None, path: str = "file_path"):
    where = in_scope(F.col(path), scope)
    return df if where is None else df.where(where)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Up to the last slash, without it; empty for a bare name."""
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(base_name(path)) - 1, F.lit(0)))


def relative(path: Column, user: Column) -> Column:
    """Without the user's files folder in front, else unchanged."""
    root = F.concat(F.lit("/"), user, F.lit("/files/"))
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def safe_target(path: Column) -> Column:
    """The target folder with forward slashes and none around it; null where it climbs, is absolute or empty."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    refused = F.contains(slashed, F.lit("..")) | F.startswith(slashed, F.lit("/")) | (F.trim(slashed, F.lit("/")) == "")
    return F.when(~refused, F.trim(slashed, F.lit("/")))


def visible(path: Column) -> Column:
    """Not inside a folder of previews, versions or deleted files."""
    names = "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS)
    return ~F.rlike(path, F.lit(f"(^|/)({names})/"))


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(base_name(path), r"\."), -1))), F.lit("application/octet-stream"))


def free_name(name: Column, taken: Column, now: Column) -> Column:
    """The name, or ``base_1.ext`` to ``base_9999.ext``, whichever the array of taken names lacks first; else one with the time."""
    dotted = F.contains(name, F.lit("."))
    ext = F.when(dotted, F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))
    base = F.when(dotted, F.substring(name, F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name)
    tail = F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))
    numbered = lambda n: F.concat(base, F.lit("_"), n.cast("string"), tail)
    # Only as many numbers can be taken as there are names.
    tries = F.transform(F.sequence(F.lit(1), F.least(F.size(taken) + 1, F.lit(9999))), numbered)
    free = F.get(F.array_except(tries, taken), F.lit(0))
    return F.when(~F.array_contains(taken, name), name).otherwise(F.coalesce(free, numbered(now)))
