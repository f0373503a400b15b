"""Index upkeep: what changed, merges, stale rows, counters, deletions, rows as JSON.

Merges return the new table; ``snapshots.IndexTable`` publishes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.paths import trimmed
from shoebox.functions.scalars import atom_time, stored_signature
from shoebox.plans.schema import KEYS

KEY = ["user_id", "file_id"]


def usable(listing: DataFrame) -> DataFrame:
    return listing.where("file_id IS NOT NULL AND file_size <> 0")


def compared(listing: DataFrame, index: DataFrame, by: str = "mtime_size", force: bool = False) -> DataFrame:
    """The listing with needs_work and was_indexed.

    by: ``mtime_size`` (hashes), ``mtime`` (faces, locations) or ``row``
    (categories: any row will do, even of an older file).
    """
    old = index.select(*KEY, F.col("file_mtime").alias("old_mtime") if by != "row" else F.lit(0).alias("old_mtime"), F.col("file_size").alias("old_size"), F.lit(True).alias("was_indexed"))
    rows = usable(listing).join(old, KEY, "left")
    same = {
        "mtime_size": F.col("file_mtime").eqNullSafe(F.col("old_mtime")) & F.col("file_size").eqNullSafe(F.col("old_size")),
        "mtime": F.col("file_mtime").eqNullSafe(F.col("old_mtime")),
        "row": F.lit(True),
    }[by]
    known = F.coalesce("was_indexed", F.lit(False))
    return rows.withColumn("needs_work", F.lit(force) | ~(known & same)).withColumn("was_indexed", known).drop("old_mtime", "old_size")


def merged(base: DataFrame, updates: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Updates replace rows of the same key; the others stay."""
    return base.join(updates.select(*key), key, "left_anti").unionByName(updates.select(*base.columns))


def at(index: DataFrame, user: str, file_id: int) -> DataFrame:
    """The row of one file, if any; both keys are filters that reach the scan."""
    return index.where((F.col("user_id") == user) & (F.col("file_id") == file_id)).limit(1)


def upserted(base: DataFrame, updates: DataFrame, kind: str) -> DataFrame:
    """An index table of a kind (see ``KEYS``) after updates: the last one of a key, by its time, replaces the row or is added."""
    when = "classified_at" if kind == "classifications" else "updated_at" if kind == "face_labels" else "scanned_at"
    return merged(base, last_of(updates, KEYS[kind], (when,)), KEYS[kind])


def last_of(updates: DataFrame, key: list[str] = KEY, order: tuple[str, ...] = ("file_mtime",)) -> DataFrame:
    """One row of each key, the last by the order columns, so that a merge doesn't depend on the order of rows."""
    window = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return updates.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def replaced_faces(base: DataFrame, detected: DataFrame) -> DataFrame:
    """All faces of the detected files anew.

    detected: the file's columns and signatures, an array of signature and
    confidence; blank ones are left out before faces are numbered from 1.
    A file without faces loses its old ones.
    """
    sound = F.filter("signatures", lambda s: trimmed(s["signature"]) != "")
    rows = detected.select("*", F.posexplode(sound).alias("_pos", "_s"))
    fresh = rows.withColumns({"face_index": F.col("_pos") + 1, "face_signature": stored_signature(F.col("_s.signature")), "face_confidence": F.col("_s.confidence")})
    return base.join(detected.select(*KEY), KEY, "left_anti").unionByName(fresh.select(*base.columns))


def set_labels(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels after changes (user_id, face_signature, label_name, updated_at): a blank name deletes; a blank signature is ignored."""
    clean = changes.withColumns({"face_signature": trimmed(F.col("face_signature")), "label_name": trimmed(F.col("label_name"))}).where("face_signature <> ''")
    key = ["user_id", "face_signature"]
    last = last_of(clean, key, ("updated_at",))
    kept = base.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.where("label_name <> ''").select(*base.columns))


def split_stale(index: DataFrame, listing: DataFrame, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Rows that are still listed, and rows that aren't."""
    there = listing.select(*KEY)
    return index.join(there, KEY, "left_semi"), index.join(there, KEY, "left_anti")


def without_files(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select(*KEY), KEY, "left_anti")


def without_users(index: DataFrame, users: list[str]) -> DataFrame:
    return index.where(~F.col("user_id").isin(users))


def counters(rows: DataFrame, done: str = "hashed") -> DataFrame:
    """Per user, from ``outcome`` (done, skipped, error): total and each number.  A column ``positive`` gives with_positive, skipped rows included."""
    found = {"total": F.count("*"), done: F.count_if(F.col("outcome") == "done"), "skipped": F.count_if(F.col("outcome") == "skipped"), "errors": F.count_if(F.col("outcome") == "error")}
    if "positive" in rows.columns:
        found["with_positive"] = F.count_if(F.col("positive") & (F.col("outcome") != "error"))
    return rows.groupBy("user_id").agg(*(c.alias(k) for k, c in found.items()))


def moved(index: DataFrame, moves: DataFrame) -> DataFrame:
    """New paths (user_id, file_id, file_path) for files that are indexed; all else stays."""
    new = moves.select(*KEY, F.col("file_path").alias("_path"))
    return index.join(new, KEY, "left").withColumn("file_path", F.coalesce("_path", "file_path")).select(*index.columns)


# --- progress ---

PROGRESS = "status string, total long, processed long, updated_at string"


def progress(raw: Column, from_zero: bool = True) -> Column:
    """A stored progress as a struct; missing and broken ones are idle.  ``from_zero`` lifts negative numbers to 0."""
    parsed = F.from_json(raw, PROGRESS)
    object_ = F.rlike(F.coalesce(raw, F.lit("")), F.lit(r"^\s*\{.*\}\s*$")) & parsed.isNotNull()

    def number(name: str) -> Column:
        n = F.coalesce(F.when(object_, parsed[name]), F.lit(0).cast("long"))
        return F.greatest(n, F.lit(0).cast("long")) if from_zero else n

    return F.struct(
        F.coalesce(F.when(object_, parsed["status"]), F.lit("idle")).alias("status"),
        number("total").alias("total"),
        number("processed").alias("processed"),
        F.coalesce(F.when(object_, parsed["updated_at"]), F.lit("")).alias("updated_at"),
    )


def settled(p: Column, is_stale: Column) -> Column:
    """The status, where a stale scan counts as completed if all is processed, else as interrupted."""
    done = (p["total"] > 0) & (p["processed"] >= p["total"])
    return F.when((p["status"] == "scanning") & is_stale, F.when(done, F.lit("completed")).otherwise(F.lit("interrupted"))).otherwise(p["status"])


def progress_text(status: Column, total: Column, processed: Column, updated_at: Column) -> Column:
    """A progress as it is stored; ``progress`` reads it."""
    return F.to_json(F.struct(status.alias("status"), total.cast("long").alias("total"), processed.cast("long").alias("processed"), atom_time(updated_at).alias("updated_at")))


def progress_log(outcomes: DataFrame, every: int = 50, status: str = "scanning") -> DataFrame:
    """What a scan reports: a row after every so many files of a user, and one when all are done.

    outcomes: user_id and processed_at of each file that was handled.  The
    number of a file among its user's is a running count over counts by
    second, so a user with very many files needs no single sorted list of
    files: only as many rows as there were seconds.
    """
    seconds = outcomes.groupBy("user_id", F.date_trunc("second", "processed_at").alias("second")).agg(F.count("*").alias("n"), F.max("processed_at").alias("last"))
    order = Window.partitionBy("user_id").orderBy("second")
    own = Window.partitionBy("user_id")
    rows = seconds.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(own)})
    first = F.floor((F.col("upto") - F.col("n")) / every) + 1
    marks = F.when(F.floor(F.col("upto") / every) >= first, F.sequence(first, F.floor(F.col("upto") / every))).otherwise(F.array().cast("array<bigint>"))
    steps = rows.select("user_id", "total", F.explode(F.transform(marks, lambda k: k * every)).alias("processed")).where("processed < total").withColumn("status", F.lit(status))
    done = rows.groupBy("user_id").agg(F.max("total").alias("total")).select("user_id", "total", F.col("total").alias("processed"), F.lit("completed").alias("status"))
    return steps.select("user_id", "status", "processed", "total").unionByName(done.select("user_id", "status", "processed", "total"))


def may_start(p: Column, is_stale: Column | None = None) -> Column:
    """Whether a scan may begin: none is running, or the one that says so is stale (HTTP 409 otherwise)."""
    running = p["status"] == "scanning" if is_stale is None else settled(p, is_stale) == "scanning"
    return ~running


# --- rows as JSON ---

# The keys of each kind, in order.
SHAPES = {
    "file_hashes": ("id", "user_id", "file_id", "file_path", "file_size", "content_hash", "mime_type", "file_mtime", "scanned_at"),
    "classifications": ("id", "user_id", "file_id", "file_path", "file_size", "mime_type", "category", "confidence", "indicators", "classified_at"),
    "file_locations": ("id", "user_id", "file_id", "file_path", "file_size", "mime_type", "has_location", "lat", "lng", "file_mtime", "scanned_at"),
    "file_faces": ("id", "user_id", "file_id", "file_path", "file_size", "mime_type", "has_face", "face_signature", "face_confidence", "file_mtime", "scanned_at"),
    "face_instances": ("id", "user_id", "file_id", "file_path", "file_size", "mime_type", "face_index", "face_signature", "face_confidence", "file_mtime", "scanned_at"),
    "face_labels": ("id", "user_id", "face_signature", "label_name", "updated_at"),
}
PLACES = {"classifications": {"confidence": 3}, "file_locations": {"lat": 6, "lng": 6}, "file_faces": {"face_confidence": 4}}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def as_json(table: DataFrame, kind: str) -> DataFrame:
    """One JSON text a row, with rounded numbers, times with offset, and empty lists for missing ones."""
    types = dict(table.dtypes)

    def shown(c: str) -> Column:
        if types[c] == "timestamp":
            return atom_time(F.col(c))
        if c in PLACES.get(kind, {}):
            return F.round(c, PLACES[kind][c])
        return F.coalesce(F.col(c), F.array().cast(types[c])) if types[c].startswith("array") else F.col(c)

    return table.select(F.to_json(F.struct(*(shown(c).alias(camel(c)) for c in SHAPES[kind])), {"ignoreNullFields": "false"}).alias("json"))
