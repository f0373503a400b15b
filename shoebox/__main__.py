"""Commands over an index in a folder: ``python -m shoebox scan|classify|gps|people|cleanup|stats|groups|progress ...``.

A user's files are below ``--files``; with ``--all`` each folder right
below it is a user.  Commands end with 1 if a user is missing, a scan is
running already, or a file couldn't be handled.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.paths import SUPPORTED, base_name, mime_type, visible
from shoebox.functions.scalars import stored_signature
from shoebox.operators import classify, dedup, index, scoring
from shoebox.operators.snapshots import IndexTable
from shoebox.plans import schema
from shoebox.plans.config import EngineConfig
from shoebox.sources import files, folders, ranges, stores
from shoebox.streaming import jobs, progress

SCANS = ("scan", "classify", "gps", "people")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="shoebox")
    parser.add_argument("command", choices=(*SCANS, "cleanup", "stats", "groups", "progress"))
    parser.add_argument("user", nargs="?", help="whose files; omit with --all")
    parser.add_argument("--all", action="store_true", help="each folder right below --files is a user")
    parser.add_argument("--index", required=True, help="folder of the index tables")
    parser.add_argument("--files", help="folder of the user's files, or of all users' with --all (scans, cleanup)")
    parser.add_argument("--scope", default="all", help="photos: show only those (stats, groups)")
    parser.add_argument("--limit", type=int, default=100)
    parser.add_argument("--force", action="store_true", help="handle files that didn't change, too")
    parser.add_argument("--worker", help="address of the model worker (people)")
    parser.add_argument("--token", help="what the worker is told")
    return parser


class Index:
    """The tables of an index folder."""

    def __init__(self, spark: SparkSession, path: str):
        table = lambda name, kind: IndexTable(spark, f"{path.rstrip('/')}/{name}", kind)
        self.hashes, self.classes = table("file_hashes", schema.FILE_HASHES), table("classifications", schema.CLASSIFICATIONS)
        self.locations, self.faces = table("file_locations", schema.FILE_LOCATIONS), table("face_instances", schema.FACE_INSTANCES)
        self.face_files = table("file_faces", schema.FILE_FACES)
        self.progress = progress.Store(spark, f"{path.rstrip('/')}/progress")


def there(path: str) -> bool:
    fs, place = stores.opened(path)
    return fs.get_file_info(place).type.name == "Directory"


def users_below(path: str) -> list[str]:
    fs, place = stores.opened(path.rstrip("/"))
    return [p.rsplit("/", 1)[1] for p in folders.listed(fs, place)[1]]


def listed(spark: SparkSession, root: str, user: str) -> DataFrame:
    """path, user_id, file_id (a hash of the path), file_path, file_size, mime_type and file_mtime of a user's files."""
    root = root.rstrip("/")
    rows = folders.read_folders(spark, root)
    below = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rows = rows.select(
        "path", F.lit(user).alias("user_id"), F.xxhash64(bare).alias("file_id"), below.alias("file_path"), F.col("length").alias("file_size"), mime_type(below).alias("mime_type"), F.floor(F.col("modified") / 1_000_000).cast("long").alias("file_mtime")
    )
    return rows.where(visible(F.col("file_path")))


class Scan:
    """One user's scan: what is listed, compared and done, with its progress, and published at its end."""

    def __init__(self, spark: SparkSession, tables: Index, command: str, user: str, root: str, given: argparse.Namespace):
        self.spark, self.tables, self.command, self.user, self.root, self.given = spark, tables, command, user, root, given

    def report(self, status: str, total: int, processed: int) -> None:
        self.tables.progress.put(self.user, self.command, status, total, processed)

    def run(self) -> int:
        if not self.tables.progress.get(self.user, self.command)["may_start"]:
            print(f"{self.user}: a {self.command} is running", file=sys.stderr)
            return 1
        self.report("scanning", 0, 0)
        if not there(self.root):
            self.report("error", 0, 0)
            print(f"{self.user}: no folder {self.root}", file=sys.stderr)
            return 1
        try:
            listing = stores.kept(listed(self.spark, self.root, self.user), f"{self.command}-listing")
            counts = {"scan": self.hashes, "classify": self.classes, "gps": self.locations, "people": self.faces}[self.command](listing)
        except Exception:
            self.report("error", 0, 0)
            raise
        self.report("completed", counts["total"], counts["total"])
        print(f"{self.user}: " + " | ".join(f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in counts.items()))
        return 1 if counts["errors"] else 0

    def done(self, rows: DataFrame, table: IndexTable, by: str, do: Callable[[DataFrame], DataFrame], name: str, write: Callable[[DataFrame, DataFrame], DataFrame], positive: str | None = None) -> dict[str, int]:
        """Do what changed, in steps, and publish it.

        ``do`` gives path, ``outcome`` and what it finds, and may leave out
        files that it can't handle; ``write`` gives a user's rows from the
        old ones and the listed files with what was found.
        """
        compared = stores.kept(index.compared(rows, table.read(users=[self.user]), by, self.given.force), f"{self.command}-compared")
        total, skipped = compared.count(), compared.where("NOT needs_work").count()
        self.report("scanning", total, 0)
        work = compared.where("needs_work").drop("needs_work", "was_indexed")
        found = work.join(progress.in_steps(work, do, lambda n: self.report("scanning", total, skipped + n), self.command), "path").withColumn("scanned_at", F.current_timestamp())
        found = stores.kept(found.where("outcome = 'done'"), f"{self.command}-found")
        listing = rows.select("user_id", "file_id")
        table.commit([self.user], lambda old: index.split_stale(write(old, found), listing)[0])
        good = found.count()
        counts = {"total": total, name: good, "skipped": skipped, "errors": total - skipped - good}
        return counts | ({positive.replace("has_", "with_"): found.where(positive).count()} if positive else {})

    def hashes(self, listing: DataFrame) -> dict[str, int]:
        do = lambda w: ranges.hashed(w.select("path", F.col("file_size").alias("length"))).drop("length")
        return self.done(listing, self.tables.hashes, "mtime_size", do, "hashed", replaced)

    def classes(self, listing: DataFrame) -> dict[str, int]:
        def write(old: DataFrame, found: DataFrame) -> DataFrame:
            photos = found.withColumns({"file_name": base_name(F.col("file_path")), "has_gps": F.col("lat").isNotNull() & F.col("lng").isNotNull()})
            return replaced(old, classify.best(classify.scores(photos)).withColumn("classified_at", F.current_timestamp()))

        do = lambda w: headers(w, files.HEADER_BYTES)
        return self.done(listing.where(F.col("mime_type").isin(*SUPPORTED)), self.tables.classes, "row", do, "classified", write)

    def locations(self, listing: DataFrame) -> dict[str, int]:
        def do(work: DataFrame) -> DataFrame:
            read = headers(work, EngineConfig().exif_read_bytes)
            return files.header_locations(read, "outcome")

        return self.done(listing.where(F.col("mime_type").isin(*SUPPORTED)), self.tables.locations, "mtime", do, "scanned", replaced, "has_location")

    def faces(self, listing: DataFrame) -> dict[str, int]:
        """Faces by the worker; what it says of a file is asked for file by file."""
        if not self.given.worker:
            raise SystemExit("people needs --worker")
        scorer = scoring.HttpScorer(self.given.worker, "face-signature", token=self.given.token)

        def do(work: DataFrame) -> DataFrame:
            answers = scoring.asked(work.select("user_id", "file_id", "path"), scorer, f"{scoring.FACE_ANSWER}, path string")
            return answers.select("path", scoring.parsed_faces(F.col("response")).alias("signatures"), F.lit("done").alias("outcome")).withColumn("has_face", F.size("signatures") > 0)

        def write(old: DataFrame, found: DataFrame) -> DataFrame:
            return index.replaced_faces(old, found)

        rows = scoring.eligible_faces(listing)
        counts = self.done(rows, self.tables.face_files, "mtime", do, "scanned", lambda old, found: self._faces(rows, found, old, write), "has_face")
        return counts

    def _faces(self, rows: DataFrame, found: DataFrame, old: DataFrame, write: Callable) -> DataFrame:
        """The faces first, then the files that they are of, so that a file isn't taken for done before."""
        self.tables.faces.commit([self.user], lambda faces: index.split_stale(write(faces, found), rows.select("user_id", "file_id"))[0])
        first = F.get("signatures", F.lit(0))
        return replaced(old, found.withColumns({"face_signature": stored_signature(first["signature"]), "face_confidence": first["confidence"]}))


def replaced(old: DataFrame, found: DataFrame) -> DataFrame:
    return index.merged(old, found.select(*old.columns))


def headers(work: DataFrame, most: int) -> DataFrame:
    """What image headers say, by path; a file that can't be opened is an error."""
    heads = ranges.heads(work, most)
    return files.image_headers(heads.where("content IS NOT NULL")).withColumn("outcome", F.lit("done"))


def scanned(spark: SparkSession, tables: Index, given: argparse.Namespace) -> int:
    if bool(given.user) == given.all:
        print("Give a user, or --all", file=sys.stderr)
        return 1
    if not given.files:
        print("Say where the files are: --files", file=sys.stderr)
        return 1
    users = {u: f"{given.files.rstrip('/')}/{u}" for u in users_below(given.files)} if given.all else {given.user: given.files}
    return max((Scan(spark, tables, given.command, u, root, given).run() for u, root in users.items()), default=0)


def cleaned(spark: SparkSession, tables: Index, given: argparse.Namespace) -> int:
    """The weekly cleanup of a user's hashes; a scope shows no part of the table, so it changes none here."""
    if not given.user or not given.files or not there(given.files):
        print("Give a user, and --files that is there", file=sys.stderr)
        return 1
    listing = stores.kept(listed(spark, given.files, given.user), "cleanup-listing")
    tables.hashes.commit([given.user], lambda old: jobs.cleanup(old, listing))
    return 0


def run(spark: SparkSession, given: argparse.Namespace) -> int:
    """The exit code."""
    tables = Index(spark, given.index)
    if given.command in SCANS:
        return scanned(spark, tables, given)
    if given.command == "cleanup":
        return cleaned(spark, tables, given)
    if given.command == "progress":
        for job in SCANS:
            print(job, tables.progress.get(given.user or "", job))
        return 0
    own = dedup.of_user(tables.hashes.read(users=[given.user] if given.user else None), None, given.scope)
    if given.command == "stats":
        dedup.stats(own).show(truncate=False)
    else:
        dedup.group_page(own, given.limit).show(given.limit, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("shoebox").getOrCreate(), arguments().parse_args()))
