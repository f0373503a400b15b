"""The index kept current from file events: applied to a table, or as they stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoebox.functions.paths import SUPPORTED
from shoebox.operators.index import KEY, without_files
from shoebox.operators.snapshots import IndexTable
from shoebox.plans.config import CLEANUP_SECONDS

from . import versions

OPS = ("created", "written", "renamed", "deleted")


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each user and file, by time, then id."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def wanted(events: DataFrame, image_only: bool = True) -> DataFrame:
    """Listeners only see images, deletions of other files included; a full scan sees every type."""
    return events.where(F.col("mime_type").isin(*SUPPORTED)) if image_only else events


def apply_to_index(index: DataFrame, events: DataFrame, image_only: bool = True) -> DataFrame:
    """The hash index after the events, one after another (see ``versions``)."""
    return versions.applied(index, versions.settled(index, wanted(events, image_only)))


def delete_cascade(tables: dict[str, DataFrame], events: DataFrame, strict: bool = False, image_only: bool = True) -> dict[str, DataFrame]:
    """Tables after deletions: hashes and categories only, or with ``strict`` all of them.

    A hash comes back with a later event of its file; other tables wait for their own scans.
    """
    seen = wanted(events, image_only)
    gone = {"file_hashes": last_events(seen).where(F.col("op") == "deleted")}
    every = seen.where(F.col("op") == "deleted").select(*KEY).distinct()
    touched = set(tables) if strict else {"file_hashes", "classifications"}
    return {name: without_files(t, gone.get(name, every)) if name in touched else t for name, t in tables.items()}


def start_upkeep(events: DataFrame, table: IndexTable, checkpoint: str, image_only: bool = True, available_now: bool = True, categories: IndexTable | None = None, late_seconds: int = 3600) -> StreamingQuery:
    """Apply a stream of events to the hash table, and deletions to that of the categories.

    What is held of each file tells its row (see ``Versions``), so a batch
    replaces rows without asking what they were, and a repeated batch does
    no harm.  Whoever else writes the table sends what it wrote as
    ``written`` events.  Rows are published by users, some thousand at once
    (see ``IndexTable``).  Faces and places are left to their own scans.
    """
    held = versions.Versions(events.sparkSession, f"{checkpoint.rstrip('/')}/files", table.read(), late_seconds)

    def batch(new: DataFrame, number: int) -> None:
        new = wanted(new, image_only).persist()
        rows = held.taken(new, number).persist()
        try:

            def after(old: DataFrame, users: list) -> DataFrame:
                own = table.of(rows, users)
                return without_files(old, own).unionByName(own.where("op = 'indexed'").select(*old.columns))

            table.in_turns(rows.select("user_id").distinct(), after)
            if categories:
                gone = rows.where("went")  # also where a file came back: it is to be classified anew
                categories.in_turns(gone.select("user_id").distinct(), lambda old, users: without_files(old, categories.of(gone, users)))
            held.forget(number)
        finally:
            rows.unpersist()
            new.unpersist()

    writer = events.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without repeated event ids, with state for so long (beyond what listeners do)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rates(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and kind (beyond what listeners do)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")


def due_in_order(requests: DataFrame, seconds: int = CLEANUP_SECONDS) -> DataFrame:
    """Of a table of page views (user_id, ts, classifying), those that start a cleanup: none while classifying, and not again within so many seconds (as a stream: ``timers.cleanup_due``).

    Each user's times stream by in order and only the last start is held,
    so a user with very many page views costs no memory.
    """
    idle = requests.where("NOT classifying").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).distinct()
    rows = idle.repartition("user_id").sortWithinPartitions("user_id", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last = object(), None
        for batch in batches:
            users, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            due = []
            for k, (u, at) in enumerate(zip(users, times)):
                if u != user or at - last >= seconds * 1_000_000:
                    user, last = u, at
                    due.append(k)
            yield batch.take(pa.array(due, pa.int64()))

    return rows.mapInArrow(run, "user_id string, at long").select("user_id", F.timestamp_micros("at").alias("ts"))
