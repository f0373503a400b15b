"""What becomes of a file's row under its events, in a finished log and in a stream.

In the order of (ts, event_id), ``created`` brings a row unless one of the
same time and size is there, ``written`` brings one in any case,
``deleted`` takes it away, and ``renamed`` moves it if it is there.
Contents and renames are versions of their own: a rename counts unless a
content that took effect follows it.

``settled`` works on a log as a whole.  Only events since the last written
or deleted one matter, so a hot file is first cut down to those, by an
aggregate; whether a created event took effect then shows in the content
event before it.  ``Versions`` does the same to a stream, a batch at a
time: of each file it keeps the row that the index had, or the newest
written or deleted event, and what came since, by (ts, event_id).  An
older event that comes late takes its place among them, or none if it is
older than that event, so any split of a log into batches ends with the
same row.  Events are held back for ``late``; then they are folded into
the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoebox.sources import stores

KEY = ["user_id", "file_id"]
CONTENT = ["file_path", "file_size", "mime_type", "content_hash", "file_mtime"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def usable(events: DataFrame) -> DataFrame:
    """Events of a file with an id and an owner; an empty file brings no row."""
    brings = F.col("op").isin("created", "written")
    return events.where(F.col("user_id").isNotNull() & F.col("file_id").isNotNull() & ~(brings & (F.coalesce("file_size", F.lit(0)) == 0)))


# --- a finished log ---


def order() -> Column:
    return F.struct("ts", "event_id")


def settled(index: DataFrame, events: DataFrame) -> DataFrame:
    """For each file: content (the last event that brought a row or took it away, null if none did) and file_path of a later rename, or null."""
    seen = usable(events).select(*KEY, "ts", "event_id", "op", *CONTENT)
    last = seen.where(F.col("op").isin("written", "deleted")).groupBy(*KEY).agg(F.max(order()).alias("_from"))
    tail = seen.join(last, KEY, "left").where(F.col("_from").isNull() | (order() >= F.col("_from")))
    old = index.select(*KEY, F.struct("file_mtime", "file_size").alias("_known"))
    # The content that was there before an event: of the content event before it, or of the index.
    content = F.when(F.col("op") != "renamed", F.struct("op", F.struct("file_mtime", "file_size").alias("known")))
    before = F.last(content, ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = tail.join(old, KEY, "left").withColumn("_before", before)
    known = F.when(F.col("_before").isNull(), F.col("_known")).when(F.col("_before.op") != "deleted", F.col("_before.known"))
    same = known.isNotNull() & known["file_mtime"].eqNullSafe(F.col("file_mtime")) & known["file_size"].eqNullSafe(F.col("file_size"))
    effective = F.col("op").isin("written", "deleted") | ((F.col("op") == "created") & ~same)
    newest = lambda where, *columns: F.max_by(F.when(where, F.struct("ts", "event_id", *columns)), F.when(where, order()))
    out = rows.withColumn("_effective", effective).groupBy(*KEY).agg(newest(F.col("_effective"), "op", *CONTENT).alias("content"), newest(F.col("op") == "renamed", "file_path").alias("rename"))
    later = F.col("content").isNull() | (F.struct("rename.ts", "rename.event_id") > F.struct("content.ts", "content.event_id"))
    return out.select(*KEY, "content", F.when(F.col("rename").isNotNull() & later, F.col("rename.file_path")).alias("moved_to"))


def applied(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after ``settled`` changes; other columns than those of a file's content keep their values, and are null in new rows but for scanned_at."""
    there = index.join(changes, KEY, "left")
    stays = there.where("content IS NULL").withColumn("file_path", F.coalesce("moved_to", "file_path")).select(*index.columns)
    new = changes.where("content.op <> 'deleted'")
    made = {c: F.col(f"content.{c}") for c in CONTENT} | {"file_path": F.coalesce("moved_to", "content.file_path"), "scanned_at": F.col("content.ts")}
    kinds = dict(index.dtypes)
    return stays.unionByName(new.select(*(F.col(c) if c in KEY else made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in index.columns)))


# --- a stream ---

HELD = "user_id string, file_id long, at long, event_id long, op string, file_path string, file_size long, mime_type string, content_hash string, file_mtime long, scanned_at timestamp"
#: Batches after which all that is held is written anew, by one of them.
WHOLE_AFTER = 20


class Versions:
    """What is held of each file between the batches of a stream, as tables in a folder.

    Rows are events, and the rows that the index had when the stream began
    (op ``indexed``, without a time).  A batch reads what is held of its
    files and writes it anew to a folder of its own; every ``whole_after``
    batches one writes the rows of all files, with those events folded that
    nothing can come before.  A batch that runs again reads what it read
    before and writes over its own folder.
    """

    def __init__(self, spark: SparkSession, path: str, index: DataFrame, late_seconds: int, whole_after: int = WHOLE_AFTER):
        self.spark, self.path, self.late, self.whole_after = spark, path.rstrip("/"), late_seconds * 1_000_000, whole_after
        if not stores.exists(spark, f"{self._folder(-1)}/_SUCCESS"):
            start = index.where("user_id IS NOT NULL AND file_id IS NOT NULL")
            made = {"at": F.lit(None), "event_id": F.lit(None), "op": F.lit("indexed")}
            self._write(-1, start.select(*(made.get(c, F.col(c)).cast(kind).alias(c) for c, kind in (x.split() for x in HELD.split(", ")))))

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def _write(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self._folder(batch))

    def _first(self, batch: int) -> int:
        """The last folder before a batch that holds all files."""
        return batch // self.whole_after * self.whole_after - 1

    def held(self, batch: int) -> DataFrame:
        """What is held before a batch, with the number of the batch that wrote it; a file's rows of earlier ones no longer count."""
        parts = [self._folder(k) for k in range(self._first(batch), batch)]
        return self.spark.read.schema(f"{HELD}, batch int").option("basePath", self.path).parquet(*parts)

    def taken(self, events: DataFrame, batch: int) -> DataFrame:
        """The rows after a batch: user_id, file_id, op (indexed or deleted), the columns of the row, and whether the file went meanwhile."""
        held = self.held(batch)
        newest = held.agg(F.max("at")).first()[0]
        seen = usable(events).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("scanned_at", F.lit(None).cast("timestamp")).select(*(x.split()[0] for x in HELD.split(", ")))
        seen = seen if newest is None else seen.where(F.col("at") > newest - self.late)
        files = seen.groupBy(*KEY).agg(F.max(F.col("op") == "deleted").alias("went"))
        whole = (batch + 1) % self.whole_after == 0
        own = held if whole else held.join(files.select(*KEY), KEY, "left_semi")
        latest = own.groupBy(*KEY).agg(F.max("batch").alias("batch"))
        both = own.join(latest, [*KEY, "batch"], "left_semi").drop("batch").unionByName(seen).dropDuplicates([*KEY, "at", "event_id"])
        both = unsettled(folded(both, newest - self.late) if whole and newest is not None else both)
        self._write(batch, both)
        now = self.spark.read.schema(HELD).parquet(self._folder(batch))
        rows = files.join(row_of(now.join(files.select(*KEY), KEY, "left_semi") if whole else now), KEY, "left")
        return rows.withColumn("op", F.when(F.col("there"), "indexed").otherwise("deleted")).drop("there")

    def forget(self, batch: int) -> None:
        """Remove the folders that no batch from this one on reads."""
        for k in range(max(-1, self._first(batch) - self.whole_after), self._first(batch)):
            stores.remove(self.spark, self._folder(k))


def split(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that the index had, and events."""
    start = held.where("op = 'indexed'").select(*KEY, *CONTENT, "scanned_at")
    return start, held.where("op <> 'indexed'").withColumn("ts", F.timestamp_micros("at"))


def row_of(held: DataFrame) -> DataFrame:
    """The rows of files after what is held of them; those of files that are gone are missing."""
    start, events = split(held)
    return applied(start, settled(start, events)).withColumn("there", F.lit(True))


def unsettled(held: DataFrame) -> DataFrame:
    """Without what a later written or deleted event makes void."""
    place = F.struct("at", "event_id")
    last = held.where(F.col("op").isin("written", "deleted")).groupBy(*KEY).agg(F.max(place).alias("_from"))
    return held.join(last, KEY, "left").where(F.col("_from").isNull() | (F.col("at").isNotNull() & (place >= F.col("_from")))).drop("_from")


def folded(held: DataFrame, until: int) -> DataFrame:
    """With one event in place of all up to a time, which brings or takes away the row that they lead to, at the place of the last of them."""
    old = held.where(F.coalesce(F.col("at") <= until, F.lit(True)))
    last = old.where("at IS NOT NULL").groupBy(*KEY).agg(F.max(F.struct("at", "event_id")).alias("_last"))
    rows = row_of(old.join(last, KEY, "left_semi"))
    one = last.join(rows, KEY, "left").select(*KEY, "_last.at", "_last.event_id", F.when(F.col("there"), "written").otherwise("deleted").alias("op"), *CONTENT, F.lit(None).cast("timestamp").alias("scanned_at"))
    started = old.where("at IS NULL").join(last, KEY, "left_anti")
    return held.where(F.col("at") > until).unionByName(started).unionByName(one)


def with_rocks(spark: SparkSession) -> None:
    """States with timers need that store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
