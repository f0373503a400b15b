"""The recurring jobs over finished tables: a full scan, and the weekly cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators import dedup, index
from shoebox.operators.index import KEY

#: Groups that a cleanup looks at, of each user.
CLEANUP_GROUPS = 10_000


def scan(listing: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """The hash index after a scan of a listing that has content_hash: changed files anew, unlisted ones gone.

    A file whose hash is null could not be read: it is an error, and its
    old row stays.
    """
    work = index.compared(listing, old, force=force).where("needs_work AND content_hash IS NOT NULL")
    after = index.merged(old, work.select(*old.columns))
    return index.split_stale(after, listing)[0]


def scan_counters(listing: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """Per user: total, hashed, skipped (unchanged) and errors of that scan."""
    rows = index.compared(listing, old, force=force)
    outcome: Column = F.when(~F.col("needs_work"), "skipped").when(F.col("content_hash").isNull(), "error").otherwise("done")
    return index.counters(rows.withColumn("outcome", outcome))


def cleanup(old: DataFrame, listing: DataFrame, most: int = CLEANUP_GROUPS) -> DataFrame:
    """The hash index after a cleanup: of files in each user's largest duplicate groups those that are no longer listed go.

    The number of groups is a limit that the job states; a full scan
    cleans all files.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("total_size"), F.desc("count"), "content_hash")
    top = dedup.groups(old).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select(*dedup.GROUP)
    looked_at = old.join(top, dedup.GROUP, "left_semi").select(*KEY)
    gone = looked_at.join(listing.select(*KEY), KEY, "left_anti")
    return index.without_files(old, gone)
