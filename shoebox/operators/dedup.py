"""Exact duplicates: groups by content hash, statistics, safe deletion.

Every function takes the hash index (or a filtered part of it), so a
user and a scope are ordinary filters that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.paths import scoped
from shoebox.functions.scalars import is_hash
from shoebox.plans.config import BULK, page_of

GROUP = ["user_id", "content_hash"]


def of_user(index: DataFrame, user: str | None = None, scope: str | None = None) -> DataFrame:
    rows = index if user is None else index.where(F.col("user_id") == user)
    return scoped(rows, scope)


def groups(index: DataFrame) -> DataFrame:
    """user_id, content_hash, count and total_size of contents with several files."""
    sums = index.groupBy(*GROUP).agg(F.count("*").alias("count"), F.sum("file_size").alias("total_size"))
    return sums.where(F.col("count") > 1)


def group_page(index: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of groups, largest first; the hash settles ties."""
    limit, offset = page_of(limit, offset)
    return groups(index).orderBy(F.desc("total_size"), F.desc("count"), "content_hash", "user_id").offset(offset).limit(limit)


def with_files(page: DataFrame, index: DataFrame) -> DataFrame:
    """The files of each group, one a row.

    A page of ``group_page`` is bounded by its limit, which Spark sees and
    broadcasts; of any other size it is joined as its size demands.
    """
    return index.join(page, GROUP).select(*page.columns, "file_id", "file_path", "file_size", "mime_type", "file_mtime")


def group_detail(index: DataFrame, content_hash: str) -> DataFrame:
    """The files of one content by time, with count and total size; nothing for a malformed hash or a single file."""
    rows = index.where((F.col("content_hash") == content_hash) & is_hash(F.col("content_hash")))
    own = Window.partitionBy(*GROUP)
    rows = rows.select("user_id", "content_hash", "file_id", "file_path", "file_size", "file_mtime", F.count("*").over(own).alias("count"), F.sum("file_size").over(own).alias("total_size"))
    return rows.where(F.col("count") > 1).orderBy("file_mtime", "file_id")


def stats(index: DataFrame) -> DataFrame:
    """Per user: files, duplicate groups, files in them, and bytes of surplus copies.

    Surplus counts by hash and size, groups by hash alone; two partial
    aggregates on the same leading keys give both in one pass.
    """
    sized = index.groupBy("user_id", "content_hash", "file_size").agg(F.count("*").alias("n"))
    hashed = sized.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("file_size")).alias("wasted"))
    several = F.col("n") > 1
    return hashed.groupBy("user_id").agg(
        F.sum("n").alias("indexed_files"),
        F.count_if(several).alias("duplicate_groups"),
        F.sum(F.when(several, F.col("n")).otherwise(F.lit(0))).alias("duplicate_files"),
        F.sum("wasted").alias("wasted_bytes"),
    )


def wasted(index: DataFrame) -> DataFrame:
    sized = index.groupBy("user_id", "content_hash", "file_size").agg(F.count("*").alias("n")).where("n > 1")
    return sized.groupBy("user_id").agg(F.sum((F.col("n") - 1) * F.col("file_size")).alias("wasted_bytes"))


def files_in_groups(index: DataFrame) -> DataFrame:
    """The files whose content has another file, as a semi join with the groups."""
    return index.join(groups(index).select(*GROUP), GROUP, "left_semi")


def keep_one(index: DataFrame, kept: DataFrame) -> DataFrame:
    """The other files of the groups of kept files (user_id, file_id)."""
    chosen = index.join(kept.select("user_id", "file_id"), ["user_id", "file_id"], "left_semi").select(*GROUP, F.col("file_id").alias("kept_id"))
    return index.join(chosen, GROUP).where("file_id <> kept_id").select(*GROUP, "file_id", "file_path", "file_size")


def keyset_page(index: DataFrame, after: int, size: int = 1000, key: str = "file_id") -> DataFrame:
    return index.where(F.col(key) > after).orderBy(key).limit(size)


# --- deletion ---


def bulk_ids(ids: list) -> list[int]:
    """Positive ids in request order; ValueError for none or more than the limit."""
    if not ids:
        raise ValueError("no files")
    if len(ids) > BULK:
        raise ValueError(f"more than {BULK} files")
    found = [n for n in (int(x) for x in ids) if n > 0]
    if not found:
        raise ValueError("no valid files")
    return found


def deletion_plan(index: DataFrame, request: DataFrame) -> DataFrame:
    """What becomes of each requested file.

    request: user_id, file_id, pos.  The last copy of a content stays:
    going by pos, a file is deleted while the group has another.  An id
    that is asked for again, or not indexed, fails.

    Only groups that are asked for are counted: the index meets their
    hashes in a semi join first.
    """
    first = Window.partitionBy("user_id", "file_id").orderBy("pos")
    asked = request.withColumn("turn", F.row_number().over(first))
    known = index.select("user_id", "file_id", "content_hash")
    placed = asked.join(known, ["user_id", "file_id"], "left")
    sizes = known.join(placed.select(*GROUP).distinct(), GROUP, "left_semi").groupBy(*GROUP).agg(F.count("*").alias("copies"))
    live = F.col("content_hash").isNotNull() & (F.col("turn") == 1)
    order = Window.partitionBy("user_id", "content_hash", live).orderBy("pos")
    ranked = placed.join(sizes, GROUP, "left").withColumn("nth", F.row_number().over(order))
    outcome = (
        F.when(F.col("content_hash").isNull(), F.lit("not_indexed"))
        .when(F.col("turn") > 1, F.lit("repeated"))
        .when(F.col("nth") < F.col("copies"), F.lit("deleted"))
        .otherwise(F.lit("last_copy"))
    )
    return ranked.select("user_id", "pos", "file_id", outcome.alias("outcome"))


def deletion_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("user_id").agg(F.count_if(F.col("outcome") == "deleted").alias("deleted"), F.count_if(F.col("outcome") != "deleted").alias("failed"))


def without(group: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups after files were removed: count and size again, groups of one file dropped."""
    return groups(group.join(removed.select("user_id", "file_id"), ["user_id", "file_id"], "left_anti"))


def appended(pages: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pages as a client gathers them (page, pos and the rows): of rows that come again the first one stays."""
    key = key or ["user_id", "file_id"]
    once = Window.partitionBy(*key).orderBy("page", "pos")
    return pages.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").drop("_nth")
