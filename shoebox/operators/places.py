"""Places: located photos gathered to markers on a grid of four decimal places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.plans.config import MARKER_FILES


def cell(x: Column) -> Column:
    """Ten thousandths, rounded half up: the grid of a marker."""
    return F.floor(x * 10000 + F.lit(0.5)).cast("long")


def marker_id(lat: Column, lng: Column) -> Column:
    """The grid as text, four places each; a cell of 0 from below keeps its sign."""

    def shown(x: Column) -> Column:
        n = cell(x)
        size = F.abs(n)
        return F.concat(F.when((n < 0) | ((n == 0) & (x < 0)), F.lit("-")).otherwise(F.lit("")), F.floor(size / 10000).cast("string"), F.lit("."), F.lpad((size % 10000).cast("string"), 4, "0"))

    return F.concat(shown(lat), F.lit(","), shown(lng))


def located(locations: DataFrame) -> DataFrame:
    return locations.where("has_location AND lat IS NOT NULL AND lng IS NOT NULL")


def markers(locations: DataFrame) -> DataFrame:
    """user_id, marker, lat, lng (of its first file, six places) and count; one shuffle with partial sums."""
    rows = located(locations).withColumn("marker", marker_id(F.col("lat"), F.col("lng")))
    grouped = rows.groupBy("user_id", "marker").agg(F.count("*").alias("count"), F.min_by(F.struct("lat", "lng"), "file_id").alias("at"))
    return grouped.select("user_id", "marker", F.round("at.lat", 6).alias("lat"), F.round("at.lng", 6).alias("lng"), "count")


def marker_list(locations: DataFrame) -> DataFrame:
    return markers(locations).orderBy(F.desc("count"), "user_id", "marker")


def marker_files(locations: DataFrame, most: int = MARKER_FILES) -> DataFrame:
    """The first files of each marker by id, one a row.

    Ranking stops at ``most`` in each task before rows are shuffled, as
    Spark pushes a bounded rank below the exchange.
    """
    rows = located(locations).withColumn("marker", marker_id(F.col("lat"), F.col("lng")))
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("user_id", "marker").orderBy("file_id")))
    return ranked.where(F.col("pos") <= most).select("user_id", "marker", "pos", "file_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def totals(locations: DataFrame) -> DataFrame:
    """Per user: markers, and photos that have a location even where its numbers are missing."""
    rows = locations.where("has_location")
    keys = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), marker_id(F.col("lat"), F.col("lng")))
    cells = rows.groupBy("user_id", keys.alias("marker")).agg(F.count("*").alias("n"))
    return cells.groupBy("user_id").agg(F.count("marker").alias("total_markers"), F.sum("n").alias("total_photos_with_location"))


def count_with_location(locations: DataFrame) -> DataFrame:
    """Per user, how many files have a location."""
    return locations.groupBy("user_id").agg(F.count_if("has_location").alias("files"))
