"""Filter interaction audit: every order of five filters, replayed over every document.

Each document's failures become flags (a bit a filter).  The flags are
crossed with the 120 orders, a broadcast table of fixed size; each pair's
first failing step is found once, its five steps are exploded, and
conditional sums are combined in each task before they are shuffled, so
what is shuffled is at most 600 rows for each part and task.

A: under 100 words.  B: distinct words under 80 % of the words.  C: over
10 % of the code points are A-Z.  D: holds one of # $ % & * |.  E: the
text equals that of a smaller doc_id anywhere in the table.

E needs no group of copies in one place: the first id of each text is an
aggregate by the text's digest, and joins back by id and digest, a key
that one row of each copy has.

Edge cases: a null text counts as empty (it fails A; empty texts are
copies of one another); a null lang is the part ''; repeated rows count
as often as they are there, and a row with the same id and text is not a
smaller one; a null id is neither smaller than another nor greater, and
has no labels; of several labels of an id any 1 counts; labels of unknown
ids count nowhere; other columns are ignored; an empty table gives no
rows, as it has no part.  Texts are read whole, one a row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .lines import words_of

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def own_failures(text: Column) -> Column:
    """Flags of A to D, which a text shows by itself."""
    words = words_of(text)

    def judged(w: Column) -> Column:
        fails = {
            "A": F.size(w) < 100,
            "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
            "D": F.rlike(text, F.lit(r"[#$%&*|]")),
        }
        total = F.lit(0)
        for letter, failing in fails.items():
            total = total + F.when(failing, F.lit(bit(letter))).otherwise(F.lit(0))
        return total

    return F.transform(F.array(words), judged)[0]  # words are split once


def own_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the flags of A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        own_failures(text).alias("own"),
    )


def with_copies(flags: DataFrame) -> DataFrame:
    """The flags with E: of the rows of one digest, those with an id beyond the least."""
    firsts = flags.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = flags.join(firsts, ["doc_id", "digest"], "left")
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.select("doc_id", "part", (F.col("own") + F.when(later, F.lit(bit("E"))).otherwise(F.lit(0))).alias("flags"))


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags, good and toxic (0 or 1) of each row."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flags.join(known, "doc_id", "left")
    return rows.select("part", "flags", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: a number, and the bits of their filters from first to last."""
    return spark.createDataFrame([(n, [bit(c) for c in order]) for n, order in enumerate(ORDERS)], "nth int, bits array<int>")


def replayed(flags: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, from ``with_labels``."""
    spark = flags.sparkSession
    crossed = flags.crossJoin(F.broadcast(orders(spark)))
    first = F.lit(6)
    for k in range(4, -1, -1):
        first = F.when(F.col("flags").bitwiseAND(F.col("bits")[k]) != 0, F.lit(k + 1)).otherwise(first)
    steps = crossed.select("part", "flags", "good", "toxic", "nth", first.alias("first"), F.posexplode("bits").alias("pos", "bit"))
    step = F.col("pos") + 1
    removed = F.col("first") == step
    fails = F.col("flags").bitwiseAND(F.col("bit")) != 0
    counts = {
        "kept": F.col("first") > step,
        "removed": removed,
        "redundant": fails & (F.col("first") < step),
        "unique_fails": F.col("flags") == F.col("bit"),
        "good_lost": removed & (F.col("good") == 1),
        "toxic_lost": removed & (F.col("toxic") == 1),
    }
    sums = steps.groupBy("part", "nth", step.alias("step"), "bit").agg(*(F.sum(c.cast("long")).alias(k) for k, c in counts.items()))
    spelled = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("nth") + 1)
    # A window, not a second aggregate and a join, which would replay all again: it holds 120 rows of a part and filter.
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return sums.select("part", spelled.alias("filter_order"), F.col("step").cast("int").alias("step"), *counts, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    The flags of each document, some 50 bytes, are written to the shared
    folder, so texts are read once and lost executors cost no second
    reading; they go as soon as the counts are written.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    try:
        flags = scratch.put(own_flags(docs), "flags")
        return scratch.put(replayed(with_labels(with_copies(flags), labels)), "counts")
    finally:
        scratch.drop("flags")
