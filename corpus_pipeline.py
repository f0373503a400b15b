"""The corpus pipeline: language, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again before the next one.  All but the last return the
columns of ``documents``.

Edge cases, for every stage: an empty table gives an empty table; other
columns are kept, whatever their names (``pack`` returns its own); repeated
rows are one document after ``near``; a null id is kept.  A null or empty
text has no language and goes with ``language``; handed to a later stage by
itself, it counts as empty in ``quality``, stays in ``near`` (it is linked
with nothing), stays null in ``pii`` and is one token in ``pack``.  Very long
texts are read whole by all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import language, near, packing, pii, quality
from shoebox.llm.common import Scratch, table
from shoebox.llm.entry import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or lie far further from every language than labelled ones lie from their own."""
    profiles = language.learn(docs)
    return language.keep_identified(docs, profiles, language.limit_of(docs, profiles))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of label 0 go."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return near.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    out = pii.redact(docs, pii.learn(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    out = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("pack", pack),
]

#: SQL can't express fitted models and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before: list[Scratch] = []
    try:
        for name, stage in STAGES:
            scratch = Scratch(spark, f"pipeline-{name}")
            docs = scratch.put(stage(spark, docs, sf_dir), name)
            while before:
                before.pop().drop()
            before.append(scratch)
        before.clear()  # the last one is the result
        return docs
    finally:
        for left in before:
            left.drop()
