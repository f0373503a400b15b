"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (one to
three letters, words padded by one blank) in order of frequency.  A text
is compared by its own most frequent n-grams: each adds how far its rank
lies from its rank in the profile, or the full length of the profile
where it is missing.  The language with the least sum wins.

Profiles are learned from all labelled rows that aren't held out, unless
a caller asks for a number of rows of each language.  Predictions see the
whole text and nothing else.

``keep_identified`` also rejects a text that lies further from every
profile than ``limit_of`` allows, by what all labelled rows do from their
own: text of another script, or noise.

Edge cases: a null text, or one without a letter, is ``und`` with score
0; equal distances go to the language first in alphabetical order, equal
counts rank by n-gram; with no labelled row every text is ``und``; an
empty table gives no rows; very long texts are read whole; repeated rows
give repeated results; other columns are ignored, or kept by
``keep_identified``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back, held_out, map_slices, slices, texts_of

#: Distinct n-grams that a task holds before it hands on their counts.
HELD_KEYS = 1 << 20
#: N-grams in a profile, and of a text that are compared with it.
PROFILE = 400
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str, most: int | None = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent n-grams of a text and their counts, in that order; without it all of them, in order of their numbers.

    An n-gram is a number of up to three 21-bit code points; a blank is 1,
    so that a blank in front counts, and blanks alone are no n-gram.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letter_table()[points]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points[~is_letter] = 1
    points = np.concatenate(([1], points, [1]))
    points = points[np.concatenate(([True], (points[1:] != 1) | (points[:-1] != 1)))]  # one blank between words
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    keys = np.concatenate((points[points != 1], two, three))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    return (keys[first], counts) if most is None else top(keys[first], counts, most)


def top(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most frequent of sorted keys, ties by key."""
    if len(keys) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keys, counts = keys[counts >= least], counts[counts >= least]
    order = np.argsort(-counts, kind="stable")[:k]
    return keys[order], counts[order]


class Profiles:
    def __init__(self, languages: list[str], ranked: list[list[int]]):
        self.languages = languages
        self.sorted: list[tuple[np.ndarray, np.ndarray]] = []
        for keys in ranked:
            keys = np.array(keys, np.int64)
            order = np.argsort(keys)
            self.sorted.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score: the likeness to the best profile as a share of that to the best two."""
        return self.compare(text)[:2]

    def compare(self, text: str | None) -> tuple[str, float, float]:
        """The language, its score, and the distance to its profile as a share of the largest possible one."""
        keys, _ = ngrams(text or "")
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0, 1.0
        ranks = np.arange(len(keys))
        distances = []
        for known, rank in self.sorted:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            there = known[at] == keys
            distances.append(int(np.where(there, np.abs(rank[at] - ranks), PROFILE).sum()))
        order = np.argsort(distances, kind="stable")
        best = distances[order[0]] / (PROFILE * len(keys))
        if len(order) == 1:
            return self.languages[order[0]], max(0.0, 1.0 - best), best
        second = distances[order[1]] / (PROFILE * len(keys))
        return self.languages[order[0]], float(second / (best + second)) if best + second > 0 else 0.5, best


def sampled(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int | None = None) -> DataFrame:
    """lang and text of the labelled rows that are learned from: all of them, or of each language those whose hash of id and text is least, ``per_language`` at most.

    Of so many, repeated rows count once.  A share of all hashes that holds the sample
    twice over is kept first, by an estimate of the distinct ones, so few
    rows are ranked, and texts are moved for those alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if per_language is None:
        return rows.select("lang", "text")
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("rank"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")).collect()  # one row a language
    keep = F.lit(False)
    for r in sizes:
        share = min(1.0, 2.0 * per_language / r["n"]) if r["n"] > 4 * per_language else 1.0
        keep = keep | ((F.col("lang") == r["lang"]) & (F.pmod("rank", F.lit(1_000_000_007)) <= int(share * 1_000_000_007)))
    few = rows.where(keep).groupBy("lang", "rank").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("rank", F.lit(1_000_000_007)), "rank"))
    return few.withColumn("at", place).where(F.col("at") <= per_language).select("lang", "text")


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int | None = None) -> Profiles:
    """Profiles of the non-null languages of rows that aren't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def counts(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "key", "n"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(ngrams(text, None))
                if len(parts) >= 128:
                    held[lang] = [summed(parts)]
                    if len(held[lang][0][0]) >= HELD_KEYS:
                        yield counts(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield counts(lang, *summed(parts))

    few = sampled(docs, lang_col, id_col, text_col, per_language)
    counted = few.mapInArrow(given_back(count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("at") <= PROFILE).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("keys"))
    found = sorted((r["lang"], [k["key"] for k in r["keys"]]) for r in ranked.collect())  # PROFILE numbers a language
    return Profiles([x for x, _ in found], [k for _, k in found])


def limit_of(docs: DataFrame, profiles: Profiles, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int | None = None) -> float:
    """A distance halfway between the largest at which a labelled row lies from its own language and the largest possible one; 1 without such a row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, profiles.compare(t)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return pa.record_batch([pa.array([d for lang, (best, _, d) in found if best == lang], pa.float64())], ["distance"])

    few = sampled(docs, lang_col, id_col, text_col, per_language)
    most = map_slices(few, work, "distance double").agg(F.max("distance")).first()[0]
    return 1.0 if most is None else (1.0 + float(most)) / 2


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_slices(texts_of(docs, id_col, text_col), work, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, limit: float = 1.0, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language and lies no further than ``limit`` from its profile, with all their columns."""

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        def holds(t: str) -> bool:
            lang, _, distance = profiles.compare(t)
            return lang != UNKNOWN and distance <= limit

        return texts.map(holds).astype(bool)

    return docs.where(known(F.coalesce(F.col(text_col), F.lit(""))))
