"""Vector codes: product quantisation in whole numbers, with filtered exact search.

A component x becomes floor(1024 * x).  Vectors are cut into ``PARTS``
equal consecutive parts; each part has a codebook of at most ``ENTRIES``
entries, which starts as that part of the smallest ids' vectors and is
moved ``ROUNDS`` times to the floored means of what is nearest to it.

The nearest entry is found by segment means.  With a part cut into
blocks, the squared distance of a vector to an entry is the sum of
(block length) * (difference of the block means)^2 and the squared
distance of what is left after the means are taken off, which is at
least the squared difference of the two norms.  Entries are filtered by
that bound, first with one block, then with finer ones; each level's best
entry gets its exact distance, which is what bounds must not exceed.  Bounds are floating point and get a margin, so no entry at the
least distance is lost; survivors get exact integer distances, and the
lowest index of the least one wins.

Every task sums what it assigned, so a round shuffles at most parts *
entries rows for each task, and the driver sees one codebook (64 KB for
64 components), whose size doesn't depend on the rows.

Edge cases: rows whose vector is null or holds null, NaN or infinite
components are dropped, and no other.  The dimension is that of most rows
(the larger of equals); a vector of another length keeps its row, with a
null code and error.  Where the dimension isn't a multiple of the parts,
or is 0, all codes are null.  Scaled components are held to +-2^24, so
sums stay exact.  With fewer rows than entries, codebooks are smaller.
Equal ids are ordered by their vectors, null ids come last.  Repeated rows
get repeated codes; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, given_back

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components are held to this.
MOST = 1 << 24
#: Rows that are compared with all entries at once.
ROWS = 512
#: Up to here squares of differences sum up exactly as doubles, which are faster (for parts of up to 2048 components).
SMALL = 1 << 19


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all of its components are numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of ``dim`` components."""
    return scaled(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


class Codebook:
    """The entries of one part, with their block means and residual norms at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.whole = entries, entries.astype(np.float64)
        self.small = entries.shape[1] <= 2048 and bool((np.abs(entries) <= SMALL).all())
        width = entries.shape[1]
        self.levels = [self.cut(width, n) for n in sorted({1, max(1, width // 4), max(1, width // 2)})]
        self.profiles = [self.profile(entries, cut) for cut in self.levels]
        self.sizes = [np.einsum("ij,ij->i", p, p) for p in self.profiles]

    @staticmethod
    def cut(width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of n blocks."""
        starts = np.arange(n) * width // n
        return starts, np.diff(np.append(starts, width)).astype(np.float64)

    @staticmethod
    def profile(rows: np.ndarray, cut: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Block means times the root of their length, and the residual norm: distances of profiles are bounds."""
        starts, lengths = cut
        means = np.add.reduceat(rows, starts, axis=1) / lengths
        left = rows - np.repeat(means, lengths.astype(int), axis=1)
        return np.hstack([means * np.sqrt(lengths), np.sqrt(np.einsum("ij,ij->i", left, left))[:, None]])

    def exact(self, rows: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = rows.take(row, axis=0)
        gap -= self.whole.take(entry, axis=0) if rows.dtype == np.float64 else self.entries.take(entry, axis=0)
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, and how many exact distances were computed."""
        n, m = len(rows), len(self.entries)
        if self.small and (np.abs(rows) <= SMALL).all():
            rows = rows.astype(np.float64)  # whole numbers still, and exact
        each = np.arange(n)
        upper, alive, spent = np.full(n, np.inf), np.ones((n, m), bool), 0
        for cut, known, known_size in zip(self.levels, self.profiles, self.sizes):
            own = self.profile(rows, cut)
            size = np.einsum("ij,ij->i", own, own)[:, None] + known_size
            bound = size - 2 * (own @ known.T)  # the squared distance of the profiles, but for rounding
            bound -= 1e-12 * size
            # The likeliest entry gets its exact distance; no bound above it matters.
            upper = np.minimum(upper, self.exact(rows, each, bound.argmin(axis=1)))
            spent += n
            alive &= bound <= self.ceiling(upper)[:, None]
        row, entry = np.nonzero(alive)
        distance = self.exact(rows, row, entry)
        at = self.first_least(distance, row)
        return entry[at], distance[at], spent + len(row)

    @staticmethod
    def ceiling(upper: np.ndarray) -> np.ndarray:
        """Bounds up to here may belong to an entry as near as ``upper``: a margin over their rounding."""
        return upper * (1 + 1e-9) + 1.0

    @staticmethod
    def first_least(values: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Positions of each row's least value, the first of equals; every row has one, and rows ascend."""
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(values, starts)
        hits = np.flatnonzero(values == np.repeat(least, np.diff(np.append(starts, len(row)))))
        return hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]


def pieces(vectors: np.ndarray, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part, first row and block of rows."""
    width = vectors.shape[1] // len(books)
    for start in range(0, len(vectors), ROWS):
        for p in range(len(books)):
            yield p, start, vectors[start : start + ROWS, p * width : (p + 1) * width]


def books_of(entries: np.ndarray) -> list[Codebook]:
    return [Codebook(e) for e in entries]


def summed(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """part, entry, n and the sums x0, x1 ... of the parts that are nearest to each entry: one row of each for a task, combined."""
    parts, size, width = entries.shape
    dim = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(entries)
        total = np.zeros((parts, size, width), np.int64)
        count = np.zeros((parts, size), np.int64)
        for batch in batches:
            for p, _, block in pieces(matrix(batch.column(0), dim), books):
                index = books[p].nearest(block)[0]
                np.add.at(total[p], index, block)
                count[p] += np.bincount(index, minlength=size)
        p, e = np.nonzero(count)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e])]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(total[p, e, k]) for k in range(width))], names=["part", "entry", "n", *(f"x{k}" for k in range(width))])

    names = ["n", *(f"x{k}" for k in range(width))]
    sums = rows.select("vector").mapInArrow(given_back(run), "part int, entry int, " + ", ".join(f"{c} long" for c in names))
    return sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names))


def trained(rows: DataFrame, dim: int, parts: int = PARTS, most: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The final codebooks, (parts, entries, width), of rows of vec_id and ``vector``, all of ``dim`` components."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(most).select("vector").collect()
    entries = scaled(np.array([r[0] for r in first], np.float64)).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in summed(rows, entries).collect():  # a row for each entry
            entries[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return entries


def digest_of(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of rows of vec_id, label and ``vector``."""
    parts, _, width = entries.shape
    dim = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(entries)
        for batch in batches:
            index = np.zeros((batch.num_rows, parts), np.int64)
            error = np.zeros(batch.num_rows, np.int64)
            for p, start, block in pieces(matrix(batch.column(2), dim), books):
                index[start : start + len(block), p], distance, _ = books[p].nearest(block)
                error[start : start + len(block)] += distance
            code = ["".join(f"{k:02x}" for k in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    return rows.select("vec_id", "label", "vector").mapInArrow(given_back(run), f"vec_id long, label {kind}, code string, error long")


def compress(embeddings: DataFrame, parts: int = PARTS, most: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256.

    Codes are written to the shared folder once, as both the sums of labels
    and their rows need them.  Sums are read back as a table of known size,
    so Spark broadcasts them while they are small, and joins by label, with
    hot labels split, beyond.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector")).where(finite(F.col("embedding")))
    sizes = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    usable = dim > 0 and dim % parts == 0
    fit = F.size("vector") == (dim if usable else -1)
    rows = vectors.where(fit)
    entries = trained(rows, dim, parts, most, rounds) if usable else np.zeros((parts, 0, 0), np.int64)
    scratch = Scratch(spark, "codes")
    try:
        others = vectors.where(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        found = scratch.put(encoded(rows, entries).unionByName(others) if usable else others, "codes")
        sums = scratch.put(found.groupBy("label").agg(F.sum("error").alias("label_error")), "sums")
        whole = found.join(sums, found["label"].eqNullSafe(sums["label"]), "left")
        return scratch.put(whole.select("vec_id", "code", "error", "label_error", F.lit(digest_of(entries)).alias("codebooks_sha256")), "result")
    finally:
        scratch.drop("codes", "sums")
