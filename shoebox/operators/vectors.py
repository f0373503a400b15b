"""Vectors in bulk: sums by key, and the nearest of many, without a row for each component or pair.

``sums`` adds up arrays element by element: each task combines what it
reads by key, and what is left of a key (a row a task) is added up once
more.

``nearest_two`` finds the two best of a user's many vectors for each row
that are within reach of a cosine.  Vectors are cut into chunks: by the
coordinate that is largest (vectors that point alike share it), then by
size.  A chunk knows its mean direction and the widest angle to it, so by
the triangle inequality of angles a row only visits chunks that can hold
something within reach, and none is missed.  In a chunk the best two are
found with all of its vectors at once; the best two of several chunks are
merged.  Chunks that many rows visit are copied for parts of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.scalars import bind, cosine, unit
from shoebox.sources.stores import kept

#: Vectors of a chunk, about.
CHUNK = 1024
#: Rows that meet one copy of a chunk, about.
SPREAD = 100_000
#: Keys that a task combines before it passes sums on.
HELD = 4096
#: For angles that rounding moves.
MARGIN = 1e-7


def sums(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """keys and ``total``, the element-wise sum of arrays of doubles, all of one size within a key; null ones add nothing."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", total array<double>"

    def added(keep: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            types = None

            def out() -> pa.RecordBatch:
                columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
                return pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=[*keys, "total"])

            for batch in batches:
                types = [batch.schema.field(i).type for i in range(len(keys))]
                values = batch.column(len(keys))
                flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *values.value_lengths().fill_null(0).to_pylist()])
                for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))):
                    part = flat[ends[k] : ends[k + 1]]
                    if not len(part):
                        continue
                    if key in held:
                        held[key] = held[key] + part
                    else:
                        if len(held) == keep:
                            yield out()
                            held = {}
                        held[key] = part.astype(np.float64)
            if held:
                yield out()

        return run

    parts = rows.select(*keys, vector).where(F.col(vector).isNotNull()).mapInArrow(added(HELD), schema)
    # The rows of a key follow one another, so one is held.
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added(1), schema)


def largest_coordinate(vector: Column) -> Column:
    """The place of the largest component by size, with its sign."""

    def placed(v: Column) -> Column:
        sizes = F.transform(v, lambda x: F.abs(x))
        at = F.array_position(sizes, F.array_max(sizes)).cast("int")
        return F.when(F.element_at(v, at) < 0, -at).otherwise(at)

    return bind(vector, placed)


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def chunked(vectors: DataFrame, owner: str, size: int = CHUNK) -> DataFrame:
    """owner, ord, name and unit ``vector`` -> the same with dim, chunk, ``pivot`` and ``reach`` (the widest angle of the chunk's cell to its pivot)."""
    rows = vectors.select(owner, "ord", "name", "vector", F.size("vector").alias("dim"))
    counts = rows.groupBy(owner, "dim").agg(F.count("*").alias("n"))
    if counts.where(F.col("n") > size).isEmpty():  # one chunk each: nothing to tell apart
        only = F.struct(F.lit(0).alias("cell"), F.lit(0).cast("bigint").alias("part"))
        return rows.withColumns({"chunk": only, "pivot": F.lit(None).cast("array<double>"), "reach": F.lit(math.pi)})
    rows = rows.join(counts, [owner, "dim"]).withColumn("cell", F.when(F.col("n") <= size, F.lit(0)).otherwise(largest_coordinate(F.col("vector"))))
    key = [owner, "dim", "cell"]
    pivots = sums(rows, key).select(*key, unit(F.col("total")).alias("pivot"))
    # A sum of zero has no direction: any reach will do.
    placed = rows.join(pivots, key).withColumn("away", F.when(F.col("pivot").isNull(), F.lit(math.pi)).otherwise(angle(F.col("vector"), F.col("pivot"))))
    cells = placed.groupBy(*key).agg(F.count("*").alias("members"), F.max("away").alias("reach"))
    rows = placed.join(cells, key).withColumn("part", F.pmod(F.xxhash64("ord", "name"), F.ceil(F.col("members") / size)))
    return kept(rows.select(owner, "dim", "ord", "name", "vector", F.struct("cell", "part").alias("chunk"), "pivot", "reach"), "chunks")


def nearest_two(rows: DataFrame, vectors: DataFrame, owner: str, key: str, least: float, size: int = CHUNK, asking: DataFrame | None = None) -> DataFrame:
    """key, name, score and second of the rows that have a vector of their owner within a cosine of ``least``.

    rows: key (unique), owner, unit ``vector``.  vectors: owner, ord,
    name, unit ``vector``; they are read several times, so they had better
    be a table.  asking: owner of each row, for counting.  The first by ord of equals wins.  ``second`` is
    the runner-up's cosine, or -1 if none is within reach.  Vectors of
    other sizes don't meet.
    """
    kinds = dict(rows.dtypes)
    chunks = chunked(vectors, owner, size)
    where = [owner, "dim", "chunk"]
    heads = chunks.groupBy(*where).agg(F.first("pivot").alias("pivot"), F.first("reach").alias("reach"))
    able = rows.select(key, owner, "vector", F.size("vector").alias("dim")).where("vector IS NOT NULL")
    span = math.acos(max(-1.0, min(1.0, least))) + MARGIN
    can_hold = F.col("pivot").isNull() | (F.col("reach") >= math.pi - span) | (angle(F.col("vector"), F.col("pivot")) <= F.col("reach") + span)
    visits = able.join(heads, [owner, "dim"]).where(can_hold).select(*where, key, "vector")

    # Counted by owner, which needs no vector; a chunk is copied for each part of its owner's rows.
    copies = (rows if asking is None else asking).groupBy(owner).agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("copies"))
    bodies = chunks.groupBy(*where).agg(F.sort_array(F.collect_list(F.struct("ord", "name", "vector"))).alias("body"))  # about CHUNK of them
    bodies = bodies.join(copies, owner).select(*where, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "body")
    asked = visits.join(copies, owner).select(*where, F.pmod(F.xxhash64(key), F.col("copies")).cast("int").alias("copy"), key, "vector")
    none = lambda kind: F.lit(None).cast(kind)
    first = bodies.select(*where, "copy", F.lit(0).alias("kind"), none(kinds[key]).alias(key), none("array<double>").alias("vector"), F.col("body.name").alias("names"), F.col("body.ord").alias("ords"), F.flatten("body.vector").alias("body"))
    then = asked.select(*where, "copy", F.lit(1).alias("kind"), key, "vector", none("array<string>").alias("names"), none("array<bigint>").alias("ords"), none("array<double>").alias("body"))
    met = first.unionByName(then).repartition(*where, "copy").sortWithinPartitions(*where, "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ords = matrix = None
        for batch in batches:
            kind = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if kind[a] == 0:  # of chunks in a row, the last has rows behind it
                    names, ords = batch.column(3)[b - 1].as_py(), np.array(batch.column(4)[b - 1].as_py())
                    matrix = np.array(batch.column(5)[b - 1].as_py()).reshape(len(names), -1)
                    continue
                for at in range(a, b, 1024):
                    n = min(1024, b - at)
                    yield judged(batch.column(1).slice(at, n), batch.column(2).slice(at, n), names, ords, matrix)

    def judged(ids: pa.Array, given: pa.Array, names: list, ords: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        v = given.flatten().to_numpy().reshape(len(ids), -1)
        scores = np.zeros((len(v), len(matrix)))
        for k in range(matrix.shape[1]):  # in order of the components, as a sum of doubles
            scores += v[:, k, None] * matrix[None, :, k]
        each = np.arange(len(v))
        best = scores.argmax(axis=1)  # the first of equals, as the chunk is in order
        top = scores[each, best]
        scores[each, best] = -1.0
        second = scores.max(axis=1)
        columns = [ids, pa.array([names[k] for k in best], pa.string()), pa.array(ords[best], pa.int64()), pa.array(top), pa.array(second)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "name", "ord", "score", "second"])

    partial = met.select("kind", key, "vector", "names", "ords", "body").mapInArrow(run, f"{key} {kinds[key]}, name string, ord long, score double, second double")
    # Top twos merge: the best of all, and the best of the seconds and the other firsts.
    found = partial.where(F.col("score") >= least - 1e-9).groupBy(key).agg(F.max(F.struct("score", -F.col("ord"), "name")).alias("top"), F.max("second").alias("second"), F.sort_array(F.collect_list("score"), asc=False).alias("firsts"))
    return found.select(key, F.col("top.name").alias("name"), F.col("top.score").alias("score"), F.greatest("second", F.coalesce(F.get("firsts", F.lit(1)), F.lit(-1.0))).alias("second"))
