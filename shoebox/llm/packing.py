"""Packing by lexical retrieval over a BM25 index that is sharded by content.

A document longer than a window fills windows by itself; what is left of
it (all of a shorter one) waits, and is what the index holds.  Waiting
texts are scored by BM25 over token ids, with the document frequencies
and the mean length of all that wait.  So that neighbours share a shard,
the corpus is put in order of content: a tree of principal directions
over projected BM25 weights deals it into cells of about
``SHARD_DOCUMENTS`` documents each, and inside a cell documents follow
one another by the least hash of their ids, which keeps near copies
together.  Tasks take ranges of that order, and index one shard of it
after the other.

The longest waiting document of a shard seeds a window, its unused
neighbours fill it by score; the one that doesn't fit is cut, and its
rest keeps waiting.  Where no neighbour is left, the longest waiting ones
follow.  What is too little for a window moves on to the next shard of
the range; at the range's end it is dealt into sequences whose lengths
are powers of two, which need no padding.

Every id of every document lies in exactly one piece.  Work and shuffle
grow in proportion to the input; a task holds one shard, which is bounded
by documents and by tokens; the driver holds document frequencies (one
number for each id of the vocabulary) and a bounded sample on which the
tree is fitted (about ``SAMPLE`` documents).  Cells deeper than the sample
can tell apart are cut by random planes.  A hot group of equal documents
spreads over as many ranges as it needs, as a row's own number is the
last key of the order.

Edge cases: a null or empty text has one id, the end of document; a null
id is kept; repeated rows are packed as often as they occur; no rows
give no pieces; very long texts are cut into windows where they are read,
and only what waits of them is shuffled; other columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, given_back, map_slices, slices, texts_of
from .words import word_bpe

WINDOW = 4096
END_OF_DOCUMENT = 2
#: Documents of an index shard, and tokens of them, at which it is searched.
SHARD_DOCUMENTS, SHARD_TOKENS = 4096, 4 << 20
#: A rest of at least so many tokens whose number is a power of two is a sequence by itself.
LEAST_ALONE = 256
K1, B = 1.2, 0.75
#: Weights are multiples of it, so that sums of them are exact in any order.
UNIT = 2.0**-24
#: Seeds that are scored together, and postings that are added together.
HELD_SEEDS, HELD_POSTINGS = 32, 1 << 21
#: Ids in more than this share of a shard's documents are columns of a matrix; others are lists of postings.
COMMON = 1 / 16
#: Numbers of a projected document, documents that the tree is fitted on, and levels of it, at most.
DIMENSIONS, SAMPLE, LEVELS = 256, 8192, 9
#: Tokens of a range: at most, and so many at least where there are fewer ranges than shuffle partitions.
RANGE_TOKENS, LEAST_TOKENS = 32 << 20, 4 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
COLUMNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def terms_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each document, one after the other: the document's number, the id, how often it occurs."""
    keys = (np.repeat(np.arange(len(docs)), [len(d) for d in docs]) << 16) | np.concatenate(docs)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first] >> 16, keys[first] & 0xFFFF, np.diff(np.append(first, len(keys)))


class Corpus:
    """Document frequencies, number of documents and mean length: what weights depend on."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.n, self.mean = df, n, mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weights(self, ids: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of entries, given the size of the document of each."""
        raw = self.idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / self.mean))
        return np.rint(raw / UNIT) * UNIT


def corpus_of(docs: list[np.ndarray]) -> Corpus:
    return Corpus(np.bincount(terms_of(docs)[1], minlength=1 << 16), len(docs), float(np.mean([len(d) for d in docs])))


# --- the order of content ---


def spread(x: np.ndarray) -> np.ndarray:
    """A fixed hash of ids to 63 bits."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(1)).astype(np.int64)


HASHES = spread(np.arange(1, (1 << 16) + 1))


def projected(corpus: Corpus, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, its BM25 weights projected to DIMENSIONS numbers of norm 1, and the least hash of its ids."""
    doc, ids, tf = terms_of(docs)
    sizes = np.array([len(d) for d in docs], float)
    hashed = HASHES[ids]
    weights = np.where(hashed & 1, 1.0, -1.0) * corpus.weights(ids, tf.astype(float), sizes[doc])
    slot = doc * DIMENSIONS + (hashed >> 1) % DIMENSIONS
    out = np.bincount(slot, weights, len(docs) * DIMENSIONS).reshape(len(docs), DIMENSIONS)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, np.minimum.reduceat(hashed, np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))))


class Cells:
    """A tree of principal directions, cut at medians, and random planes below its leaves."""

    def __init__(self, sample: np.ndarray, bits: int):
        self.levels = min(bits, LEVELS)
        self.extra = bits - self.levels
        nodes = 2**self.levels
        self.direction, self.cut, self.mean = np.zeros((nodes, DIMENSIONS)), np.zeros(nodes), np.zeros((nodes, DIMENSIONS))
        self.planes = np.random.default_rng(7).standard_normal((DIMENSIONS, self.extra))
        at = np.ones(len(sample), np.int64)
        for node in range(1, nodes):
            mine = np.flatnonzero(at == node)
            rows = sample[mine] - sample[mine].mean(0) if len(mine) else sample[:0]
            way = np.random.default_rng(node).standard_normal(DIMENSIONS)
            for _ in range(12 if len(mine) > 1 else 0):
                way = rows.T @ (rows @ way)
                way /= max(np.linalg.norm(way), 1e-12)
            self.direction[node] = way
            along = sample[mine] @ way
            self.cut[node] = np.median(along) if len(mine) else 0.0
            at[mine] = 2 * node + (along > self.cut[node])
        for leaf in np.unique(at).tolist():
            self.mean[leaf - nodes] = sample[at == leaf].mean(0)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.ones(len(vectors), np.int64)
        for _ in range(self.levels):
            at = 2 * at + (np.einsum("ij,ij->i", vectors, self.direction[at]) > self.cut[at])
        at -= 2**self.levels
        if self.extra:
            for bit in ((vectors - self.mean[at]) @ self.planes > 0).T:
                at = 2 * at + bit
        return at


# --- one shard ---


class Shard:
    """A BM25 inverted index over some documents of a corpus."""

    def __init__(self, corpus: Corpus, docs: list[np.ndarray]):
        self.n = len(docs)
        doc, ids, tf = terms_of(docs)
        weights = corpus.weights(ids, tf.astype(float), np.array([len(d) for d in docs], float)[doc])
        useful = corpus.df[ids] > 1  # others are in one document alone
        order = np.argsort(ids[useful], kind="stable")
        self.docs, self.weights, ids_here = doc[useful][order], weights[useful][order], ids[useful][order]
        self.ids, self.begins = np.unique(ids_here, return_index=True)
        self.counts = np.diff(np.append(self.begins, len(ids_here)))
        # Of each document, its ids as numbers into ``ids``.
        self.entries = np.searchsorted(self.ids, ids[useful])
        self.bounds = np.searchsorted(doc[useful], np.arange(self.n + 1))
        common = self.counts > max(1, COMMON * self.n)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), self.n))
        at = np.repeat(self.column, self.counts)
        self.matrix[at[at >= 0], self.docs[at >= 0]] = self.weights[at >= 0]

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """Of every document for each seed, by all ids that they share."""
        found = [self.entries[self.bounds[s] : self.bounds[s + 1]] for s in seeds.tolist()]
        row, entry = np.repeat(np.arange(len(seeds)), [len(x) for x in found]), np.concatenate(found) if found else np.zeros(0, np.int64)
        column = self.column[entry]
        asked = np.zeros((len(seeds), len(self.matrix)))
        asked[row[column >= 0], column[column >= 0]] = 1
        out = asked @ self.matrix
        row, entry = row[column < 0], entry[column < 0]
        sizes = self.counts[entry]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(entry):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_POSTINGS, side="right")))
            size = sizes[at:stop]
            places = np.arange(size.sum()) + np.repeat(self.begins[entry[at:stop]] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            out += np.bincount(np.repeat(row[at:stop] * self.n, size) + self.docs[places], self.weights[places], out.size).reshape(out.shape)
            at = stop
        return out


class Pool:
    """Waiting texts of one range; ``k`` numbers them in order of arrival, ``tags`` say whose they are."""

    def __init__(self, corpus: Corpus, shard_documents: int = SHARD_DOCUMENTS):
        self.corpus, self.shard_documents = corpus, shard_documents
        self.docs: list[np.ndarray] = []
        self.tags: list = []
        self.start: list[int] = []
        self.left: list[int] = []
        self.tokens = 0

    def add(self, tag, doc: np.ndarray, start: int, left: int) -> None:
        self.tags.append(tag)
        self.docs.append(doc)
        self.start.append(start)
        self.left.append(left)
        self.tokens += len(doc)

    def full(self) -> bool:
        return len(self.docs) >= self.shard_documents or self.tokens >= SHARD_TOKENS

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Whole windows as lists of (k, start, length), until too little waits for another one."""
        left, start = np.array(self.left, np.int64), np.array(self.start, np.int64)
        waiting = int(left.sum())
        if waiting >= WINDOW:
            shard = Shard(self.corpus, self.docs)
            by_length = np.lexsort((np.arange(len(left)), -left))
            rank = np.empty(len(left), np.int64)
            rank[by_length] = np.arange(len(left))
            at = 0
        while waiting >= WINDOW:
            seeds, at = self._seeds(by_length, left, at)
            for seed, score in zip(seeds.tolist(), shard.scores(seeds)):
                if not left[seed] or waiting < WINDOW:
                    continue
                # Itself, its neighbours by score, the other ones by length.
                order = np.lexsort((rank, -score))
                order = order[(left[order] > 0) & (order != seed)]
                space, window = WINDOW, []
                for k in [seed, *order.tolist()]:
                    n = int(min(space, left[k]))
                    window.append((k, int(start[k]), n))
                    start[k] += n
                    left[k] -= n
                    space -= n
                    if not space:
                        break
                waiting -= WINDOW
                yield window
        self.left, self.start = left.tolist(), start.tolist()

    @staticmethod
    def _seeds(by_length: np.ndarray, left: np.ndarray, at: int) -> tuple[np.ndarray, int]:
        """The next waiting documents in order, and the place of the first one."""
        rest = np.flatnonzero(left[by_length[at:]] > 0)[:HELD_SEEDS] + at
        return by_length[rest], int(rest[0])

    def rest(self) -> list[tuple[int, int, int]]:
        return [(k, self.start[k], n) for k, n in enumerate(self.left) if n]

    def forget(self) -> None:
        """Drop what no longer waits."""
        kept = [(self.tags[k], self.docs[k], start, n) for k, start, n in self.rest()]
        self.__init__(self.corpus, self.shard_documents)
        for x in kept:
            self.add(*x)


def powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A short window as sequences whose lengths are powers of two, largest first."""
    total = sum(n for _, _, n in window)
    todo = window[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        want, out = (1 << bit) & total, []
        while want:
            k, start, n = todo.pop()
            take = min(n, want)
            out.append((k, start, take))
            want -= take
            if take < n:
                todo.append((k, start + take, n - take))
        if out:
            yield out


def sequences(corpus: Corpus, docs: Iterator[tuple], shard_documents: int = SHARD_DOCUMENTS) -> Iterator[list[tuple]]:
    """tag, ids of what waits -> sequences of one range, as lists of (tag, ids, start, length)."""
    pool = Pool(corpus, shard_documents)

    def named(window: list[tuple[int, int, int]]) -> list[tuple]:
        return [(pool.tags[k], pool.docs[k], start, n) for k, start, n in window]

    for tag, doc in docs:
        pool.add(tag, doc, 0, len(doc))
        if pool.full():
            yield from map(named, pool.windows())
            pool.forget()
    yield from map(named, pool.windows())
    yield from map(named, powers(pool.rest()))


# --- the corpus ---

#: Whether what a document has beyond its own windows is a sequence by itself, or waits.
ALONE = f"(n % {WINDOW} >= {LEAST_ALONE} AND ((n % {WINDOW}) & (n % {WINDOW} - 1)) = 0)"
WAITS = f"(n % {WINDOW} > 0 AND NOT {ALONE})"
REST = f"substring(tokens, CAST(2 * (n - n % {WINDOW}) + 1 AS INT), CAST(2 * (n % {WINDOW}) AS INT))"


def encoded(texts: list[str], vocabulary: str) -> list[bytes]:
    """Ids as little-endian unsigned 16-bit numbers, the end of document among them."""
    model, end = word_bpe(vocabulary), np.array([END_OF_DOCUMENT], "<u2").tobytes()
    return [ids + end for ids in model.encode_all(texts)]


def unpacked(column: pa.Array | list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in (column if isinstance(column, list) else column.to_pylist())]


def sampled(docs: DataFrame, n: int, vocabulary: str) -> list[np.ndarray]:
    """What waits of about SAMPLE documents at most, chosen by a hash of the row's number."""
    rows = docs.select("text", F.xxhash64(F.monotonically_increasing_id()).alias("at")).where(F.pmod("at", F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).select("at", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = unpacked(encoded(batch.column(1).to_pylist(), vocabulary))
        return pa.record_batch([batch.column(0), pa.array([x[len(x) // WINDOW * WINDOW :].tobytes() for x in ids], pa.binary())], ["at", "ids"])

    found = map_slices(rows, work, "at long, ids binary").toArrow().sort_by("at")["ids"].to_pylist()
    return [x for x in unpacked(found) if len(x)]


class Router:
    """Cells that a sample was dealt into, with the weights they were fitted on."""

    def __init__(self, sample: list[np.ndarray], bits: int):
        self.corpus = corpus_of(sample) if sample else Corpus(np.zeros(1 << 16), 1, 1.0)
        vectors = [projected(self.corpus, sample[k : k + 256])[0] for k in range(0, len(sample), 256)]
        self.cells = Cells(np.concatenate(vectors) if vectors else np.zeros((0, DIMENSIONS)), bits)

    def of(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cell and least hash of each document."""
        vectors, least = projected(self.corpus, docs)
        return self.cells.of(vectors), least


def placed(docs: DataFrame, router: Router, vocabulary: str) -> DataFrame:
    """doc_id, text -> doc_id, tokens (16-bit ids), n (of them), cell and least: where it stands in the order of content."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = encoded(batch.column(1).to_pylist(), vocabulary)
        cell, least = router.of(unpacked(raw))
        columns = [batch.column(0), pa.array(raw, pa.binary()), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array(cell), pa.array(least)]
        return pa.record_batch(columns, ["doc_id", "tokens", "n", "cell", "least"])

    return map_slices(docs, work, "doc_id long, tokens binary, n long, cell long, least long")


def frequencies(rows: DataFrame) -> np.ndarray:
    """ids (binary) -> in how many rows each id is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, 0):
            df += np.bincount(terms_of(unpacked(batch.column(0)))[1], minlength=1 << 16)
        found = np.flatnonzero(df)
        yield pa.record_batch([pa.array(found), pa.array(df[found])], ["id", "n"])

    out, df = rows.mapInArrow(given_back(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow(), np.zeros(1 << 16, np.int64)
    df[out["id"].to_numpy()] = out["n"].to_numpy()
    return df


def written(found: Iterator[list[tuple]], number: int) -> Iterator[pa.RecordBatch]:
    """Sequences of (doc_id, start, ids, doc_tokens) as rows of COLUMNS, numbered from ``number``."""
    out: list[tuple] = []
    held = 0
    for sequence in found:
        offset = 0
        for doc_id, start, ids, doc_tokens in sequence:
            out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, number, offset))
            offset += len(ids)
        number += 1
        held += offset
        if held >= 256 * WINDOW:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), COLUMNS.types)], schema=COLUMNS)
            out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), COLUMNS.types)], schema=COLUMNS)


def own_sequences(rows: DataFrame) -> DataFrame:
    """Windows that documents fill by themselves; their numbers lie above those of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[tuple]]:
            for batch in slices(batches):
                for doc_id, ids, alone in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist()):
                    for at in range(0, len(ids) if alone else len(ids) // WINDOW * WINDOW, WINDOW):
                        yield [(doc_id, at, ids[at : at + WINDOW], len(ids))]

        yield from written(found(), (1 << 62) + (TaskContext.get().partitionId() << 40))

    return rows.where(f"n >= {WINDOW} OR {ALONE}").selectExpr("doc_id", "tokens", f"{ALONE} AS alone").mapInArrow(given_back(run), SCHEMA)


def shared_sequences(rows: DataFrame, corpus: Corpus, ranges: int, shard_documents: int) -> DataFrame:
    """Sequences of what waits."""
    waiting = rows.where(WAITS).selectExpr("doc_id", f"{REST} AS ids", "n", "cell", "least", "key")
    waiting = waiting.repartitionByRange(ranges, "cell", "least", "key").sortWithinPartitions("cell", "least", "key").select("doc_id", "ids", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (((doc_id, n), ids) for b in slices(batches) for doc_id, ids, n in zip(b.column(0).to_pylist(), unpacked(b.column(1)), b.column(2).to_pylist()))
        found = ([(tag[0], tag[1] // WINDOW * WINDOW + at, ids[at : at + size], tag[1]) for tag, ids, at, size in s] for s in sequences(corpus, stream, shard_documents))
        yield from written(found, TaskContext.get().partitionId() << 40)

    return waiting.mapInArrow(given_back(run), SCHEMA)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    n = docs.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    bits = max(0, int(np.ceil(np.log2(n / shard_documents))))
    router = Router(sampled(docs, n, vocabulary) if bits else [], bits)
    rows = Scratch(spark, "packing").put(placed(docs, router, vocabulary).select(F.monotonically_increasing_id().alias("key"), "*"), "tokens")
    waiting, total = rows.where(WAITS).agg(F.count("*"), F.coalesce(F.sum(F.col("n") % WINDOW), F.lit(0))).first()
    if not waiting:
        return own_sequences(rows)
    corpus = Corpus(frequencies(rows.where(WAITS).selectExpr(f"{REST} AS ids")), waiting, total / waiting)
    ranges = max(1, -(-total // RANGE_TOKENS), min(-(-total // LEAST_TOKENS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return shared_sequences(rows, corpus, ranges, shard_documents).union(own_sequences(rows))
