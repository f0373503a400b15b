"""Near duplicates by HyperMinHash.

A document's set holds its distinct shingles of five words (lower-cased
A to Z; fewer words are one shingle together).  Shingle hashes fall into
``BUCKETS`` registers, each of which keeps the leading zeros and the ten
bits behind the leading one of the least hash in it.  Bands of ``WIDTH``
registers are the keys by which documents meet; for them an empty
register borrows from another one by a fixed rule, so that a band of a
short text is as selective as one of a long text.

Equal sets are one class from the start.  In each bucket of a band every
class meets the least one; what meets is filtered by the estimated
Jaccard similarity, corrected for registers that collide by chance, with
a margin of five standard deviations, then confirmed on the full sets.
Links give components.  Then, in buckets that still hold classes of
different components, all such pairs are estimated from their registers
alone.  Texts are fetched just for classes with a pair that passes; those
pairs are confirmed too, until a link joins their components.  So a bucket
costs pairs only where it isn't one component, and none is cut short.
Large buckets are cut into blocks, of which any two meet in one task: of
``BLOCK_ROWS`` classes while registers are compared, and also of
``BLOCK_CHARS`` of text while texts are.  A row is copied once for each
block of its bucket, so shuffled rows grow in proportion to a bucket of up
to ``BLOCK_ROWS`` classes, and with a factor of size / ``BLOCK_ROWS``
beyond; comparisons of registers in such a bucket are its square.

At the threshold a pair misses all bands with a probability under 1e-5.

Edge cases: null texts and texts without a word have no shingle, are
linked with nothing and are their own component; repeated rows have
equal sets; a null id takes part, but the least non-null id names a
component; rows that share an id but not a text are separate; an empty
table gives no rows; very long texts are read whole; other columns of the
input are ignored, and ``deduplicate`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, given_back, map_slices, texts_of
from .components import components

SHINGLE = 5
WIDTH = 5
BANDS = 44
BUCKETS = WIDTH * BANDS
MANTISSA = 10
#: Bits of a hash beside its bucket.
TAIL = 48
#: Pairs of one class that are confirmed in one group.
CHUNK = 256
#: Classes of a bucket in one block, and characters of their texts.
BLOCK_ROWS, BLOCK_CHARS = 8192, 32 << 20
#: Registers that are compared at once.
HELD = 1 << 22
LINK = (75, 100)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    # bytes.lower touches A to Z alone, bytes.split knows just the six ASCII blanks.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, SHINGLE)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc = (acc ^ hashed[k : n - width + 1 + k]) * PRIME
        acc ^= acc >> np.uint64(29)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def registers(found: np.ndarray) -> np.ndarray:
    """One 16-bit register a bucket: 0 if empty, else 1 + leading zeros and mantissa."""
    out = np.zeros(BUCKETS, "<u2")
    if not len(found):
        return out
    h = mixed(found)
    keys = ((h >> np.uint64(TAIL)) * np.uint64(BUCKETS) >> np.uint64(16) << np.uint64(TAIL)) | (h & np.uint64((1 << TAIL) - 1))
    keys.sort()
    bucket = (keys >> np.uint64(TAIL)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    least = (keys[first] & np.uint64((1 << TAIL) - 1)).astype(np.int64)
    zeros = TAIL - np.frexp(least.astype(np.float64))[1]  # exact, as TAIL is under 53
    mantissa = ((least << (zeros + 1)) & ((1 << TAIL) - 1)) >> (TAIL - MANTISSA)
    out[bucket[first]] = 1 + (np.minimum(zeros, 62) << MANTISSA) + np.where(least == 0, 0, mantissa)
    return out


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The probability that unrelated registers agree, by the sizes of the two sets."""
    total = np.zeros(np.broadcast(n_a, n_b).shape)
    for z in range(24):
        p, q = ((1 - 2.0 ** -(z + 1)) ** (n / BUCKETS) - (1 - 2.0**-z) ** (n / BUCKETS) * (z > 0) for n in (n_a, n_b))
        total += p * q
    return total / 2**MANTISSA


def may_link(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the estimated similarity of register rows is no further below the threshold than chance explains."""
    used = np.maximum(((a != 0) | (b != 0)).sum(-1), 1)
    share = ((a == b) & (a != 0)).sum(-1) / used
    goal = LINK[0] / LINK[1]
    least = goal - 5 * np.sqrt(goal * (1 - goal) / used)
    passed = share >= least  # the correction only lowers a share
    at = np.nonzero(passed)
    n_a, n_b = np.broadcast_to(n_a, passed.shape)[at].astype(float), np.broadcast_to(n_b, passed.shape)[at].astype(float)
    random = chance(n_a, n_b)
    passed[at] = (share[at] - random) / (1 - random) >= least[at]
    return passed


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark -> doc_id, mark, n_shingles, n_chars, set_id (16 bytes, null without a shingle) and registers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sizes, ids, kept = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text)
            n.append(len(found))
            sizes.append(len(text))
            ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            kept.append(registers(found).tobytes() if len(found) else None)
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(kept, pa.binary())]
        return pa.record_batch(columns, ["doc_id", "mark", "n_shingles", "n_chars", "set_id", "registers"])

    return map_slices(docs, work, "doc_id long, mark long, n_shingles long, n_chars long, set_id binary, registers binary")


def lenders() -> np.ndarray:
    """For each register the others from which it borrows when it is empty, in order."""
    return np.stack([np.random.default_rng(k).permutation(BUCKETS) for k in range(BUCKETS)])


LENDERS = lenders()


def band_keys(rows: np.ndarray) -> np.ndarray:
    """The key of each band of register rows; rows have at least one register in use."""
    full = rows.copy()
    for turn in range(BUCKETS):
        empty = full == 0
        if not empty.any():
            break
        full = np.where(empty, rows[:, LENDERS[:, turn]], full)
    full = full.reshape(len(rows), BANDS, WIDTH)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), full.shape[:2]).copy()
    for k in range(WIDTH):
        keys = mixed(keys * PRIME + full[:, :, k])
    return keys.view(np.int64)


def bands(classes: DataFrame) -> DataFrame:
    """rep, registers -> key, rep: a row for each band."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(ids), BUCKETS))
        return pa.record_batch([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, BANDS))], ["key", "rep"])

    return map_slices(classes.select("rep", "registers"), work, "key long, rep long")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose registers may link."""

    def side(x: str) -> DataFrame:
        return classes.select(F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = {x: np.frombuffer(b"".join(batch.column(f"r{x}").to_pylist()), "<u2").reshape(batch.num_rows, BUCKETS) for x in "ab"}
        n = {x: batch.column(f"n{x}").to_numpy() for x in "ab"}
        return batch.select(["a", "b"]).filter(pa.array(may_link(r["a"], n["a"], r["b"], n["b"])))

    return map_slices(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "ra", "na", "b", "rb", "nb"), work, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by their first columns; a group may run over batches."""
    from itertools import groupby

    rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in list(r)[:keys]))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets link.  texts: rep, text.

    A group holds one text a and up to about CHUNK others, which stream by.
    """
    n = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    pairs = pairs.join(n, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    others = pairs.join(texts.select(F.col("rep").alias("b"), "text"), "b").select("a", "chunk", "b", "text")
    heads = pairs.select("a", "chunk").distinct().join(texts.select(F.col("rep").alias("a"), "text"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for (a, _), group in grouped(batches, 2):
            own = shingles(next(group)["text"])
            for row in group:
                if similar(own, shingles(row["text"])):
                    links.append((a, row["b"]))
            if len(links) >= 4096:
                yield _pairs(links)
                links = []
        if links:
            yield _pairs(links)

    return rows.mapInArrow(given_back(run), "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, from batches in which they follow one another; a group may run over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if held and last != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if begin:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(begin, end - begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blocks(rows: DataFrame) -> DataFrame:
    """key, blocks, rep, ... -> the same with lo, hi and own, a row for each block of the bucket: any two blocks meet in one group."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")


class Group:
    """Classes of a bucket that meet in one task; ``component`` numbers their components."""

    def __init__(self, table: pa.Table):
        self.key, self.whole = table["key"][0].as_py(), table["lo"][0].as_py() == table["hi"][0].as_py()
        self.rep, self.own, self.n = (table[c].to_numpy() for c in ("rep", "own", "n_shingles"))
        self.component = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        self.registers = np.frombuffer(b"".join(table["registers"].to_pylist()), "<u2").reshape(len(self.rep), BUCKETS)
        self._keys = None

    def pairs(self, roots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components that pass the estimate and share no earlier band than this bucket's, a few rows at a time."""
        of = self.component if roots is None else roots
        step = max(1, HELD // (len(self.rep) * BUCKETS))
        for at in range(0, len(self.rep), step):
            own = np.arange(at, min(at + step, len(self.rep)))
            fits = (of[own][:, None] != of) & (own[:, None] < np.arange(len(self.rep))) & (self.whole | (self.own[own][:, None] != self.own))
            if not fits.any():
                continue
            fits &= may_link(self.registers[own][:, None], self.n[own][:, None], self.registers[None], self.n[None])
            a, b = np.nonzero(fits)
            if len(a):
                if self._keys is None:
                    self._keys = band_keys(self.registers)
                a = own[a]
                first = np.concatenate([(self._keys[x] == self._keys[y]).argmax(1) for x, y in zip(np.array_split(a, 1 + len(a) // 4096), np.array_split(b, 1 + len(a) // 4096))])
                mine = self._keys[a, first] == self.key
                yield a[mine], b[mine]


def open_classes(rows: DataFrame) -> DataFrame:
    """key, blocks, rep, component, n_shingles, n_chars, registers -> key, rep, component and n_chars of the classes that have a pair to confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "lo", "hi"]):
            group, found = Group(table), np.zeros(table.num_rows, bool)
            for a, b in group.pairs():
                found[a] = found[b] = True
            if found.any():
                yield from table.select(["key", "rep", "component", "n_chars"]).filter(pa.array(found)).to_batches()

    return blocks(rows).mapInArrow(given_back(run), "key long, rep long, component long, n_chars long").distinct()


def across(rows: DataFrame) -> DataFrame:
    """key, blocks, rep, component, n_shingles, registers, text -> links a, b between different components.

    For each two components of a group that are linked there it holds at
    least a path of links: pairs are confirmed on their full sets, row by
    row and likeliest first; those whose components a link has joined by
    then need no test.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "lo", "hi"]):
            if links := joined(Group(table), table["text"]):
                yield _pairs(links)

    return blocks(rows).mapInArrow(given_back(run), "a long, b long")


def joined(group: Group, texts: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Links between the components of one group."""
    parent = list(range(len(group.rep)))
    sets: dict[int, np.ndarray] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(texts[k].as_py())
        return sets[k]

    links: list[tuple[int, int]] = []
    for a, b in group.pairs():
        order = np.lexsort((-(group.registers[a] == group.registers[b]).sum(1), a))
        for one, other in zip(a[order].tolist(), b[order].tolist()):
            x, y = root(int(group.component[one])), root(int(group.component[other]))
            if x != y and similar(set_of(one), set_of(other)):
                parent[max(x, y)] = min(x, y)
                links.append((int(group.rep[one]), int(group.rep[other])))
    return links


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return LINK[1] * shared >= LINK[0] * (len(a) + len(b) - shared)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; a table of the shared folder."""
    rows = linked(docs, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component (a number, null without a shingle) and component_id of each row."""
    spark = docs.sparkSession
    scratch, result = Scratch(spark, "near"), Scratch(spark, "near-result")
    try:
        return result.put(_linked(texts_of(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")), scratch), "links")
    finally:
        scratch.drop()


def _linked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    sketches = scratch.put(sketch(docs), "sketches")
    # Classes are numbered, as ids may be null or repeat.  The numbers are written once, so they hold.
    first = [F.first(c).alias(c) for c in ("n_shingles", "n_chars", "registers")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("x")
    classes = sketches.where("n_shingles > 0").groupBy("set_id").agg(least, *first)
    classes = scratch.put(classes.select(F.monotonically_increasing_id().alias("rep"), "set_id", F.col("x.doc_id").alias("first_id"), F.col("x.mark").alias("first_mark"), "n_shingles", "n_chars", "registers"), "classes")

    banded = scratch.put(bands(classes), "bands")
    buckets = scratch.put(banded.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "buckets")
    shared = scratch.put(banded.join(buckets, "key"), "shared")
    scratch.drop("bands")

    # Texts of classes that meet another one, one row of each class.
    ids = shared.select("rep").distinct()
    wanted = classes.join(ids, "rep", "left_semi").select("first_id", "first_mark", "set_id", "rep", "n_shingles", "registers")
    texts = scratch.put(one_text(docs, wanted), "texts")

    met = scratch.put(estimated(shared.where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), classes), "met")
    confirmed_ = scratch.put(confirmed(met, texts), "first")
    part = scratch.put(components(confirmed_, scratch, "c1"), "part")

    placed = shared.join(part.withColumnRenamed("vertex", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = scratch.put(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y")
    open_keys = scratch.put(open_keys.select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), "open")
    meeting = placed.join(open_keys, "key").join(classes.select("rep", "n_shingles", "n_chars", "registers"), "rep")
    chosen = scratch.put(open_classes(meeting.select("key", "blocks", "rep", "component", "n_shingles", "n_chars", "registers")), "chosen")
    sizes = chosen.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_chars") / BLOCK_CHARS)).alias("blocks"))
    rest = chosen.join(sizes, "key").join(texts, "rep")
    second = scratch.put(across(rest.select("key", "blocks", "rep", "component", "n_shingles", "registers", "text")), "second")
    every = components(confirmed_.unionByName(second), scratch, "c2")

    # A component is named by its least document, not by its least class.
    named = classes.select("set_id", "rep", "first_id").join(every.withColumnRenamed("vertex", "rep"), "rep", "left")
    named = scratch.put(named.select("set_id", "first_id", F.coalesce("component", "rep").alias("component")), "named")
    least = scratch.put(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    of_set = scratch.put(named.join(least, "component").select("set_id", "component", "component_id"), "of_set")
    out = sketches.select("doc_id", "mark", "n_shingles", "set_id").join(of_set, "set_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "mark", "n_shingles", "component", own.alias("component_id"))


def one_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, text, n_shingles, registers: each class with the text of its first document.

    Documents are met by id and a hash of the text, so classes of one id,
    or of none, don't meet each other's documents; the set confirms it.
    """
    same_row = docs["doc_id"].eqNullSafe(wanted["first_id"]) & (docs["mark"] == wanted["first_mark"])
    joined = docs.join(wanted, same_row).select("rep", "text", "set_id", "n_shingles", "registers")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        same = [hashlib.blake2b(shingles(t).tobytes(), digest_size=16).digest() == s for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return batch.select(["rep", "text", "n_shingles", "registers"]).filter(pa.array(same))

    return map_slices(joined, work, "rep long, text string, n_shingles long, registers binary").dropDuplicates(["rep"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that with the least id, of equal ids that whose text hashes lowest.

    A row without an id stays only where its component has no other one.
    Of repeated rows (of one id and text) any one stays.  Rows without a
    word are linked with nothing, so all of them stay.
    """
    rows = linked(docs, id_col, text_col).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    first = rows.groupBy("component").agg(F.min(order).alias("x"))
    keys = fresh(docs, "id", "unnamed", "mark")
    named = [F.coalesce(F.col("x.doc_id"), F.lit(0)), F.col("x.unnamed"), F.col("x.mark")]
    chosen = first.select(*(c.alias(k) for c, k in zip(named, keys)))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    worded = F.coalesce(F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    # Repeated rows go before the join, as partial sums keep a hot one from filling a task.
    single = docs.where(worded).withColumns(dict(zip(keys, own))).dropDuplicates(keys)
    return single.join(chosen, keys, "left_semi").select(*docs.columns).unionByName(docs.where(~worded))
