"""What the operators share: table access, scratch tables, Arrow mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow mapping holds as Python objects at once.
SLICE_ROWS = 256
#: Bytes of text after which a slice ends early.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is missing (tests, a laptop), a folder of this
    machine is set for this session, which is then in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shoebox-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python holds few rows and few bytes at a time."""
    for batch in batches:
        n, at = batch.num_rows, 0
        sizes = None
        if n > 1 and batch.column(column).nbytes > SLICE_BYTES:
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while at < n:
            end = min(n, at + SLICE_ROWS)
            if sizes is not None:
                held, k = sizes[at], at + 1
                while k < end and held + sizes[k] <= SLICE_BYTES:
                    held += sizes[k]
                    k += 1
                end = k
            yield batch.slice(at, end - at)
            at = end


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives the memory that it no longer uses back to the machine: the next task's stage may need other workers beside it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return whole


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over slices; ``work`` may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = work(part)
            if out is not None:
                yield out

    return df.mapInArrow(given_back(run), schema)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; a null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the frame has, whatever their case."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        out.append(name)
        known.add(name.lower())
    return out
