"""File systems and shared folders, as tasks and the driver see them."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The Arrow file system of a path as Spark spells it (blanks unescaped), and the path in it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file") or len(parts.scheme) == 1:
        return arrow_fs.LocalFileSystem(), path[len("file:") :].replace("///", "/", 1) if path.startswith("file:") else path
    root, at = arrow_fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    bare = path[len(f"{parts.scheme}://{parts.netloc}") :]
    return root, f"{at.rstrip('/')}{bare}" if at.strip("/") else bare.lstrip("/") if parts.scheme in ("s3", "gs", "gcs", "abfs", "abfss") else unquote(bare)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which the driver and all executors see.

    Where the setting is missing, a folder of this machine stands in, in
    local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shoebox-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table of the shared folder: worked out once, whatever reads them and whichever executors are lost."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
