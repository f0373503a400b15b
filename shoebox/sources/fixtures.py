"""The index tables, made from the synthetic corpus by deterministic expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FILE_INDEX = """
SELECT lang AS user_id, doc_id AS file_id,
  CASE WHEN doc_id % 50 = 7 THEN 'Photos' ELSE
    CASE doc_id % 5 WHEN 0 THEN 'Photos/' WHEN 1 THEN 'photos/' WHEN 2 THEN 'Documents/' WHEN 3 THEN 'PhotosArchive/' ELSE 'Camera/Photos/' END
    || source || '/' || CAST(doc_id AS STRING) || '.jpg' END AS file_path,
  CAST({octets}(text) AS BIGINT) AS file_size, {hash} AS content_hash,
  CASE WHEN doc_id % 10 < 6 THEN 'image/jpeg' WHEN doc_id % 10 < 8 THEN 'image/png' WHEN doc_id % 10 = 8 THEN 'image/webp' ELSE 'text/plain' END AS mime_type,
  1700000000 + (doc_id * 7919) % 1000003 AS file_mtime
FROM documents"""

PHOTO_ATTRS = """
SELECT doc_id AS file_id, lang AS user_id, CAST(n_chars * 400 AS BIGINT) AS file_size,
  CASE doc_id % 7 WHEN 0 THEN 'screenshot_1.png' WHEN 1 THEN 'IMG_2041.jpg' WHEN 2 THEN 'DSC_001.jpg' WHEN 3 THEN 'meme_12.jpg'
    WHEN 4 THEN 'IMG-20240101-WA0001.jpg' WHEN 5 THEN 'a1b2c3d4e5.jpg' ELSE 'thing.jpg' END AS file_name,
  CASE WHEN doc_id % 23 < 14 THEN 'image/jpeg' WHEN doc_id % 23 < 19 THEN 'image/png' ELSE 'image/webp' END AS mime_type,
  CASE doc_id % 6 WHEN 0 THEN 1920 WHEN 1 THEN 1080 WHEN 2 THEN 4000 WHEN 3 THEN 3000 WHEN 4 THEN 2000 ELSE 0 END AS width,
  CASE doc_id % 6 WHEN 0 THEN 1080 WHEN 1 THEN 1080 WHEN 2 THEN 3000 WHEN 3 THEN 4000 WHEN 4 THEN 2000 ELSE 0 END AS height,
  CASE WHEN doc_id % 11 < 5 THEN 'Canon' END AS make, CAST(NULL AS STRING) AS model, doc_id % 17 < 6 AS has_gps,
  CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 0 END AS flash,
  CASE doc_id % 19 WHEN 0 THEN '28/1' WHEN 1 THEN '50/1' WHEN 2 THEN '85' WHEN 3 THEN '0/0' WHEN 4 THEN '24' WHEN 5 THEN '35/1' END AS focal_length,
  CAST(NULL AS STRING) AS focal_35mm, CASE WHEN doc_id % 13 < 6 THEN '2024:01:01 00:00:00' END AS date_original
FROM documents"""

LOCATIONS = """
SELECT concat('u', CAST(user_id % 4 AS STRING)) AS user_id, event_id AS file_id, event_id % 5 <> 0 AS has_location,
  CASE WHEN event_id % 11 <> 0 THEN CAST((user_id % 20) * 8 - 85 AS DOUBLE) + CAST(0.12341 AS DOUBLE) + CAST(0.00003 AS DOUBLE) * (event_id % 3) END AS lat,
  CASE WHEN event_id % 11 <> 0 THEN CAST((user_id % 20) * 16 - 170 AS DOUBLE) + CAST(0.54321 AS DOUBLE) + CAST(0.00003 AS DOUBLE) * (event_id % 2) END AS lng
FROM events"""

FILE_EVENTS = """
SELECT CAST(user_id AS STRING) AS user_id, CAST({k} AS BIGINT) AS file_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'renamed' WHEN 'error' THEN 'deleted' ELSE 'written' END AS op,
  'Photos/' || CAST(event_id AS STRING) || '.jpg' AS file_path, CAST(floor(value * 100) AS BIGINT) AS file_size,
  CASE WHEN event_id % 13 = 0 THEN 'text/plain' ELSE 'image/jpeg' END AS mime_type, CAST(event_id AS STRING) AS content_hash, event_id AS file_mtime
FROM events"""

FACES = """
SELECT CASE WHEN (vec_id - vec_id % 4) % 8 = 0 THEN 'alice' ELSE 'bob' END AS user_id,
  CASE WHEN vec_id % 4 = 3 THEN vec_id - 1 ELSE vec_id END AS file_id, CASE WHEN vec_id % 4 = 3 THEN 2 ELSE 1 END AS face_index, vec_id, label,
  CAST(vec_id % 97 AS DOUBLE) / 100 AS face_confidence, 1000 + vec_id % 7 AS file_size, 'Photos/' || CAST(vec_id - CASE WHEN vec_id % 4 = 3 THEN 1 ELSE 0 END AS STRING) || '.jpg' AS file_path,
  {vector} AS raw
FROM embeddings"""

# 1.5 is added to the coordinate of the label, so that labels mean something.
SPARK_VECTOR = "transform(embedding, (x, i) -> CAST(x AS DOUBLE) + CASE WHEN i = label THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
DUCK_VECTOR = "[CAST(embedding[i] AS DOUBLE) + CASE WHEN i - 1 = label THEN 1.5::DOUBLE ELSE 0::DOUBLE END FOR i IN range(1, 65)]"


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    views(spark, sf_dir, source)
    return spark.sql(sql)


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, FILE_INDEX.format(octets="octet_length", hash="sha2(text, 256)"), "documents")


def photo_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PHOTO_ATTRS, "documents")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, LOCATIONS, "events")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, FILE_EVENTS.format(k="get_json_object(props, '$.k')"), "events")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with signatures that the engine encodes itself."""
    from shoebox.functions.scalars import encode_signature

    rows = table(spark, sf_dir, FACES.format(vector=SPARK_VECTOR), "embeddings")
    from pyspark.sql import functions as F

    return rows.withColumn("face_signature", encode_signature(F.col("raw"))).drop("raw")


def face_labels(faces: DataFrame) -> DataFrame:
    """Names of the three first single-face rows of each user and label, a name on a two-face file, and a blank one."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    single = faces.where("vec_id % 4 < 2")
    nth = F.row_number().over(Window.partitionBy("user_id", "label").orderBy("vec_id"))
    good = single.withColumn("n", nth).where("n <= 3").select(F.col("vec_id").alias("label_id"), "user_id", "face_signature", F.concat(F.lit("P"), F.col("label").cast("string")).alias("label_name"))
    pair = faces.where("vec_id = 2").select(F.lit(-1).cast("long").alias("label_id"), "user_id", "face_signature", F.lit("Nobody").alias("label_name"))
    blank = faces.where("vec_id = 9").select(F.lit(-2).cast("long").alias("label_id"), "user_id", "face_signature", F.lit("  ").alias("label_name"))
    return good.unionByName(pair).unionByName(blank)


# --- workers: the tables hold no pictures, so answers follow from a file's size and id ---


class StubScorer:
    """Answers by the file's size; a stand-in for a model."""

    def score(self, files: pd.DataFrame) -> pd.DataFrame:
        names = ("document", "meme", "nature", "family", "object")
        out = files[["user_id", "file_id"]].copy()
        out["status"] = 200
        out["category"] = [names[s % 5] for s in files["file_size"]]
        out["confidence"] = [(s % 100) / 100 for s in files["file_size"]]
        out["model"], out["algorithm_version"] = "stub", "1"
        out["labels"] = [[{"name": "size", "score": (s % 100) / 100}] for s in files["file_size"]]
        return out


class FlakyStub(StubScorer):
    """Fails for every third file when it is asked first, and rejects every seventh; a stand-in for a model."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def score(self, files: pd.DataFrame) -> pd.DataFrame:
        out = super().score(files)
        first = ~out["file_id"].isin(self.seen)
        out.loc[(out["file_id"] % 3 == 0) & first, "status"] = 503
        out.loc[out["file_id"] % 7 == 0, "status"] = 422
        self.seen |= set(out["file_id"])
        return out


class FaceStub:
    """Two faces by the file's size, the second one unsure for odd sizes; a stand-in for a model."""

    def score(self, files: pd.DataFrame) -> pd.DataFrame:
        out = files[["user_id", "file_id"]].copy()
        out["status"] = 200
        face = '{"signature":"%s","confidence":%s}'
        out["response"] = ['{"faces":[%s,%s]}' % (face % (f"a{s}", 0.9), face % (f"b{s}", 0.2 if s % 2 else 0.8)) for s in files["file_size"]]
        return out
