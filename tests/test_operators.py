"""Hand-computed cases of scalars and operators."""

import base64

import pytest
from pyspark.sql import functions as F

from shoebox.functions import paths, scalars
from shoebox.operators import classify, dedup, index, people, scoring
from shoebox.sources import fixtures
from shoebox.plans.config import EngineConfig, normal_scope, page_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_settings_are_clamped():
    c = EngineConfig(ml_retries=9, people_min_similarity=0.1, exif_read_bytes=1)
    assert (c.ml_retries, c.people_min_similarity, c.exif_read_bytes) == (3, 0.5, 256 << 10)
    assert page_of(999, -20) == (200, 0) and page_of(0, 5) == (1, 5)
    assert [normal_scope(x) for x in ("photos", "Photos", None, "x")] == ["photos", "all", "all", "all"]


@pytest.mark.parametrize("text,value", [("50/1", 50.0), ("1/0", None), (" 3.5 ", 3.5), ("x", None), ("", None), ("1e1", 10.0), ("7/2/3", 3.5)])
def test_exif_numbers(spark, text, value):
    assert one(spark, scalars.exif_number(F.lit(text))) == value


def test_focal_length(spark):
    cases = [(None, "50/1", 50.0), ("28", "50/1", 28.0), ("0", "0/0", None), (None, "85", 85.0), (None, None, None), ("", "10/4", 2.5)]
    df = spark.createDataFrame(cases, "a string, b string, x double")
    assert all(r.y == r.x for r in df.select("x", scalars.focal_length(F.col("a"), F.col("b")).alias("y")).collect())


def test_embedding_round_trip(spark):
    raw = bytes([127, 0, 129, 5])
    text = "emb:v1:" + base64.urlsafe_b64encode(raw).decode().rstrip("=")
    assert one(spark, scalars.signature_bytes(F.lit(f" {text}\n"))) == [127, 0, -127, 5]
    for bad in ("emb:v1:", "emb:v1:!!!!", "emb:v2:AAAA", "", "emb:v1:A"):
        assert one(spark, scalars.embedding(F.lit(bad))) is None
    assert one(spark, scalars.embedding(F.lit("emb:v1:AAAA"))) is None  # zero vector
    encoded = one(spark, scalars.encode_signature(F.array(*map(F.lit, (3.0, 0.0, -4.0)))))
    assert one(spark, scalars.signature_bytes(F.lit(encoded))) == [76, 0, -102]
    long = one(spark, scalars.encode_signature(F.sequence(F.lit(1), F.lit(5)).cast("array<double>"), 2))
    assert one(spark, scalars.signature_bytes(F.lit(long))) == [52, 116]  # means 2 and 4.5


def test_long_signatures_are_hashed(spark):
    assert one(spark, scalars.stored_signature(F.lit("a" * 191))) == "a" * 191
    assert one(spark, scalars.stored_signature(F.lit("a" * 192))).startswith("sig:v1:")


def test_other_scalars(spark):
    assert one(spark, scalars.hex_distance(F.lit("ff00"), F.lit(" FE01"))) == 2
    assert one(spark, scalars.hex_distance(F.lit("f"), F.lit("ff"))) is None
    assert one(spark, scalars.gps(F.array(*map(F.lit, ("1", "30", "0"))), F.lit("s"), F.array(*map(F.lit, ("2", "0", "0"))), F.lit("E"))).asDict() == {"lat": -1.5, "lng": 2.0}
    assert one(spark, scalars.size_text(F.lit(1536))) == "1.5 KB" and one(spark, scalars.size_text(F.lit(0))) == "0 B"
    assert one(spark, scalars.flat_tags(F.array(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))))) == {"a": "2", "b": "3"}
    assert one(spark, scalars.stale(F.lit(""), F.current_timestamp())) is True
    assert one(spark, scalars.face_confidence(F.struct(F.lit(10).alias("w"), F.lit(10).alias("h")), F.lit(1), F.lit(0.9), F.lit(100), F.lit(100))) == 0.702
    assert one(spark, paths.free_name(F.lit("a.jpg"), F.array(F.lit("a.jpg"), F.lit("a_1.jpg")), F.lit(5))) == "a_2.jpg"
    assert one(spark, paths.free_name(F.lit("b"), F.array(F.lit("a")), F.lit(5))) == "b"
    assert [one(spark, paths.visible(F.lit(p))) for p in ("a/.trash/b", ".thumbnails/x", "a/.trashy/b")] == [False, False, True]
    assert [one(spark, paths.safe_target(F.lit(p))) for p in ("../etc", "/x", "Photos/Nature/", "a\\b")] == [None, None, "Photos/Nature", "a/b"]


INDEX = "user_id string, file_id long, file_path string, file_size long, mime_type string, content_hash string, file_mtime long"


def test_last_copy_is_kept(spark):
    files = spark.createDataFrame([("u", k, "p", 10, "image/jpeg", "a" * 64 if k < 4 else "b" * 64, k) for k in range(1, 5)], INDEX)
    asked = spark.createDataFrame([("u", 3, 0), ("u", 3, 1), ("u", 1, 2), ("u", 2, 3), ("u", 4, 4), ("u", 9, 5)], "user_id string, file_id long, pos long")
    got = {r.pos: r.outcome for r in dedup.deletion_plan(files, asked).collect()}
    assert got == {0: "deleted", 1: "repeated", 2: "deleted", 3: "last_copy", 4: "last_copy", 5: "not_indexed"}
    with pytest.raises(ValueError):
        dedup.bulk_ids(list(range(1, 502)))
    assert dedup.bulk_ids(["1", 2, "3", -4]) == [1, 2, 3]
    assert dedup.group_detail(files, "x").count() == 0 and dedup.group_detail(files, "b" * 64).count() == 0


def test_faces_are_replaced_and_labels_set(spark):
    base = spark.createDataFrame([("u", 1, 1, "old", 0.1), ("u", 2, 1, "other", 0.2)], "user_id string, file_id long, face_index int, face_signature string, face_confidence double")
    new = spark.createDataFrame([("u", 1, [(" ", 0.5), ("s1", 0.6), ("s2", 0.7)])], "user_id string, file_id long, signatures array<struct<signature:string,confidence:double>>")
    got = sorted((r.file_id, r.face_index, r.face_signature) for r in index.replaced_faces(base, new).collect())
    assert got == [(1, 1, "s1"), (1, 2, "s2"), (2, 1, "other")]
    labels = spark.createDataFrame([("u", "s1", "Ann", 1), ("u", "s2", "Bob", 1)], "user_id string, face_signature string, label_name string, updated_at long")
    changes = spark.createDataFrame([("u", " s1 ", " ", 2), ("u", "s3", " Cid ", 2), ("u", "", "x", 2)], labels.schema)
    assert sorted((r.face_signature, r.label_name) for r in index.set_labels(labels, changes).collect()) == [("s2", "Bob"), ("s3", "Cid")]


@pytest.mark.parametrize("raw,expected", [(None, ("idle", 0, 0)), ("", ("idle", 0, 0)), ("{bad-json", ("idle", 0, 0)), ('{"status":"scanning","total":-4,"processed":3}', ("scanning", 0, 3))])
def test_progress(spark, raw, expected):
    p = one(spark, index.progress(F.lit(raw).cast("string")))
    assert (p.status, p.total, p.processed) == expected


def test_prompts_and_worker_answers(spark):
    known = spark.createDataFrame([("cat", " A ", 0), ("cat", "a", 1), ("cat", "b", 2)], "category string, prompt string, pos int")
    wanted = spark.createDataFrame([("cat", 0), ("dog", 1)], "label string, pos int")
    assert sorted((r.category, r.prompt) for r in classify.prompts_of(wanted, known).collect()) == [("cat", "a"), ("cat", "b"), ("dog", "dog")]
    files = spark.createDataFrame([("u", k, 1000 + k, "image/jpeg") for k in range(20)], "user_id string, file_id long, file_size long, mime_type string")
    got = scoring.answers(scoring.eligible(files), fixtures.StubScorer()).collect()
    assert len(got) == 20 and {r.category for r in got} == set(classify.CATEGORIES)
    faces = one(spark, scoring.parsed_faces(F.lit('{"faces":[{"signature":"a","confidence":0.2},{"signature":"b","confidence":0.9}]}')))
    assert [f.signature for f in faces] == ["b"]
    assert [f.signature for f in one(spark, scoring.parsed_faces(F.lit('{"signature":"z","confidence":0.5}')))] == ["z"]


def test_scope_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("Photos/a",), ("PhotosArchive/b",)], "file_path string").write.parquet(str(tmp_path / "t"))
    df = paths.scoped(spark.read.parquet(str(tmp_path / "t")), "photos")
    assert df.count() == 1
    assert "StringStartsWith(file_path,Photos/)" in df._jdf.queryExecution().executedPlan().toString()


def test_image_headers(spark, tmp_path):
    import struct

    from shoebox.sources import files

    ifd = struct.pack("<HHHI4s", 2, 0x010F, 2, 4, b"Cam\0") + struct.pack("<HHII", 0x9209, 3, 1, 1) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd
    app1 = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + bytes(10) + b"\xff\xda\0\2"
    (tmp_path / ".trash").mkdir()
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 7, 9))
    (tmp_path / ".trash/c.jpg").write_bytes(jpeg)
    (tmp_path / "d.txt").write_bytes(b"abc")
    found = files.binary_files(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.image_headers(found).collect()}
    assert (rows["a.jpg"].width, rows["a.jpg"].height, rows["a.jpg"].make, rows["a.jpg"].flash) == (40, 30, "Cam", 1)
    assert (rows["b.png"].width, rows["b.png"].height, rows["d.txt"].width) == (7, 9, 0)
    listed = files.listing(found, F.lit(f"file:{tmp_path}"), F.lit("u"))
    assert sorted(r.file_path for r in listed.collect()) == ["a.jpg", "b.png", "d.txt"]
    hashes = {r.path.rsplit("/", 1)[1]: r.content_hash for r in files.hashed(found).collect()}
    assert hashes["d.txt"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_usable_references(spark):
    faces = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 2, "c"), ("u", 3, " ")], "user_id string, file_id long, face_signature string")
    assert [r.file_id for r in people.usable_as_reference(faces).collect()] == [1]


def test_a_failed_file_is_asked_again_by_itself(spark):
    """Only failing files are asked again, and what comes after the breaker opened is dropped, as by the window over the log."""
    import pandas as pd

    class Logged(fixtures.StubScorer):
        def __init__(self, statuses):
            self.statuses, self.asked = statuses, []

        def score(self, files):
            out = super().score(files)
            self.asked.append(out["file_id"].tolist())
            out["status"] = [self.statuses[k] for k in out["file_id"]]
            return out

    def answered(statuses, batches):
        """file ids of good answers of one task, and what the scorer was asked."""
        scorer = Logged(statuses)
        found = []

        class Frame:
            def mapInPandas(self, run, _):
                rows = [pd.DataFrame({"user_id": "u", "file_id": b, "file_size": 1}) for b in batches]
                for part in run(iter(rows)):
                    found.extend(part["file_id"])

        scoring.asked(Frame(), scorer, scoring.ANSWER)
        return found, scorer.asked

    assert answered({1: 200, 2: 503, 3: 422}, [[1, 2, 3]]) == ([1], [[1, 2, 3], [2, 3]])
    for statuses in ([503, 200] + [500] * 5 + [200, 200], [429] * 6 + [200], [429] * 4 + [503, 200], [0, 401, 422, 403, 404, 500, 200], [500] * 4 + [200] + [500] * 4 + [200]):
        log = [(0, n, s) for n, s in enumerate(statuses)]
        out = scoring.breaker(spark.createDataFrame(log, "run_id int, seq int, status int")).collect()
        expected = [r.seq for r in sorted(out, key=lambda r: r.seq) if r.asked and 200 <= r.status < 300]
        for size in (1, 3, 20):
            ids = list(range(len(statuses)))
            assert answered(dict(enumerate(statuses)), [ids[k : k + size] for k in range(0, len(ids), size)])[0] == expected


def test_moves_find_free_names(spark):
    listing = spark.createDataFrame([("u", k, p) for k, p in enumerate(["A/x.jpg", "B/x.jpg", "B/x_1.jpg", "C/x.jpg", "C/x_1.jpg", "D/n", "B/y.tar.gz"])], "user_id string, file_id long, file_path string")
    asked = spark.createDataFrame([("u", 0, 1, "/B/"), ("u", 3, 2, "B"), ("u", 4, 3, "B"), ("u", 5, 4, "new\\deep"), ("u", 6, 5, "A/.."), ("u", 99, 6, "B"), ("u", 6, 7, "E")], "user_id string, file_id long, pos long, target string")
    from shoebox.operators import actions

    got = {r.pos: (r.outcome, r.new_path) for r in actions.move_plan(listing, asked, F.lit(5)).collect()}
    assert got[1] == ("moved", "B/x_2.jpg") and got[2] == ("moved", "B/x_3.jpg") and got[3] == ("moved", "B/x_1_1.jpg")
    assert got[4] == ("moved", "new/deep/n") and got[5] == ("invalid_target", None) and got[6] == ("not_found", None) and got[7] == ("moved", "E/y.tar.gz")


def test_moves_number_more_files_than_four_digits(spark):
    """Names like one another go on beyond _9999, past those that are held."""
    from shoebox.operators import actions

    n = 10_020
    held = {"B/x.jpg": 0, "B/x_3.jpg": 3, "B/x_9999.jpg": 9999, "B/x_10004.jpg": 10_004, "B/x_20240101123456789.jpg": 20240101123456789}
    listing = spark.range(n).select(F.lit("u").alias("user_id"), F.col("id").alias("file_id"), F.concat(F.lit("A"), F.col("id").cast("string"), F.lit("/x.jpg")).alias("file_path"))
    listing = listing.unionByName(spark.createDataFrame([("u", -k - 1, p) for k, p in enumerate(held)], listing.schema))
    asked = spark.range(n).select(F.lit("u").alias("user_id"), F.col("id").alias("file_id"), F.col("id").alias("pos"), F.lit("B").alias("target"))
    free = [k for k in range(n + len(held)) if k not in held.values()][:n]
    got = actions.move_plan(listing, asked, F.lit(5)).orderBy("pos").collect()
    assert [r.new_path for r in got] == [f"B/x_{k}.jpg" for k in free]
    got = actions.move_plan(listing, asked, F.lit(5), most_suffix=9999).orderBy("pos").collect()
    assert [r.new_path for r in got] == [f"B/x_{k}.jpg" if k <= 9999 else f"B/x_5_{turn}.jpg" for turn, k in enumerate(free, 1)]


def test_zero_counts_and_capped_copies(spark):
    rows = spark.createDataFrame([("meme",), ("meme",)], "category string")
    assert [(r.category, r["count"], r.total) for r in classify.all_counts(rows).orderBy("ord").collect()] == [(c, 2 if c == "meme" else 0, 2) for c in classify.CATEGORIES]
    from shoebox.sources import files

    found = spark.createDataFrame([("a", bytearray(b"abc"), 3), ("b", bytearray(b"abcd"), 4)], "path string, content binary, length long")
    assert sorted((r.path, r.outcome, r.content_hash is None) for r in files.capped(found, 3).collect()) == [("a", "done", False), ("b", "error", True)]
