"""Further queries: single operators over whole tables, each with its SQL in ``details_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import paths, scalars
from shoebox.operators import actions, classify, dedup, index, people, places, scoring, signatures
from shoebox.operators.snapshots import IndexTable
from shoebox.plans import config, schema
from shoebox.sources import files as sources
from shoebox.sources import fixtures, ranges, stores
from shoebox.streaming import events as upkeep
from shoebox.streaming import jobs, timers

from .catalogue import categories, index_before, indexed_of, listing_of, query, requests


def moment(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(1_700_000_000) + seconds)


def files_of(spark, sf_dir) -> DataFrame:
    return fixtures.file_index(spark, sf_dir)


# --- sources ---


@query
def listing_visible(spark, sf_dir):
    """Every file with a path inside some folder; hidden folders are skipped."""
    rows = files_of(spark, sf_dir)
    k = F.col("file_id") % 6
    head = F.when(k == 0, ".trash/").when(k == 1, "a/.versions/b/").when(k == 2, "x.thumbnails/").when(k == 3, "a/.thumbnails/").when(k == 4, ".trashed/").otherwise("")
    path = F.concat(head, F.col("file_path"))
    shown = rows.withColumn("file_path", path).where(paths.visible(F.col("file_path")))
    return shown.groupBy("user_id").agg(F.count("*").alias("files"), F.count_if(F.col("mime_type").isin(*paths.SUPPORTED)).alias("images"))


@query
def listing_types(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    k = F.col("file_id") % 9
    name = F.when(k == 0, "a.JPG").when(k == 1, "b.jpeg").when(k == 2, "c.d.png").when(k == 3, "e").when(k == 4, ".heic").when(k == 5, "f.tar.gz").when(k == 6, "g.CR2").when(k == 7, "x.y/h.svg").otherwise("i.webp")
    return rows.select("file_id", paths.mime_type(name).alias("mime_type"))


@query
def capped_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length"))
    return sources.capped(rows, 2000)


@query
def ranged_hashes(spark, sf_dir):
    """Texts stored as files, then read by ranges of 1000 bytes, most of them several; those over a cap aren't opened."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = stores.shared_folder(spark, "files")
    content = docs.select(F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    found = ranges.hashed(ranges.write_contents(content, folder), most=20_000, chunk=1000)
    number = F.regexp_extract("path", r"file (-?[0-9]+)\.txt$", 1).cast("long")
    return found.select(number.alias("file_id"), "length", "content_hash", "outcome")


@query
def header_sizes(spark, sf_dir):
    """Pictures with a header and a long tail, stored as files; only their first bytes are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    number = lambda x: F.lpad(F.hex(x), 8, "0")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(k % 5000), number(k * 31 % 7001)))
    content = F.when(k % 9 == 4, F.lit(b"GIF8")).otherwise(F.concat(header, F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    files = ranges.write_contents(docs.select(F.concat(k.cast("string"), F.lit(".png")).alias("name"), content.alias("content")), stores.shared_folder(spark, "pictures"))
    found = sources.image_headers(ranges.heads(files, 1024))
    return found.select(F.regexp_extract("path", r"(-?[0-9]+)\.png$", 1).cast("long").alias("file_id"), "width", "height")


def tags(spark, sf_dir) -> DataFrame:
    """Tags of a position for every event; some are missing."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    lat = F.array(F.concat(text(k % 90), F.lit("/1")), F.concat(text(k % 60 * 2), F.lit("/2")), F.concat(text(k % 600), F.lit("/10")))
    lng = F.array(text(k % 180), text(k % 60), F.when(k % 13 == 0, "1/0").otherwise(text(k % 60)))
    lat_ref = F.when(k % 5 == 0, " s ").when(k % 7 == 0, "").when(k % 11 == 0, F.lit(None)).otherwise("N")
    return rows.select(
        text(k).alias("path"), F.when(k % 17 != 0, lat).alias("lat"), lat_ref.alias("lat_ref"), lng.alias("lng"), F.when(k % 2 == 0, "W").otherwise("E").alias("lng_ref")
    )


@query
def tag_locations(spark, sf_dir):
    out = sources.header_locations(tags(spark, sf_dir))
    return out.select(F.col("path").cast("long").alias("file_id"), "has_location", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"))


@query
def tag_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    n = k.cast("string")
    text = F.when(k % 8 == 0, F.concat(n, F.lit("/4"))).when(k % 8 == 1, F.concat(n, F.lit("/0"))).when(k % 8 == 2, F.concat(F.lit(" "), n, F.lit(".5 "))).when(k % 8 == 3, F.concat(F.lit("x"), n)).when(k % 8 == 4, "").when(k % 8 == 5, F.concat(F.lit("-"), n)).when(k % 8 == 6, F.lit(None)).otherwise(F.concat(n, F.lit("e1")))
    return rows.select("event_id", scalars.exif_number(text).alias("number"))


@query
def tags_flattened(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    k, n = F.col("file_id"), F.col("file_id").cast("string")
    none = F.lit(None).cast("map<string,string>")
    sections = F.array(
        F.create_map(F.lit("make"), n, F.lit("flash"), F.lit("0")), F.when(k % 3 != 0, F.create_map(F.lit("flash"), F.lit("1"), F.lit("iso"), n)).otherwise(none), F.when(k % 4 == 0, F.create_map(F.lit("make"), F.lit("last"))).otherwise(F.create_map().cast("map<string,string>"))
    )
    flat = scalars.flat_tags(sections)
    return rows.select("file_id", flat["make"].alias("make"), flat["flash"].alias("flash"), F.try_element_at(flat, F.lit("iso")).alias("iso"), F.size(flat).cast("long").alias("tags"))


# --- settings ---


@query
def page_settings(spark, sf_dir):
    """What becomes of the limits, offsets and scopes that requests ask for."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    limit, offset = k * 7 % 500 - 100, k % 50 - 10
    scope = F.element_at(F.array(F.lit("photos"), F.lit("Photos"), F.lit("all"), F.lit("")), (k % 4 + 1).cast("int"))
    clamped = lambda x, bounds: F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), x)).cast("long")
    return rows.select(
        "event_id", clamped(limit, config.PAGE).alias("page_limit"), F.greatest(F.lit(0), offset).cast("long").alias("page_offset"), clamped(limit, config.CLUSTERS).alias("clusters"),
        clamped(limit, config.CANDIDATES).alias("candidates"), F.when(scope == config.normal_scope("photos"), scope).otherwise(config.normal_scope(None)).alias("scope"),
    )


@query
def eligible_files(spark, sf_dir):
    """Sizes are scaled so that both limits cut some."""
    rows = files_of(spark, sf_dir).withColumn("file_size", F.when(F.col("file_id") % 19 == 0, 0).otherwise(F.col("file_size") * 4096))
    rows = rows.withColumn("mime_type", F.when(F.col("file_id") % 8 == 0, "image/tiff").when(F.col("file_id") % 8 == 1, "image/heic").otherwise(F.col("mime_type")))
    one = lambda df, name: df.select("file_id", F.lit(name).alias("worker"))
    return one(scoring.eligible(rows), "categories").unionByName(one(scoring.eligible_faces(rows), "faces"))


# --- progress ---


def stored(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    n = k.cast("string")
    at = scalars.atom_time(moment(k % 400))
    whole = F.concat(F.lit('{"status":"scanning","total":'), n, F.lit(',"processed":'), (k - k % 3).cast("string"), F.lit(',"updated_at":"'), at, F.lit('"}'))
    raw = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, "").when(k % 6 == 2, "{bad").when(k % 6 == 3, '{"status":"completed","total":-4,"processed":2}').otherwise(whole)
    return rows.select("event_id", raw.alias("raw"))


@query
def progress_read(spark, sf_dir):
    rows = stored(spark, sf_dir).withColumns({"p": index.progress(F.col("raw")), "q": index.progress(F.col("raw"), from_zero=False)})
    return rows.select("event_id", "p.status", "p.total", "p.processed", F.col("q.total").alias("raw_total"))


@query
def progress_settled(spark, sf_dir):
    rows = stored(spark, sf_dir).withColumn("p", index.progress(F.col("raw")))
    old = scalars.stale(F.col("p.updated_at"), moment(F.lit(400)))
    return rows.select("event_id", old.alias("stale"), index.settled(F.col("p"), old).alias("status"), index.may_start(F.col("p")).alias("may_start"), index.may_start(F.col("p"), old).alias("may_restart"))


@query
def progress_written(spark, sf_dir):
    rows = files_of(spark, sf_dir).select("user_id", moment(F.col("file_id") % 97).alias("processed_at"))
    out = index.progress_log(rows)
    text = index.progress_text(F.col("status"), F.col("total"), F.col("processed"), moment(F.lit(0)))
    return out.select("user_id", "processed", text.alias("text"))


# --- upserts, replacements, deletions ---


def updates(base: DataFrame) -> DataFrame:
    """Two versions of every third file, later ones by time, and some files that are new."""
    old = base.where("file_id % 3 = 0")
    new = base.where("file_id % 7 = 0").withColumn("file_id", -F.col("file_id") - 1)
    every = old.unionByName(new).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return every


@query
def upsert_categories(spark, sf_dir):
    base = categories(spark, sf_dir).select("user_id", "file_id", F.lit("p").alias("file_path"), F.lit(1).cast("long").alias("file_size"), F.lit("image/jpeg").alias("mime_type"), "category", "confidence", "indicators", moment(F.lit(0)).alias("classified_at"))
    changed = updates(base).withColumns({"category": F.when(F.col("version") == 2, "meme").otherwise("nature"), "confidence": F.lit(0.5), "classified_at": moment(F.col("version"))})
    return index.upserted(base, changed.select(*base.columns), "classifications").groupBy("user_id", "category").agg(F.count("*").alias("files"), F.count_if(F.col("confidence") == 0.5).alias("half"))


@query
def upsert_locations(spark, sf_dir):
    base = fixtures.locations(spark, sf_dir).withColumns({"file_path": F.lit("p"), "file_size": F.lit(1).cast("long"), "mime_type": F.lit("image/jpeg"), "file_mtime": F.lit(0).cast("long"), "scanned_at": moment(F.lit(0))})
    base = base.select(*(c.split()[0] for c in schema.FILE_LOCATIONS.split(", ")))
    changed = updates(base).withColumns({"has_location": F.col("version") == 1, "file_mtime": F.col("version").cast("long"), "scanned_at": moment(F.col("version"))})
    return index.upserted(base, changed.select(*base.columns), "file_locations").select("user_id", "file_id", "has_location", "file_mtime")


def face_files(spark, sf_dir) -> DataFrame:
    """The file-level face table."""
    faces = fixtures.faces(spark, sf_dir).where("face_index = 1")
    rows = faces.withColumns({"mime_type": F.lit("image/jpeg"), "has_face": F.col("file_id") % 4 != 1, "file_mtime": F.lit(0).cast("long"), "scanned_at": moment(F.lit(0))})
    return rows.withColumn("face_signature", F.when(F.col("has_face"), F.concat(F.lit("s"), F.col("vec_id").cast("string")))).select(*(c.split()[0] for c in schema.FILE_FACES.split(", ")))


@query
def upsert_faces(spark, sf_dir):
    base = face_files(spark, sf_dir)
    changed = updates(base).withColumns({"has_face": F.lit(True), "face_signature": F.concat(F.lit("v"), F.col("version").cast("string")), "scanned_at": moment(F.col("version"))})
    return index.upserted(base, changed.select(*base.columns), "file_faces").select("user_id", "file_id", "has_face", "face_signature")


@query
def faces_present(spark, sf_dir):
    return people.with_face(face_files(spark, sf_dir)).select("user_id", "file_id", "face_signature")


@query
def face_file_counts(spark, sf_dir):
    return people.count_with_face(face_files(spark, sf_dir), "photos")


@query
def location_file_counts(spark, sf_dir):
    return places.count_with_location(fixtures.locations(spark, sf_dir))


@query
def class_count_one(spark, sf_dir):
    return classify.count_of(categories(spark, sf_dir), "family")


@query
def faces_replaced(spark, sf_dir):
    base = fixtures.faces(spark, sf_dir).select("user_id", "file_id", F.col("face_index").cast("int").alias("face_index"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("face_signature"), "face_confidence")
    seen = base.where("file_id % 3 = 0").select("user_id", "file_id").distinct()
    face = lambda s, c: F.struct(s.alias("signature"), F.lit(c).alias("confidence"))
    n = F.col("file_id").cast("string")
    many = F.array(face(F.lit(" "), 0.1), face(F.concat(F.lit(" n"), n), 0.5), face(F.lit(None).cast("string"), 0.2), face(F.concat(F.lit("m"), n), 0.6))
    found = seen.withColumn("signatures", F.when(F.col("file_id") % 2 == 0, many).otherwise(F.slice(many, 1, 1)))
    return index.replaced_faces(base, found)


@query
def labels_set(spark, sf_dir):
    rows = fixtures.faces(spark, sf_dir)
    signature = F.concat(F.lit("s"), F.col("vec_id").cast("string"))
    base = rows.where("vec_id % 5 = 0").select("user_id", signature.alias("face_signature"), F.lit("Old").alias("label_name"), moment(F.lit(0)).alias("updated_at"))
    k = F.col("vec_id") % 6
    name = F.when(k == 0, "  ").when(k == 1, F.lit(None)).otherwise(F.concat(F.lit(" New "), k.cast("string"), F.lit("\t")))
    first = rows.where("vec_id % 2 = 0").select("user_id", F.concat(F.lit(" "), F.when(F.col("vec_id") % 22 == 0, "").otherwise(signature)).alias("face_signature"), name.alias("label_name"), moment(F.col("vec_id")).alias("updated_at"))
    again = rows.where("vec_id % 8 = 0").select("user_id", signature.alias("face_signature"), F.lit("Later").alias("label_name"), moment(F.col("vec_id") + 1).alias("updated_at"))
    return index.set_labels(base, first.unionByName(again)).select("user_id", "face_signature", "label_name")


@query
def users_dropped(spark, sf_dir):
    return index.without_users(files_of(spark, sf_dir), ["en", "nobody"]).groupBy("user_id").agg(F.count("*").alias("files"))


@query
def point_lookup(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    found = [index.at(rows, user, n) for user in ("en", "de") for n in (7, 8, -1)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("user_id", "file_id", "content_hash")


# --- rows as JSON ---


def shown(table: DataFrame, kind: str) -> DataFrame:
    return index.as_json(table.withColumn("id", F.col("file_id") * 10 + 1), kind).select(F.col("json"))


@query
def json_file_hashes(spark, sf_dir):
    return shown(files_of(spark, sf_dir).withColumn("scanned_at", moment(F.col("file_id"))), "file_hashes")


@query
def json_classifications(spark, sf_dir):
    rows = files_of(spark, sf_dir).withColumns({"category": F.lit("meme"), "confidence": F.col("file_id") % 8 / 16.0, "indicators": F.when(F.col("file_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))), "classified_at": moment(F.col("file_id"))})
    return shown(rows, "classifications")


@query
def json_file_locations(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    there = F.col("file_id") % 2 == 0
    return shown(rows.withColumns({"has_location": there, "lat": F.when(there, F.col("file_id") % 90 + 0.25), "lng": F.when(there, -(F.col("file_id") % 90) - 0.5), "scanned_at": moment(F.col("file_id"))}), "file_locations")


@query
def json_file_faces(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    there = F.col("file_id") % 2 == 0
    return shown(rows.withColumns({"has_face": there, "face_signature": F.when(there, "s"), "face_confidence": F.when(there, F.col("file_id") % 8 / 8.0 + 0.25), "scanned_at": moment(F.col("file_id"))}), "file_faces")


@query
def json_face_instances(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    return shown(rows.withColumns({"face_index": F.lit(1), "face_signature": F.concat(F.lit("s"), F.col("file_id").cast("string")), "face_confidence": F.col("file_id") % 8 / 8.0 + 0.25, "scanned_at": moment(F.col("file_id"))}), "face_instances")


@query
def json_face_labels(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    return shown(rows.select("user_id", "file_id", F.concat(F.lit("s"), F.col("file_id").cast("string")).alias("face_signature"), F.lit('A "B"').alias("label_name"), moment(F.col("file_id")).alias("updated_at")), "face_labels")


# --- names, numbers, forms ---


@query
def free_names(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    k = F.col("file_id") % 5
    name = F.when(k == 0, "a.jpg").when(k == 1, "b").when(k == 2, "c.tar.gz").when(k == 3, ".x").otherwise("free.png")
    taken = F.array(*map(F.lit, ("a.jpg", "a_1.jpg", "a_2.jpg", "a_4.jpg", "b", "c.tar.gz", "c.tar_1.gz", ".x", "_1.x")))
    return rows.select("file_id", paths.free_name(name, taken, F.col("file_mtime")).alias("name"))


@query
def confidence_forms(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    return rows.select("file_id", scalars.confidence_percent(F.col("file_id") % 201 / 200.0).cast("long").alias("percent"), scalars.spaced(F.concat(F.lit("a_b_"), "user_id", F.lit("_"))).alias("spaced"))


@query
def face_confidences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = F.col("vec_id")
    box = F.struct((k % 30 + 1).alias("w"), (k % 41 + 1).alias("h"))
    score = F.when(k % 3 != 0, (k % 64) / 64.0)
    return rows.select("vec_id", scalars.face_confidence(box, k % 5 + 1, score, F.lit(64), F.lit(64)).alias("confidence"))


@query
def prompt_expansion(spark, sf_dir):
    rows = files_of(spark, sf_dir)
    k = F.col("file_id")
    known = rows.select(F.concat(F.lit("c"), (k % 4).cast("string")).alias("category"), F.concat(F.when(k % 2 == 0, " P").otherwise("p"), F.floor(k / 8).cast("string"), F.when(k % 5 == 0, " ").otherwise("")).alias("prompt"), k.alias("pos"))
    wanted = rows.groupBy((k % 6).alias("n")).agg(F.min(k).alias("pos")).select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("label"), "pos")
    return classify.prompts_of(wanted, known).select("category", "prompt", F.col("ord").cast("long").alias("ord"), F.col("pos").cast("long").alias("pos"))


@query
def perceptual_hashes(spark, sf_dir):
    """Of pictures that are spelled from embeddings; tested against sums in Python."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = lambda i: F.abs(F.element_at("embedding", i % 64 + 1).cast("double"))
    digit = lambda i: F.lpad(F.hex((F.floor(x(i) * 997 + x(F.floor(i / 64).cast("int")) * 31) % 256).cast("int")), 2, "0")
    samples = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(signatures.SIDE**2 - 1)), digit), ""))
    return rows.select("vec_id", signatures.hashed(samples).alias("face_signature"))


# --- workers ---


@query
def ml_retry(spark, sf_dir):
    """Every third file fails once and is asked again; every seventh is rejected for good."""
    rows = scoring.eligible(files_of(spark, sf_dir)).select("user_id", "file_id", "file_size", "mime_type")
    return scoring.answers(rows, fixtures.FlakyStub()).select("user_id", "file_id", "category", F.round("confidence", 6).alias("confidence"))


@query
def face_worker(spark, sf_dir):
    rows = scoring.eligible_faces(files_of(spark, sf_dir)).select("user_id", "file_id", "file_size")
    found = scoring.face_answers(rows, fixtures.FaceStub())
    return found.select("user_id", "file_id", F.posexplode("signatures").alias("pos", "s")).select("user_id", "file_id", F.col("pos").cast("long").alias("pos"), "s.signature", "s.confidence")


# --- actions ---


@query
def move_files(spark, sf_dir):
    files = files_of(spark, sf_dir).withColumn("file_path", F.concat(F.when(F.col("file_id") % 2 == 0, "Old/").otherwise("New/"), F.lit("n"), (F.col("file_id") % 10).cast("string"), F.when(F.col("file_id") % 4 == 1, "_1").otherwise(""), F.lit(".jpg")))
    asked = files.where("file_id % 6 = 2").select("user_id", "file_id", F.col("file_id").alias("pos"), F.lit("/New/").alias("target"))
    bad = files.where("file_id % 6 = 3").select("user_id", "file_id", F.col("file_id").alias("pos"), F.lit("a/../b").alias("target"))
    unknown = files.where("file_id % 6 = 4").select("user_id", (-F.col("file_id")).alias("file_id"), F.col("file_id").alias("pos"), F.lit("New").alias("target"))
    plan = actions.move_plan(files, asked.unionByName(bad).unionByName(unknown), F.lit(1_700_000_000))
    return plan.select("user_id", "pos", "file_id", "outcome", "new_path")


@query
def classified_delete(spark, sf_dir):
    files = files_of(spark, sf_dir)
    return actions.classified_deletes(listing_of(files), requests(files).where("pos < 0"))


@query
def duplicate_delete(spark, sf_dir):
    """Every third file is asked for; storage lacks some, holds some twice, and protects some."""
    files = files_of(spark, sf_dir)
    k = F.col("file_id")
    nodes = files.where(k % 8 != 0).withColumn("nth", F.explode(F.when(k % 8 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    nodes = nodes.select("user_id", "file_id", "nth", F.concat("file_path", F.lit("#"), F.col("nth").cast("string")).alias("path"), ((k % 8 > 2) | (F.col("nth") == 2)).alias("deletable"))
    asked = files.where(k % 3 != 1).select("user_id", "file_id", (k * 7919 % 10007).alias("pos"))
    unknown = files.where(k % 100 == 5).select("user_id", (-k).alias("file_id"), k.alias("pos"))
    return actions.duplicate_deletes(files, nodes, asked.unionByName(unknown)).drop("pos")


@query
def group_after_delete(spark, sf_dir):
    files = files_of(spark, sf_dir)
    plan = dedup.deletion_plan(files, requests(files)).where("outcome = 'deleted'")
    return dedup.without(files, plan)


@query
def reference_faces(spark, sf_dir):
    return people.usable_as_reference(fixtures.faces(spark, sf_dir)).select("user_id", "file_id")


@query
def pages_appended(spark, sf_dir):
    """Pages that overlap, as when files come in between two of them."""
    rows = files_of(spark, sf_dir).select("user_id", "file_id", F.floor(F.col("file_id") / 20).alias("page"), (F.col("file_id") % 20).alias("pos"))
    again = rows.where("file_id % 20 > 15").select("user_id", "file_id", (F.col("page") + 1).alias("page"), (F.col("pos") - 16).alias("pos"))
    return dedup.appended(rows.unionByName(again))


# --- events and jobs ---


@query
def event_apply_all_types(spark, sf_dir):
    return upkeep.apply_to_index(*index_before(spark, sf_dir), image_only=False).select("user_id", "file_id", "file_path", "mime_type")


def streamed(spark, rows: DataFrame, order: str, files: int) -> DataFrame:
    """A table as a stream, a file a batch, in order: the files are written one after another, as a stream reads them by their times."""
    ranges_, folder = stores.shared_folder(spark, "ranges"), stores.shared_folder(spark, "stream")
    rows.repartitionByRange(files, order).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(ranges_)
    for k in range(files):
        spark.read.schema(f"{rows._jdf.schema().toDDL()}, part int").parquet(ranges_).where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    stores.remove(spark, ranges_)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@query
def event_apply_stream(spark, sf_dir):
    """The log in batches that have nothing to do with time, through the state of each file, into a table of snapshots."""
    base, log = index_before(spark, sf_dir)
    table = IndexTable(spark, stores.shared_folder(spark, "upkeep"), schema.FILE_HASHES)
    table.commit(None, lambda _: base)
    events = streamed(spark, log.drop("scanned_at").withColumn("turn", F.xxhash64("event_id")), "turn", 4)
    late = 10 * 365 * 86400  # nothing is too late
    finished(upkeep.start_upkeep(events.drop("turn"), table, stores.shared_folder(spark, "check"), late_seconds=late))
    return table.read().select("user_id", "file_id", "file_path", "content_hash", "file_size")


def scans(spark, sf_dir) -> DataFrame:
    """Progress of each user's scans, with pauses."""
    rows = fixtures.file_events(spark, sf_dir)
    k = F.col("event_id")
    status = F.when(k % 11 == 0, "completed").when(k % 37 == 0, "error").otherwise("scanning")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + k * F.lit(10))
    return rows.select((k % 23).cast("string").alias("user_id"), status.alias("status"), (k % 5 * 10).alias("total"), (k % 7 * 10).alias("processed"), at.alias("updated_at"))


@query
def scans_settled(spark, sf_dir):
    return timers.scans_settled_by(scans(spark, sf_dir), "2100-01-01 00:00:00")


@query
def scans_settled_stream(spark, sf_dir):
    """The same as a stream with timers; its last row is one of another user, late enough to settle all."""
    rows = scans(spark, sf_dir)
    end = rows.groupBy().agg(F.max("updated_at").alias("at")).select(F.lit("end").alias("user_id"), F.lit("completed").alias("status"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("processed"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    out = stores.shared_folder(spark, "settled")
    query = timers.scans_settled(streamed(spark, rows.unionByName(end), "updated_at", 4), clock="EventTime").writeStream.format("parquet").option("path", out)
    finished(query.option("checkpointLocation", stores.shared_folder(spark, "check")).outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(timers.WATCHED).parquet(out).where("user_id <> 'end'")


@query
def cleanup_throttle_stream(spark, sf_dir):
    log = fixtures.file_events(spark, sf_dir).select("user_id", "ts", (F.col("op") == "created").alias("classifying"))
    out = stores.shared_folder(spark, "due")
    query = timers.cleanup_due(streamed(spark, log, "ts", 4)).writeStream.format("parquet").option("path", out)
    finished(query.option("checkpointLocation", stores.shared_folder(spark, "check")).outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema("user_id string, ts timestamp").parquet(out).groupBy("user_id").agg(F.count("*").alias("cleanups"))


@query
def event_delete_both(spark, sf_dir):
    """Deletions leave hashes and categories, row by row."""
    log = fixtures.file_events(spark, sf_dir)
    table = log.select("user_id", "file_id").distinct()
    out = upkeep.delete_cascade({"file_hashes": table, "classifications": table}, log)
    return out["file_hashes"].withColumn("table_name", F.lit("file_hashes")).unionByName(out["classifications"].withColumn("table_name", F.lit("classifications")))


def rescanned(files: DataFrame) -> DataFrame:
    """A listing with hashes; every 40th can't be read."""
    rows = listing_of(files)
    return rows.withColumn("content_hash", F.when(F.col("file_id") % 40 != 0, F.col("content_hash")))


@query
def job_scan(spark, sf_dir):
    files = files_of(spark, sf_dir)
    return jobs.scan(rescanned(files), indexed_of(files)).select("user_id", "file_id", "file_size", "file_mtime")


@query
def job_scan_forced(spark, sf_dir):
    files = files_of(spark, sf_dir)
    return jobs.scan_counters(rescanned(files), indexed_of(files), force=True)


@query
def job_cleanup(spark, sf_dir):
    files = files_of(spark, sf_dir)
    return jobs.cleanup(files, listing_of(files), 20).groupBy("user_id").agg(F.count("*").alias("files"), F.sum("file_id").alias("ids"))
