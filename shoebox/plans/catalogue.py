"""Every query of the engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths, scalars
from shoebox.operators import classify, dedup, index, people, places, scoring
from shoebox.sources import fixtures
from shoebox.streaming import events as upkeep

from .oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from . import details  # noqa: F401 - it registers its queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .details_sql import SQL

    return ORACLE | SQL


# --- duplicates ---


@query
def dup_groups_all(spark, sf_dir):
    return dedup.groups(fixtures.file_index(spark, sf_dir))


@query
def dup_groups_photos(spark, sf_dir):
    return dedup.groups(dedup.of_user(fixtures.file_index(spark, sf_dir), scope="photos"))


@query
def dup_groups_page2(spark, sf_dir):
    return dedup.group_page(fixtures.file_index(spark, sf_dir), limit=20, offset=20)


@query
def dup_group_count(spark, sf_dir):
    return dedup.groups(fixtures.file_index(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("groups"))


@query
def dup_page_files(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    return dedup.with_files(dedup.group_page(files, limit=20), files)


@query
def dup_group_detail(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    # The content of the largest group, found by the engine itself.
    top = dedup.group_page(files, limit=1).select(F.col("content_hash").alias("h")).first()
    return dedup.group_detail(files, top["h"] if top else "")


@query
def dup_stats_all(spark, sf_dir):
    return dedup.stats(fixtures.file_index(spark, sf_dir))


@query
def dup_stats_photos(spark, sf_dir):
    return dedup.stats(dedup.of_user(fixtures.file_index(spark, sf_dir), scope="photos"))


@query
def dup_wasted_bytes(spark, sf_dir):
    return dedup.wasted(fixtures.file_index(spark, sf_dir))


@query
def dup_files_semi(spark, sf_dir):
    return dedup.files_in_groups(fixtures.file_index(spark, sf_dir)).select("user_id", "file_id", "content_hash")


@query
def dup_keep_one(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    kept = files.groupBy("user_id", "content_hash").agg(F.min("file_id").alias("file_id"))
    return dedup.keep_one(files, kept)


@query
def bulk_delete_plan(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    return dedup.deletion_plan(files, requests(files))


@query
def bulk_delete_summary(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    return dedup.deletion_summary(dedup.deletion_plan(files, requests(files)))


def requests(files: DataFrame) -> DataFrame:
    """Two of three files by descending id, some of them twice, and one that isn't indexed."""
    asked = files.where("file_id % 3 <> 0").select("user_id", "file_id", (-F.col("file_id")).alias("pos"))
    again = files.where("file_id % 30 = 1").select("user_id", "file_id", F.lit(1).cast("long").alias("pos"))
    unknown = files.where("file_id = 0").select("user_id", F.lit(-7).cast("long").alias("file_id"), F.lit(2).cast("long").alias("pos"))
    return asked.unionByName(again).unionByName(unknown)


# --- index upkeep ---


@query
def index_keyset_page(spark, sf_dir):
    return dedup.keyset_page(fixtures.file_index(spark, sf_dir), 100, 500).select("user_id", "file_id", "file_path")


def listing_of(files: DataFrame) -> DataFrame:
    """What storage has now: some files gone, some touched, some of another size, some empty."""
    rows = files.where("file_id % 9 <> 4")
    return rows.withColumns({"file_mtime": F.col("file_mtime") + F.when(F.col("file_id") % 7 == 1, 5).otherwise(0), "file_size": F.when(F.col("file_id") % 17 == 3, 0).when(F.col("file_id") % 11 == 2, F.col("file_size") + 1).otherwise(F.col("file_size"))})


def indexed_of(files: DataFrame) -> DataFrame:
    return files.where("file_id % 5 <> 2")


def diff(spark, sf_dir, by):
    files = fixtures.file_index(spark, sf_dir)
    return index.compared(listing_of(files), indexed_of(files), by).select("user_id", "file_id", "was_indexed", "needs_work")


@query
def index_diff(spark, sf_dir):
    return diff(spark, sf_dir, "mtime_size")


@query
def index_diff_mtime(spark, sf_dir):
    return diff(spark, sf_dir, "mtime")


@query
def index_diff_row(spark, sf_dir):
    return diff(spark, sf_dir, "row")


@query
def index_merge(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    work = index.compared(listing_of(files), indexed_of(files)).where("needs_work").select(*files.columns)
    return index.merged(indexed_of(files), work).select("user_id", "file_id", "file_size", "file_mtime")


@query
def index_stale_anti(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    return index.split_stale(files, listing_of(files))[1].select("user_id", "file_id", "file_path")


@query
def index_stale_kept(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    return index.split_stale(files, listing_of(files))[0].groupBy("user_id").agg(F.count("*").alias("files"))


@query
def scan_counters(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    rows = index.compared(listing_of(files), indexed_of(files))
    outcome = F.when(F.col("needs_work") & (F.col("file_id") % 40 == 0), "error").when(F.col("needs_work"), "done").otherwise("skipped")
    return index.counters(rows.withColumn("outcome", outcome).withColumn("positive", F.col("file_id") % 2 == 0))


@query
def index_counts(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    return dedup.of_user(files, scope="photos").groupBy("user_id").agg(F.count("*").alias("files"), F.count_if(F.col("mime_type").isin(*paths.SUPPORTED)).alias("images"))


@query
def index_json(spark, sf_dir):
    rows = fixtures.locations(spark, sf_dir).withColumns({"file_path": F.lit("p"), "file_size": F.lit(1), "mime_type": F.lit("image/jpeg"), "file_mtime": F.lit(0), "scanned_at": F.timestamp_seconds(F.lit(1700000000)), "id": F.col("file_id") + 1})
    made = index.as_json(rows, "file_locations")
    return made.select(F.get_json_object("json", "$.fileId").cast("long").alias("file_id"), F.get_json_object("json", "$.hasLocation").alias("has_location"), F.get_json_object("json", "$.lat").cast("double").alias("lat"), F.get_json_object("json", "$.scannedAt").alias("scanned_at"))


# --- categories ---


@query
def class_scores(spark, sf_dir):
    out = classify.scores(fixtures.photo_attrs(spark, sf_dir))
    return out.select("file_id", *(F.round(f"s_{c}", 9).alias(c) for c in classify.CATEGORIES))


def prefixed(category):
    return lambda x: F.concat(F.lit(f"{category}/"), x)


@query
def class_indicators(spark, sf_dir):
    out = classify.scores(fixtures.photo_attrs(spark, sf_dir))
    names = F.explode(F.array(*(F.transform(f"i_{c}", prefixed(c)) for c in classify.CATEGORIES)))
    return out.select("file_id", names.alias("xs")).select(F.explode("xs").alias("indicator")).groupBy("indicator").agg(F.count("*").alias("files"))


def categories(spark, sf_dir):
    return classify.best(classify.scores(fixtures.photo_attrs(spark, sf_dir)))


@query
def class_best(spark, sf_dir):
    out = categories(spark, sf_dir)
    return out.select("file_id", "category", F.round("confidence", 9).alias("confidence"), F.size("indicators").cast("long").alias("n_indicators"))


@query
def class_counts(spark, sf_dir):
    return classify.counts(categories(spark, sf_dir))


@query
def class_counts_zero_filled(spark, sf_dir):
    return classify.all_counts(categories(spark, sf_dir)).select("category", "count", "total")


@query
def class_page(spark, sf_dir):
    return classify.category_page(categories(spark, sf_dir), "family", 30, 10).select("file_id", F.round("confidence", 9).alias("confidence"))


@query
def ml_merge(spark, sf_dir):
    rows = categories(spark, sf_dir)
    answers = rows.where("file_id % 2 = 0").select(
        "user_id", "file_id",
        F.when(F.col("file_id") % 10 == 0, "selfie").otherwise("meme").alias("category"), ((F.col("file_id") % 100) / 80.0).alias("confidence"),
        F.lit("m").alias("model"), F.lit("").alias("algorithm_version"), F.array(F.struct(F.lit("a").alias("name"), F.lit(0.25).alias("score"))).alias("labels"),
    )
    out = classify.merge_model(rows, answers)
    return out.select("file_id", "category", F.round("confidence", 9).alias("confidence"), F.when(F.col("indicators")[0] == "ml_inference", F.array_join("indicators", ",")).otherwise("").alias("indicators"))


# What the worker asks its model.
PROMPTS = {
    "document": ("a document scan with text", "a screenshot of an app or website", "an invoice or receipt", "printed page with mostly text"),
    "meme": ("an internet meme", "a social media post image", "a funny image with caption text", "chat app forwarded image"),
    "nature": ("a nature landscape", "mountains, forest, sea, or outdoor scenery with no close people", "a travel landscape photo", "outdoor scenic view"),
    "family": ("a family photo with people", "people portrait", "group of people indoors or outdoors", "a child or kids in a photo", "a person taking a selfie"),
    "object": ("a photo of an object", "product shot", "close-up of an item", "indoor clutter or household items", "car interior or dashboard"),
}


def prompt_table(spark: SparkSession) -> DataFrame:
    rows = [(c, k, p) for k, c in enumerate(classify.CATEGORIES) for p in PROMPTS[c]]
    return spark.createDataFrame([(p, c, k, n) for n, (c, k, p) in enumerate(rows)], "prompt string, category string, ord int, rank int")


@query
def ml_label_argmax(spark, sf_dir):
    prompts = prompt_table(spark)
    files = fixtures.file_index(spark, sf_dir).select("file_id")
    pairs = files.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(21))))
    scores = pairs.join(F.broadcast(prompts.select("rank", "prompt")), "rank").select("file_id", "prompt", (((F.col("file_id") * 31 + F.col("rank") * 17) % 101) / 128.0).alias("score"))
    out = classify.prompt_answers(scores, prompts)
    return out.select("file_id", "category", "confidence", F.col("labels")[0]["name"].alias("first"), F.col("labels")[4]["name"].alias("fifth"))


# --- places ---


@query
def place_markers(spark, sf_dir):
    return places.markers(fixtures.locations(spark, sf_dir))


@query
def place_totals(spark, sf_dir):
    return places.totals(fixtures.locations(spark, sf_dir))


@query
def place_marker_files(spark, sf_dir):
    return places.marker_files(fixtures.locations(spark, sf_dir)).select("user_id", "marker", "pos", "file_id")


@query
def gps_decimal(spark, sf_dir):
    """Degrees, minutes and seconds in several spellings; some have no divisor, no number or no third part."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    degree = F.when(k % 7 == 2, "1/0").when(k % 7 == 5, "x").otherwise(F.concat(text(k % 90), F.lit("/1")))
    minute, second = F.concat(F.lit(" "), text(k % 60), F.lit("/2 ")), F.when(k % 7 != 3, F.concat(text(k % 3600), F.lit("/100")))
    hemisphere = F.element_at(F.array(F.lit("S"), F.lit(" w "), F.lit("N"), F.lit("E")), (k % 4 + 1).cast("int"))
    return rows.select("event_id", F.round(scalars.degrees(F.array(degree, minute, second), hemisphere), 6).alias("decimal"))


# --- people ---


def people_tables(spark, sf_dir):
    faces = people.with_vectors(fixtures.faces(spark, sf_dir))
    refs = people.references(faces, fixtures.face_labels(faces))
    return faces, refs, people.centroids(refs)


@query
def face_counts(spark, sf_dir):
    return people.face_counts(fixtures.faces(spark, sf_dir))


@query
def face_images(spark, sf_dir):
    return people.face_images(fixtures.faces(spark, sf_dir))


@query
def face_decode(spark, sf_dir):
    rows = fixtures.faces(spark, sf_dir)
    b = scalars.signature_bytes(F.col("face_signature"))
    return rows.select("vec_id", F.aggregate(b, F.lit(0), lambda s, x: s + x).cast("long").alias("total"), F.array_min(b).cast("long").alias("least"), F.array_max(b).cast("long").alias("most"))


@query
def ref_candidates(spark, sf_dir):
    return people.candidates(fixtures.faces(spark, sf_dir)).select("user_id", "pos", "file_id", "confidence")


@query
def ref_eligible_labels(spark, sf_dir):
    faces, refs, _ = people_tables(spark, sf_dir)
    return refs.select("user_id", "label_id", "person")


@query
def person_centroids(spark, sf_dir):
    _, _, centres = people_tables(spark, sf_dir)
    return centres.select("user_id", "person", F.posexplode("vector").alias("pos", "x")).select("user_id", "person", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query
def person_assign(spark, sf_dir):
    return people.assigned(*people_tables(spark, sf_dir)).select("vec_id", "user_id", "person", F.round("match_score", 6).alias("match_score"))


@query
def person_clusters(spark, sf_dir):
    faces, refs, centres = people_tables(spark, sf_dir)
    found = people.person_files(people.assigned(faces, refs, centres))
    return people.clusters(found, centres).select("user_id", "cluster_id", "person", "count", "top_confidence", "total_clusters")


@query
def person_page(spark, sf_dir):
    found = people.person_files(people.assigned(*people_tables(spark, sf_dir)))
    return people.page(found, 10, 5).select("user_id", "person", "pos", "file_id", "count", "has_more", "next_offset")


@query
def person_files_only_one_profile(spark, sf_dir):
    out = people.files_of_person(*people_tables(spark, sf_dir), "P1")
    return out.select("user_id", "file_id", F.round("match_score", 6).alias("match_score"), "count")


@query
def signature_files(spark, sf_dir):
    faces = fixtures.faces(spark, sf_dir)
    wanted = faces.where("vec_id % 10 < 4").select("user_id", F.concat(F.lit(" "), "face_signature").alias("face_signature"))
    return people.files_of_signatures(faces, wanted).select("user_id", "pos", "file_id", "faces", "count")


@query
def face_nms(spark, sf_dir):
    faces = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = F.col("vec_id")
    boxes = faces.select((k % 40).alias("file_id"), (k * 37 % 200).cast("int").alias("x"), (k * 53 % 150).cast("int").alias("y"), (k * 7 % 60 + 40).cast("int").alias("w"), (k * 11 % 60 + 40).cast("int").alias("h"), F.lit(0.9).alias("score"))
    return people.kept_boxes(boxes)


# --- events ---


@query
def event_apply_last(spark, sf_dir):
    return upkeep.last_events(fixtures.file_events(spark, sf_dir)).select("user_id", "file_id", "event_id", "op", "file_size")


def index_before(spark, sf_dir):
    """An index of every third event's file, and the log."""
    log = fixtures.file_events(spark, sf_dir).withColumn("scanned_at", F.col("ts"))
    start = log.where("event_id % 3 = 0").groupBy("user_id", "file_id").agg(F.max("event_id").alias("file_mtime"))
    columns = ["user_id", "file_id", "file_path", "file_size", "mime_type", "content_hash", "file_mtime", "scanned_at"]
    base = start.select("user_id", "file_id", F.lit("Photos/old.jpg").alias("file_path"), F.lit(1).cast("long").alias("file_size"), F.lit("image/jpeg").alias("mime_type"), F.lit("old").alias("content_hash"), "file_mtime", F.timestamp_seconds(F.lit(0)).alias("scanned_at"))
    return base.select(*columns), log


@query
def event_apply_index(spark, sf_dir):
    return upkeep.apply_to_index(*index_before(spark, sf_dir)).select("user_id", "file_id", "file_path", "content_hash", "file_size")


@query
def event_delete_cascade(spark, sf_dir):
    log = fixtures.file_events(spark, sf_dir)
    table = log.select("user_id", "file_id").distinct()
    out = upkeep.delete_cascade({"file_hashes": table, "classifications": table, "file_faces": table, "file_locations": table}, log)
    sizes = [t.groupBy().agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in out.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])


@query
def event_rates(spark, sf_dir):
    return upkeep.rates(fixtures.file_events(spark, sf_dir), "1 day")


@query
def cleanup_throttle(spark, sf_dir):
    log = fixtures.file_events(spark, sf_dir)
    return upkeep.due_in_order(log.select("user_id", "ts", (F.col("op") == "created").alias("classifying"))).groupBy("user_id").agg(F.count("*").alias("cleanups"))


@query
def ml_breaker(spark, sf_dir):
    log = fixtures.file_events(spark, sf_dir)
    n = F.col("event_id")
    status = F.when(n % 6 == 0, 200).when(n % 5 == 0, 422).otherwise(503)
    rows = log.select((n % 16).alias("run_id"), n.alias("seq"), status.alias("status"))
    # Runs succeed every few calls, except those of one kind.
    rows = rows.withColumn("status", F.when((F.col("run_id") == 3) & (F.col("status") == 200), 503).otherwise(F.col("status")))
    return scoring.breaker(rows).groupBy("run_id").agg(F.count("*").alias("calls"), F.count_if("asked").alias("asked"))


# --- scalars ---


@query
def path_functions(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    p = F.col("file_path")
    full = F.concat(F.lit("/"), "user_id", F.lit("/files/"), p)
    target = F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("../"), p)).when(F.col("file_id") % 4 == 1, F.concat(F.lit("/"), p)).otherwise(F.concat(p, F.lit("/")))
    return files.select("file_id", paths.base_name(p).alias("base"), paths.directory(p).alias("folder"), paths.relative(full, F.col("user_id")).alias("relative"), paths.safe_target(target).alias("target"))


@query
def display_forms(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    n = F.col("file_size")
    return files.select("file_id", scalars.size_text(n * n).alias("size"), scalars.percent(F.col("file_id"), F.lit(700)).alias("progress"), scalars.preview(F.col("content_hash")).alias("preview"))


@query
def signature_hashes(spark, sf_dir):
    files = fixtures.file_index(spark, sf_dir)
    long_text = F.concat(F.lit(" \t"), F.repeat("content_hash", (F.col("file_id") % 4 + 1).cast("int")), F.lit("\n"))
    return files.select("file_id", scalars.stored_signature(long_text).alias("signature"), scalars.cluster_id(F.col("user_id")).alias("cluster"), scalars.hex_distance(F.col("content_hash"), F.reverse("content_hash")).cast("long").alias("distance"))
