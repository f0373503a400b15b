"""People: labelled reference faces, centroids, and assignment of the other faces.

faces: user_id, file_id, face_index, file_path, file_size,
face_signature, face_confidence and ``vector`` (the unit embedding of
the signature, null if it is none; see ``with_vectors``).
labels: label_id, user_id, face_signature, label_name.

Wherever the first of equals wins, faces go by file and index, people by
their first label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.paths import scoped, trimmed
from shoebox.functions.scalars import cluster_id, embedding, unit
from shoebox.operators import vectors
from shoebox.sources.stores import kept
from shoebox.plans.config import CANDIDATES, CLUSTERS, EngineConfig, clamp, page_of

FILE = ["user_id", "file_id"]


def with_vectors(faces: DataFrame) -> DataFrame:
    return faces.withColumn("vector", embedding(F.col("face_signature")))


def signed(faces: DataFrame) -> DataFrame:
    """Faces with a signature, trimmed."""
    return faces.withColumn("face_signature", trimmed(F.col("face_signature"))).where("face_signature <> ''")


def face_counts(faces: DataFrame) -> DataFrame:
    return signed(faces).groupBy(*FILE).agg(F.count("*").alias("faces"))


def with_counts(faces: DataFrame) -> DataFrame:
    return signed(faces).withColumn("faces", F.count("*").over(Window.partitionBy(*FILE)))


def face_images(faces: DataFrame) -> DataFrame:
    """Distinct images per user, with blank signatures too."""
    return faces.groupBy("user_id").agg(F.countDistinct("file_id", "file_path").alias("total_face_images"))


def with_face(files: DataFrame, user: str | None = None) -> DataFrame:
    """Rows of the face index that say that a face was found, by file."""
    rows = files if user is None else files.where(F.col("user_id") == user)
    return rows.where("has_face")


def count_with_face(files: DataFrame, scope: str | None = None) -> DataFrame:
    """Per user, how many files of a scope have a face."""
    return scoped(files, scope).groupBy("user_id").agg(F.count_if("has_face").alias("files"))


def candidates(faces: DataFrame, limit: int = 120) -> DataFrame:
    """Of each signature its surest single-face file, surest first; a page of each user."""
    single = with_counts(faces).where("faces = 1").withColumn("confidence", F.coalesce("face_confidence", F.lit(0.0)))
    best = Window.partitionBy("user_id", "face_signature").orderBy(F.desc("confidence"), "file_id", "face_index")
    once = single.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    order = Window.partitionBy("user_id").orderBy(F.desc("confidence"), F.desc("file_size"), "file_id")
    return once.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= clamp(limit, *CANDIDATES)).select("user_id", "pos", "file_id", "face_signature", "confidence", "file_size")


def references(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with a name whose signature is alone in some file: label_id, user_id, face_signature, person."""
    single = with_counts(faces).where("faces = 1").select("user_id", "face_signature")
    named = labels.select("label_id", "user_id", trimmed(F.col("face_signature")).alias("face_signature"), trimmed(F.col("label_name")).alias("person"))
    return named.where("face_signature <> '' AND person <> ''").join(single, ["user_id", "face_signature"], "left_semi")


def centroids(refs: DataFrame) -> DataFrame:
    """user_id, person, ord (of the first label) and the unit mean of the references' vectors.

    The first reference sets the dimension; others are left out.
    """
    rows = refs.withColumn("vector", embedding(F.col("face_signature"))).where("vector IS NOT NULL")
    own = Window.partitionBy("user_id", "person").orderBy("label_id")
    rows = rows.withColumn("dim", F.first(F.size("vector")).over(own)).withColumn("ord", F.first("label_id").over(own)).where(F.size("vector") == F.col("dim"))
    whole = vectors.sums(rows, ["user_id", "person", "ord"])
    return whole.withColumn("vector", unit(F.col("total"))).where("vector IS NOT NULL").select("user_id", "person", "ord", "vector")


def assigned(faces: DataFrame, refs: DataFrame, people: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each face that belongs to someone, with person and match_score.

    A reference's own signature belongs to its person with score 1.  Any
    other face goes to the nearest centroid if that is near enough and far
    enough ahead of the next.  A person further off than the least
    similarity less the margin changes no verdict, so ``nearest_two`` needs
    to look no further; it compares each different signature once.
    """
    people = kept(people.select("user_id", "person", "ord", "vector"), "people")
    exact = refs.join(people.select("user_id", "person"), ["user_id", "person"], "left_semi").groupBy("user_id", "face_signature").agg(F.max_by("person", "label_id").alias("own"))
    exact = kept(exact, "exact")
    rows = with_counts(faces)
    key = F.sha2(F.to_json(F.struct("user_id", "face_signature")), 256)
    signatures = signed(faces).select("user_id", "face_signature").distinct()
    asked = signatures.join(exact, ["user_id", "face_signature"], "left_anti").select(key.alias("key"), "user_id", embedding(F.col("face_signature")).alias("vector"))
    named = people.select("user_id", "ord", F.col("person").alias("name"), "vector")
    least, margin = config.people_min_similarity, config.people_min_margin
    near = vectors.nearest_two(asked, named, "user_id", "key", least - margin, asking=signatures)
    near = near.where((F.col("score") >= least) & (F.col("score") - F.col("second") >= margin)).select("key", F.col("name").alias("near"), F.col("score").alias("near_score"))
    joined = rows.withColumn("key", key).join(exact, ["user_id", "face_signature"], "left").join(near, "key", "left")
    joined = joined.withColumns({"person": F.coalesce("own", "near"), "match_score": F.when(F.col("own").isNotNull(), F.lit(1.0)).otherwise(F.col("near_score")), "confidence": F.coalesce("face_confidence", F.lit(0.0))})
    return joined.where("person IS NOT NULL").select(*rows.columns, "person", "match_score", "confidence")


def person_files(found: DataFrame) -> DataFrame:
    """One face of each person and file, in the order of the person's page; pos from 1, with the number of files."""
    best = Window.partitionBy("user_id", "person", "file_id").orderBy(F.desc("match_score"), "face_index")
    once = found.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    page = Window.partitionBy("user_id", "person")
    order = page.orderBy(F.desc("match_score"), F.desc("confidence"), F.desc("file_size"), "file_id")
    return once.withColumn("pos", F.row_number().over(order)).withColumn("count", F.count("*").over(page))


def clusters(files: DataFrame, people: DataFrame, limit: int = 10) -> DataFrame:
    """A user's people, surest first file first, then most files; total_clusters counts before the cut."""
    heads = files.where("pos = 1").select("user_id", "person", "count", F.col("confidence").alias("top_confidence"))
    rows = heads.join(people.select("user_id", "person", "ord"), ["user_id", "person"])
    own = Window.partitionBy("user_id")
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("top_confidence"), F.desc("count"), "ord"))).withColumn("total_clusters", F.count("*").over(own))
    return ranked.where(F.col("rank") <= clamp(limit, *CLUSTERS)).select("user_id", "rank", cluster_id(F.col("person")).alias("cluster_id"), "person", "count", "top_confidence", "total_clusters")


def page(files: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each person's files, with has_more and next_offset."""
    limit, offset = page_of(limit, offset)
    last = F.least(F.col("count"), F.lit(offset + limit))
    rows = files.where((F.col("pos") > offset) & (F.col("pos") <= offset + limit))
    return rows.withColumn("next_offset", last).withColumn("has_more", last < F.col("count"))


def files_of_person(faces: DataFrame, refs: DataFrame, people: DataFrame, person: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The files of one person when nobody else competes: no margin to others, whose references may match too."""
    only = people.where(F.col("person") == person)
    return person_files(assigned(faces, refs.where(F.col("person") == person), only, config))


def files_of_signatures(faces: DataFrame, signatures: DataFrame) -> DataFrame:
    """Files with one of the signatures (user_id, face_signature), surest first; ``faces`` counts matching ones only."""
    wanted = signatures.select("user_id", trimmed(F.col("face_signature")).alias("face_signature")).where("face_signature <> ''")
    rows = faces.join(wanted, ["user_id", "face_signature"], "left_semi").withColumn("confidence", F.coalesce("face_confidence", F.lit(0.0)))
    own = Window.partitionBy(*FILE)
    rows = rows.withColumn("faces", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy(F.desc("confidence"), "face_index"))).where("nth = 1")
    user = Window.partitionBy("user_id")
    order = user.orderBy(F.desc("confidence"), F.desc("file_size"), "file_id")
    return rows.withColumn("pos", F.row_number().over(order)).withColumn("count", F.count("*").over(user)).drop("nth")


def usable_as_reference(faces: DataFrame) -> DataFrame:
    return with_counts(faces).where("faces = 1")


# --- boxes of a detector ---


def kept_boxes(boxes: DataFrame, most_overlap: float = 0.35) -> DataFrame:
    """Greedy suppression: by area, a box stays if it overlaps none of those kept by so much.

    boxes: file_id, x, y, w, h, score.  Returns them with face_index from
    1 by area.  A picture's boxes are one array; the kept ones grow in a fold.
    """
    box = F.struct((-F.col("w") * F.col("h")).alias("neg_area"), "x", "y", "w", "h", "score")
    lists = boxes.groupBy("file_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    from shoebox.functions.scalars import box_iou

    kind = "array<struct<neg_area:{0},x:{0},y:{0},w:{0},h:{0},score:double>>".format("int" if dict(boxes.dtypes)["x"] == "int" else "bigint")
    kept = F.aggregate("boxes", F.array().cast(kind), lambda acc, b: F.when(F.exists(acc, lambda k: box_iou(b, k) >= most_overlap), acc).otherwise(F.concat(acc, F.array(b))))
    out = lists.select("file_id", F.posexplode(kept).alias("pos", "b"))
    return out.select("file_id", (F.col("pos") + 1).alias("face_index"), "b.x", "b.y", "b.w", "b.h", "b.score")
