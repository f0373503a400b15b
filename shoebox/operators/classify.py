"""Image categories: rules as a table, scores as sums of columns, counts and pages.

A rule is a category, a weight, a name and a condition.  A category's
score adds its weights in the rules' order, as doubles; the names of the
rules that hold are its indicators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.scalars import any_match, blank, focal_length, screen_sized, total
from shoebox.plans.config import EngineConfig, page_of

# Fixed values.
CATEGORIES = ("document", "meme", "nature", "family", "object")
DOCUMENT_NAMES = (r"screenshot", r"bildschirmfoto", r"screen[\s_-]?shot", r"scan[\s_-]?\d", r"document", r"receipt", r"invoice", r"page[\s_-]?\d", r"pdf", r"print", r"statement")
MEME_NAMES = (
    r"^[a-f0-9]{8,}\.(?:jpg|jpeg|png|webp)$", r"meme", r"funny", r"lol", r"FB_IMG", r"instagram", r"reddit", r"twitter", r"received_\d+", r"signal-\d+", r"whatsapp",
    r"^IMG-\d{8}-WA\d+", r"download", r"saved",
)
FAMILY_NAMES = (r"^IMG_\d{4,}", r"^PXL_\d{4,}", r"^DSC_\d{3,}", r"selfie", r"portrait", r"family", r"kids?", r"child", r"vacation", r"holiday")
PORTRAIT_LENGTHS = (35, 50, 56, 85, 105, 135)


@dataclass(frozen=True)
class Rule:
    category: str
    weight: float
    name: str
    holds: Column


class Facts:
    """What the rules ask of a row: columns that are made once (``made``), and by which the rules name them."""

    def __init__(self):
        c = F.col
        w, h = c("width").cast("double"), c("height").cast("double")
        given = {
            "camera": ~blank(c("make")) | ~blank(c("model")),
            "gps": F.coalesce(c("has_gps"), F.lit(False)),
            "flash": F.coalesce(c("flash"), F.lit(0)).bitwiseAND(1) == 1,
            "dated": ~blank(c("date_original")),
            "focal": focal_length(c("focal_35mm"), c("focal_length")),
            "screen": screen_sized(c("width"), c("height")),
            "aspect": F.when(h > 0, w / h).otherwise(F.lit(1.0)),
            "mp": w * h / 1_000_000,
            "bpp": F.when((w > 0) & (h > 0), c("file_size") / (w * h)).otherwise(F.lit(0.0)),
            "document_name": any_match(c("file_name"), DOCUMENT_NAMES),
            "meme_name": any_match(c("file_name"), MEME_NAMES),
            "family_name": any_match(c("file_name"), FAMILY_NAMES),
        }
        self.made = {f"_fact_{k}": v for k, v in given.items()}
        for k in given:
            setattr(self, k, c(f"_fact_{k}"))
        self.size = c("file_size")
        self.png, self.jpeg = c("mime_type") == "image/png", c("mime_type") == "image/jpeg"


def first_rules(f: Facts) -> list[Rule]:
    """Weights, names, conditions and their order."""
    lens = F.coalesce(f.focal, F.lit(float("nan")))  # no comparison below holds for a missing length
    given = f.focal.isNotNull()
    portrait = given & F.exists(F.array(*(F.lit(float(x)) for x in PORTRAIT_LENGTHS)), lambda x: F.abs(lens - x) < 5)
    return [
        Rule("document", 0.18, "png_no_camera", f.png & ~f.camera),
        Rule("document", 0.15, "screen_resolution", f.screen & ~f.camera),
        Rule("document", 0.45, "document_filename", f.document_name),
        Rule("document", 0.10, "no_metadata", ~f.gps & ~f.camera),
        Rule("document", 0.08, "low_compression_ratio", f.png & (f.bpp > 0) & (f.bpp < 1.5)),
        Rule("document", -0.25, "camera_penalty", f.camera & ~f.document_name),
        Rule("document", -0.10, "gps_penalty", f.gps),
        Rule("document", -0.08, "jpeg_photo_bias_penalty", f.jpeg & ~f.document_name),
        Rule("meme", 0.15, "no_camera_metadata", ~f.camera & ~f.gps),
        Rule("meme", 0.15, "small_file_size", (f.size > 0) & (f.size < 500_000)),
        Rule("meme", 0.10, "low_resolution", (f.mp > 0) & (f.mp < 2.0)),
        Rule("meme", 0.15, "high_jpeg_compression", f.jpeg & (f.bpp > 0) & (f.bpp < 0.5)),
        Rule("meme", 0.30, "meme_filename", f.meme_name),
        Rule("meme", 0.10, "square_aspect", (f.aspect > 0.8) & (f.aspect < 1.25) & (f.mp < 3)),
        Rule("nature", 0.12, "has_gps", f.gps),
        Rule("nature", 0.06, "has_camera", f.camera),
        Rule("nature", 0.08, "no_flash", f.camera & ~f.flash),
        Rule("nature", 0.15, "landscape_orientation", f.aspect > 1.3),
        Rule("nature", 0.08, "high_resolution", f.mp >= 8),
        Rule("nature", 0.14, "wide_angle", given & (f.focal <= 35)),
        Rule("nature", 0.05, "large_file", f.size > 3_000_000),
        Rule("nature", -0.18, "flash_penalty", f.flash),
        Rule("nature", -0.12, "portrait_penalty", f.aspect < 1.0),
        Rule("nature", -0.08, "telephoto_penalty", given & (f.focal >= 60)),
        Rule("family", 0.10, "has_camera", f.camera),
        Rule("family", 0.15, "portrait_orientation", f.aspect < 0.85),
        Rule("family", 0.08, "human_photo_aspect", (f.aspect >= 0.85) & (f.aspect <= 1.45)),
        Rule("family", 0.18, "flash_used", f.flash),
        Rule("family", 0.18, "portrait_focal_length", portrait),
        Rule("family", 0.10, "has_date", f.dated),
        Rule("family", 0.20, "family_filename", f.family_name),
        Rule("family", 0.10, "high_quality", (f.mp >= 5) & (f.size > 1_000_000)),
        Rule("family", 0.05, "gps_with_camera", f.gps & f.camera),
        Rule("family", 0.08, "phone_export_people_bias", ~f.camera & (f.mp >= 2.0) & (f.aspect >= 0.75) & (f.aspect <= 1.5)),
        Rule("object", 0.05, "default_category", F.lit(True)),
        Rule("object", 0.15, "square_with_camera", (f.aspect > 0.9) & (f.aspect < 1.1) & f.camera),
        Rule("object", 0.05, "medium_resolution", (f.mp >= 2) & (f.mp < 8)),
    ]


def second_rules(f: Facts) -> list[list[Rule]]:
    """Calibrations; those of a later list see the scores that the earlier ones left in ``s_<category>``."""
    long_lens = f.focal.isNotNull() & (f.focal >= 50)
    return [
        [
            Rule("document", -0.18, "doc_without_filename_penalty", ~f.document_name & (F.col("s_document") > 0.45)),
            Rule("document", -0.10, "jpeg_document_penalty", f.jpeg & ~f.document_name & (f.mp >= 1.5)),
            Rule("nature", -0.12, "nature_context_penalty", f.flash | long_lens | (f.aspect < 1.15)),
            Rule("family", 0.07, "family_indoor_camera_bias", f.camera & ~f.gps & (f.aspect <= 1.45)),
        ],
        [Rule("family", 0.05, "family_close_competitor_boost", f.camera & f.gps & (F.col("s_nature") > 0.35) & (F.col("s_family") > 0.30))],
    ]


def apply_rules(df: DataFrame, rules: list[Rule], start: bool) -> DataFrame:
    made = {}
    for category in CATEGORIES:
        own = [r for r in rules if r.category == category]
        score, names = f"s_{category}", f"i_{category}"
        before = F.lit(0.0) if start else F.col(score)
        made[score] = total([before, *(F.when(r.holds, F.lit(r.weight)).otherwise(F.lit(0.0)) for r in own)])
        fired = F.array_compact(F.array(*(F.when(r.holds, F.lit(r.name)) for r in own))) if own else F.array().cast("array<string>")
        made[names] = fired if start else F.concat(F.col(names), fired)
    return df.withColumns(made)


def scores(photos: DataFrame) -> DataFrame:
    """Of each photo: s_<category> in [0, 1] and i_<category>, the names of the rules that held.

    photos: file_name, mime_type, file_size, width, height, make, model,
    has_gps, flash, focal_length, focal_35mm, date_original.
    """
    f = Facts()
    out = apply_rules(photos.withColumns(f.made), first_rules(f), True)
    for rules in second_rules(f):
        out = apply_rules(out, rules, False)
    return out.withColumns({f"s_{c}": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"s_{c}"))) for c in CATEGORIES}).drop(*f.made)


def best(scored: DataFrame) -> DataFrame:
    """category, confidence and indicators; equal scores go to the category declared first, all zero to object."""
    ranked = F.array(*(F.struct(F.col(f"s_{c}").alias("score"), F.lit(-k).alias("order"), F.lit(c).alias("category"), F.col(f"i_{c}").alias("names")) for k, c in enumerate(CATEGORIES)))
    top = F.array_max(ranked)
    fallback = F.array(F.lit("heuristic_fallback"))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.lit("object").alias("category"), F.col("i_object").alias("names"))
    out = scored.withColumn("_top", top).withColumn("_top", F.when(F.col("_top.score") > 0, F.col("_top")).otherwise(none))
    return out.withColumns({"category": F.col("_top.category"), "confidence": F.col("_top.score"), "indicators": F.concat("_top.names", fallback)}).drop("_top", *(f"{x}_{c}" for c in CATEGORIES for x in "si"))


def merge_model(heuristic: DataFrame, answers: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The model's answer where it is acceptable, else the rules' one.

    answers: user_id, file_id, category, confidence, model,
    algorithm_version, labels (array of name and score).
    """
    a = {c: F.col(f"a.{c}") for c in ("category", "confidence", "model", "algorithm_version", "labels")}
    accepted = a["category"].isin(*CATEGORIES) & (a["confidence"] >= config.ml_min_confidence) & (a["confidence"] <= 1.0)
    shown = lambda s: F.format_string("%.3f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    named = F.filter(F.coalesce(a["labels"], F.array().cast("array<struct<name:string,score:double>>")), lambda x: (F.trim(x["name"]) != "") & x["score"].isNotNull())
    labels = F.transform(named, lambda x: F.concat(F.lit("ml_label:"), F.trim(x["name"]), F.lit(":"), shown(x["score"])))
    version = F.trim(F.coalesce(a["algorithm_version"], F.lit("")))
    head = F.array_compact(F.array(F.lit("ml_inference"), F.concat(F.lit("ml_model:"), F.trim(F.coalesce(a["model"], F.lit("external_ml")))), F.when(version != "", F.concat(F.lit("ml_algo:"), version))))
    joined = heuristic.alias("h").join(answers.alias("a"), ["user_id", "file_id"], "left")
    rest = [F.col(f"h.{c}") for c in heuristic.columns if c not in ("user_id", "file_id", "category", "confidence", "indicators")]
    return joined.select(
        "user_id", "file_id", *rest,
        F.when(accepted, a["category"]).otherwise(F.col("h.category")).alias("category"),
        F.when(accepted, a["confidence"]).otherwise(F.col("h.confidence")).alias("confidence"),
        F.when(accepted, F.concat(head, labels)).otherwise(F.col("h.indicators")).alias("indicators"),
    )


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("count"))


def count_of(rows: DataFrame, category: str) -> DataFrame:
    """Per user, how many files are of a category."""
    return rows.where(F.col("category") == category).groupBy("user_id").agg(F.count("*").alias("count"))


def all_counts(rows: DataFrame) -> DataFrame:
    """Each category in declared order, with 0 where it has no file, and the total."""
    found = {c: F.count_if(F.col("category") == c) for c in CATEGORIES}
    one = rows.agg(F.count("*").alias("total"), *(n.alias(c) for c, n in found.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(c).alias("category"), F.col(c).alias("count")) for k, c in enumerate(CATEGORIES)))
    return one.select("total", F.explode(pairs).alias("x")).select("x.ord", "x.category", "x.count", "total")


def category_page(rows: DataFrame, category: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Files of a category by confidence; no rows for a category that doesn't exist."""
    limit, offset = page_of(limit, offset)
    return rows.where((F.col("category") == category) & F.col("category").isin(*CATEGORIES)).orderBy(F.desc("confidence"), "file_id").offset(offset).limit(limit)


# --- the model worker's answer, from the scores of prompts ---


def prompt_answers(prompt_scores: DataFrame, prompts: DataFrame, bias: float = 1.0) -> DataFrame:
    """file_id, category, confidence and the five best labels.

    prompt_scores: file_id, prompt, score.  prompts: prompt, category,
    ord (of the category), rank (of the prompt).  A category is as good as
    its best prompt; the first category wins ties.
    """
    rows = prompt_scores.join(prompts, "prompt")
    tops = rows.groupBy("file_id", "category", "ord").agg(F.max("score").alias("top"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top") * F.lit(bias)))
    winner = tops.groupBy("file_id").agg(F.max(F.struct(scaled.alias("score"), (-F.col("ord")).alias("ord"), "category")).alias("w"))
    label = F.struct((-F.bround("score", 4)).alias("neg"), "rank", F.translate("prompt", " ", "_").alias("name"))
    labels = rows.groupBy("file_id").agg(F.slice(F.array_sort(F.collect_list(label)), 1, 5).alias("ls"))
    out = winner.join(labels, "file_id")
    return out.select("file_id", "w.category", F.bround("w.score", 4).alias("confidence"), F.transform("ls", lambda x: F.struct(x["name"].alias("name"), (-x["neg"]).alias("score"))).alias("labels"))


def prompts_of(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Prompts of the wanted labels (label, pos): trimmed, lower-cased, once each; an unknown label is its own prompt.

    known: category, prompt, pos.
    """
    clean = known.select("category", F.lower(F.trim("prompt")).alias("prompt"), "pos").where("prompt <> ''").groupBy("category", "prompt").agg(F.min("pos").alias("pos"))
    joined = wanted.alias("w").join(clean.alias("k"), F.col("w.label") == F.col("k.category"), "left")
    return joined.select(F.col("w.label").alias("category"), F.coalesce("k.prompt", "w.label").alias("prompt"), F.col("w.pos").alias("ord"), F.coalesce("k.pos", F.lit(0)).alias("pos"))
