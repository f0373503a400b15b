"""The queries of this subpackage and their SQL, as the driver's entry module adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, table, texts_of


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    path = vocabulary("byte_bpe_50k.json")
    out = bpe.round_trip(texts_of(table(spark, sf_dir, "documents")), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import counts

    return counts.count(texts_of(table(spark, sf_dir, "documents")), vocabulary("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract(table(spark, sf_dir, "pages"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    scratch = Scratch(spark, "media")
    try:
        media.write_archive(media.texts_to_images(texts_of(table(spark, sf_dir, "documents"))), scratch.path("archives"))
        return scratch.put(media.image_columns(media.read_archive(spark, scratch.path("archives"))), "columns")
    finally:
        scratch.drop("archives")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near

    return near.link(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    out = pii.find(table(spark, sf_dir, "documents"), pii.learn(spark))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(pii.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.spelled(F.col("spans")).alias("spans"),
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    out = lines.clean(table(spark, sf_dir, "documents"))
    return out.drop("cleaned", "lost")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    out = quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import codes

    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audit

    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(probe), vocabulary("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_counts": op2_counts,
    "op3_packing": op3_packing,
    "op4_html": op4_html,
    "op5_media": op5_media,
    "op6_language": op6_language,
    "op7_near": op7_near,
    "op8_pii": op8_pii,
    "op9_lines": op9_lines,
    "op10_quality": op10_quality,
    "op11_codes": op11_codes,
    "op12_audit": op12_audit,
    "op13_chat": op13_chat,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLE

    return dict(ORACLE)
