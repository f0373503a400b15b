"""Small tables of awkward rows, shared by the tests of this folder."""

import random

LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 8))) for _ in range(n))


def awkward():
    """Null and empty values, repeated rows, ties, long and odd texts."""
    texts = [None, "", " ", "\n\n", "é", "a", LONG, "x" * 20_000, prose(1), prose(1), prose(2), "<|endoftext|> <|startoftext|> b", "\x00 \x85　​'Tis 1² \U0001f642", "1234 !!! ###", "漢字 абв"]
    rows = [(k, t, "en" if t and k % 2 else None, None, None) for k, t in enumerate(texts)]
    return [*rows, (None, prose(3), "en", "s", 1), (8, prose(1), "en", "s", 1), (8, prose(1), "en", "s", 1)]


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if extra:  # names that operators use themselves
        from pyspark.sql import functions as F

        for name in ("ids", "shard", "kept", "score", "set_id", "words", "lines", "spans", "base", "registers", "rep", "payload", "name"):
            df = df.withColumn(name, F.lit("clash"))
    return df
