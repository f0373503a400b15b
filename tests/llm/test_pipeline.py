"""The stages in a row."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [n for n, _ in corpus_pipeline.STAGES]
    assert seen == ["language", "quality", "near", "pii", "pack"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and (after == before if name == "pii" else True)
        kept = out.persist()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    bad = [d for d, q in labels.items() if q == 0 and d in ids]
    assert len(bad) <= 0.1 * max(1, sum(q == 0 for q in labels.values()))
    import re

    assert not [r for r in kept.collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)]


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = out.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert sums and all(r["sum(length)"] == r.doc_tokens for r in sums)


def brute_pack_sums(rows):
    """Tokens of each document that is packed."""
    from shoebox.llm import packing, words

    model = words.word_bpe(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    return sorted((str(d), len(packing.encoded([t or ""], corpus_pipeline.vocabulary("word_bpe_49k.json"))[0]) // 2) for d, t in rows)


def stages_of(spark, rows, sf_dir):
    """What each stage keeps of awkward rows, and their columns."""
    docs, out = rows, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out[name] = docs.columns, docs.collect()
    return out


def test_stages_on_awkward_rows(spark, tmp_path):
    """Each stage against its rule in Python, with nulls, repeats, long texts, clashing names and no rows."""
    from data import LONG, awkward, frame, prose
    from test_columns import base
    from test_near import brute

    from shoebox.llm import language, quality

    sf = str(tmp_path)
    rows = awkward() + [(30 + k, prose(60 + k) + ". call a.b@c.de or 1.2.3.4", "en", "s", 1) for k in range(12)] + [(60, None, "en", None, None), (61, "ωψφ χυτ " * 20, None, None, None)]
    spark.createDataFrame([(30 + k, 1) for k in range(12)] + [(1, 0), (2, 0)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs = frame(spark, rows, extra=True)
    found = stages_of(spark, docs, sf)
    for name in ("language", "quality", "near", "pii"):
        assert found[name][0] == docs.columns
    profiles = language.learn(docs)
    limit = language.limit_of(docs, profiles)
    key = lambda r: str((r[0], r[1]))
    after = sorted(((r.doc_id, r.text) for r in found["language"][1]), key=str)
    expected = [(d, t) for d, t, *_ in rows if profiles.compare(t)[0] != "und" and profiles.compare(t)[2] <= limit]
    assert after == sorted(expected, key=str) and LONG in {t for _, t in after} and (61, "ωψφ χυτ " * 20) not in after
    kept = spark.createDataFrame([(*r,) for r in found["language"][1]], docs.schema)
    model = quality.learn(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {after[r.doc_id]: r.score for r in quality.scored(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(after)], "doc_id long, text string"), model).collect()}
    assert sorted(((r.doc_id, r.text) for r in found["quality"][1]), key=str) == sorted([x for x in after if scores[x] >= quality.GOOD], key=str)
    left = [(r.doc_id, r.text, None, None, None) for r in found["quality"][1]]
    components = {(c, d) for d, n, c, k in brute(left) if k}
    assert len(found["near"][1]) == len(components)
    for before, now in zip(sorted(found["near"][1], key=key), sorted(found["pii"][1], key=key)):
        assert before.doc_id == now.doc_id and not base(now.text) and (before.text == now.text or base(before.text))
    packed = {}
    for r in found["pack"][1]:
        packed[str(r.doc_id), r.doc_tokens] = packed.get((str(r.doc_id), r.doc_tokens), 0) + r.length
    assert sorted(packed) == sorted(set(brute_pack_sums([(r.doc_id, r.text) for r in found["pii"][1]]))) and all(n == total for (_, total), n in packed.items())
    for name, (columns, left) in stages_of(spark, docs.limit(0), sf).items():
        assert left == [] and (columns == docs.columns or name == "pack")
