"""Sums and nearest vectors in bulk, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import people, vectors


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_sums_are_those_of_numpy(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(int(k % 7) if k % 7 else None, f"g{k % 3}", r.normal(size=3 + k % 7).tolist()) for k in range(400)] + [(1, "g1", None)]
    want = {}
    for a, b, v in rows:
        if v:
            want[a, b] = want.get((a, b), 0) + np.array(v)
    df = spark.createDataFrame(rows, "a long, b string, vector array<double>").repartition(5)
    for held in (4096, 2):  # few keys at once
        monkeypatch.setattr(vectors, "HELD", held)
        got = {(x.a, x.b): x.total for x in vectors.sums(df, ["a", "b"]).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert vectors.sums(df.where("false"), ["a", "b"]).count() == 0
    plan = vectors.sums(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


KIND = "owner string, ord long, name string, vector array<double>"
ROWS = "key string, owner string, vector array<double>"


@pytest.mark.parametrize("size,spread", [(1024, 100_000), (40, 30)])
def test_nearest_two_are_those_of_all_pairs(spark, monkeypatch, size, spread):
    monkeypatch.setattr(vectors, "SPREAD", spread)
    r = np.random.default_rng(size)
    centres = unit(r.normal(size=(30, 16)))
    known = unit(centres[r.integers(0, 30, 400)] + 0.15 * r.normal(size=(400, 16)))
    known[200] = known[7]  # equals: the first wins
    asked = unit(np.vstack([known[r.integers(0, 400, 120)] + 0.1 * r.normal(size=(120, 16)), r.normal(size=(60, 16)), known[[7, 200]]]))
    people_ = [("u" if k < 380 else "v", k, f"p{k}", v.tolist()) for k, v in enumerate(known)]
    people_ += [("u", 900, "short", [1.0, 0.0]), ("w", 901, "alone", [0.0, 1.0])]
    rows = [(f"r{k}", "u" if k % 4 else "v", v.tolist()) for k, v in enumerate(asked)] + [("s1", "u", [1.0, 0.0]), ("s2", "u", [0.0, 1.0, 0.0]), ("s3", "w", [0.6, 0.8]), ("s4", "x", [1.0, 0.0]), ("s5", "u", None)]
    least = 0.7
    want = {}
    for key, owner, v in rows:
        scores = sorted(((float(np.dot(v, x)), -n, name) for o, n, name, x in people_ if o == owner and v and len(x) == len(v)), reverse=True)
        scores = [s for s in scores if s[0] >= least]
        if scores:
            want[key] = (scores[0][2], scores[0][0], scores[1][0] if len(scores) > 1 else None)
    found = vectors.nearest_two(spark.createDataFrame(rows, ROWS), spark.createDataFrame(people_, KIND), "owner", "key", least, size)
    got = {x.key: (x["name"], x.score, x.second) for x in found.collect()}
    assert set(got) == set(want) and len(want) > 100
    for key, (name, score, second) in want.items():
        assert got[key][0] == name and abs(got[key][1] - score) < 1e-9
        assert abs(got[key][2] - second) < 1e-9 if second is not None else got[key][2] < least
    if size == 40:
        chunks = vectors.chunked(spark.createDataFrame(people_, KIND), "owner", size)
        assert chunks.select("owner", "dim", "chunk").distinct().count() > 10
        assert chunks.groupBy("owner", "dim", "chunk").count().agg(F.max("count")).first()[0] <= 3 * size


def test_many_people_of_one_user(spark):
    """No array of all of a user's people; each face visits the chunks within its reach alone."""
    r = np.random.default_rng(5)
    centres = unit(r.normal(size=(6000, 24)))
    known = spark.createDataFrame([("u", k, f"p{k}", v.tolist()) for k, v in enumerate(centres)], KIND)
    picks = r.integers(0, 6000, 150)
    rows = spark.createDataFrame([(f"r{k}", "u", unit(centres[p] + 0.02 * r.normal(size=24)).tolist()) for k, p in enumerate(picks)], ROWS)
    got = {x.key: x["name"] for x in vectors.nearest_two(rows, known, "owner", "key", 0.95, 200).collect()}
    assert got == {f"r{k}": f"p{p}" for k, p in enumerate(picks)}


def test_faces_go_to_people_as_by_all_pairs(spark):
    from shoebox.plans import catalogue

    faces, refs, centres = catalogue.people_tables(spark, "/root/testdata/sf0.001")
    plan = people.assigned(faces, refs, centres)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "CartesianProduct" not in plan
