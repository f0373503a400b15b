"""Every query against its SQL in DuckDB, on the smallest corpus."""

import glob
import math
import os

import duckdb
import pytest

from shoebox.plans import catalogue

SF = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert rows == sorted(tuple(map(shown, r)) for r in expected.select(*(f'"{c}"' for c in columns)).fetchall())


def test_other_queries_are_few():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"perceptual_hashes"}
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_perceptual_hashes(spark):
    """Against the sums of the transform, written out."""
    import numpy as np

    from shoebox.operators import signatures

    r = np.random.default_rng(3)
    pictures = [r.integers(0, 256, 4096).astype(np.uint8).tobytes() for _ in range(3)] + [bytes(4096)]
    for raw in pictures:
        x = np.frombuffer(raw, np.uint8).reshape(64, 64).astype(float)
        low = np.array([[sum(4 * x[m, n] * math.cos(math.pi * i * (2 * m + 1) / 128) * math.cos(math.pi * j * (2 * n + 1) / 128) for m in range(64) for n in range(64)) for j in range(16)] for i in range(2)])
        got = signatures.perceptual_hash(raw)
        bits = bin(int(got, 16))[2:].zfill(256)
        full = signatures.cosines() @ x @ signatures.cosines().T
        assert np.allclose(full[:2], low, atol=1e-6)
        assert bits[:32] == "".join("1" if v > np.median(full) else "0" for v in full[:2].reshape(-1))
    assert signatures.perceptual_hash(b"abc") is None and signatures.perceptual_hash(None) is None
    assert signatures.perceptual_hashes([None, pictures[0], b"abc", pictures[1]]) == [None, signatures.perceptual_hash(pictures[0]), None, signatures.perceptual_hash(pictures[1])]


def test_perceptual_hashes_of_the_table(spark):
    """Every row, with the transform as plain sums."""
    import numpy as np
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet")
    i = np.arange(4096)
    wave = lambda n: np.array([[math.cos(math.pi * k * (2 * m + 1) / 128) for m in range(64)] for k in range(n)])
    expected = {}
    for vec_id, v in zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist()):
        x = np.abs(np.array(v, np.float32).astype(float))
        samples = (np.floor(x[i % 64] * 997 + x[i // 64 % 64] * 31).astype(int) % 256).reshape(64, 64)
        low = np.einsum("mn,im,jn->ij", samples * 4.0, wave(16), wave(16))
        bits = "".join("1" if y > np.median(low) else "0" for y in low.reshape(-1))
        expected[vec_id] = f"{int(bits, 2):064x}"
    rows = {x.vec_id: x.face_signature for x in catalogue.queries()["perceptual_hashes"](spark, SF).collect()}
    assert rows == expected and len(set(rows.values())) > 1


def test_greedy_suppression(spark):
    """face_nms against the loop over boxes by area."""
    import pyarrow.parquet as pq

    ids = pq.read_table(f"{SF}/embeddings.parquet").column("vec_id").to_pylist()
    boxes = {}
    for k in ids:
        boxes.setdefault(k % 40, []).append((k * 37 % 200, k * 53 % 150, k * 7 % 60 + 40, k * 11 % 60 + 40))

    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    expected = set()
    for f, own in boxes.items():
        kept = []
        for b in sorted(own, key=lambda b: (-b[2] * b[3], b)):
            if all(iou(b, k) < 0.35 for k in kept):
                kept.append(b)
                expected.add((f, len(kept), *b))
    got = {(r.file_id, r.face_index, r.x, r.y, r.w, r.h) for r in catalogue.queries()["face_nms"](spark, SF).collect()}
    assert got == expected
