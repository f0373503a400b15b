"""Near duplicates against all pairs."""

import random

import numpy as np
from data import awkward, frame, prose
from pyspark.sql import functions as F

from shoebox.llm import near
from shoebox.llm.common import Scratch
from shoebox.llm.components import components


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])))
    return out


def brute(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return out


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("edit%d" % r.randrange(999) if r.random() < share else w for w in text.split())


def corpus():
    """A chain of edits, copies of many lengths, and many borderline copies of one text."""
    rows = [(k, prose(k, n), None, None, None) for k, n in enumerate((1, 3, 4, 5, 6, 8, 12, 20, 40, 80, 200, 400))]
    for k in range(12):
        for j in range(6):
            rows.append((len(rows) + 5, edited(rows[k][1], 100 * k + j, (0, 0.01, 0.02, 0.04, 0.06, 0.1)[j]), None, None, None))
    text = prose(77, 150)
    for k in range(60):
        rows.append((1000 - k, edited(text, k, 0.03), None, None, None))
    return rows


def key(t):
    return [(x is not None, x if x is not None else 0) for x in t]


def test_components_are_those_of_all_pairs(spark):
    rows = corpus()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.link(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_awkward_rows(spark):
    rows = awkward()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.link(frame(spark, rows, extra=True)).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert near.link(frame(spark, [])).collect() == []
    kept = near.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x or 0)) == sorted({d for d, _, _, k in brute(rows) if k}, key=lambda x: (x is not None, x or 0))


def borderline(n=40, seed=9):
    """Copies of one text that lie about the threshold from one another."""
    text = prose(31, 120)
    return [(k, edited(text, seed * 1000 + k, 0.028), None, None, None) for k in range(n)]


def test_small_blocks_find_the_same_links(spark, monkeypatch):
    """A bucket cut into blocks links what it links whole."""
    rows = borderline(90) + corpus()[84:]
    expected = sorted(brute(rows), key=key)
    assert len({c for _, _, c, _ in expected}) > 3
    for block_rows, block_chars in ((8192, 1 << 25), (7, 1 << 25), (8192, 3000)):
        monkeypatch.setattr(near, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(near, "BLOCK_CHARS", block_chars)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.link(frame(spark, rows)).collect()), key=key)
        assert got == expected


def test_rows_of_an_open_bucket_grow_linearly(spark):
    """Registers travel once for each block of a bucket, and a bucket of 5000 classes is one block."""
    for n in (1250, 5000):
        rows = spark.range(n).selectExpr("1L AS key", f"CAST(ceil({n} / {near.BLOCK_ROWS}) AS long) AS blocks", "id AS rep")
        assert near.blocks(rows).count() == n
    # 5000 classes of one bucket that don't link: every pair is estimated, no text is fetched.
    r = np.random.default_rng(1)
    registers = np.stack([near.registers(np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))) for _ in range(5000)])
    registers[:, : near.WIDTH] = registers[0, : near.WIDTH]
    bucket = int(near.band_keys(registers[:1])[0, 0])
    made = [(bucket, 1, k, k, 300, 1800, bytearray(x.tobytes())) for k, x in enumerate(registers)]
    df = spark.createDataFrame(made, "key long, blocks long, rep long, component long, n_shingles long, n_chars long, registers binary")
    assert near.open_classes(df).collect() == []


def test_groups_run_over_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    for cuts in ([0, 8], [0, 2, 8], [0, 1, 3, 4, 7, 8], [0, 3, 3, 8]):
        batches = [pa.record_batch([pa.array(keys[a:b], pa.int64())], ["key"]) for a, b in zip(cuts, cuts[1:])]
        assert [t["key"].to_pylist() for t in near.groups(iter(batches), ["key"])] == [[1, 1], [2, 2, 2], [3], [4, 4]]


def test_one_document_of_each_component_stays(spark):
    """An id that stands for several texts neither loses one nor keeps a duplicate, however rows are dealt."""
    a, b, c = prose(51), prose(52), prose(53)
    rows = [(3, b), (8, a), (8, b), (None, c), (None, a), (None, c), (9, ""), (9, ""), (None, None), (8, a)]
    schema = "doc_id long, text string"
    for parts in range(1, 9):
        df = spark.createDataFrame(rows, schema).repartition(parts).withColumns({x: F.lit("clash") for x in ("id", "mark", "unnamed", "component", "rep", "kept")})
        out = near.deduplicate(df)
        assert out.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert got == sorted([(3, b), (8, a), (None, c), (9, ""), (9, ""), (None, None)], key=str)
    assert near.deduplicate(spark.createDataFrame([], schema)).collect() == []


def test_estimates_are_close():
    r = random.Random(3)
    for share in (0.3, 0.5, 0.75, 0.9):
        both = [r.getrandbits(64) for _ in range(int(2000 * share))]
        a, b = (np.unique(np.array(both + [r.getrandbits(64) for _ in range(int(1000 * (1 - share)))], np.uint64)) for _ in range(2))
        ra, rb = near.registers(a), near.registers(b)
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        used = ((ra != 0) | (rb != 0)).sum()
        assert abs(((ra == rb) & (ra != 0)).sum() / used - truth) < 0.12
        assert bool(near.may_link(ra, np.array(len(a)), rb[None], np.array([len(b)]))[0]) == (truth > 0.62) or 0.55 < truth < 0.7


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (159, 158)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.vertex: r.component for r in components(edges, Scratch(spark, "cc"), "t").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert components(edges.limit(0), Scratch(spark, "cc"), "t").collect() == []


def test_rows_without_an_id_meet_by_their_text(spark, monkeypatch):
    """Near copies without ids: each class fetches its own text, and no other."""
    rows = []
    for k in range(1500):
        text = prose(k, 40)
        rows += [(None, text, "en", "s", 1), (None, text + " more", "en", "s", 1)]
    met = []
    real = near.map_slices

    def counted(df, work, schema):
        if schema.startswith("rep long, text string"):
            met.append(df.count())
        return real(df, work, schema)

    monkeypatch.setattr(near, "map_slices", counted)
    found = near.link(frame(spark, rows))
    assert found.where("component_id IS NOT NULL OR NOT kept").count() == 0 and found.count() == 3000
    assert met == [3000]
