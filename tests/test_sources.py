"""Hashes by ranges, and folders as tables and streams."""

import hashlib
import os
import resource
import sys
import time

import pytest
from pyspark.sql import functions as F

from shoebox.sources import folders, ranges


def test_ranges_give_the_digest(spark, tmp_path):
    names = {}
    for k, n in enumerate((0, 1, 63, 64, 1000, 1001, 5000)):
        data = bytes((j * 31 + k) % 256 for j in range(n))
        path = tmp_path / f"a b{k}ü%20.bin"
        path.write_bytes(data)
        names[f"file:{path}" if k % 2 else str(path)] = (hashlib.sha256(data).hexdigest(), n)
    files = spark.createDataFrame([(p, n) for p, (_, n) in names.items()] + [(str(tmp_path / "gone"), 5), (str(tmp_path), 3)], "path string, length long")
    for chunk in (1, 64, 1 << 20):
        got = {r.path: (r.content_hash, r.length, r.outcome) for r in ranges.hashed(files, chunk=chunk, tasks=3).collect()}
        assert {p: v[:2] for p, v in got.items() if v[2] == "done"} == names
        assert got[str(tmp_path / "gone")][2] == got[str(tmp_path)][2] == "error"
    capped = {r.path: r.outcome for r in ranges.hashed(files, most=1000).collect()}
    assert sum(v == "done" for v in capped.values()) == 5
    folder = {r.path.rsplit("/", 1)[1]: r.content_hash for r in ranges.hashed_folder(spark, str(tmp_path), most=1000, chunk=100, split=900).where("outcome = 'done'").collect()}
    assert folder == {p.rsplit("/", 1)[1]: h for p, (h, n) in names.items() if n <= 1000}


def test_a_failed_read_is_taken_up_at_its_offset(tmp_path, monkeypatch):
    path = tmp_path / "x"
    path.write_bytes(bytes(range(256)) * 40)
    fails = [3, 7]

    class Flaky:
        def __init__(self, file):
            self.file, self.n = file, 0

        def seek(self, at):
            return self.file.seek(at)

        def read(self, n):
            self.n += 1
            if fails and self.n == fails[0]:
                fails.pop(0)
                raise OSError("lost")
            return self.file.read(n)

        def close(self):
            self.file.close()

    real = ranges.opened

    def opened(where):
        fs, place = real(where)

        class Fs:
            def open_input_file(self, p):
                return Flaky(fs.open_input_file(p))

        return Fs(), place

    monkeypatch.setattr(ranges, "opened", opened)
    assert ranges.digest_of(str(path), 1000) == (hashlib.sha256(path.read_bytes()).hexdigest(), 10240) and not fails
    fails[:] = [1, 1, 1]
    with pytest.raises(OSError):
        ranges.digest_of(str(path), 1000)


def test_a_large_file_costs_little_memory(tmp_path):
    """3 GB, sparse, in a process of its own."""
    path = tmp_path / "large"
    with path.open("wb") as f:
        f.truncate(3 << 30)
    code = f"import resource, sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(__file__))!r})\nfrom shoebox.sources import ranges\nbase = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nprint(*ranges.digest_of({str(path)!r}), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)"
    import subprocess

    h, n, kib = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    zero, state = bytes(1 << 20), hashlib.sha256()
    for _ in range(3 << 10):
        state.update(zero)
    assert (h, int(n)) == (state.hexdigest(), 3 << 30) and int(kib) < 200 << 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0


def tree(root):
    for name in ("a.jpg", "x/b.jpg", "x/y/c.jpg", "x/y/z/d.jpg", "x/.trash/e.jpg", ".versions/f.jpg", "w w/ü.png"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


def test_folders_as_a_table(spark, tmp_path):
    tree(tmp_path)
    seen = ["a.jpg", "w w/ü.png", "x/b.jpg", "x/y/c.jpg", "x/y/z/d.jpg"]
    for depth in (0, 1, 2, 5):
        for root in (str(tmp_path), f"file:{tmp_path}/"):
            rows = folders.read_folders(spark, root, depth).collect()
            assert sorted(r.path for r in rows) == [f"{root.rstrip('/')}/{x}" for x in seen] and {r.change for r in rows} == {"added"}
    assert folders.read_folders(spark, str(tmp_path / "nothing")).count() == 0


def test_folders_as_a_stream(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    tree(root)
    place = {"n": 0}

    def batch():
        """What one more trigger brings."""
        out, place["n"] = str(tmp_path / f"out{place['n']}"), place["n"] + 1
        stream = folders.stream_folders(spark, str(root), str(tmp_path / "state"), depth=1)
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        rows = spark.read.schema(folders.SCHEMA).parquet(out).collect() if os.path.exists(out) else []
        return sorted((r.path[len(str(root)) + 1 :], r.change) for r in rows)

    assert batch() == [(x, "added") for x in ("a.jpg", "w w/ü.png", "x/b.jpg", "x/y/c.jpg", "x/y/z/d.jpg")]
    assert batch() == []
    time.sleep(0.01)
    (root / "a.jpg").write_text("longer")
    (root / "x/y/c.jpg").unlink()
    (root / "new").mkdir()
    (root / "new/g.jpg").write_text("g")
    (root / "w w/ü.png").unlink()
    (root / "w w").rmdir()
    assert batch() == [("a.jpg", "changed"), ("new/g.jpg", "added"), ("w w/ü.png", "removed"), ("x/y/c.jpg", "removed")]
    (root / "w w").mkdir()
    (root / "w w/ü.png").write_text("again")
    assert batch() == [("w w/ü.png", "added")]


def test_a_repeated_trigger_gives_the_same_rows(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    tree(root)
    reader = folders.TreeStream(folders.Tree({"path": str(root), "state": str(tmp_path / "state"), "depth": "0"}))

    def rows(start, end):
        return sorted(r for p in reader.partitions({"at": start}, {"at": end}) for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns)))

    first = rows(0, 10)
    (root / "a.jpg").unlink()
    assert rows(0, 10) == first and len(first) == 5
    assert [r[3] for r in rows(10, 20)] == ["removed"]
    assert [r[3] for r in rows(10, 20)] == ["removed"] and rows(20, 30) == []
