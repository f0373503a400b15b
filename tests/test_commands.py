"""Commands over folders: what they index, report, lose and refuse."""

import http.server
import json
import struct
import threading

import pytest
from pyspark.sql import functions as F

from shoebox import __main__ as commands
from shoebox.sources import ranges
from shoebox.streaming import progress


@pytest.fixture
def place(spark, tmp_path):
    root = tmp_path / "files"

    class Place:
        files, tables = root, commands.Index(spark, str(tmp_path / "index"))

        def put(self, **texts):
            for name, text in texts.items():
                path = root / name.replace("__", "/").replace("_dot_", ".")
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(text if isinstance(text, bytes) else text.encode())

        def run(self, *words, files=None):
            return commands.run(spark, commands.arguments().parse_args([*words, "--index", str(tmp_path / "index"), "--files", str(files or root)]))

        def paths(self, table=None):
            return sorted(f"{r.user_id}:{r.file_path}" for r in (table or self.tables.hashes).read().collect())

    return Place()


def test_scans_keep_other_rows_and_drop_stale_ones(place, monkeypatch, capsys):
    place.put(Docs__a_dot_txt="x", Photos__b_dot_jpg="x", Photos__c_dot_jpg="y", Photos__empty_dot_jpg="")
    (place.files / ".trash").mkdir()
    (place.files / ".trash/d.jpg").write_text("x")
    assert place.run("scan", "u") == 0
    rows = ["u:Docs/a.txt", "u:Photos/b.jpg", "u:Photos/c.jpg"]
    assert place.paths() == rows and "Total: 3 | Hashed: 3 | Skipped: 0 | Errors: 0" in capsys.readouterr().out
    # Only what changed is read again.
    place.put(Photos__c_dot_jpg="longer")
    real, asked = ranges.hashed, []
    monkeypatch.setattr(ranges, "hashed", lambda files, **k: asked.append(files) or real(files, **k))
    assert place.run("scan", "u") == 0 and "Total: 3 | Hashed: 1 | Skipped: 2 | Errors: 0" in capsys.readouterr().out
    assert place.run("scan", "u", "--force") == 0 and "Hashed: 3 | Skipped: 0" in capsys.readouterr().out
    # A scope is for showing; a cleanup with one loses no rows outside it.
    assert place.run("cleanup", "u", "--scope", "photos") == 0 and place.paths() == rows
    place.run("stats", "u", "--scope", "photos")
    place.run("groups", "u")
    assert "duplicate_groups" in capsys.readouterr().out
    # One of two copies goes; the cleanup looks at files of groups.
    (place.files / "Photos/b.jpg").unlink()
    assert place.run("cleanup", "u") == 0 and place.paths() == [rows[0], rows[2]]
    # An emptied folder leaves no rows; a missing one changes none.
    for path in (place.files / "Docs/a.txt", place.files / "Photos/c.jpg", place.files / "Photos/empty.jpg"):
        path.unlink()
    assert place.run("scan", "u", files=place.files / "nowhere") == 1 and place.paths() == [rows[0], rows[2]]
    assert place.tables.progress.get("u", "scan")["status"] == "error"
    assert place.run("scan", "u") == 0 and place.paths() == []


def test_all_users_and_exit_codes(place, capsys):
    place.put(ann__Photos__a_dot_jpg="x", bob__b_dot_jpg="y", bob__c_dot_txt="z")
    assert place.run("scan") == 1 and place.run("scan", "ann", "--all") == 1
    assert place.run("scan", "--all") == 0 and place.paths() == ["ann:Photos/a.jpg", "bob:b.jpg", "bob:c.txt"]
    (place.files / "ann/Photos/a.jpg").unlink()
    assert place.run("scan", "ann", files=place.files / "ann") == 0 and place.paths() == ["bob:b.jpg", "bob:c.txt"]
    # A file that can't be read is an error, its old row stays, and the code is 1.
    place.put(bob__b_dot_jpg="changed")
    (place.files / "bob/b.jpg").chmod(0)
    import os

    if os.geteuid() != 0:
        assert place.run("scan", "--all") == 1 and place.paths() == ["bob:b.jpg", "bob:c.txt"]
    (place.files / "bob/b.jpg").chmod(0o644)
    capsys.readouterr()


def picture(make=b"Cam\0", gps=True):
    """A JPEG header with a camera and a position."""
    rational = lambda *v: b"".join(struct.pack("<II", x, 1) for x in v)
    entries = [(0x010F, 2, 4, make)] + ([(0x8825, 4, 1, None)] if gps else [])
    at = 8 + 2 + 12 * len(entries) + 4
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI4s", t, k, n, v if v is not None else struct.pack("<I", at)) for t, k, n, v in entries) + bytes(4)
    tags = b""
    if gps:
        data = at + 2 + 12 * 4 + 4
        four = [(1, 2, 2, b"N\0\0\0"), (2, 5, 3, struct.pack("<I", data)), (3, 2, 2, b"W\0\0\0"), (4, 5, 3, struct.pack("<I", data + 24))]
        tags = struct.pack("<H", 4) + b"".join(struct.pack("<HHI4s", *x) for x in four) + bytes(4) + rational(10, 30, 0) + rational(20, 15, 0)
    app1 = b"Exif\0\0II*\0" + struct.pack("<I", 8) + ifd + tags
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + bytes(10) + b"\xff\xda\0\2"


def test_classes_and_places(place, capsys):
    place.put(a_dot_jpg=picture(), b_dot_jpg=picture(gps=False), c_dot_txt="no image", d_dot_png="broken")
    assert place.run("gps", "u") == 0 and "Total: 3 | Scanned: 3 | Skipped: 0 | Errors: 0 | With location: 1" in capsys.readouterr().out
    assert [(r.lat, r.lng) for r in place.tables.locations.read().where("has_location").collect()] == [(10.5, -20.25)]
    assert place.run("classify", "u") == 0 and place.paths(place.tables.classes) == ["u:a.jpg", "u:b.jpg", "u:d.png"]
    place.put(b_dot_jpg=picture())  # any row will do for classes, a new time counts for places
    assert place.run("classify", "u") == 0 and "Classified: 0 | Skipped: 3" in capsys.readouterr().out


class Worker(http.server.BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Worker.calls.append((self.path, self.headers.get("Authorization")))
        name = b"two" if b"two faces" in body else b"bad" if b"bad file" in body else b"none"
        status = 422 if name == b"bad" else 503 if name == b"two" and len(Worker.calls) == 1 else 200
        answer = {"has_face": True, "faces": [{"signature": "s1", "confidence": 0.9}, {"signature": "s2", "confidence": 0.8}, {"signature": "s3", "confidence": 0.1}]} if name == b"two" else {"has_face": False}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode() if status == 200 else b"")

    def log_message(self, *_):
        pass


def test_people_by_a_worker(place, capsys):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Worker)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        place.put(a_dot_jpg="two faces", b_dot_jpg="nobody", c_dot_jpg="bad file")
        words = ("people", "u", "--worker", f"http://127.0.0.1:{server.server_port}", "--token", "t")
        assert place.run(*words) == 1  # one file is refused
        assert "Total: 3 | Scanned: 2 | Skipped: 0 | Errors: 1 | With face: 1" in capsys.readouterr().out
        assert sorted((r.file_path, r.face_index, r.face_signature) for r in place.tables.faces.read().collect()) == [("a.jpg", 1, "s1"), ("a.jpg", 2, "s2")]
        assert {c for c in Worker.calls} == {("/face-signature", "Bearer t")}
        (place.files / "c.jpg").unlink()
        assert place.run(*words) == 0 and "Scanned: 0 | Skipped: 2 | Errors: 0" in capsys.readouterr().out
        (place.files / "a.jpg").unlink()
        assert place.run(*words) == 0 and place.tables.faces.read().count() == 0 and place.paths(place.tables.face_files) == ["u:b.jpg"]
    finally:
        server.shutdown()


def test_progress_is_there_while_a_scan_runs(spark, tmp_path):
    store = progress.Store(spark, str(tmp_path / "p"))
    assert store.get("u/ü", "scan") == {"status": "idle", "total": 0, "processed": 0, "updated_at": "", "may_start": True}
    seen = []

    def report(n):
        store.put("u/ü", "scan", "scanning", 500, n)
        seen.append(store.get("u/ü", "scan"))

    work = spark.range(500).select(F.col("id").cast("string").alias("path"))
    found = progress.in_steps(work, lambda w: w.withColumn("x", F.length("path")), report, "test", every=100)
    assert found.count() == 500 and found.agg(F.countDistinct("path")).first()[0] == 500
    counts = [s["processed"] for s in seen]
    assert counts == sorted(counts) and counts[-1] == 500 and any(0 < n < 500 for n in counts)
    assert all(s["status"] == "scanning" and not s["may_start"] for s in seen)  # a second scan is refused
    store.put("u/ü", "scan", "completed", 500, 500)
    assert store.get("u/ü", "scan")["may_start"]
