"""The index kept current by a stream, and states with timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators.snapshots import IndexTable
from shoebox.plans import schema
from shoebox.streaming import events as upkeep
from shoebox.streaming import timers

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(n, user, file, op, path="Photos/a.jpg", size=5, mime="image/jpeg", mtime=None, at=None):
    return (user, file, n, T0 + dt.timedelta(seconds=n if at is None else at), op, path, size, mime, f"h{n}", n if mtime is None else mtime)


def replay(base, log):
    """One event after another: base and the result map (user, file) to (path, hash, size, mtime)."""
    rows = dict(base)
    for user, file, _, _, op, path, size, mime, digest, mtime in sorted(log, key=lambda e: (e[3], e[2])):
        key = user, file
        if user is None or file is None or mime == "text/plain" or (op in ("created", "written") and not size):
            continue
        old = rows.get(key)
        if op == "deleted":
            rows.pop(key, None)
        elif op == "renamed":
            if old:
                rows[key] = (path, *old[1:])
        elif op == "written" or old is None or (old[2], old[3]) != (size, mtime):
            rows[key] = (path, digest, size, mtime)
    return rows


def index_rows(base):
    return [(u, f, p, s, "image/jpeg", h, m, T0) for (u, f), (p, h, s, m) in base.items()]


def keyed(df):
    return {(r.user_id, r.file_id): (r.file_path, r.content_hash, r.file_size, r.file_mtime) for r in df.collect()}


def log_of(seed, n=120):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        op = r.choice(("created", "created", "written", "renamed", "renamed", "deleted"))
        rows.append(event(k, r.choice(("u", "v/x=1")), r.randint(1, 8), op, f"p{k}", r.choice((0, 5, 5, 6)), r.choice(("image/jpeg",) * 5 + ("text/plain",)), r.choice((1, 2)), at=r.randint(0, 60)))
    return rows + [event(900, None, 1, "written"), event(901, "u", None, "written")]


BASE = {("u", 1): ("old1", "b", 5, 1), ("u", 2): ("old2", "b", 6, 2), ("v/x=1", 3): ("old3", "b", 5, 1), ("w", 9): ("old9", "b", 1, 1)}


@pytest.mark.parametrize("seed", range(6))
def test_a_log_is_applied_in_order(spark, seed):
    index = spark.createDataFrame(index_rows(BASE), schema.FILE_HASHES)
    log = log_of(seed)
    assert keyed(upkeep.apply_to_index(index, spark.createDataFrame(log, schema.EVENTS))) == replay(BASE, log)


def test_renames_and_deletions_that_counted_before(spark):
    """A rename stays though an unchanged file is seen after it; deletions of other files than images pass by."""
    index = spark.createDataFrame(index_rows({("u", 1): ("A", "b", 5, 1), ("u", 2): ("C", "b", 5, 1)}), schema.FILE_HASHES)
    log = [event(1, "u", 1, "renamed", "B"), event(2, "u", 1, "created", "A", 5, mtime=1), event(3, "u", 2, "deleted", mime="text/plain")]
    assert keyed(upkeep.apply_to_index(index, spark.createDataFrame(log, schema.EVENTS))) == {("u", 1): ("B", "b", 5, 1), ("u", 2): ("C", "b", 5, 1)}


def stream_of(spark, batches, kind, path):
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_ends_alike(spark, tmp_path, seed):
    """Batches have nothing to do with time; late events can't undo newer ones, and a replay changes nothing."""
    log = log_of(seed, 80)
    mixed = random.Random(seed).sample(log, len(log))
    table, classes = (IndexTable(spark, str(tmp_path / x), k) for x, k in (("table", schema.FILE_HASHES), ("classes", schema.CLASSIFICATIONS)))
    table.commit(None, lambda _: spark.createDataFrame(index_rows(BASE), schema.FILE_HASHES))
    kinds = [(u, f, "p", 1, "image/jpeg", "meme", 0.5, ["a"], T0) for u, f in BASE]
    classes.commit(None, lambda _: spark.createDataFrame(kinds, schema.CLASSIFICATIONS))
    events = stream_of(spark, [mixed[k::3] for k in range(3)], schema.EVENTS, str(tmp_path / "events"))
    for run in ("a",) if seed == 1 else ("a", "a"):  # again from where it ended: nothing comes
        query = upkeep.start_upkeep(events, table, str(tmp_path / f"c{run}"), categories=classes, late_seconds=10_000)
        assert query.awaitTermination(300) and query.exception() is None
    assert keyed(table.read()) == replay(BASE, log)
    gone = {(e[0], e[1]) for e in log if e[4] == "deleted" and e[7] == "image/jpeg"}
    assert {(r.user_id, r.file_id) for r in classes.read().collect()} == set(BASE) - gone


def test_the_last_file_of_a_user_can_go_and_old_events_are_folded(spark, tmp_path):
    table = IndexTable(spark, str(tmp_path / "t"), schema.FILE_HASHES)
    base = {("u", 1): ("p", "b", 5, 1), ("v", 2): ("q", "b", 5, 1)}
    table.commit(None, lambda _: spark.createDataFrame(index_rows(base), schema.FILE_HASHES))
    batches = [
        [event(1, "u", 1, "deleted"), event(2, "v", 2, "renamed", "r")],
        [event(5000, "w", 3, "created", mtime=7)],
        [event(9000, "v", 2, "renamed", "s"), event(9001, "w", 3, "created", "else", mtime=7)],
        [event(20000, "x", 4, "written")],
    ]
    query = upkeep.start_upkeep(stream_of(spark, batches, schema.EVENTS, str(tmp_path / "e")), table, str(tmp_path / "c"), late_seconds=100)
    assert query.awaitTermination(300) and query.exception() is None
    assert keyed(table.read()) == replay(base, [e for b in batches for e in b])
    assert table._files("u", None) == []


def test_what_is_held_is_folded_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    from shoebox.streaming import versions

    index = spark.createDataFrame(index_rows({("u", 1): ("p", "b", 5, 1), ("v", 2): ("q", "b", 5, 1)}), schema.FILE_HASHES)
    held = versions.Versions(spark, str(tmp_path / "files"), index, 100, whole_after=2)
    batches = [
        [event(1, "u", 1, "renamed", "r"), event(2, "w", 3, "created", mtime=7)],
        [event(3, "u", 1, "created", "s", mtime=9), event(5000, "w", 3, "renamed", "t")],
        [event(4, "u", 1, "deleted"), event(5001, "w", 3, "renamed", "late", at=4950)],
        [event(9000, "w", 3, "deleted", mime="text/plain"), event(9001, "v", 2, "renamed", "z")],
        [event(9002, "u", 1, "renamed", "y"), event(9003, "w", 3, "created", "x", mtime=7)],
    ]
    rows = {("u", 1): "p", ("v", 2): "q"}
    for k, batch in enumerate(batches):
        for _ in range(2):
            found = held.taken(upkeep.wanted(spark.createDataFrame(batch, schema.EVENTS)), k).collect()
        held.forget(k)
        for r in found:
            rows.pop((r.user_id, r.file_id), None)
            if r.op == "indexed":
                rows[r.user_id, r.file_id] = r.file_path
    # Event 4 is later than 100 seconds; the others count in their order.
    assert rows == {("u", 1): "y", ("v", 2): "z", ("w", 3): "t"}
    kept = spark.read.parquet(str(tmp_path / "files" / "batch=3"))
    assert {(r.user_id, r.op, r.file_path, r.at is None) for r in kept.collect()} == {("u", "written", "s", False), ("v", "indexed", "q", True), ("v", "renamed", "z", False), ("w", "written", "Photos/a.jpg", False), ("w", "renamed", "late", False), ("w", "renamed", "t", False)}
    assert not (tmp_path / "files" / "batch=-1").exists() and (tmp_path / "files" / "batch=3").exists()


def test_cleanup_is_throttled(spark, tmp_path):
    times = [(0, False), (10, False), (299, True), (300, False), (301, False), (700, False), (2000, False), (2299, False), (2300, True), (2301, False)]
    rows = [(u, T0 + dt.timedelta(seconds=s), busy) for s, busy in times for u in ("u", "v")]
    kind = "user_id string, ts timestamp, classifying boolean"
    expected = sorted((u, s) for s in (0, 300, 700, 2000, 2301) for u in ("u", "v"))

    def seconds(df):
        return sorted((r.user_id, r.s) for r in df.select("user_id", (F.unix_timestamp("ts") - int(T0.timestamp())).alias("s")).collect())

    assert seconds(upkeep.due_in_order(spark.createDataFrame(rows, kind))) == expected
    due = timers.cleanup_due(stream_of(spark, [rows[:7], rows[7:12], rows[12:]], kind, str(tmp_path / "views")))
    query = due.writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    assert seconds(spark.table("due")) == expected


def test_scans_that_nobody_hears_of_are_settled(spark, tmp_path):
    def row(user, status, total, processed, at):
        return user, status, total, processed, T0 + dt.timedelta(seconds=at)

    rows = [row("a", "scanning", 9, 3, 0), row("a", "scanning", 9, 5, 100), row("b", "scanning", 4, 4, 50), row("a", "scanning", 9, 6, 400), row("c", "scanning", 1, 0, 410), row("c", "completed", 1, 1, 420), row("a", "completed", 9, 9, 500), row("d", "scanning", 0, 0, 600), row("e", "idle", 0, 0, 5000)]
    kind = "user_id string, status string, total long, processed long, updated_at timestamp"
    batches = [rows[:3], rows[3:6], rows[6:8], rows[8:]]
    expected = {("a", "interrupted", 100), ("b", "completed", 50), ("c", "completed", 420), ("a", "completed", 500), ("d", "interrupted", 600), ("e", "idle", 5000)}

    def seen(df):
        return {(r.user_id, r.status, int(r.s)) for r in df.select("*", (F.unix_timestamp("updated_at") - int(T0.timestamp())).alias("s")).collect()}

    assert seen(timers.scans_settled_by(spark.createDataFrame(rows, kind), "2030-01-01")) == expected
    watch = timers.scans_settled(stream_of(spark, batches, kind, str(tmp_path / "p")), clock="EventTime")
    query = watch.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    assert seen(spark.table("settled")) == expected
