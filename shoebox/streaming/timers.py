"""States that end: a throttle, and scans that nobody hears of any more.

Both are states of a user with a timer.  With ``EventTime`` timers follow
the times in the data (a replayed stream gives the same rows); with
``ProcessingTime`` they follow the clock, so that a scan is settled even
if no other row comes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from shoebox.plans.config import CLEANUP_SECONDS, STALE_SECONDS

from .versions import with_rocks


def now_ms(values: TimerValues, clock: str) -> int:
    return values.getCurrentWatermarkInMs() if clock == "EventTime" else values.getCurrentProcessingTimeInMs()


class Throttle(StatefulProcessor):
    """When a user's last cleanup began; forgotten when the next one may."""

    def __init__(self, seconds: int, clock: str):
        self.seconds, self.clock = seconds, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        was = last
        for at in sorted(r["at"] for r in rows if not r["classifying"]):
            if last is None or at - last >= self.seconds * 1_000_000:
                last = at
                yield Row(user_id=key[0], at=at)
        if last is not was:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.last.update((last,))
            base = last // 1000 if self.clock == "EventTime" else now_ms(timerValues, self.clock)
            self.handle.registerTimer(max(base + self.seconds * 1000, now_ms(timerValues, self.clock) + 1))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def cleanup_due(requests: DataFrame, seconds: int = CLEANUP_SECONDS, clock: str = "EventTime", late_seconds: int = 60) -> DataFrame:
    """Of a stream of page views (user_id, ts, classifying), those that start a cleanup: none while classifying, and not again within so many seconds."""
    with_rocks(requests.sparkSession)
    rows = requests.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "classifying").withWatermark("ts", f"{late_seconds} seconds")
    due = rows.groupBy("user_id").transformWithState(Throttle(seconds, clock), "user_id string, at long", "append", clock)
    return due.select("user_id", F.timestamp_micros("at").alias("ts"))


WATCHED = "user_id string, status string, total long, processed long, updated_at timestamp"
_ENDED = "user_id string, status string, total long, processed long, at long"


def verdict(total: int, processed: int) -> str:
    return "completed" if total > 0 and processed >= total else "interrupted"


class ScanWatch(StatefulProcessor):
    """The last progress of a user's scan, while it runs; a timer settles it when nothing more is heard."""

    def __init__(self, seconds: int, clock: str):
        self.seconds, self.clock = seconds, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "total long, processed long, at long")

    def _settled(self, user, total, processed, at) -> Row:
        return Row(user_id=user, status=verdict(total, processed), total=total, processed=processed, at=at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r["at"]):
            if last and r["at"] < last[2]:
                continue  # older than what is known
            if last and r["at"] - last[2] > self.seconds * 1_000_000:
                yield self._settled(key[0], *last)
            last = (r["total"], r["processed"], r["at"]) if r["status"] == "scanning" else None
            if r["status"] != "scanning":
                yield Row(user_id=key[0], status=r["status"], total=r["total"], processed=r["processed"], at=r["at"])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if last:
            self.last.update(last)
            self.handle.registerTimer(max(last[2] // 1000 + self.seconds * 1000 + 1, now_ms(timerValues, self.clock) + 1))
        elif self.last.exists():
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            yield self._settled(key[0], *self.last.get())
            self.last.clear()

    def close(self) -> None:
        pass


def scans_settled(progress: DataFrame, seconds: int = STALE_SECONDS, clock: str = "ProcessingTime", late_seconds: int = 0) -> DataFrame:
    """How each scan of a stream of progress (user_id, status, total, processed, updated_at) ended: as it says, or, unheard of for so many seconds, completed if all was processed, else interrupted."""
    with_rocks(progress.sparkSession)
    rows = progress.select("user_id", "status", "total", "processed", F.col("updated_at").cast("timestamp").alias("updated_at"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at")).withWatermark("updated_at", f"{late_seconds} seconds")
    ended = rows.groupBy("user_id").transformWithState(ScanWatch(seconds, clock), _ENDED, "append", clock)
    return ended.select("user_id", "status", "total", "processed", F.timestamp_micros("at").alias("updated_at"))


def scans_settled_by(progress: DataFrame, now: str | None, seconds: int = STALE_SECONDS) -> DataFrame:
    """The same of a finished table, as of a time (a timestamp text; without one, of the last progress of all)."""
    by_user = Window.partitionBy("user_id").orderBy("updated_at")
    until = F.lit(now).cast("timestamp") if now else F.lit(progress.agg(F.max("updated_at")).first()[0]).cast("timestamp")
    rows = progress.withColumns({"_next": F.lead("updated_at").over(by_user), "_until": until})
    quiet = F.unix_micros(F.coalesce("_next", "_until")) - F.unix_micros("updated_at") > seconds * 1_000_000
    status = F.when(F.col("status") != "scanning", F.col("status")).when(quiet & (F.col("total") > 0) & (F.col("processed") >= F.col("total")), "completed").when(quiet, "interrupted")
    return rows.withColumn("status", status).where("status IS NOT NULL").select("user_id", "status", "total", "processed", "updated_at")
