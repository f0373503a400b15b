"""Progress of a job while it runs: work in steps, counted by a query's own metrics.

What a scan reports is one small text for each user and job, replaced as
a whole, which others read at any time.  Work is a stream over a written
table of what is to be done, some files a step; each step's counts come as
observed metrics of the query, so nothing is counted twice and the tasks
report to nobody.  A job that starts again goes on where its steps ended.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import threading
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from shoebox.operators import index
from shoebox.sources import stores

#: Files after which a scan reports, at least; and reports of a scan, at most.
EVERY, REPORTS = 50, 200
#: How long the end of a query may take to be told.
WAIT_SECONDS = 30


class Store:
    """The progress texts of users, a file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path.rstrip("/"), threading.Lock()
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, user: str, job: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{job}", f"u-{quote(user, safe='')}.json".replace("%", "="))

    def put(self, user: str, job: str, status: str, total: int, processed: int) -> None:
        """Replace the text; in the form of ``index.progress_text``."""
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        text = json.dumps({"status": status, "total": total, "processed": processed, "updated_at": now}, separators=(",", ":"))
        place = self._place(user, job)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{place}.{uuid.uuid4().hex}")
        with self.lock:  # a listener reports from its own thread
            out = self.fs.create(part, True)
            out.write(bytearray(text.encode()))
            out.close()
            if self.fs.exists(place):
                self.fs.delete(place, False)
            self.fs.rename(part, place)

    def text(self, user: str, job: str) -> str | None:
        place = self._place(user, job)
        with self.lock:
            if not self.fs.exists(place):
                return None
            stream = self.fs.open(place)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def get(self, user: str, job: str) -> dict:
        """status (settled if nobody is heard of any more), total, processed, updated_at, and whether a scan may start."""
        from shoebox.functions.scalars import stale

        p = index.progress(F.lit(self.text(user, job)).cast("string"))
        row = self.spark.range(1).select(p.alias("p")).select("p", stale(F.col("p.updated_at"), F.current_timestamp()).alias("old"))
        row = row.select("p.*", index.settled(F.col("p"), F.col("old")).alias("now"), index.may_start(F.col("p"), F.col("old")).alias("may_start")).first()
        return {"status": row["now"], "total": row["total"], "processed": row["processed"], "updated_at": row["updated_at"], "may_start": row["may_start"]}


class Counted(StreamingQueryListener):
    """Adds up an observed count of one query and reports the sum after each step, until it is closed."""

    def __init__(self, name: str, report: Callable[[int], None]):
        self.name, self.report, self.batches = name, report, {}
        self.changed, self.ended, self.closed = threading.Condition(), set(), False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        with self.changed:
            if not self.closed:
                self.batches[event.progress.batchId] = found["n"]
                self.report(sum(self.batches.values()))

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def close(self, run_id: str) -> None:
        """Wait until a run's end was told, which comes after its steps; nothing is reported from then on."""
        with self.changed:
            self.changed.wait_for(lambda: run_id in self.ended, timeout=WAIT_SECONDS)
            self.closed = True


def in_steps(work: DataFrame, do: Callable[[DataFrame], DataFrame], report: Callable[[int], None], label: str, every: int | None = None) -> DataFrame:
    """``do`` of the rows of ``work``, some at a time; ``report`` gets how many are done after each step.

    The result is a table of the shared folder.
    """
    spark = work.sparkSession
    queue, out, check = (stores.shared_folder(spark, f"{label}-{x}") for x in ("work", "done", "check"))
    total = work.count()
    step = every or max(EVERY, math.ceil(total / REPORTS))
    # A step's rows are several files, so that all cores have some.
    tasks = max(1, min(spark.sparkContext.defaultParallelism, step))
    size = math.ceil(step / tasks)
    work.repartition(max(1, math.ceil(total / (size * tasks)))).write.option("maxRecordsPerFile", size).parquet(queue)
    name = f"{label}-{queue[-8:]}"
    listener = Counted(name, report)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", tasks).parquet(queue)
        rows = do(stream.observe(name, F.count(F.lit(1)).alias("n")))
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        listener.close(str(query.runId))
        found = spark.read.schema(rows.schema).parquet(out)
        report(total)
        return found
    finally:
        spark.streams.removeListener(listener)
        stores.remove(spark, queue)
        stores.remove(spark, check)


