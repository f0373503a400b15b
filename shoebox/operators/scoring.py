"""Model scorers at the edge of the engine: batches in, batches out, and a breaker.

A scorer gets a pandas frame of files and gives one with file_id,
status, category, confidence, model, algorithm_version and labels.
Statuses are HTTP-like; 0 means no answer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoebox.functions.paths import FACE_SUPPORTED, ML_SUPPORTED
from shoebox.plans.config import MAX_FAILURES, EngineConfig

ANSWER = "user_id string, file_id long, status int, category string, confidence double, model string, algorithm_version string, labels array<struct<name:string,score:double>>"
FACE_ANSWER = "user_id string, file_id long, status int, response string"
#: Statuses besides 5xx of a service that is gone or refuses; 0 is no answer.
TRIPPING = (0, 401, 403, 404)
#: Statuses that speak of the file, not of the service.
FILE_ERRORS = (400, 413, 415, 422)


class Scorer(Protocol):
    def score(self, files: pd.DataFrame) -> pd.DataFrame: ...


class HttpScorer:
    """A worker behind HTTP: a form with the file, and a JSON answer.

    files: user_id, file_id and ``path``, which tasks read.  ``task`` is
    ``classify`` or ``face-signature``.  No answer in time is status 0.
    """

    def __init__(self, url: str, task: str = "classify", labels: str = "", token: str | None = None, config: EngineConfig = EngineConfig()):
        self.url, self.task, self.labels, self.token, self.timeout = url.rstrip("/"), task, labels, token, config.ml_timeout_seconds

    def _asked(self, path: str) -> tuple[int, str]:
        from urllib import error, request

        from shoebox.sources.stores import opened

        fs, place = opened(path)
        with fs.open_input_file(place) as f:
            content = f.read()
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="image"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode(), content, b"\r\n"]
        if self.labels:
            parts.append(f'--{mark}\r\nContent-Disposition: form-data; name="candidate_labels"\r\n\r\n{self.labels}\r\n'.encode())
        parts.append(f"--{mark}--\r\n".encode())
        headers = {"Content-Type": f"multipart/form-data; boundary={mark}"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with request.urlopen(request.Request(f"{self.url}/{self.task}", b"".join(parts), headers), timeout=self.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except error.HTTPError as e:
            return e.code, ""
        except OSError:
            return 0, ""

    def score(self, files: pd.DataFrame) -> pd.DataFrame:
        out = files[["user_id", "file_id", "path"]].copy()
        found = [self._asked(p) for p in files["path"]]
        out["status"], out["response"] = [s for s, _ in found], [r for _, r in found]
        if self.task != "classify":
            return out
        answers = []
        for status, text in found:
            try:
                answers.append(json.loads(text) if 200 <= status < 300 else {})
            except ValueError:
                answers.append({})
        for name in ("category", "confidence", "model", "algorithm_version"):
            out[name] = [a.get(name) for a in answers]
        out["labels"] = [[{"name": str(x.get("name", x.get("label"))), "score": float(x.get("score", 0))} for x in a.get("labels") or []] for a in answers]
        return out.drop(columns="response")


def eligible(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return files.where(F.col("mime_type").isin(*ML_SUPPORTED) & (F.col("file_size") > 0) & (F.col("file_size") <= config.ml_max_file_bytes))


def eligible_faces(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return files.where(F.col("mime_type").isin(*FACE_SUPPORTED) & (F.col("file_size") > 0) & (F.col("file_size") <= config.people_max_file_bytes))


def trips(status: int) -> bool:
    """Whether a failure with this status may open the breaker; other failures only count."""
    return status in TRIPPING or 500 <= status <= 599


def asked(files: DataFrame, scorer: Scorer, schema: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The scorer's good answers, in the shape of ``schema`` (user_id, file_id and status among it).

    Each file that gets no good answer is asked again by itself, after a
    growing pause.  After so many failures in a row, one of them of the
    service, a task stops asking; what a batch brought after that point is
    dropped, as it is by ``breaker``.
    """
    retries = config.ml_retries
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streak, disabled = 0, False
        for batch in batches:
            if disabled or not len(batch):
                continue
            batch = batch.reset_index(drop=True)
            pending, answers = batch, {}
            for attempt in range(retries + 1):
                out = scorer.score(pending).reset_index(drop=True)
                answers |= dict(zip(pending.index, out.to_dict("records")))
                pending = pending[~out["status"].between(200, 299).to_numpy()]
                if not len(pending) or attempt == retries:
                    break
                time.sleep(0.15 * (attempt + 1))
            good = []
            for k in batch.index:
                status = int(answers[k]["status"])
                if 200 <= status < 300:
                    streak = 0
                    good.append(answers[k])
                elif status not in FILE_ERRORS:
                    streak += 1
                    if streak >= MAX_FAILURES and trips(status):
                        disabled = True
                        break
            if good:
                yield pd.DataFrame(good)[names]

    return files.mapInPandas(run, schema)


def answers(files: DataFrame, scorer: Scorer, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Categories of the files."""
    return asked(files, scorer, ANSWER, config)


def face_answers(files: DataFrame, scorer: Scorer, config: EngineConfig = EngineConfig()) -> DataFrame:
    """user_id, file_id and signatures: faces that are sure enough (see ``parsed_faces``)."""
    found = asked(files, scorer, FACE_ANSWER, config)
    return found.select("user_id", "file_id", parsed_faces(F.col("response"), config).alias("signatures"))


def breaker(outcomes: DataFrame, key: str = "run_id", order: str = "seq") -> DataFrame:
    """The same as a window over logged outcomes (run_id, seq, status): streak before each, and whether the run was still asking.

    Success ends a streak, errors of files neither add nor end.
    """
    ok = F.col("status").between(200, 299)
    failing = ~ok & ~F.col("status").isin(*FILE_ERRORS)
    opening = F.col("status").isin(*TRIPPING) | F.col("status").between(500, 599)
    run = Window.partitionBy(key).orderBy(order)
    rows = outcomes.withColumn("_epoch", F.sum(ok.cast("int")).over(run))
    rows = rows.withColumn("streak", F.sum(failing.cast("int")).over(Window.partitionBy(key, "_epoch").orderBy(order)))
    tripped = F.max((opening & failing & (F.col("streak") >= MAX_FAILURES)).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("asked", F.coalesce(tripped, F.lit(0)) == 0).drop("_epoch")


def parsed_faces(response: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Signatures of a face response: those sure enough; else its single signature, if any."""
    schema = "signature string, confidence double, faces array<struct<signature:string,confidence:double>>"
    r = F.from_json(response, schema)
    sure = lambda s: (F.trim(F.coalesce(s["signature"], F.lit(""))) != "") & (F.coalesce(s["confidence"], F.lit(1.0)) >= config.people_min_face_confidence)
    none = F.array().cast("array<struct<signature:string,confidence:double>>")
    many = F.filter(F.coalesce(r["faces"], none), sure)
    one = F.struct(r["signature"].alias("signature"), r["confidence"].alias("confidence"))
    return F.when(F.size(many) > 0, many).when(sure(one), F.array(one)).otherwise(none)
