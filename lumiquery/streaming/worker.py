"""The polling worker: bounded polls in order, collection of finished outputs, states by job, one worker at a time."""

from __future__ import annotations

import json
import logging
import socket
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files
from .jobs import STATES, next_jobs

log = logging.getLogger(__name__)

#: What a worker does in a loop.
MODES = ("both", "submit", "collect")
OUTPUT = "job_id string, status string, predictions array<struct<model_name:string,predicted_emission_nm:double,predicted_quantum_yield:double>>, error_code string, error_message string"
STATE = "id string, status string, updated_at timestamp, n_updates long"


def work(read_queue: Callable[[], DataFrame], submit: Callable[[DataFrame], int], collect: Callable[[], int], limit: int = 5, interval: float = 30.0, max_loops: int | None = None, idle_exit: int | None = None, mode: str = "both", dry_run: bool = False, busy: Callable[[], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Poll until ``max_loops``, or until so many loops in a row had nothing to do.

    Each loop collects before it submits; a poll takes the ``limit`` oldest queued jobs, and
    none while ``busy`` says that another worker runs. An error is logged and counted, and the
    next loop goes on. A dry run counts what it would submit.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    done = {"loops": 0, "collected": 0, "submitted": 0, "planned": 0, "skipped": 0, "errors": 0}
    idle = 0
    while max_loops is None or done["loops"] < max_loops:
        done["loops"] += 1
        before = (done["collected"], done["submitted"], done["planned"], done["skipped"])
        try:
            if mode != "submit" and not dry_run:
                done["collected"] += collect()
            if mode != "collect":
                if busy is not None and busy():
                    done["skipped"] += 1
                else:
                    jobs = next_jobs(read_queue(), limit)
                    if dry_run:
                        done["planned"] += jobs.count()
                    else:
                        done["submitted"] += submit(jobs)
        except Exception:  # the loop goes on
            log.exception("loop %d failed", done["loops"])
            done["errors"] += 1
        idle = idle + 1 if before == (done["collected"], done["submitted"], done["planned"], done["skipped"]) else 0
        if idle_exit is not None and idle >= idle_exit:
            break
        if max_loops is None or done["loops"] < max_loops:
            sleep(interval)
    return done


def completed_outputs(spark: SparkSession, folder: str, schema: str = OUTPUT) -> DataFrame:
    """The stream of ``prediction_*/output.json`` documents below a folder, each read once by its checkpoint."""
    return spark.readStream.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/prediction_*/output.json")


def collect_outputs(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Hand all outputs that are new since the checkpoint to the sink; returns how many there were."""
    counted = []

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.filter("job_id IS NOT NULL")
        sink(batch, batch_id)
        counted.append(batch.count())

    query = completed_outputs(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(counted)


def track_states(updates: DataFrame) -> DataFrame:
    """The current state of each job of a stream of updates (id, status, updated_at): a stateful operator keyed by job.

    A job moves forward only: an update counts if it is later, or as late and further on.
    A finished job's state is kept, so a repeated update changes nothing.
    """
    rank = {s: k for k, s in enumerate(STATES)}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, place, n = state.get if state.exists else (None, -1, 0)
        for f in frames:
            for when, status in zip(f["updated_at"], f["status"], strict=True):
                if status not in rank:
                    continue
                n += 1
                micros = int(pd.Timestamp(when).value // 1000)
                if at is None or (micros, rank[status]) > (at, place):
                    at, place = micros, rank[status]
        if at is not None:
            state.update((at, place, n))
            yield pd.DataFrame({"id": [key[0]], "status": [STATES[place]], "updated_at": [pd.Timestamp(at * 1000)], "n_updates": [n]})

    rows = updates.select(F.col("id").cast("string").alias("id"), "status", "updated_at").filter("id IS NOT NULL AND updated_at IS NOT NULL")
    return rows.groupBy("id").applyInPandasWithState(step, STATE, "at long, place long, n long", "update", GroupStateTimeout.NoTimeout)


class Lock:
    """One worker at a time: a file that only one can create, with its owner and an expiry.

    A worker renews its lease while it works. A lease that has run out, since its worker is
    gone, is taken over: of several that try, one renames the file and goes on.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3_600, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.seconds, self.clock = spark, path, seconds, clock
        self.owner = f"{socket.gethostname()}-{uuid.uuid4().hex}"

    def holder(self) -> dict | None:
        """Owner and expiry, as far as the file can be read."""
        try:
            return json.loads(files.read_text(self.spark, self.path))
        except (ValueError, Py4JError):  # just made, or just gone
            return None

    def renew(self) -> None:
        """Hold on for another term; an error if another worker has taken over."""
        if (self.holder() or {}).get("owner") != self.owner:
            raise RuntimeError(f"{self.path} belongs to another worker")
        files.write_text(self.spark, self.path, json.dumps({"owner": self.owner, "expires": self.clock() + self.seconds}))

    def _age(self) -> float:
        fs, p = files._fs(self.spark, self.path)
        return self.clock() - fs.getFileStatus(p).getModificationTime() / 1000

    def _expired(self) -> bool:
        held = self.holder()
        if held is not None:
            return held["expires"] <= self.clock()
        return files.exists(self.spark, self.path) and self._age() > self.seconds  # made, but its worker ended before it wrote

    def __enter__(self) -> Lock:
        fs, p = files._fs(self.spark, self.path)
        if files.exists(self.spark, self.path) and self._expired():
            gone = files._fs(self.spark, f"{self.path}.{self.owner}")[1]
            if fs.rename(p, gone):
                fs.delete(gone, False)
        if not fs.createNewFile(p):
            raise RuntimeError(f"another worker holds {self.path}")
        files.write_text(self.spark, self.path, json.dumps({"owner": self.owner, "expires": self.clock() + self.seconds}))
        return self

    def __exit__(self, *_: object) -> None:
        fs, p = files._fs(self.spark, self.path)
        if (self.holder() or {}).get("owner") == self.owner:
            fs.delete(p, False)
