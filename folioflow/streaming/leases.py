"""Leases of jobs as a stream: a state machine for each job with a timer for the end of its lease."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.streaming.events import logged

#: States that hold a lease, and those that a job ends in.
LEASED, FINAL = ("running", "cancel_requested"), ("completed", "cancelled", "failed")
#: What each event asks of a job's state, and the state that it leads to.
ALLOWED = {"submit": ("none", *FINAL), "claim": ("queued",), "renew": LEASED, "cancel": ("queued", "running"), "complete": LEASED}
TRANSITIONS = "job long, seq int, at timestamp, event string, status string, attempts int, accepted boolean, lease_until timestamp"
#: The same with times as milliseconds, as the tasks give them.
_ROWS = TRANSITIONS.replace("timestamp", "long")
#: The time of an event that has none: before all others, so it is refused.
_NO_TIME = -9_223_372_036_855
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Job(NamedTuple):
    """State of a job; times are milliseconds, until is null without a lease, at is the newest event's."""

    status: str = "none"
    attempts: int = 0
    until: int | None = None
    at: int = 0
    seq: int = 0


def expired(job: Job, now: int, most_attempts: int) -> Job | None:
    """The job after the end of its lease, if that lies before now: asked to cancel it is cancelled, else queued again while it has attempts."""
    if job.until is None or job.until >= now:
        return None
    status = "cancelled" if job.status == "cancel_requested" else "failed" if job.attempts >= most_attempts else "queued"
    return job._replace(status=status, until=None, seq=job.seq + 1)


def advanced(job: Job, event: str, now: int, attempt: int | None, lease: int) -> tuple[Job, bool]:
    """The job after an event, and whether it was accepted. A renewal that names an attempt must name the present one; an event older than the newest is refused."""
    seen = job._replace(at=max(job.at, now), seq=job.seq + 1)
    if now < job.at or job.status not in ALLOWED.get(event, ()) or (event == "renew" and attempt is not None and attempt != job.attempts):
        return seen, False
    if event == "submit":
        return seen._replace(status="queued", attempts=0, until=None), True
    if event == "claim":
        return seen._replace(status="running", attempts=job.attempts + 1, until=now + lease), True
    if event == "renew":
        return seen._replace(until=now + lease), True
    if event == "cancel":
        return seen._replace(status="cancel_requested" if job.status == "running" else "cancelled"), True
    return seen._replace(status="cancelled" if job.status == "cancel_requested" else "completed", until=None), True


class Leases(StatefulProcessor):
    """Events of a job in the order of their times; a lease ends by the next event or by a timer when the watermark passes it.

    The state of a job that has ended is dropped when the watermark is `keep` past its last event.
    """

    def __init__(self, lease: int, most_attempts: int, keep: int):
        self.lease, self.most_attempts, self.keep = lease, most_attempts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, until long, at long, seq int")

    def _load(self) -> Job:
        held = self.state.get()  # null for a new job
        return Job(*held) if held is not None else Job()

    def _due(self, job: Job) -> int | None:
        return job.until + 1 if job.until is not None else job.at + self.keep if job.status in FINAL else None

    def _save(self, was: Job, job: Job) -> None:
        """Each call is a message to the state store, so timers aren't listed: a job has the one that its stored state asks for."""
        self.state.update(tuple(job))
        old, due = self._due(was), self._due(job)
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if due is not None and old != due:
            self.handle.registerTimer(due)

    def _rows(self, key: int, found: list[tuple[Job, int, str, bool]]) -> pd.DataFrame:
        jobs, at, event, accepted = zip(*found, strict=True)
        return pd.DataFrame({
            "job": np.full(len(jobs), key), "seq": [x.seq for x in jobs], "at": at, "event": event, "status": [x.status for x in jobs],
            "attempts": [x.attempts for x in jobs], "accepted": accepted, "lease_until": np.array([x.until for x in jobs], dtype=object),
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(rows)
        batch = held[0] if len(held) == 1 else pd.concat(held)
        order = np.lexsort((batch["event_id"].to_numpy(), batch["ms"].to_numpy()))
        was, found = self._load(), []
        job = was
        for at, event, attempt in zip(*[batch[c].to_numpy()[order].tolist() for c in ("ms", "event", "attempt")], strict=True):
            ended = expired(job, at, self.most_attempts)
            if ended:
                found.append((ended, job.until, "expire", True))
                job = ended
            job, accepted = advanced(job, event, at, None if attempt is None or attempt != attempt else int(attempt), self.lease)
            found.append((job, at, event, accepted))
        self._save(was, job)
        yield self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._load()
        ended = expired(job, expiredTimerInfo.getExpiryTimeInMs(), self.most_attempts)
        if ended:
            self._save(job, ended)
            yield self._rows(key[0], [(ended, job.until, "expire", True)])
        elif job.status in FINAL:
            self.state.clear()

    def close(self) -> None:
        pass


def transitions(events: DataFrame, minutes: int, most_attempts: int, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """Every transition of a stream of events (job, at, event_id, event, attempt), refused ones too; seq numbers those of a job.

    Events more than `late` older than the newest that an earlier batch saw are dropped. Events of one job in one
    batch are held together to sort them.
    """
    at = F.col("at").cast("timestamp")
    own = events.select("job", at.alias("at"), F.coalesce(F.unix_millis(at), F.lit(_NO_TIME)).alias("ms"), "event_id", "event", F.col("attempt").cast("int").alias("attempt"))
    machine = Leases(minutes * 60_000, most_attempts, keep_days * 86_400_000)
    found = own.withWatermark("at", late).groupBy("job").transformWithStateInPandas(statefulProcessor=machine, outputStructType=_ROWS, outputMode="Append", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("at", "lease_until")})


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run the transitions over what is there now, append them to a log in the shared folder and give that whole log."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # timers need this store
    try:
        return logged(stream, f"leases-{name}")
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def summary(log: DataFrame) -> DataFrame:
    """job, status, attempts, n_accepted, n_refused, n_expired: where each job stands after its newest transition."""
    n = lambda c: F.count(F.when(c, 1))
    expire = F.col("event") == "expire"
    return log.groupBy("job").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("attempts", "seq").alias("attempts"),
        n(F.col("accepted") & ~expire).alias("n_accepted"), n(~F.col("accepted")).alias("n_refused"), n(expire).alias("n_expired"),
    )
