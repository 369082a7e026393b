"""Retries from a stream of job events: one small state per note, started afresh whenever the note is queued, indexed or retried by hand.

Events of a note: ``queued`` (saved with new or old content), ``ok`` and ``failed`` (an attempt ended), ``retry`` (by hand). They are applied in the order of
their times, not of their arrival: an event waits in the state until the watermark has passed it, so batching does not matter and events may be late
by the watermark's delay. A timer on the watermark wakes a note for its next waiting event and for its next attempt, so due attempts come out
by themselves, without any new event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorebank import constants as K

#: Events of one instant are applied in this order: a failure has the last word.
ORDER = ("queued", "retry", "ok", "failed")
_STATE = "content_hash string, attempts int, status string, available long, told boolean, step long, passed long, at array<long>, events array<string>, hashes array<string>"
_OUT = "user_id string, note_id string, step long, at long, content_hash string, attempts int, status string, available long, due boolean"


@dataclass
class Job:
    """The ledger row of one note. ``told`` says that the waiting attempt was announced, ``step`` counts changes."""

    content_hash: str | None = None
    attempts: int = 0
    status: str | None = None
    available: int | None = None
    told: bool = False
    step: int = 0
    rows: list[tuple] = field(default_factory=list)

    def apply(self, at: int, event: str, content_hash: str | None) -> None:
        """One event. Outcomes of other content than the queued one, or of a job that failed for good, change nothing."""
        if event == "queued":
            self._set(at, content_hash, 0, "pending", at)
        elif event == "retry":
            if self.status == "failed":
                self._set(at, self.content_hash, 0, "pending", at)
        elif self.status != "failed" and (self.status is None or content_hash == self.content_hash):
            if event == "ok":
                self._set(at, content_hash, 0, "ready", None)
            elif event == "failed":
                n = self.attempts + 1
                if n <= len(K.RETRY_DELAYS_S):
                    self._set(at, content_hash, n, "pending", at + K.RETRY_DELAYS_S[n - 1] * 1_000_000)
                else:
                    self._set(at, content_hash, n, "failed", None)

    def _set(self, at: int, content_hash: str | None, attempts: int, status: str, available: int | None) -> None:
        self.content_hash, self.attempts, self.status, self.available, self.told = content_hash, attempts, status, available, False
        self._emit(at, False)

    def announce(self, until: int) -> None:
        """Say once that the waiting attempt is due."""
        if self.status == "pending" and not self.told and self.available <= until:
            self.told = True
            self._emit(self.available, True)

    def _emit(self, at: int, due: bool) -> None:
        self.step += 1
        self.rows.append((self.step, at, self.content_hash, self.attempts, self.status, self.available, due))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    job, waiting, before = Job(), [], -1
    if state.exists:
        *kept, before, at, events, hashes = state.get
        job = Job(*kept)
        waiting = list(zip(at, events, hashes))
    for frame in frames:
        fresh = zip(frame["at"].tolist(), frame["event"].tolist(), [None if h is None else str(h) for h in frame["content_hash"]])
        # Spark lets events of the last batch's lateness through: a note that has gone on without them stays as it is
        waiting += [e for e in fresh if e[0] > before]
    watermark = state.getCurrentWatermarkMs()
    passed = watermark * 1000
    waiting.sort(key=lambda e: (e[0], ORDER.index(e[1]) if e[1] in ORDER else -1, e[2] or ""))
    done = 0
    for at, event, content_hash in waiting:
        if at > passed:
            break
        job.announce(at)
        job.apply(at, event, content_hash)
        done += 1
    job.announce(passed)
    waiting = waiting[done:]
    times = [w[0] for w in waiting[:1]] + [job.available] * (job.status == "pending" and not job.told)
    at, events, hashes = (list(c) for c in zip(*waiting)) if waiting else ([], [], [])
    state.update((job.content_hash, job.attempts, job.status, job.available, job.told, job.step, passed, at, events, hashes))
    if times:
        state.setTimeoutTimestamp(max(min(times) // 1000, watermark) + 1)
    yield pd.DataFrame([(*key, *row) for row in job.rows], columns=[c.split()[0] for c in _OUT.split(", ")])


def retry_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every change of every note's job, and a row with ``due`` when its next attempt may start.

    ``events`` (streaming): user_id, note_id, content_hash, ts, event. Events later than ``delay`` are dropped, events of another name are ignored.
    ``user_id, note_id, step, at, content_hash, attempts, status, available_at, due``; ``step`` orders the rows of a note. Write in append mode.
    """
    rows = events.withWatermark("ts", delay).select("user_id", "note_id", "content_hash", "ts", F.unix_micros("ts").alias("at"), "event")
    out = rows.groupBy("user_id", "note_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({"at": F.timestamp_micros("at"), "available_at": F.timestamp_micros("available")}).drop("available")


def latest_jobs(changes: DataFrame) -> DataFrame:
    """The ledger row of each note from all its changes so far, and how many attempts were announced."""
    newest = F.max_by(F.struct("content_hash", "attempts", "status", "available_at"), "step").alias("r")
    return changes.groupBy("user_id", "note_id").agg(newest, F.count_if("due").alias("n_due")).select("user_id", "note_id", "r.*", "n_due")
