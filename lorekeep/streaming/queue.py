"""A durable task queue as a stateful stream: tasks are claimed under a lease, retried after a backoff and dead at their last attempt.

Commands come in as a stream, transitions go out as one. A ``task_started`` row is the claim: whoever reads it runs the task and
sends ``done``, ``fail`` or ``continue`` with the attempt's number back in. A claim whose lease runs out without an answer is made again
under the next number, and answers to an older number no longer count, so a slow worker can't overwrite its successor. State is one row
per open task; timers wake it up, no pass over all tasks does. A task that succeeded or died leaves its key behind for
``keep_ms``, so that a repeated enqueue is dropped.

Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider, as all of Spark's ``transformWithState`` does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Leases of tasks and of webhook deliveries, attempts, and the backoff of a failed attempt.
TASK_LEASE_MS, DELIVERY_LEASE_MS = 5 * 60_000, 60_000
MAX_ATTEMPTS = 5
FIRST_WAIT_MS, LONGEST_WAIT_MS = 60_000, 3_600_000

STATE = "status string, attempts int, payload string, due_ms bigint, lease_ms bigint, started_ms bigint"
COMMANDS = "task_id string, command string, attempt int, payload string, error string, at timestamp"
TRANSITIONS = "task_id string, event string, status string, attempts int, payload string, error string, at timestamp, lease_until timestamp, next_attempt_at timestamp"
OPEN = ("pending", "retry", "processing")


def wait_ms(attempts: int) -> int:
    """The wait after so many attempts."""
    return min(FIRST_WAIT_MS * 2 ** (attempts - 1), LONGEST_WAIT_MS)


class Task:
    """One task's state machine; times are milliseconds. A method gives the transition's event, or None if nothing changes."""

    def __init__(self, lease_ms: int, max_attempts: int, row: tuple | None = None) -> None:
        self.lease_for, self.most = lease_ms, max_attempts
        self.status, self.attempts, self.payload, self.due, self.lease, self.started = row or (None, 0, None, None, None, None)
        self.error: str | None = None

    @property
    def row(self) -> tuple:
        return self.status, self.attempts, self.payload, self.due, self.lease, self.started

    @property
    def wakes_at(self) -> int | None:
        return self.lease if self.status == "processing" else self.due if self.status in OPEN else None

    def enqueue(self, now: int, payload: str | None, first_at: int | None = None) -> str | None:
        if self.status is not None:
            return None
        self.status, self.payload, self.due = "pending", payload, now if first_at is None else first_at
        return "task_queued"

    def claim(self, now: int) -> str | None:
        if self.wakes_at is None or self.wakes_at > now:
            return None
        self.status, self.attempts, self.lease, self.error = "processing", self.attempts + 1, now + self.lease_for, None
        self.started = now if self.started is None else self.started
        return "task_started"

    def answer(self, now: int, command: str, attempt: int | None, payload: str | None, error: str | None) -> str | None:
        if self.status != "processing" or attempt is not None and attempt != self.attempts:
            return None
        self.lease, self.error = None, error if command == "fail" else None
        if command == "done":
            self.status, self.due = "success", None
            return "task_succeeded"
        if command == "continue":
            self.status, self.attempts, self.payload, self.due = "pending", 0, payload, now
            return "task_continued"
        if self.attempts >= self.most:
            self.status, self.due = "dead", None
            return "task_dead"
        self.status, self.due = "retry", now + wait_ms(self.attempts)
        return "task_retry"


class _Queue(StatefulProcessor):
    def __init__(self, lease_ms: int, max_attempts: int, keep_ms: int, event_time: bool) -> None:
        self.lease_ms, self.max_attempts, self.keep_ms, self.event_time = lease_ms, max_attempts, keep_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _load(self) -> Task:
        return Task(self.lease_ms, self.max_attempts, tuple(self.state.get()) if self.state.exists() else None)

    def _save(self, task: Task, now: int) -> None:
        """Keeps the state and its one timer: the task's next time, or when a closed one is forgotten."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if task.status is None:
            return
        self.state.update(task.row)
        self.handle.registerTimer(max(1, task.wakes_at if task.wakes_at is not None else now + self.keep_ms))

    def _rows(self, key, made: list[tuple[str, int, Task, tuple]]) -> pd.DataFrame:
        at = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms")
        rows = [(key[0], event, s[0], s[1], s[2], error, at(now), at(s[4]) if s[0] == "processing" else None, at(s[3]) if s[0] in ("pending", "retry") else None) for event, now, error, s in made]
        frame = pd.DataFrame(rows, columns=["task_id", "event", "status", "attempts", "payload", "error", "at", "lease_until", "next_attempt_at"])
        for c in ("at", "lease_until", "next_attempt_at"):
            frame[c] = pd.to_datetime(frame[c])
        return frame.astype({"attempts": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        task, made, now = self._load(), [], self._now(timerValues)
        held = pd.concat(list(rows)).sort_values("at", kind="stable")
        for r in held.itertuples(index=False):
            ms = int(pd.Timestamp(r.at).timestamp() * 1000)
            text = lambda v: None if v is None or v is pd.NA or v != v else v
            attempt = text(r.attempt)
            if r.command == "enqueue":
                event = task.enqueue(ms, text(r.payload))
            elif r.command in ("done", "fail", "continue"):
                event = task.answer(ms, r.command, None if attempt is None else int(attempt), text(r.payload), text(r.error))
            else:
                continue  # a tick only moves the clock
            if event:
                made.append((event, ms, task.error, task.row))
        self._save(task, now)
        yield self._rows(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        task, now = self._load(), self._now(timerValues)
        if task.wakes_at is None:
            self.state.clear()
            return
        event = task.claim(now)
        self._save(task, now)
        if event:
            yield self._rows(key, [(event, now, task.error, task.row)])

    def close(self) -> None:
        pass


def task_queue(commands: DataFrame, lease_ms: int = TASK_LEASE_MS, max_attempts: int = MAX_ATTEMPTS, keep_ms: int = 24 * LONGEST_WAIT_MS, late: str | None = None) -> DataFrame:
    """Transitions (TRANSITIONS) of a stream of commands (COMMANDS): enqueue, done, fail, continue; others, such as tick, only move the
    clock.

    late: the clock is the watermark of ``at`` with that lateness, so a replay gives the same claims, and commands that are not later than
    it are dropped by Spark; None: the clock is processing time. A
    claim is made when the clock has passed a task's time, at the clock's time; there is no limit of claims in a pass, which a reader of the
    transitions may have. Commands of a null task_id are left out."""
    rows = commands.where("task_id is not null")
    if late is not None:
        rows = rows.withWatermark("at", late)
    mode = "ProcessingTime" if late is None else "EventTime"
    queue = _Queue(lease_ms, max_attempts, keep_ms, late is not None)
    return rows.select("task_id", "command", "attempt", "payload", "error", "at").groupBy("task_id").transformWithStateInPandas(queue, TRANSITIONS, "Append", mode)


def delivery_commands(deliveries: DataFrame) -> DataFrame:
    """Enqueue commands of deliveries (event_id, endpoint_id, payload, at): an event is one task for each endpoint."""
    none = F.lit(None)
    return deliveries.select(F.concat_ws(":", "endpoint_id", "event_id").alias("task_id"), F.lit("enqueue").alias("command"), none.cast("int").alias("attempt"), "payload", none.cast("string").alias("error"), "at")


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a text under a key, as lower-case hex, from Spark's own SHA-256."""
    import hashlib

    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ mask for b in block)) for mask in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signature(secret: str, payload: Column, seconds: Column) -> Column:
    """The signature of a delivery: the HMAC of its time and payload, joined by a full stop."""
    return F.concat(F.lit("v1="), hmac_sha256(secret, F.concat_ws(".", seconds.cast("string"), payload)))
