"""The task queue: its state machine, and the stream with clock steps and restarts from its checkpoint."""

import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.streaming import queue

NOON = dt.datetime(2024, 6, 1, 12)
MINUTE = 60_000


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


def test_states_of_a_task():
    t = queue.Task(5 * MINUTE, 3)
    assert t.claim(0) is None and t.answer(0, "done", None, None, None) is None
    assert t.enqueue(10, "p") == "task_queued" and t.enqueue(11, "q") is None and t.payload == "p"
    assert t.claim(9) is None and t.claim(10) == "task_started" and t.row == ("processing", 1, "p", 10, 10 + 5 * MINUTE, 10)
    assert t.claim(10 + 5 * MINUTE - 1) is None and t.claim(10 + 5 * MINUTE) == "task_started" and t.attempts == 2
    assert t.answer(20, "done", 1, None, None) is None  # the first worker comes too late
    assert t.answer(20, "continue", 2, "next", None) == "task_continued" and t.row[:4] == ("pending", 0, "next", 20)
    waits = []
    for k in (1, 2, 3):
        assert t.claim(t.due) == "task_started" and t.attempts == k
        before = t.due
        event = t.answer(before, "fail", k, None, "boom")
        waits.append(None if t.due is None else t.due - before)
    assert event == "task_dead" and t.status == "dead" and waits == [MINUTE, 2 * MINUTE, None] and t.started == 10
    assert t.claim(10**12) is None and t.enqueue(10**12, "again") is None
    assert [queue.wait_ms(n) // MINUTE for n in range(1, 9)] == [1, 2, 4, 8, 16, 32, 60, 60]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


class Steps:
    """Each step writes commands and runs the stream until it has read them: every one is a restart from the checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.seen = spark, folder, options, 0

    def __call__(self, *commands):
        rows = [(t, c, (more[0] if more else None), (more[1] if len(more) > 1 else None), (more[2] if len(more) > 2 else None), when) for when, t, c, *more in commands]
        self.spark.createDataFrame(rows, queue.COMMANDS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(queue.COMMANDS).parquet(f"{self.folder}/in")
        made = queue.task_queue(stream, late="0 seconds", **self.options)
        made.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        found = sorted(self.spark.read.schema(queue.TRANSITIONS).parquet(f"{self.folder}/out").collect(), key=lambda r: (r.at, r.attempts, r.event))
        new, self.seen = [r for r in found if (r.task_id, r.event, r.at) not in self.old], len(found)
        self.old |= {(r.task_id, r.event, r.at) for r in found}
        return sorted((r.task_id, r.event, r.status, r.attempts, r.at, r.lease_until, r.next_attempt_at) for r in new)

    old: set = set()


def test_a_stream_with_clock_steps_and_restarts(rocks, tmp_path):
    step = Steps(rocks, str(tmp_path), max_attempts=2)
    step.old = set()
    got = step((at(0), "a", "enqueue", None, "one"), (at(0), "b", "enqueue", None, "two"), (at(1), "clock", "tick"))
    assert got == [("a", "task_queued", "pending", 0, at(0), None, at(0)), ("a", "task_started", "processing", 1, at(1), at(6), None), ("b", "task_queued", "pending", 0, at(0), None, at(0)), ("b", "task_started", "processing", 1, at(1), at(6), None)]
    # a is done, b fails: a retry after a minute
    got = step((at(2), "a", "done", 1), (at(3), "b", "fail", 1, None, "boom"))
    assert got == [("a", "task_succeeded", "success", 1, at(2), None, None), ("b", "task_retry", "retry", 1, at(3), None, at(4))]
    assert step((at(3.5), "clock", "tick"), (at(3.5), "a", "enqueue", None, "again")) == []
    assert step((at(4), "clock", "tick")) == [("b", "task_started", "processing", 2, at(4), at(9), None)]
    # no answer: the lease runs out and the claim is made again, after which the old answer does not count
    assert step((at(9), "clock", "tick")) == [("b", "task_started", "processing", 3, at(9), at(14), None)]
    assert step((at(10), "b", "done", 2), (at(10), "clock", "tick")) == []
    assert step((at(11), "b", "fail", 3, None, "still")) == [("b", "task_dead", "dead", 3, at(11), None, None)]
    assert step((at(900), "clock", "tick"), (at(900), None, "enqueue")) == []
    # continued tasks begin again with no attempts
    got = step((at(901), "c", "enqueue", None, "p1"), (at(902), "clock", "tick"))
    assert [r[1] for r in got] == ["task_queued", "task_started"]
    got = step((at(903), "c", "continue", 1, "p2"), (at(904), "clock", "tick"))
    assert [(r[1], r[3]) for r in got] == [("task_continued", 0), ("task_started", 1)]


def test_closed_tasks_are_forgotten(rocks, tmp_path):
    step = Steps(rocks, str(tmp_path), keep_ms=10 * MINUTE)
    step.old = set()
    step((at(0), "a", "enqueue"), (at(1), "clock", "tick"))
    step((at(2), "a", "done", 1), (at(3), "clock", "tick"))
    assert step((at(4), "a", "enqueue"), (at(5), "clock", "tick")) == []
    step((at(30), "clock", "tick"))
    assert [r[1] for r in step((at(31), "a", "enqueue"), (at(32), "clock", "tick"))] == ["task_queued", "task_started"]


def test_a_stream_ends_as_a_plain_replay(rocks, tmp_path):
    """Random answers in steps of several commands; claims are made when a step's clock has passed."""
    rng = random.Random(4)
    answers = [(at(m), f"t{rng.randrange(4)}", rng.choice(["done", "fail", "fail", "fail", "continue"])) for m in range(1, 29)]
    steps = [[(at(0), f"t{i}", "enqueue") for i in range(4)] + [(at(0.5), "clock", "tick")]] + [[*answers[k : k + 4], (answers[min(k + 3, 27)][0] + dt.timedelta(seconds=30), "clock", "tick")] for k in range(0, 28, 4)]
    step = Steps(rocks, str(tmp_path), lease_ms=3 * MINUTE)
    step.old = set()
    events = [e for s in steps for e in step(*s)]
    tasks, want = {f"t{i}": queue.Task(3 * MINUTE, 5) for i in range(4)}, []
    ms = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    for commands in steps:
        for when, t, c in commands[:-1]:
            event = tasks[t].enqueue(ms(when), None) if c == "enqueue" else tasks[t].answer(ms(when), c, None, None, None)
            want += [(t, event, tasks[t].status, tasks[t].attempts, when)] if event else []
        clock = commands[-1][0]
        for t, task in tasks.items():
            event = task.claim(ms(clock))
            want += [(t, event, task.status, task.attempts, clock)] if event else []
    assert sorted(e[:5] for e in events) == sorted(want)


def test_signatures(spark):
    secrets = ["k", "a secret", "x" * 100]
    for secret in secrets:
        got = spark.createDataFrame([("körper", 17), ("", 0)], "payload string, at long").select("payload", "at", queue.signature(secret, F.col("payload"), F.col("at")).alias("s")).collect()
        assert all(r.s == "v1=" + hmac.new(secret.encode(), f"{r['at']}.{r.payload}".encode(), hashlib.sha256).hexdigest() for r in got)


def test_deliveries_become_tasks(spark):
    rows = spark.createDataFrame([("e1", "w1", "{}", NOON), ("e1", "w2", "{}", NOON)], "event_id string, endpoint_id string, payload string, at timestamp")
    assert {(r.task_id, r.command, r.attempt) for r in queue.delivery_commands(rows).collect()} == {("w1:e1", "enqueue", None), ("w2:e1", "enqueue", None)}
