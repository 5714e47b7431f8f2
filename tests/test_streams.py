"""The merged table of batches, and leases as a stream."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators.relational import latest
from folioflow.streaming import events as S
from folioflow.streaming import leases as L
from folioflow.streaming.upserts import UpsertTable

KINDS = "k long, s string, v long"


def batches(spark, n):
    """Batches that change a few of 40 keys each, null keys among them."""
    for b in range(n):
        yield b, spark.createDataFrame([(None if k == 39 else k, "a" if k % 2 else None, b * 100 + k) for k in range(40) if (k * 7 + b * 5) % 11 < 4], KINDS)


def test_files_stay_bounded_and_the_last_row_counts(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KINDS).schema, ["k", "s"], buckets=4, most_deltas=3)
    assert t.table().count() == 0
    want = {}
    for b, df in batches(spark, 14):
        t.merge(df, b)
        want |= {(r.k, r.s): r.v for r in df.collect()}
        assert len(t.deltas()) <= 3
    assert {(r.k, r.s): r.v for r in t.table().collect()} == want
    assert t.files() <= 4 + 3 * 4 * spark.sparkContext.defaultParallelism


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KINDS).schema, ["k", "s"], buckets=4, most_deltas=2)
    all_ = list(batches(spark, 5))
    for b, df in all_:
        t.merge(df, b)
        t.merge(df, b)
    once = sorted(map(str, t.table().collect()))
    t.merge(*reversed(all_[-1]))
    assert sorted(map(str, t.table().collect())) == once
    t.compact()
    t.compact()
    assert sorted(map(str, t.table().collect())) == once and t.deltas() == []


@pytest.mark.parametrize("stop", ["aside", "base"])
def test_a_compaction_that_stops_anywhere_loses_nothing(spark, tmp_path, monkeypatch, stop):
    from pyspark.sql import DataFrameWriter

    t = UpsertTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KINDS).schema, ["k", "s"], buckets=4, most_deltas=99)
    for b, df in batches(spark, 6):
        t.merge(df, b)
        if b == 2:
            t.compact()
    want = sorted(map(str, t.table().collect()))
    write = DataFrameWriter.parquet

    def failing(self, path, *a, **k):
        if stop == "base" or not path.endswith("/aside"):
            write(self, path, *a, **k)  # what was written stays, then the driver dies
        if path.endswith(f"/{stop}"):
            raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", failing)
        with pytest.raises(RuntimeError):
            t.compact()
    assert sorted(map(str, t.table().collect())) == want and len(t.deltas()) == 3
    t.compact()
    assert sorted(map(str, t.table().collect())) == want and t.deltas() == []


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    t = UpsertTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KINDS).schema, ["k"], buckets=8, most_deltas=99)
    t.merge(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("s"), F.lit(0).cast("long").alias("v")), 0)
    t.compact()
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "base").rglob("*.parquet")}
    t.merge(spark.createDataFrame([(5, "b", 1)], KINDS), 1)
    t.compact()
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "base").rglob("*.parquet")}
    assert len(before) >= 7 and len(set(before.items()) - set(after.items())) == 1
    assert latest(t.table(), ["k"], F.desc("v")).where("v = 1").count() == 1


EVENTS = "job long, at string, event_id long, event string, attempt int"


@pytest.fixture
def stream(spark, tmp_path):
    """put(rows) adds a file of events, drain() runs the machine over what is new and gives the whole log in order."""
    path = tmp_path / "events"

    def put(*rows):
        df = spark.createDataFrame([(j, f"2024-01-01 {at}:00", i, e, a) for i, (j, at, e, a) in enumerate(rows)], EVENTS)
        df.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(path))

    def drain(minutes=15, attempts=2):
        source = S.tail(spark, str(path), spark.read.parquet(str(path)).schema)
        log = L.drained(L.transitions(source, minutes, attempts, late="10 minutes", keep_days=1), tmp_path.name)
        return [(r.job, str(r.at)[11:16], r.event, r.status, r.attempts, r.accepted) for r in log.orderBy("job", "seq").collect()]

    return put, drain


def test_leases_are_claimed_renewed_and_end(stream):
    put, drain = stream
    put((1, "10:00", "submit", None), (1, "10:01", "claim", None), (1, "10:10", "renew", 1), (2, "10:00", "submit", None), (2, "10:05", "claim", None))
    first = [(1, "10:00", "submit", "queued", 0, True), (1, "10:01", "claim", "running", 1, True), (1, "10:10", "renew", "running", 1, True)]
    assert [r for r in drain() if r[0] == 1] == first
    # the watermark passes the end of both leases: 10:25 of job 1, 10:20 of job 2
    put((3, "11:00", "submit", None), (1, "10:55", "renew", 1))
    got = drain()
    assert [r for r in got if r[0] == 2][-1] == (2, "10:20", "expire", "queued", 1, True)
    # its renewal comes late: the lease has ended, the job is queued again
    assert [r for r in got if r[0] == 1] == [*first, (1, "10:25", "expire", "queued", 1, True), (1, "10:55", "renew", "queued", 1, False)]


def test_attempts_end_and_cancels_wait_for_the_lease(stream):
    put, drain = stream
    put((1, "10:00", "submit", None), (1, "10:01", "claim", None), (1, "10:30", "claim", None), (1, "10:31", "renew", 1), (1, "10:31", "renew", 2), (1, "11:00", "claim", None),
        (2, "10:00", "submit", None), (2, "10:01", "claim", None), (2, "10:02", "cancel", None), (2, "10:30", "complete", None), (3, "10:00", "submit", None), (3, "10:01", "cancel", None), (3, "10:02", "submit", None), (4, "10:00", "claim", None))
    got = drain()
    assert [r[2:] for r in got if r[0] == 1] == [("submit", "queued", 0, True), ("claim", "running", 1, True), ("expire", "queued", 1, True), ("claim", "running", 2, True), ("renew", "running", 2, False), ("renew", "running", 2, True), ("expire", "failed", 2, True), ("claim", "failed", 2, False)]
    assert [r[2:] for r in got if r[0] == 2] == [("submit", "queued", 0, True), ("claim", "running", 1, True), ("cancel", "cancel_requested", 1, True), ("expire", "cancelled", 1, True), ("complete", "cancelled", 1, False)]
    assert [r[3] for r in got if r[0] == 3] == ["queued", "cancelled", "queued"] and [r[2:] for r in got if r[0] == 4] == [("claim", "none", 0, False)]


def test_a_run_in_parts_equals_one_run(spark, tmp_path):
    """Events that come in the order of their times give the same transitions in one batch or in many."""
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(5), f"2024-01-01 {10 + k // 60:02}:{k % 60:02}:00", k, rng.choice(list(L.ALLOWED)), rng.choice([None, 1, 2])) for k in range(240)]

    def run(name, parts):
        path = str(tmp_path / name)
        size = -(-len(rows) // parts)
        for at in range(0, len(rows), size):
            spark.createDataFrame(rows[at : at + size], EVENTS).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
            source = S.tail(spark, path, spark.read.parquet(path).schema)
            log = L.drained(L.transitions(source, 15, 3), f"{name}-{tmp_path.name}")
        return sorted((r.job, r.seq, r.at, r.event, r.status, r.attempts, r.accepted) for r in log.collect())

    assert run("whole", 1) == run("parts", 3)


def test_a_key_is_reserved_again_after_its_span(spark, tmp_path):
    path, name = str(tmp_path / "jobs"), tmp_path.name

    def send(*rows):
        spark.createDataFrame(rows, "job long, at string, key string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        source = S.tail(spark, path, spark.read.parquet(path).schema)
        return sorted(r.job for r in S.logged(S.reserved(source, ["key"], "at", "1 hour"), f"r-{name}").collect())

    assert send((1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:00:00", "b")) == [1, 2]
    assert send((3, "2024-01-01 10:30:00", "a")) == [1, 2]  # reuses job 1
    assert send((4, "2024-01-01 13:00:00", "c")) == [1, 2, 4]  # the watermark passes the span of a and b
    assert send((5, "2024-01-01 13:30:00", "a")) == [1, 2, 4, 5]


class Store:
    """A job's state and timers, and the messages that they took."""

    def __init__(self):
        self.held, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.held = None

    def listTimers(self):  # noqa: N802
        self.calls.append("list")
        return iter(list(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.discard(at)


def test_a_batch_of_a_job_takes_few_messages_and_leaves_one_timer():
    import pandas as pd

    store, machine = Store(), L.Leases(60_000, 2, 600_000)
    machine.init(store)
    give = lambda *rows: pd.concat(machine.handleInputRows((7,), iter([pd.DataFrame([(pd.Timestamp(ms, unit="ms"), ms, i, e, None) for i, (ms, e) in enumerate(rows)], columns=["at", "ms", "event_id", "event", "attempt"])]), None))
    assert give((2_000, "claim"), (1_000, "submit"))["accepted"].tolist() == [True, True]
    assert store.calls == ["get", "update", "register"] and store.timers == {62_001}
    store.calls.clear()
    give((3_000, "renew"))
    assert store.timers == {63_001} and len(store.calls) == 4 and "list" not in store.calls
    give((4_000, "complete"))
    assert store.timers == {604_000}
    give((5_000, "submit"))
    assert store.timers == set()
