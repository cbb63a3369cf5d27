"""The registry as a versioned table, and the job log as a stream."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import registry as RG
from tessera.plans import catalog
from tessera.sinks.versioned import Conflict, VersionedTable
from tessera.streaming import jobs_log as JL

SCHEMA = "hash string, n long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_versions_and_crashes(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert table.versions() == [] and table.read().collect() == []
    assert table.write(rows(spark, ("a", 1))) == 1
    assert table.write(table.read().unionByName(rows(spark, ("b", 2))), after=1) == 2
    both = [("a", 1), ("b", 2)]
    seen = lambda v=None: sorted(map(tuple, table.read(v).collect()))
    assert seen() == both and seen(1) == [("a", 1)]

    dying = rows(spark, ("c", 3)).select("hash", F.raise_error(F.lit("killed")).cast("long").alias("n"))
    with pytest.raises(Exception, match="killed"):  # while rows are written
        table.write(dying)
    with monkeypatch.context() as m:  # between rows and log
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.write(rows(spark, ("d", 4)))
    assert VersionedTable(spark, str(tmp_path / "t"), SCHEMA).versions() == [1, 2] and seen() == both
    assert table.write(rows(spark, ("e", 5))) == 3 and seen() == [("e", 5)]


def test_second_writer_fails(spark, tmp_path, monkeypatch):
    one = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    one.write(rows(spark, ("a", 1)))
    with pytest.raises(Conflict):
        one.write(rows(spark, ("b", 2)), after=0)
    # both start from version 1; the other commits while this one writes its rows
    two, commit = VersionedTable(spark, str(tmp_path / "t"), SCHEMA), VersionedTable._commit

    def late(self, version, folder):
        if self is one:
            two.write(rows(spark, ("two", 2)))
        commit(self, version, folder)

    monkeypatch.setattr(VersionedTable, "_commit", late)
    with pytest.raises(Conflict):
        one.write(rows(spark, ("one", 1)), after=1)
    assert [r["hash"] for r in one.read().collect()] == ["two"] and one.versions() == [1, 2]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    events = [(f"ft-{rng.randrange(12)}", rng.randrange(200), i, rng.choice(["running", "pending", "completed", "failed", "cancelled"])) for i in range(300)]
    return spark.createDataFrame(events, "job_id string, s long, event_id long, status string").select(
        "job_id", F.timestamp_seconds("s").alias("ts"), "event_id", "status").cache()


@pytest.mark.parametrize("parts", [1, 3])
def test_states_however_the_log_is_split(spark, tmp_path, log, parts):
    """Parts in random order; a restart after each."""
    for i in range(parts):
        log.filter(F.pmod(F.hash("event_id"), F.lit(parts)) == i).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        JL.start_following(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = {tuple(r) for r in RG.terminal_status(log).select("job_id", "n_events", "last_status", "outcome").collect()}
    assert {tuple(r)[:4] for r in JL.job_states(spark, str(tmp_path / "out")).collect()} == want


def test_silent_jobs_are_reported(spark, tmp_path):
    def arrive(job, status, n):
        spark.createDataFrame([(job, n, status)], "job_id string, event_id long, status string").select(
            "job_id", F.timestamp_seconds("event_id").alias("ts"), "event_id", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(JL.LOG_SCHEMA).parquet(str(tmp_path / "in"))
        JL.start_following(stream, str(tmp_path / "out"), str(tmp_path / "ck"), silent_after=1).awaitTermination()

    for n, (job, status) in enumerate([("quiet", "running"), ("done", "completed"), ("other", "running")]):
        arrive(job, status, n)
    got = {r["job_id"]: (r["n_events"], r["outcome"], r["silent"]) for r in JL.job_states(spark, str(tmp_path / "out")).collect()}
    assert got["quiet"] == (1, "remaining", True) and got["done"] == (1, "completed", False)


def test_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Two starts of the stream give two batches, however many files the parts come in."""
    rows = [(i, f"2024-01-0{1 + i % 9} 00:00:00", i % 5, "click") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")) \
        .repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: str(tmp_path / name))
    got = {r["job_id"]: r["n_events"] for r in catalog.job_status_stream(spark, str(tmp_path)).collect()}
    assert got == {f"ft-{i}": 80 for i in range(5)}
    assert len(list((tmp_path / "job-log" / "states").glob("batch=*"))) == 2


def test_last_event_of_a_batch(spark):
    """As a stable sort by time and id has it, missing times last."""
    rng = random.Random(9)

    class Kept:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

        def setTimeoutDuration(self, _):
            pass

    for _ in range(60):
        n = rng.randrange(1, 9)
        rows = pd.DataFrame({"ts": pd.to_datetime([rng.choice([None, *range(3)][rng.randrange(2):]) for _ in range(n)], unit="s").astype("datetime64[us]"),
                             "event_id": [rng.randrange(4) for _ in range(n)], "status": [str(i) for i in range(n)]})
        kept, last = Kept(), rows.sort_values(["ts", "event_id"], kind="stable").iloc[-1]
        list(JL._follow(1, frozenset())(("job",), iter([rows]), kept))
        assert kept.value == (n, int(pd.Timestamp(last["ts"]).as_unit("ns").value if last["ts"] is not pd.NaT else pd.NaT.value), last["event_id"], last["status"])
