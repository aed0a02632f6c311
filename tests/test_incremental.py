import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrystone.operators.incremental import FileRuns, covered_periods, pending_deliveries
from quarrystone.operators.store import RecordIndex
from quarrystone.config import RecordIndexConfig, RecordQuery
from quarrystone.streaming.changes import apply_changes, stream_into
from tests.conftest import RECORD, rows_of

FEED = f"delivery_id long, arrived_at timestamp, op string, {RECORD}, read string, checksum string, size string, day string"
RUNS = "run_no int, started_at timestamp, finished_at timestamp, from_arrived_at timestamp, to_arrived_at timestamp, status string"
DAY = datetime(2026, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def delivery(n, hour, body="b", time=1, op="upsert", fields=None, tags=(), rid="x"):
    return (n, None if hour is None else at(hour), op, rid, "c", None, body, fields, list(tags), {}, time, "r", "c", "s", "d")


def run(n, a, b, status="succeeded"):
    return (n, at(0), None, None if a is None else at(a), at(b), status)


@pytest.mark.parametrize("most", [100_000, 0])
def test_pending(frame, monkeypatch, most):
    monkeypatch.setattr("quarrystone.operators.incremental.BROADCAST_ROWS", most)
    runs = [run(1, 0, 10), run(1, 0, 10), run(2, 10, 30, "failed"), run(3, 8, 12), run(4, 40, 41, "running"), run(5, 60, 50), run(6, None, 99), run(7, 25, 73)]
    feed = [
        delivery(1, 0), delivery(2, 9.99, "a"), delivery(3, 12, "late"), delivery(4, 20, "b2"), delivery(5, 13, "b2"), delivery(6, 13, "b2"), delivery(7, 14, "a"),  # done by 2
        delivery(8, 14, "b", 2), delivery(9, 14, "m", fields={"p": "1", "q": None}), delivery(10, 15, "m", fields={"q": None, "p": "1"}), delivery(11, 16, "m", fields={"p": "1", "q": ""}),
        delivery(12, None, "never"), delivery(13, 15, op="delete", body=""), delivery(14, 24, None), delivery(15, 24, ""), delivery(16, 50, "covered by 7"), delivery(17, 24, "t", tags=["a", "b"]), delivery(18, 24, "t", tags=["b", "a"]),
        delivery(19, 73, "end is exclusive"), delivery(20, 30, "b2"),
    ]
    got = [r.delivery_id for r in pending_deliveries(frame(feed, FEED), frame(runs, RUNS)).orderBy("delivery_id").collect()]
    assert got == [3, 8, 9, 11, 12, 13, 14, 15, 17, 18, 19]
    assert [(r.begin, r.end) for r in covered_periods(frame(runs, RUNS)).orderBy("begin").collect()] == [(at(0), at(12)), (at(25), at(73))]


def test_empty(frame):
    assert pending_deliveries(frame([], FEED), frame([], RUNS)).count() == 0
    assert pending_deliveries(frame([delivery(1, 0)] * 2, FEED), frame([], RUNS)).collect() == [(1,)]
    assert pending_deliveries(frame([], FEED), frame([run(1, 0, 1)], RUNS)).count() == 0


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    runs = FileRuns(spark, str(tmp_path / "in"), str(tmp_path / "runs"))
    process = lambda entries, paths: spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return runs, put, lambda **more: runs.run(process, **more), lambda: rows_of(runs.results().select("value"))


def die():
    raise RuntimeError


def test_file_runs_survive_failure(files):
    runs, put, run_now, results = files
    put("a.txt", "one")
    put("b.txt", "two")
    assert runs.results() is None
    with pytest.raises(RuntimeError):
        run_now(before_commit=die)
    assert runs.results() is None and runs.pending().count() == 2
    first = run_now()
    assert results() == [("one",), ("two",)] and len(first) == 1
    assert run_now() == []
    put("b.txt", "TWO")  # same size, other content
    put("c.txt", "three")
    assert runs.pending().count() == 2
    second = run_now()
    assert second != first and results() == [("TWO",), ("one",), ("three",)]
    assert [n for _, n in sorted((r.commit, r.n) for r in runs.history().groupBy("commit").agg(F.count("*").alias("n")).collect())] == [2, 2]


def test_file_changed_back_is_processed_again(files):
    runs, put, run_now, results = files
    batches = []
    for text in ("A", "B", "A"):
        put("a.txt", text)
        put("rest.txt", "stays")
        batches += run_now()
        assert results() == [(text,), ("stays",)]
    assert len(set(batches)) == 3
    put("a.txt", "C")
    with pytest.raises(RuntimeError):
        run_now(before_commit=die)  # output and entries are there, the commit is not
    assert results() == [("A",), ("stays",)]
    run_now()
    assert results() == [("C",), ("stays",)]


def test_file_that_is_only_touched(files, tmp_path):
    runs, put, run_now, results = files
    put("a.txt", "one")
    os.utime(tmp_path / "in" / "a.txt", (1_600_000_000, 1_600_000_000))
    run_now()
    assert runs.suspects().count() == 0  # its content is not read again
    os.utime(tmp_path / "in" / "a.txt", (1_600_000_001, 1_600_000_001))
    assert runs.suspects().count() == 1 and run_now() == [] and runs.suspects().count() == 0
    assert results() == [("one",)]


def test_blocks_of_files(files, monkeypatch):
    runs, put, run_now, results = files
    monkeypatch.setattr(FileRuns, "FILES", 2)
    for k in range(5):
        put(f"{k}.txt", str(k))
    done = []

    def second_dies():
        if done:
            raise RuntimeError
        done.append(1)

    with pytest.raises(RuntimeError):
        run_now(before_commit=second_dies)
    assert results() == [("0",), ("1",)]
    assert len(run_now()) == 2 and results() == [(str(k),) for k in range(5)]


@pytest.mark.parametrize("name", ["_metadata.file_path", "input_file_name()"])
def test_odd_names(files, name, spark):
    runs, put, run_now, results = files
    names = ["a b.txt", "c%20d.txt", "é+x#1.txt", "q[1]{2}.txt", "plain.txt"]
    for n in names:
        put(n, n)
    runs.run(lambda entries, paths: spark.read.text(paths).select("value", F.expr(name).alias("path")))
    assert results() == sorted((n,) for n in names)
    put("z.txt", "z")
    with pytest.raises(Exception, match="no file of this batch"):
        runs.run(lambda entries, paths: spark.read.text(paths).select("value", F.lit("elsewhere").alias("path")))
    assert results() == sorted((n,) for n in names)


def test_two_runs_at_once(files, spark):
    runs, put, run_now, results = files
    put("a.txt", "one")
    other = FileRuns(spark, runs.inputs, runs.folder)
    process = lambda entries, paths: spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    with pytest.raises(RuntimeError, match="another run"):
        run_now(before_commit=lambda: other.run(process))
    assert run_now() == [] and results() == [("one",)]


def test_deliveries_are_committed(spark, frame, tmp_path):
    feed = [delivery(1, 0, "old"), delivery(2, 20, "new"), delivery(3, 21, "new"), delivery(4, 22, "old")]
    due = lambda rows: [r.delivery_id for r in pending_deliveries(frame(rows, FEED), frame([run(1, 0, 10)], RUNS), str(tmp_path / "log")).collect()]
    assert due(feed) == [2]
    assert due(feed) == []  # the run before committed it
    assert due([*feed, delivery(5, 1, "late")]) == []  # read by a past run after all
    assert due([*feed, delivery(5, 30, "late")]) == [5]


def test_changes_and_stream(spark, frame, tmp_path):
    index = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "ix")))
    rows = [delivery(1, 1, "first text", rid="a"), delivery(2, 2, "second text", rid="a"), delivery(3, 1, "gone text", rid="b"), delivery(4, 5, "", op="delete", rid="b"), delivery(5, 3, "kept text", rid="d")]
    apply_changes(index, frame(rows[:3], FEED))
    assert index.search(RecordQuery("text"))[1].first().matched_record_count == 2
    apply_changes(index, frame(rows, FEED))
    assert {r.record_id for r in index.search(RecordQuery("text"))[0].collect()} == {"a", "d"}
    other = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "iy")))
    frame(rows, FEED).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(FEED).parquet(str(tmp_path / "feed"))
    stream_into(other, stream, str(tmp_path / "cp")).awaitTermination()
    assert {(r.record_id, r.text) for r in other.chunks().collect()} == {("a", "second text"), ("d", "kept text")}
