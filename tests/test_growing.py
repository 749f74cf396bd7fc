"""Files that grow between the runs of a stream."""

import io
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators.attempts import attempt_stats
from gleaner.sources import growing, scans
from gleaner.streaming import sync as T


def append(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def taken(spark, stream, tmp_path):
    """Runs the stream to its end and returns the lines it has taken in all."""
    T.run_available(stream, str(tmp_path / "ck"), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}")))
    rows = spark.read.parquet(str(tmp_path / "out/*")).collect() if (tmp_path / "out").exists() else []
    return sorted(r.value for r in rows)


@pytest.mark.parametrize("range_bytes", [5, 1 << 20])
def test_appended_lines_are_taken_once_and_whole(spark, tmp_path, range_bytes):
    log = tmp_path / "logs" / "run.log"
    run = lambda: taken(spark, growing.follow_lines(spark, str(tmp_path / "logs"), rangeBytes=range_bytes), tmp_path)
    append(log, "one\ntwo\r\nthr")
    assert run() == ["one", "two"]
    append(log, "ee\n\nfour é\nfi")
    append(tmp_path / "logs" / "sub" / "b.log", b"other \xff\n")
    append(tmp_path / "logs" / ".hidden", "no\n")
    second = ["", "four é", "one", "other �", "three", "two"]
    assert run() == second
    assert run() == second                                  # nothing new
    append(log, "ve\n")
    assert run() == sorted([*second, "five"])
    log.write_text("new\n")                                 # rotated: shorter than what was read
    assert run() == sorted([*second, "five", "new"])


def test_a_single_file_and_a_missing_one(spark, tmp_path):
    append(tmp_path / "a.log", "x\n")
    append(tmp_path / "b.log", "y\n")
    assert taken(spark, growing.follow_lines(spark, str(tmp_path / "a.log")), tmp_path) == ["x"]
    assert taken(spark, growing.follow_lines(spark, str(tmp_path / "none")), tmp_path / "n") == []


def test_ranges_share_out_the_lines_whatever_their_size(monkeypatch):
    rng = random.Random(1)
    data = b"".join(b"z" * rng.choice([0, 1, 5, 40]) + b"\n" for _ in range(200))
    starts = [0] + [i + 1 for i, c in enumerate(data[:-1]) if c == 10]
    for piece in (3, 64):
        monkeypatch.setattr(growing, "PIECE", piece)
        assert growing.whole_lines(io.BytesIO(data + b"tail"), len(data) + 4) == len(data)
        for size in (1, 7, 100, 10 ** 6):
            got = [at for a in range(0, len(data), size)
                   for at, _ in growing.lines_of(io.BytesIO(data + b"tail"), a, min(a + size, len(data)), a == 0)]
            assert got == starts


def test_progress_follows_an_appended_line(spark, tmp_path):
    log = tmp_path / "logs" / "run.log"
    run = lambda: T.progress_stream(scans.scan_run_log(spark, str(tmp_path / "logs"), stream=True), str(tmp_path / "p"), str(tmp_path / "ck"))
    last = lambda: T.progress(spark, str(tmp_path / "p"), F.lit("2024-05-02 10:00:30").cast("timestamp")).first()
    append(log, "2024-05-02 10:00:00 INFO [ingest] x (1/9)\n2024-05-02 10:00:01 INFO [proc")
    run()
    assert (last().stage, last().done) == ("ingest", 1)
    append(log, "ess] y (5/9)\n2024-05-02 10:00:02 INFO resting\n")
    run()
    assert (last().stage, last().done, last().live) == ("process", 5, True)
    append(log, "2024-05-02 10:00:03 INFO [process] z (6/9)\n")
    run()
    assert last().done == 6


def test_attempts_of_a_growing_log(spark, tmp_path):
    log = tmp_path / "logs" / "attempts.jsonl"

    def run():
        T.attempt_stats_stream(scans.attempts_from_log(scans.scan_attempt_log(spark, str(tmp_path / "logs"), stream=True)),
                               str(tmp_path / "t"), str(tmp_path / "ck"))
        return [tuple(r) for r in attempt_stats(T.last_attempts(spark, str(tmp_path / "t"))).collect()]

    append(log, '{"profile": "p", "reel_id": "a", "at": "2024-01-01T00:00:00Z", "ok": false, "seconds": 4}\nnot json\n{"profile": "p", ')
    assert run() == [("p", 0, 1, 4.0)]
    append(log, '"reel_id": "a", "at": "2024-01-02T00:00:00Z", "ok": true, "seconds": 2}\n')
    assert run() == [("p", 1, 0, 2.0)]
