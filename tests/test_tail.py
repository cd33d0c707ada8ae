"""The tail of jobs: what a reader is sent, once, across restarts; and when it ends."""

import datetime as dt
import threading
import time

import pytest

from asofline.streaming import tail

T0 = dt.datetime(2026, 6, 1)


def entries(spark, rows):
    return spark.createDataFrame([(k, n, kind, f"s{n}", T0 + dt.timedelta(minutes=n)) for k, n, kind in rows], tail.SCHEMA)


def drained(spark, path, check, out, **options):
    """What the stream sends now, from its checkpoint on, in the sink's rows."""
    q = tail.tail(spark, path, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.id, r.seq) for r in spark.read.schema(tail.SCHEMA).parquet(out).collect())


def test_a_batch_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert tail.append(entries(spark, [("a", 0, "stage")]), path, 0)
    assert not tail.append(entries(spark, [("a", 9, "stage")]), path, 0)
    assert drained(spark, path, f"{tmp_path}/c", f"{tmp_path}/o") == [("a", 0)]
    assert not list((tmp_path / "log" / "staged").iterdir())


def test_a_restart_neither_loses_nor_repeats(spark, tmp_path):
    path, check, out = f"file://{tmp_path}/log", f"{tmp_path}/c", f"{tmp_path}/o"
    tail.append(entries(spark, [("a", 0, "stage"), ("b", 0, "stage")]), path, 0)
    assert drained(spark, path, check, out) == [("a", 0), ("b", 0)]
    assert drained(spark, path, check, out) == [("a", 0), ("b", 0)]  # nothing new
    tail.append(entries(spark, [("a", 1, "stage")]), path, 1)
    tail.append(entries(spark, [("a", 3, "complete")]), path, 3)  # batch 2 isn't there yet, so 3 waits
    assert drained(spark, path, check, out) == [("a", 0), ("a", 1), ("b", 0)]
    tail.append(entries(spark, [("a", 2, "stage"), ("b", 1, "fail")]), path, 2)
    assert drained(spark, path, check, out) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]


def test_seen_entries_and_other_jobs_are_not_sent(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    tail.append(entries(spark, [(k, n, "stage") for k in "abc" for n in range(4)]), path, 0)
    got = drained(spark, path, f"{tmp_path}/c", f"{tmp_path}/o", jobs=["a", "b", "x"], seen={"a": 3, "b": 0})
    assert got == [("a", 3), *(("b", n) for n in range(4))]


def test_an_empty_log_and_one_that_is_not_there(spark, tmp_path):
    assert tail.ended(spark, f"file://{tmp_path}/none", ["a"]) == set()
    path = f"file://{tmp_path}/log"
    tail.append(entries(spark, []), path, 0)
    assert tail.ended(spark, path, ["a"]) == set()
    assert drained(spark, path, f"{tmp_path}/c", f"{tmp_path}/o") == []


def test_following_ends_with_the_jobs(spark, tmp_path):
    path, sent = f"file://{tmp_path}/log", {}
    tail.append(entries(spark, [("a", 0, "stage"), ("other", 0, "stage")]), path, 0)

    def sink(batch, n):
        sent[n] = sorted((r.id, r.seq, r.kind) for r in batch.collect())

    def later():
        time.sleep(3)
        tail.append(entries(spark, [("a", 1, "complete")]), path, 1)
        tail.append(entries(spark, [("b", 0, "stage"), ("b", 1, "timeout")]), path, 2)

    writer = threading.Thread(target=later)
    writer.start()
    assert tail.follow(spark, path, ["a", "b"], sink, f"{tmp_path}/c", wait=0.2, most=120)
    writer.join()
    assert sorted(x for rows in sent.values() for x in rows) == [("a", 0, "stage"), ("a", 1, "complete"), ("b", 0, "stage"), ("b", 1, "timeout")]


def test_following_gives_up(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    tail.append(entries(spark, [("a", 0, "stage")]), path, 0)
    assert not tail.follow(spark, path, ["a"], lambda batch, n: None, f"{tmp_path}/c", wait=0.1, most=0.5)


def test_a_path_without_a_scheme_is_the_same_log(spark, tmp_path):
    tail.append(entries(spark, [("a", 0, "complete")]), str(tmp_path / "log"), 0)
    assert tail.ended(spark, f"{tmp_path}/log", ["a", "b"]) == {"a"}
    assert drained(spark, f"{tmp_path}/log", f"{tmp_path}/c", f"{tmp_path}/o") == [("a", 0)]
