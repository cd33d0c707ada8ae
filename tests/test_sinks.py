"""Versioned tables: batches twice, failed attempts, two writers, old versions, streams, and what each store keeps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from asofline.operators import upsert
from asofline.sinks import stores
from asofline.sinks.versioned import Conflict, VersionedTable

SCHEMA = StructType().add("k", "string").add("v", "long")
TIME = dt.datetime(2026, 6, 5, 12)


def table(spark, path, merge=None, buckets=4):
    return VersionedTable(spark, f"file://{path}", SCHEMA, ["k"], merge or (lambda old, new: upsert.latest_wins(old, new, ["k"], ["v"])), buckets)


def batch(spark, **rows):
    return spark.createDataFrame(list(rows.items()), "k string, v long")


def rows(df):
    return {r.k: r.v for r in df.collect()}


def test_a_batch_written_twice_and_versions_that_stay_readable(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows(t.read()) == {} and t.versions() == []
    assert t.write(batch(spark, a=1, b=1, c=1), "one") == 1
    assert t.write(batch(spark, a=1, b=1, c=1), "one") == 1  # known by its id
    assert t.write(batch(spark, a=2, d=1)) == 2
    assert t.write(batch(spark, a=2, d=1)) == 3  # not known, and changes nothing
    assert rows(t.read()) == rows(t.read(2)) == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert rows(t.read(1)) == {"a": 1, "b": 1, "c": 1}
    untouched = {b: f for b, f in t.manifest(1)["buckets"].items() if t.manifest(3)["buckets"].get(b) == f}
    assert len(untouched) < 4  # only buckets of the batch's keys are written anew
    t.vacuum(1)
    assert t.versions() == [3] and rows(t.read()) == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert t.write(batch(spark, a=9), "one") == 3  # still known


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    table(spark, tmp_path).write(batch(spark, a=1))

    def broken(old, new):
        return new.withColumn("v", F.raise_error(F.lit("broken")).cast("long"))

    with pytest.raises(Exception, match="broken"):
        table(spark, tmp_path, broken).write(batch(spark, a=2, b=2))
    t = table(spark, tmp_path)
    assert rows(t.read()) == {"a": 1} and t.versions() == [1]
    t.vacuum()
    assert t.write(batch(spark, a=3)) == 2 and rows(t.read()) == {"a": 3}


def test_a_writer_that_lost_merges_again(spark, tmp_path):
    """The second writer commits while the first one merges; both batches are there in the end."""
    other, done = table(spark, tmp_path), []

    def slow(old, new):
        if not done:
            done.append(other.write(batch(spark, a=5, z=5)))
        return upsert.latest_wins(old, new, ["k"], ["v"])

    t = table(spark, tmp_path, slow)
    assert t.write(batch(spark, a=1, b=1)) == 2 and done == [1]
    assert rows(t.read()) == {"a": 1, "b": 1, "z": 5}
    always = table(spark, tmp_path, lambda old, new: (other.write(batch(spark, y=1)), new)[1])
    with pytest.raises(Conflict):
        always.write(batch(spark, x=1), tries=2)
    assert "x" not in rows(t.read())


def test_a_stream_that_restarts_repeats_nothing(spark, tmp_path):
    add = table(spark, tmp_path / "t", lambda old, new: old.unionByName(new.groupBy("k").agg(F.sum("v").alias("v"))))  # not idempotent by itself
    source = tmp_path / "in"
    for part in (batch(spark, a=1, b=2), batch(spark, a=10)):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        for _ in range(2):
            q = add.stream_into(stream, str(tmp_path / "check"), "sums")
            q.processAllAvailable()
            q.stop()
    assert sorted((r.k, r.v) for r in add.read().collect()) == [("a", 1), ("a", 10), ("b", 2)]
    add.write(batch(spark, a=1, b=2), "sums-0")  # a replayed micro-batch
    assert add.read().count() == 3


def test_stores(spark, tmp_path):
    path = lambda n: f"file://{tmp_path}/{n}"
    f = stores.filings(spark, path("filings"))
    one = spark.createDataFrame([("1", "10-K", TIME, "x", "u"), ("", "8-K", TIME, "x", "u"), (None, "8-K", TIME, "x", "u")], f.schema)
    f.write(one)
    f.write(one.withColumn("form_type", F.lit("8-K")))
    assert [(r.accession, r.form_type, r.symbol) for r in f.read().collect()] == [("1", "10-K", "X")]

    n = stores.news(spark, path("news"))
    n.write(spark.createDataFrame([("id", "t", "d", "s", TIME, "aaa", "u"), ("id", "t", "d", "s", TIME, "bbb", "u")], n.schema))
    n.write(spark.createDataFrame([("id", "t2", "d", "s", TIME, "ccc", "u")], n.schema))
    assert [(r.id, r.title, r.symbol) for r in n.read().collect()] == [("id", "t", "AAA")]

    s = stores.sentiments(spark, path("sentiments"))
    s.write(spark.createDataFrame([("a", 0.1, TIME), ("a", 0.3, TIME + dt.timedelta(1))], s.schema))
    s.write(spark.createDataFrame([("a", 0.5, TIME)], s.schema))
    assert [r.score for r in s.read().collect()] == [0.5]

    v = stores.verdicts(spark, path("verdicts"))
    v.write(spark.createDataFrame([("a", "X", True, "RELEVANT", "USER", "LEGAL", 1.0, 1), ("b", "X", True, "RELEVANT", "AI", "LEGAL", 1.0, 1)], v.schema))
    v.write(spark.createDataFrame([(k, "X", False, "IRRELEVANT", "AI", "LEGAL", 0.2, 2) for k in "ab"], v.schema))
    assert {r.article_id: r.decision for r in v.read().collect()} == {"a": "RELEVANT", "b": "IRRELEVANT"}


def test_a_case_saved_again_keeps_its_symbol_peak_and_birth(spark, tmp_path):
    t = stores.cases(spark, f"file://{tmp_path}")
    d = dt.date(2026, 6, 5)
    row = lambda k, at, score, symbol="X": (f"X:{k}", symbol, d, at, d, "gdelt", score, 1.0, "spike", "agree", "full", "{}")
    t.write(spark.createDataFrame([row(1, TIME, 1.0), row(2, TIME + dt.timedelta(1), 1.0)], t.schema))
    t.write(spark.createDataFrame([row(1, TIME + dt.timedelta(9), 7.0, "OTHER")], t.schema))
    got = {r.case_id: r for r in t.read().collect()}
    assert (got["X:1"].score, got["X:1"].symbol, got["X:1"].created_at) == (7.0, "X", TIME)
    assert [r.case_id for r in stores.recent_cases(t.read(), 1).collect()] == ["X:2"]
    assert stores.cases_of(t.read(), " x ").count() == 2 and stores.case_by(t.read(), "x", "1").count() == 1
