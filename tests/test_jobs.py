"""The job state machine over streams: order of arrival, first end by time, timeouts, and what is forgotten."""

import datetime as dt
import random

from asofline.streaming import jobs

T0 = dt.datetime(2026, 6, 1)
SCHEMA = "id string, kind string, at timestamp, stage string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, path, batches, delay, name):
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = jobs.lifecycle(stream, delay).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_events_in_any_order_give_one_lifecycle(spark, tmp_path):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        start = r.randrange(100)
        ends = [(r.choice(["complete", "fail"]), start + 1 + r.randrange(50)) for _ in range(r.randrange(3))]
        ends = list({t: (kind, t) for kind, t in ends}.values())
        stages = [start + r.randrange(60) for _ in range(3)]
        rows += [(f"j{k}", "start", at(start), None), *((f"j{k}", kind, at(t), None) for kind, t in ends), *((f"j{k}", "stage", at(t), "s") for t in stages)]
        first = min(ends, key=lambda e: e[1], default=None)
        want[f"j{k}"] = (jobs.ENDS[first[0]] if first else "running", at(start))
    r.shuffle(rows)
    got = jobs.current(run(spark, tmp_path, [rows[k::3] for k in range(3)], "400 days", "any_order")).collect()
    assert {x.id: (x.status, x.created) for x in got} == want


def test_timeouts_and_what_is_forgotten(spark, tmp_path):
    one = [("a", "complete", at(5), None), ("a", "start", at(0), None), ("a", "stage", at(2), "s"), ("a", "stage", at(9), "late"), ("b", "start", at(1), None), ("c", "start", at(100), None), ("c", "fail", at(130), None), ("c", "complete", at(120), None)]
    two = [("d", "start", at(200), None)]
    three = [("b", "complete", at(195), None), ("e", "start", at(11_500), None)]
    states = run(spark, tmp_path, [one, two, three], "10 minutes", "timeouts")
    told = sorted((r.id, r.version, r.status, r.updated) for r in states.collect())
    of = lambda k: [(s, u) for i, _, s, u in told if i == k]
    assert of("a") == [("completed", at(5)), ("pruned", at(5))]
    assert of("b")[:2] == [("running", at(1)), ("timeout", at(61))] and "completed" not in {s for s, _ in of("b")}  # what comes after the end changes nothing
    assert of("c") == [("completed", at(120)), ("pruned", at(120))]
    assert [s for s, _ in of("d")] == ["running", "timeout", "pruned"]
    assert {r.id: r.n_stages for r in states.where("id = 'a' and status = 'completed'").collect()} == {"a": 1}
    assert {r.id for r in jobs.current(states).collect()} == {"e"}


def test_state_is_of_groups_and_what_is_due_at_the_watermark_is_told(spark, tmp_path):
    rows = [(f"j{k}", "start", at(0), None) for k in range(500)] + [(None, "start", at(1), None), ("k", "start", at(70), None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = jobs.lifecycle(stream, "10 minutes", groups=8).writeStream.outputMode("update").format("memory").queryName("groups").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8 * 3  # a group's jobs and its timer, not a row for each job
    got = {r.id: (r.status, r.updated) for r in jobs.current(spark.table("groups")).collect()}
    assert got == {**{f"j{k}": ("timeout", at(60)) for k in range(500)}, None: ("running", at(1)), "k": ("running", at(70))}


def test_events_of_many_frames_and_a_group_that_is_read_again():
    import pandas as pd

    frame = lambda rows: pd.DataFrame(rows, columns=["id", "kind", "ms"])
    g = jobs.Group()
    assert len(g.take(iter([frame([("a", "stage", 5), ("b", "fail", 9)]), frame([("a", "start", 1), ("b", "complete", 9), ("c", "stage", 2)])]))) == 2
    g = jobs.Group(*g.packed())
    changed = g.take(iter([frame([("a", "complete", 4), ("b", "start", 3), ("b", "complete", 12), ("c", "stage", 3)])]))
    told = g.told(changed)
    assert sorted(zip(told["id"], told["status"], told["created"], told["updated"], told["n_stages"], told["version"])) == [("a", "completed", 1, 4, 0, 2), ("b", "completed", 3, 9, 0, 2)]
    late, old = g.expire(9 + jobs.RETENTION)
    assert not len(late) and sorted(old["id"]) == ["a", "b"] and list(g.ids) == ["c"] and list(g.at) == [2, 3]


def test_a_stage_after_the_last_end_moves_no_clock(spark, tmp_path):
    import duckdb

    from asofline.plans import casebook, catalog

    rows = [(1, 60 * 61, "purchase"), (2, 52 * 60, "click"), (3, 52 * 60 + 0.5, "view"), (4, 51 * 60 + 60, "error"), (5, -8 * 60 + 0.5, "click"), (6, -8 * 60, "click")]
    times = [(k, T0 + dt.timedelta(seconds=s), 1, kind, 1.0, "") for k, s, kind in rows]
    spark.createDataFrame(times, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (tmp_path / "sf").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "sf" / "events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/sf/events.parquet'")
    want = sorted(db.sql(catalog.SQL["k10_job_stream"]).fetchall())
    got = sorted(tuple(r) for r in casebook.k10_job_stream(spark, f"{tmp_path}/sf").select("id", "status", "created", "updated", "n_stages").collect())
    assert got == want and dict((r[0], r[1]) for r in got)["5"] == "running" and dict((r[0], r[1]) for r in got)["6"] == "timeout"
