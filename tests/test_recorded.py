"""Slices of recorded answers: pages, caps, failures, and what isn't opened."""

import datetime as dt
import json
import pathlib

from asofline.sources import recorded

D = dt.date(2026, 6, 8)


def day(k):
    return D - dt.timedelta(k)


def body(*urls, when="20260601T000000Z"):
    return json.dumps({"articles": [{"url": u, "title": u.upper(), "seendate": when} for u in urls]})


def test_slices_fail_by_themselves_and_pruned_days_are_never_opened(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = [("X", day(0), 0, body("a", "b")), ("X", day(0), 1, body("c", " A ")), ("X", day(1), 0, body("d")), ("X", day(1), 1, "{broken"), ("X", day(2), 0, body()), ("Y", day(0), 0, body("y")), ("Z", day(0), 0, "{broken"), ("X", day(3), 0, body("late", when="20260609T000000Z")), ("X", day(9), 0, body("old"))]
    recorded.record(spark.createDataFrame(rows, "symbol string, day date, page int, body string"), path)
    for f in pathlib.Path(path, f"day={day(9)}").glob("*.parquet"):
        f.write_bytes(b"not parquet at all")  # whoever opens it fails
    articles, status = recorded.traversed(spark, f"file://{path}", recorded.KEYWORDS, ["X", "Y", "W", "X"], str(D), 7)
    told = {(r.symbol, r.day): (r.status, r.n_articles) for r in status.collect()}
    assert len(told) == 3 * 8
    assert [told["X", day(k)] for k in range(5)] == [("ok", 4), ("failed", 0), ("empty", 0), ("ok", 0), ("missing", 0)]
    assert told["Y", day(0)] == ("ok", 1) and {v for (s, _), v in told.items() if s == "W"} == {("missing", 0)}
    assert sorted((r.symbol, r.title) for r in articles.collect()) == [("X", "A"), ("X", "B"), ("X", "C"), ("Y", "Y")]
    plan = articles._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [In(symbol" in plan


def test_a_slice_is_capped_across_its_pages(spark, tmp_path):
    path = f"file://{tmp_path}/answers"
    rows = [("X", D, p, body(*(f"u{p:02}{k}" for k in range(9)))) for p in range(4)]
    recorded.record(spark.createDataFrame(rows, "symbol string, day date, page int, body string"), path)
    articles, status = recorded.traversed(spark, path, recorded.KEYWORDS, ["X"], str(D), 0)
    assert status.first().n_articles == 20
    assert {r.url for r in articles.collect()} == {f"u{p:02}{k}" for p in range(4) for k in range(9) if 9 * p + k < 20}
