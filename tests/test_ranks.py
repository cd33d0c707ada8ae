"""Order statistics of growing prefixes, and the aftermath of supporters, against plain versions."""

import datetime as dt
import random
import statistics

import pytest

from asofline.operators import cases, ranks

DAY = dt.date(2026, 6, 5)


def plain(rows, asked):
    out = set()
    for key, at, k in asked:
        found = sorted(v for kk, a, v in rows if kk == key and a is not None and v is not None and a <= at)
        if 0 <= k < len(found):
            out.add((key, at, k, found[k]))
    return out


@pytest.mark.parametrize("few, ranges", [(20_000, 64), (3, 2), (10, 5)])
def test_order_statistics(spark, monkeypatch, few, ranges):
    """Answered at once, and down a tree of small ranges, with ties, a commonest value and days without rows."""
    monkeypatch.setattr(ranks, "FEW_ROWS", few)
    monkeypatch.setattr(ranks, "RANGES", ranges)
    r = random.Random(few)
    day = lambda: DAY + dt.timedelta(r.randrange(12))
    rows = [(r.choice("ab"), day(), float(r.randrange(30) if r.random() < 0.5 else 29)) for _ in range(400)] + [("c", DAY, 1.0)] * 50 + [("d", None, 1.0), ("d", DAY, None)]
    asked = [(r.choice("abcde"), day(), r.randrange(-2, 260)) for _ in range(200)]
    got = ranks.order_statistics(spark.createDataFrame(rows, "key string, at date, value double"), spark.createDataFrame(asked, "key string, at date, k long"))
    assert {tuple(x) for x in got.select("key", "at", "k", "value").collect()} == plain(rows, asked)


SCHEMA = "case_id string, symbol string, peak date, fired array<string>, reaction array<struct<day: date, close: double>>"


def row(name, day, *closes, fired=("s",)):
    return name, "NFLX", DAY + dt.timedelta(day), list(fired), [(DAY + dt.timedelta(day + k), c) for k, c in enumerate(closes, 1)]


def test_aftermath_of_supporters_alone(spark):
    """The case itself, later peaks and cases without the signal don't count; a peak of the same day does; a case without closes supports without a move."""
    rows = [row("SELF", 0, 100.0, 150.0), row("SAME", 0, 100.0, 110.0), row("FUTURE", 1, 100.0, 900.0), row("PAST", -30, 100.0, 120.0), row("MORE", -31, 200.0, 190.0), row("QUIET", -30, 100.0, 700.0, fired=()), row("BARE", -30), row("ONE", -29, 7.0), row("ZERO", -28, 0.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: (r.n, r.median, r.high, r.low) for r in cases.aftermath(df).collect()}
    assert got["SELF"] == (3, 10.0, 20.0, -5.0)
    assert got["SAME"] == (3, 20.0, 50.0, -5.0)
    assert got["MORE"] == (0, None, None, None)
    assert got["PAST"] == (1, -5.0, -5.0, -5.0)
    assert got["BARE"] == (2, 7.5, 20.0, -5.0)
    assert "QUIET" not in got
    supporters = {r.case_id: r.n_supporters for r in cases.supporters(df).collect()}
    assert all(n <= supporters[c] for c, (n, *_) in got.items())


def test_aftermath_equals_the_plain_one(spark):
    r = random.Random(5)
    rows = [row(f"C{k}", r.randrange(9), *[float(r.randrange(1, 6)) for _ in range(r.randrange(4))], fired=r.sample(["s", "t", "u"], r.randrange(3))) for k in range(120)]
    got = {(x.case_id, x.signal): (x.n, x.median, x.high, x.low) for x in cases.aftermath(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == sum(len(x[3]) for x in rows)
    move = lambda x: (x[4][-1][1] - x[4][0][1]) / x[4][0][1] * 100 if len(x[4]) >= 2 else None
    for x in rows:
        for s in x[3]:
            m = [move(y) for y in rows if s in y[3] and y[2] <= x[2] and y[0] != x[0] and move(y) is not None]
            expected = (len(m), statistics.median(m), max(m), min(m)) if m else (0, None, None, None)
            assert got[x[0], s] == pytest.approx(expected, abs=0.0051), (x, s)
