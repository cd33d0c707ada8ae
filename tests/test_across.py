"""Pairs of clusters against a plain version, and the answers of asked symbols."""

import datetime as dt

import numpy as np
import pytest
from test_threads import plain_linkage

from asofline.operators import across, snapshot
from asofline.plans import reports
from asofline.sources import tables as T

T0 = dt.datetime(2026, 6, 1)
DOCS = "symbol string, id string, title string, description string, url string, published_at timestamp, vector array<double>"


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def plain(docs, a, b, link, near):
    """(duplicates, pairs as (similarity, mean, a's ids, b's ids, a's cohesion, b's cohesion, a's title)) by loops."""
    sides = []
    for s in (a, b):
        mine = sorted((d for d in docs if d["symbol"] == s), key=lambda d: (-d["published_at"].timestamp(), d["id"]))[:30]
        v = [np.array(d["vector"], float) for d in mine]
        if not mine:
            return 0, []
        found, _, _ = merged(v, link)
        sides.append((mine, v, sorted(found, key=len, reverse=True)))
    (da, va, ca), (db, vb, cb) = sides
    inside = lambda v, c: round(float(np.mean([cos(v[x], v[y]) for k, x in enumerate(c) for y in c[k + 1 :]])), 3) if len(c) > 1 else None
    twice, pairs = 0, []
    for x in ca:
        for y in cb:
            all_ = [cos(va[i], vb[j]) for i in x for j in y if da[i]["id"] != db[j]["id"]]
            if not all_:
                continue
            best = max([0.0, *all_])
            if best >= 0.999:
                twice += 1
            elif best >= near:
                title = max((da[i]["title"] or "" for i in x), key=len)
                pairs.append((round(best, 3), round(sum(all_) / len(all_), 3), [da[i]["id"] for i in x], [db[j]["id"] for j in y], inside(va, x), inside(vb, y), title))
    return twice, sorted(pairs, key=lambda p: -p[0])[:10]


def merged(v, link):
    """Clusters with their members in the order of merging; plain_linkage tells which merges are made."""
    clusters = [[k] for k in range(len(v))]
    _, log, _ = plain_linkage(v, link)
    for _, i, j in log:
        x, y = next(c for c in clusters if c[0] == i), next(c for c in clusters if c[0] == j)
        x += y
        clusters.remove(y)
    return clusters, log, None


def told(row):
    return [(p.similarity, p.mean, [m.id for m in p.a_members], [m.id for m in p.b_members], p.a_cohesion, p.b_cohesion, p.a_title) for p in row.pairs]


def check(spark, docs, asked, link, near):
    got = across.near_clusters(spark.createDataFrame([tuple(d[c] for c in ("symbol", "id", "title", "description", "url", "published_at", "vector")) for d in docs], DOCS), spark.createDataFrame(asked, "request string, a string, b string"), link, near).collect()
    assert sorted(r.request for r in got) == sorted(a[0] for a in asked)
    for request, a, b in asked:
        row = next(r for r in got if r.request == request)
        twice, pairs = plain(docs, a, b, link, near)
        assert row.duplicates == twice
        for x, y in zip(told(row), pairs, strict=True):
            assert x[2:4] == y[2:4] and x[6] == y[6]
            assert [x[k] for k in (0, 1, 4, 5)] == pytest.approx([y[k] for k in (0, 1, 4, 5)], abs=1.1e-3)


def test_cluster_pairs_equal_the_plain_version(spark):
    r = np.random.default_rng(5)
    docs = [{"symbol": s, "id": f"{s}{k:02d}", "title": "t" * int(r.integers(9)) if k % 7 else None, "description": "alpha beta gamma", "url": None, "published_at": T0 - dt.timedelta(hours=int(r.integers(500))), "vector": r.normal(size=4).tolist()} for s in "ABC" for k in range(34)]
    docs.append({**docs[3], "symbol": "B", "published_at": T0 + dt.timedelta(hours=1)})  # one article of both
    docs.append({**docs[5], "symbol": "C", "id": "C-copy", "published_at": T0 + dt.timedelta(hours=2)})  # the same content again
    docs.append({**docs[9], "id": "A-zero", "vector": [0.0] * 4, "published_at": T0 + dt.timedelta(hours=3)})
    check(spark, docs, [("ab", "A", "B"), ("ac", "A", "C"), ("bc", "B", "C"), ("none", "A", "Z")], 0.75, 0.70)


def test_one_symbol_twice_has_no_pairs(spark):
    docs = spark.createDataFrame([("A", "1", "t", "d", "u", T0, [1.0, 0.0])], DOCS)
    assert [(r.duplicates, r.pairs) for r in across.near_clusters(docs, spark.createDataFrame([("x", "A", "A")], "request string, a string, b string")).collect()] == [(0, [])]


def test_cluster_pairs_of_the_sample(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in reports.clustered_articles(spark, sf).collect()]
    symbols = sorted({r.symbol for r in T.companies(spark, sf).collect()})
    check(spark, docs, [(f"{a}|{b}", a, b) for a, b in zip(symbols, symbols[1:])][:6], reports.LINK, reports.NEAR)


def test_sector_rows_say_why_they_are_empty(spark):
    asked = spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string")
    companies = spark.createDataFrame([("A", "Aa"), ("B", "Bb")], "symbol string, name string")
    peaks = spark.createDataFrame([("A", dt.date(2026, 1, 2), 1.5), ("A", dt.date(2026, 1, 1), 2.5), ("Q", dt.date(2026, 1, 1), 2.5)], "symbol string, peak date, score double")
    rows = {r.symbol: r for r in snapshot.sector_rows(asked, companies, peaks).collect()}
    assert [p.score for p in rows["A"].peaks] == [2.5, 1.5] and rows["A"].reason is None
    assert rows["B"].peaks == [] and rows["B"].reason.startswith("B returned no key moves") and rows["Z"].reason.startswith("Z is not a known symbol")


def test_messages_are_of_asked_sections(spark):
    rows = spark.sql("select 'A' symbol, array() prices, array() filings, cast(null as date) as_of_date, 0 n_news, array('prices') failed")
    say = lambda asked: snapshot.messages(rows, snapshot.F.lit("2026-03-01").cast("date"), "GDELT", asked).first().warnings
    assert [len(say(a)) for a in (None, "news", "outcome", "prices,filings")] == [4, 2, 1, 3]
    assert say("prices")[0] == "Historical market data is not available for A on March 1, 2026. Try a nearby date."
