"""Neighbours by pivots against all pairs."""

import numpy as np
import pytest

from asofline.operators import pivots


def clustered(n, seed=1, width=16, centres=30, spread=0.15):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    return c[r.integers(0, centres, n)] + spread * r.normal(size=(n, width))


def table(spark, v, key="id", first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in row]) for k, row in enumerate(v)], f"{key} long, vector array<double>")


def all_pairs(a, b, least, first=0):
    s = pivots.unit(a) @ pivots.unit(b).T
    return {(first + i, j): s[i, j] for i, j in zip(*np.nonzero(s >= least)) if first + i != j}


@pytest.mark.parametrize("least", [0.9, 0.3])
@pytest.mark.parametrize("block", [2000, 7])
def test_pairs_equal_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(pivots, "CELL", 20)
    monkeypatch.setattr(pivots, "BLOCK", block)
    v = clustered(300)
    v[5] = v[6] = v[7]
    v[9] = 0
    df = table(spark, v)
    got = {(r.q, r.id): r.similarity for r in pivots.near_pairs(df.withColumnRenamed("id", "q").where("q % 3 = 0"), df, least).collect()}
    want = {k: s for k, s in all_pairs(v, v, least).items() if k[0] % 3 == 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and got


def test_far_cells_are_never_compared(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 20)
    df = table(spark, clustered(600, spread=0.05))
    c = pivots.cells(df, pivots.pivots_of(df))
    assert pivots.compared(c, c, pivots.meeting(c, c, 0.9)) < 600 * 600 / 5
    assert pivots.compared(c, c, pivots.meeting(c, c, -1.0)) == 600 * 600


def test_nearest_other_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 15)
    monkeypatch.setattr(pivots, "BLOCK", 9)
    v = clustered(200, 3)
    s = pivots.unit(v) @ pivots.unit(v).T
    np.fill_diagonal(s, -2)
    got = {r.q: r.similarity for r in pivots.nearest_other(table(spark, v)).collect()}
    assert len(got) == 200 and all(abs(got[k] - s[k].max()) < 1e-9 for k in got)


def test_vectors_of_different_lengths_and_none(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0]), (3, None), (4, [0.0, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.q, r.id) for r in pivots.near_pairs(df.withColumnRenamed("id", "q"), df, 0.5).collect()}
    assert got == {(1, 2), (2, 1)}
    none = df.where("false")
    assert pivots.near_pairs(none.withColumnRenamed("id", "q"), none, 0.5).count() == 0 and pivots.nearest_other(none).count() == 0
    assert pivots.nearest_other(df.where("id = 1")).count() == 0


@pytest.mark.parametrize("pack", [(4000, 30_000), (9, 40)])
def test_best_of_groups_and_nearest_equal_all_pairs(spark, monkeypatch, pack):
    monkeypatch.setattr(pivots, "CELL", 20)
    monkeypatch.setattr(pivots, "LEAST_PACK", pack[0])
    monkeypatch.setattr(pivots, "PACK", pack[1])
    v = clustered(300, 5)
    v[5] = v[6] = v[7]
    v[9] = 0
    r = np.random.default_rng(2)
    asks, holds = ([sorted({f"{x}{k}" for k in r.integers(0, 12, r.integers(1, 4))}) for _ in v] for x in "qc")
    df = table(spark, v).withColumnRenamed("id", "n")
    named = lambda of: df.join(spark.createDataFrame(list(enumerate(of)), "n long, of array<string>"), "n").selectExpr("cast(n as string) as id", "vector", "of")
    s = np.round(pivots.unit(v) @ pivots.unit(v).T, 9)
    np.fill_diagonal(s, -2)
    want = {}
    for i, j in zip(*np.nonzero(s >= 0.6)):
        for q in asks[i]:
            for c in holds[j]:
                want[q, c] = max(want.get((q, c), -2), s[i, j])
    assert {(x.q, x.case_id): x.similarity for x in pivots.best_of_groups(named(asks), named(holds), 0.6).collect()} == pytest.approx(want, abs=2e-9)
    ids = named(asks).select("id", "vector")
    got = {}
    for x in pivots.nearest(ids.withColumnRenamed("id", "q"), ids, 0.6, 4).collect():
        got.setdefault(int(x.q), []).append((-x.similarity, x.id))
    want = {i: sorted((-s[i, j], str(j)) for j in np.flatnonzero(s[i] >= 0.6))[:4] for i in range(300)}
    assert {i: sorted(x for _, x in got[i]) for i in got} == {i: sorted(x for _, x in w) for i, w in want.items() if w}
    none = named(asks).where("false")
    assert pivots.best_of_groups(none, none, 0.6).count() == 0 and pivots.nearest(none.selectExpr("id as q", "vector"), none, 0.6, 4).count() == 0


def test_a_vector_is_exchanged_once_for_each_pack(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 10)
    df = table(spark, np.random.default_rng(4).normal(size=(600, 16)))
    seen = []
    met = pivots._met
    monkeypatch.setattr(pivots, "_met", lambda q, r, *a: (seen.append((len(q.sizes), {p for x in pivots._packs(q).values() for p in x})), met(q, r, *a))[1])
    assert pivots.nearest(df.withColumnRenamed("id", "q"), df, 0.3, 3).count() > 0
    assert seen[0][0] > 40 and len(seen[0][1]) == 1  # many cells, one pack


@pytest.mark.parametrize("n", [600_000, 60_000])
def test_packs_of_a_side_stay_few(n):
    width = 192
    c = pivots.Cells(None, {}, dict.fromkeys(range(width), n // width), {k: np.full(1, k / width) for k in range(width)}, {})
    packs = pivots._packs(c)
    assert len({p for x in packs.values() for p in x}) <= 6
    assert max(sum(n // width / len(x) for x in packs.values() if p in x) for p in {p for x in packs.values() for p in x}) <= pivots.PACK


def test_vectors_are_exchanged_as_they_came(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 20)
    v = clustered(120, 6).astype(np.float32)
    df = table(spark, v).selectExpr("cast(id as string) as id", "cast(vector as array<float>) as vector", "array(cast(id % 7 as string)) as of")
    c = pivots.cells(df, pivots.pivots_of(df), more=("of",))
    assert c.rows.schema["vector"].dataType.simpleString() == "array<float>"
    want = {}
    for (i, j), s in all_pairs(v.astype(np.float64), v.astype(np.float64), 0.5).items():
        want[str(i % 7), str(j % 7)] = max(want.get((str(i % 7), str(j % 7)), -2), round(s, 9))
    monkeypatch.setattr(pivots, "COSINES", 50, raising=False)  # rows of a tile are fewer, not the columns
    assert {(x.q, x.case_id): x.similarity for x in pivots.best_of_groups(df, df, 0.5).collect()} == pytest.approx(want, abs=2e-9)


def test_queries_may_be_longer_than_all_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(7, [3.0, 0.0, 4.0])], "q long, vector array<double>")
    got = [(r.q, r.id, r.similarity) for r in pivots.near_pairs(queries, rows, 0.5).collect()]
    assert got == [(7, 1, pytest.approx(0.6))]
