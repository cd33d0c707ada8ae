import pytest
from sqlcheck import ordered, rows_of_sql

from asofline.plans import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert got.count() > 0  # held against a plain version elsewhere
        return
    cols, rows = ordered(got.toPandas())
    expected_cols, expected = ordered(rows_of_sql(catalog.SQL[name], SF))
    if not rows and not expected:  # the smallest tables hold none
        cols, rows = ordered(catalog.QUERIES[name](spark, LARGER).toPandas())
        expected_cols, expected = ordered(rows_of_sql(catalog.SQL[name], LARGER))
    assert rows, "nothing is compared with nothing"
    assert cols == expected_cols
    assert rows == expected


def test_every_kind_of_resemblance_is_there(spark):
    rows = catalog.QUERIES["l5_resemblance"](spark, LARGER).collect()
    assert {r.kind for r in rows} == {"strong", "pattern", "narrative"}
    assert all(r.rank <= 5 for r in rows)


def test_signals_are_told_without_hindsight(spark):
    rows = catalog.QUERIES["h21_signals"](spark, LARGER).collect()
    assert rows and all(r.n_after <= r.n_supporters for r in rows) and any(r.n_after for r in rows)
    assert all(r.median is None for r in rows if not r.n_after)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
