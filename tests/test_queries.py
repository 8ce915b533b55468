import pytest

import __spark_entry__ as entry


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


NAMES = sorted(n for n in entry.plans.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_sql_gives(spark, small, duck, name):
    got = entry.queries()[name](spark, small).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
