"""Every query of the catalog engine against its SQL."""

import pytest

from tests.conftest import SF, rows, sql_rows
from skyloom.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df, columns)
    if name in ORACLE:
        assert got == sql_rows(duck, ORACLE[name], columns)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "user_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
