"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    run = entry.queries()[name]
    if name in ORACLE:
        assert difference(spark, database, run, ORACLE[name], SF) is None
    else:
        assert run(spark, SF).count() >= 1


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["user_id", "behavior_type", "behavior_count"]
