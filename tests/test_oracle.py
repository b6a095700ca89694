"""Every registered query against its SQL on the smallest tables."""

import pytest

from slabspark.registry import ORACLE, QUERIES
from tests.oracle import connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = rows_of_spark(QUERIES[name](spark, sf))
    if name in ORACLE:
        assert got == rows_of_sql(con, ORACLE[name])
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["population_stat", "fresh_prices", "latency_percentiles", "outlier_fraction", "track_lock",
                                  "two_sided_thresholds", "triplets"])
def test_query_with_every_group_hot(spark, sf, con, hot, name):
    assert rows_of_spark(QUERIES[name](spark, sf)) == rows_of_sql(con, ORACLE[name])
