import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slabspark.operators.hot import HOT_ROWS_CONF  # noqa: E402
from slabspark.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", master="local[8]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false",
                        spark_driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def hot(spark):
    """Treat every group of more than five rows as hot, with several real slices."""
    spark.conf.set(HOT_ROWS_CONF, "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
