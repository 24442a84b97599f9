import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from airgrid.plans.views import Tables  # noqa: E402
from airgrid.session import build_session, prepare  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(params=["one range", "many ranges"])
def ranges(request, spark):
    """Small tables fit in one key range; without coalescing they are cut into several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "one range").lower())
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
