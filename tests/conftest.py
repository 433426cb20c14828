import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from wayspark.session import build_session, ship_code
    session = build_session("wayspark-tests", os.environ.get("TEST_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session)
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Every group counts as hot, so the chunked way runs."""
    from wayspark.functions.ordered import HOT_SETTING
    spark.conf.set(HOT_SETTING, "1")
    yield
    spark.conf.unset(HOT_SETTING)
