import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle_check import spark_session

    session = spark_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
