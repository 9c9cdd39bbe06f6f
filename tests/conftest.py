import pytest

from inkwell.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
