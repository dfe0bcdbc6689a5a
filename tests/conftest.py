import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", partitions=4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
