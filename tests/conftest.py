import pytest

from siteferry.session import session


@pytest.fixture(scope="session")
def spark():
    made = session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
