import pytest

from placewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
