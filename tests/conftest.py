import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from backuplake.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Sorted tuples of a DataFrame."""

    def collect(df, *cols):
        out = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))

    return collect
