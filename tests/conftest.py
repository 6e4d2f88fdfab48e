import pytest

from dyadspark import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
