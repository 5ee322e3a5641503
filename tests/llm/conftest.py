import pytest

from tests.llm.fixtures import write_tables


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of small tables with awkward rows, ids given once."""
    return write_tables(spark, str(tmp_path_factory.mktemp("small")))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The same tables without rows."""
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), rows=False)
