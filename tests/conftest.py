from pathlib import Path

import pytest

from quillspark.runtime import local_session

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)
