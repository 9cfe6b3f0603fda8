import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", **{"spark.checkpoint.dir": str(shared), "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def shared(spark):
    """A function that names a fresh folder."""
    from marginalia.storage import run_dir

    return lambda label: run_dir(spark, label)
