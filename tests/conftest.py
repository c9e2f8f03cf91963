import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return entry.local_session(8, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf():
    return SF
