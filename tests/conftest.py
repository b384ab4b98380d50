import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowsift.session import local_session

    return local_session(8, "flowsift-tests", memory="8g", shared=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
