import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vocale.session import build_session

    # Python workers must find the package wherever the tests are started.
    os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
    session = build_session("vocale-tests", 8, "6g", partitions=2, shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
